"""Mixing sources to target weights.

Words per source are summed; a water level shares the wanted total by weight
while no source goes past its cap; each source's repetition rate is its target
over its size.  A document is emitted floor(rate) times, plus once more if a
seeded hash of it falls under the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DRAWS, cut, drawn, join_small, null_safe_key, word_count


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Targets per source from rows ``source, stratum, source_size`` (one a source).

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``total_share`` of all sizes; no target passes ``cap`` times its source's
    size and what is cut off goes to the others by weight.  The sources sorted
    by cap/weight fill up in that order, so the level follows from one running
    sum: it is (total - caps before) / (weights from here on) at the first
    source that this level doesn't fill.  The windows run over one row a source.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", "place")
    level = F.min(F.when(F.col("ratio") > F.col("level_here"), F.struct("filled", "level_here"))).over(
        Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("filled", F.row_number().over(fill))
        .withColumn("caps_before", F.sum("most").over(fill) - F.col("most"))
        .withColumn("weights_on", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
        .withColumn("level_here", (F.col("wanted") - F.col("caps_before")) / F.col("weights_on"))
        .withColumn("level", level["level_here"])
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "stratum", "source_size", "weight", "target", "rate")
    )


#: Seeds tried for a source; the one whose draw comes nearest the target is kept.
SEEDS = 16


def _draw_of(id_col: str, text_col: str) -> Column:
    """What a document's draws hang on: its id and text, so repeated rows share them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text))


def _copies(pick: Column, seed: int) -> Column:
    """floor(rate) copies, and one more if the draw for seed ``pick`` falls under the fraction."""
    whole = F.floor("rate")
    return (whole + (drawn(seed, pick, F.col("h")) / F.lit(DRAWS) < F.col("rate") - whole).cast("int")).cast("int")


def _rates(thin: DataFrame, weights: Sequence[float], total_share: float, cap: float, seed: int) -> DataFrame:
    """One row a source: ``stratum, source_size, target, rate, pick`` (cut).

    Each of the ``SEEDS`` seeds is a fair draw; small sources would still stray
    from their target by some percent, so each source takes the seed whose
    words taken come nearest it.
    """
    sizes = thin.groupBy("stratum").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, total_share, cap).drop("source"))
    tried = (
        join_small(thin, targets.select("stratum", "rate"), "stratum")
        .groupBy("stratum")
        .agg(*[F.sum(F.col("size") * _copies(F.lit(k), seed)).alias(f"taken_{k}") for k in range(SEEDS)])
    )
    misses = F.array(*[F.struct(F.abs(F.col(f"taken_{k}") - F.col("target")).alias("miss"), F.lit(k).alias("k")) for k in range(SEEDS)])
    return cut(targets.join(tried, "stratum").withColumn("pick", F.array_min(misses)["k"]).select("stratum", "source_size", "target", "rate", "pick"))


def _thin(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        null_safe_key(source_col).alias("stratum"),
        word_count(F.col(text_col).cast("string")).alias("size"),
        _draw_of(id_col, text_col).alias("h"),
    )


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken, copies, source``.

    Null texts and texts without words have size 0 and are taken with 0 words.
    Null sources form one source, last in order.  Equal rows (same id and text)
    share one draw, so reruns and repeated rows agree.  A source of size 0 has
    target 0.  An empty table gives an empty result; extra columns are ignored.
    """
    thin = cut(_thin(docs, id_col, text_col, source_col))
    rates = _rates(thin, weights, total_share, cap, seed)
    return (
        join_small(thin, rates, "stratum")
        .withColumn("copies", _copies(F.col("pick"), seed))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    total_share: float = 1.5,
    cap: float = 2.0,
    seed: int = 29,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus itself: rows of ``docs``, each as often as the plan takes it.

    Texts are not shuffled: the rates of the sources come to the documents.
    Same rules for nulls, ties and repeated rows as :func:`plan_mix`.
    """
    thin = cut(_thin(docs, id_col, text_col, source_col).drop("doc_id"))
    rates = _rates(thin, weights, total_share, cap, seed).select("stratum", "rate", "pick")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), null_safe_key(source_col).alias("stratum"), _draw_of(id_col, text_col).alias("h")
    )
    taken = join_small(whole, rates, "stratum").withColumn("copies", _copies(F.col("pick"), seed)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
