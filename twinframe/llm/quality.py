"""Quality rules from cross-document line frequency, in DataFrame functions only.

Base figures come from each text alone.  The method's verdict: lines are
normalised and hashed, distinct documents are counted for every line and host,
lines in more documents than allowed are removed, and documents left with too
little of their words are rejected.  A line may be in ``max_docs`` documents of
its host, or in the share ``max_share`` of the host's documents if that is more,
so a growing host does not turn ever more of its lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_PATTERN, cut, join_small, null_safe_key

#: Words in a window whose repetition inside one text counts.
WINDOW = 8
#: Documents of its host that a line may be in, as a number and as a share of the host's rows.
MAX_DOCS, MAX_SHARE = 10, 0.01
#: Share of its words that a document must keep.
MIN_LEFT = 1 / 3


def base_figures(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Arrays that a lambda looks into are columns of their own, each named at
    least twice in the next step: the optimiser then keeps them apart instead
    of computing them anew for every element.  A window of eight words can only
    be found twice if a run of four is, so most texts stop after hashing runs
    of four.
    """
    half = WINDOW // 2
    step = docs.withColumn("_t", F.coalesce(text, F.lit("")))
    step = step.withColumns(
        {
            "_w": F.array_remove(F.split("_t", f"{SPACE_CLASS}+"), ""),
            "n_symbols": F.coalesce(F.regexp_count("_t", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
            "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_PATTERN)),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_f": F.transform(
                F.slice("_w", F.lit(1), F.greatest(F.size("_w") - (half - 1), F.lit(0))),
                lambda w, i: F.xxhash64(w, *[F.get(F.col("_w"), i + k) for k in range(1, half)]),
            ),
        }
    )
    step = step.withColumn("_maybe", (F.size("_w") >= WINDOW) & (F.size("_f") > F.size(F.array_distinct("_f"))))
    windows = F.zip_with(
        F.slice("_f", F.lit(1), F.greatest(F.size("_f") - half, F.lit(0))), F.slice("_f", F.lit(half + 1), F.greatest(F.size("_f") - half, F.lit(0))), lambda a, b: F.xxhash64(a, b)
    )
    step = step.withColumn("_h", F.when(F.col("_maybe"), windows))
    # sorting (hash, position) puts equal windows side by side
    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_s", F.when(F.size("_h") > F.size(F.array_distinct("_h")), pairs))
    beside = lambda p, k: F.coalesce(F.get(F.col("_s"), k)["h"] == p["h"], F.lit(False))
    tagged = F.transform("_s", lambda p, k: F.when(beside(p, k - 1) | beside(p, k + 1), p["i"]))
    step = step.withColumn("_p", F.array_sort(F.filter(tagged, lambda i: i.isNotNull())))
    # starts of windows in order; the union of their words is summed gap by gap
    gaps = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(gaps, F.lit(0)).cast("long"))
    return step.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).drop(
        "_t", "_w", "_l", "_f", "_maybe", "_h", "_s", "_p"
    )


def plain_line(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(raw, f"{SPACE_CLASS}+", " ")))


def page_key(text_col: str = "text", host_col: str = "source") -> Column:
    return F.xxhash64(null_safe_key(host_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def document_key(id_col: str | None, text_col: str, host_col: str) -> Column:
    """What counts as one document of a host: the id, or host and text where there is none or copies count once."""
    page = page_key(text_col, host_col)
    return page if id_col is None else F.when(F.col(id_col).isNull(), page).otherwise(F.xxhash64(F.col(id_col).cast("string"), F.lit(1)))


def host_lines(docs: DataFrame, id_col: str | None, text_col: str, host_col: str) -> DataFrame:
    """``host, page, doc, line, words`` of every line with a word; ``line`` is the hash of host and normalised line."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(null_safe_key(host_col).alias("host"), page_key(text_col, host_col).alias("page"), document_key(id_col, text_col, host_col).alias("doc"), text.alias("t"))
        .select("host", "page", "doc", F.explode(F.split("t", "\n")).alias("raw"))
        .withColumn("line", plain_line(F.col("raw")))
        .where("line <> ''")
        .select(F.xxhash64("host").alias("host"), "page", "doc", F.xxhash64("host", "line").alias("line"), F.regexp_count("line", F.lit("[^ ]+")).cast("long").alias("words"))
    )


def frequent_lines(lines: DataFrame, docs: DataFrame, host_col: str, max_docs: int, max_share: float) -> DataFrame:
    """``host, line, frequent`` of the lines in more distinct documents than their host allows (cut).

    A host has at most ``1 / max_share`` times the lines of a mean document of them.
    """
    # sums for each line, over one row a document at most, before any limit is looked up
    often = lines.select("host", "line", "doc").distinct().groupBy("host", "line").count().where(F.col("count") > max_docs)
    hosts = cut(docs.groupBy(F.xxhash64(null_safe_key(host_col)).alias("host")).agg(F.count(F.lit(1)).alias("rows")))
    return cut(join_small(often, hosts, "host").where(F.col("count") > F.lit(float(max_share)) * F.col("rows")).select("host", "line", F.lit(True).alias("frequent")))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    max_share: float = MAX_SHARE,
    copies_once: bool = False,
) -> DataFrame:
    """Per document: ``doc_id``, the base figures, ``lost`` and ``kept``.

    ``lost`` is the share of a document's words in frequent lines where that
    leaves less than ``min_left`` of them, else null.  Documents are told apart
    by id (by text where the id is null, or everywhere with ``copies_once``,
    which a near-copy stage after it may want).  Null and empty texts have no
    words, so they fail the base rule.  A null host is a host of its own.
    Repeated rows get equal verdicts and are one document; a line just at its
    limit stays.  Very long texts are taken whole.  An empty table gives an
    empty result; extra columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).alias("source"))
    named = slim.select("doc_id", "text", page_key().alias("page"))
    figures = base_figures(named, F.col("text")).drop("text")
    lines = host_lines(slim, None if copies_once else "doc_id", "text", "source")
    worn = cut(
        join_small(lines, frequent_lines(lines, slim, "source", max_docs, max_share).drop("host"), "line", "left")
        .groupBy("page")
        .agg(F.sum("words").alias("all_words"), F.sum(F.when(F.col("frequent"), F.col("words")).otherwise(0)).alias("gone"))
        .where(F.col("gone") > (1.0 - min_left) * F.col("all_words"))
        .select("page", (F.col("gone") / F.col("all_words")).alias("lost"))
    )
    return join_small(figures, worn, "page", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("lost").isNull()).alias("kept"),
        "lost",
    )


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    max_share: float = MAX_SHARE,
    copies_once: bool = False,
    chars_col: str = "n_chars",
) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, without their frequent lines.

    ``chars_col``, where there is such a column, is the length of the text that
    is left; rows without a frequent line stay as they are.  All cases of
    :func:`quality_rules` hold here too.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).alias("source"))
    # cut before the filter: pushed below, it would compute the figures' arrays many times
    figures = cut(base_figures(slim.select(page_key().alias("page"), "text"), F.col("text")).select("page", "base_failed"))
    bad = cut(figures.where("base_failed").select("page").distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), page_key(text_col, host_col).alias("page"), _host(host_col).alias("host"))
    kept = _marked(join_small(whole, bad, "page", "left_anti"), slim, F.col("doc")[text_col], max_docs, max_share, copies_once)
    kept = kept.where(~F.coalesce(_gone_words("marked") > (1.0 - min_left) * _all_words("marked"), F.lit(False))).withColumn("left", _left("marked"))
    new = {text_col: F.col("left"), chars_col: F.length("left")}
    return kept.select(
        *[
            F.when(F.col("left").isNotNull(), new[c].cast(docs.schema[c].dataType)).otherwise(F.col("doc")[c]).alias(c) if c in new else F.col("doc")[c].alias(c)
            for c in docs.columns
        ]
    )


def _host(host_col: str) -> Column:
    return F.xxhash64(null_safe_key(host_col))


def _marked(rows: DataFrame, slim: DataFrame, text: Column, max_docs: int, max_share: float, copies_once: bool) -> DataFrame:
    """``rows`` (with ``host``) and ``marked``: their lines with ``raw, gone, words``, null where the host has no frequent line.

    The lines of a host come to its documents; texts are not shuffled while they fit a broadcast.
    """
    lines = host_lines(slim, None if copies_once else "doc_id", "text", "source")
    frequent = frequent_lines(lines, slim, "source", max_docs, max_share).groupBy("host").agg(F.collect_list("line").alias("frequent"))
    key = lambda plain: F.xxhash64(F.col("host_key"), plain)
    each = lambda x: F.struct(x.alias("raw"), F.array_contains("frequent", key(plain_line(x))).alias("gone"), F.coalesce(F.regexp_count(x, F.lit(WORD_PATTERN)), F.lit(0)).alias("words"))
    named = slim.select(_host("source").alias("host"), null_safe_key("source").alias("host_key")).distinct()
    hosts = cut(frequent.join(named, "host"))
    return join_small(rows, hosts, "host", "left").withColumn("marked", F.when(F.col("frequent").isNotNull(), F.transform(F.split(text.cast("string"), "\n"), each)))


def _gone_words(marked: str) -> Column:
    return F.aggregate(marked, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["gone"], x["words"]).otherwise(0))


def _all_words(marked: str) -> Column:
    return F.aggregate(marked, F.lit(0).cast("bigint"), lambda a, x: a + x["words"])


def _left(marked: str) -> Column:
    """The text without its frequent lines; null if it has none."""
    return F.when(F.exists(marked, lambda x: x["gone"]), F.array_join(F.transform(F.filter(marked, lambda x: ~x["gone"]), lambda x: x["raw"]), "\n"))


def without_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, copies_once: bool = False
) -> DataFrame:
    """``doc_id, text`` of every row with its frequent lines removed (line order kept).

    Null texts become empty; repeated rows stay repeated; empty tables, long
    texts and clashing columns are as in :func:`quality_rules`.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(host_col).alias("source"))
    rows = _marked(slim.select("doc_id", "text", _host("source").alias("host")), slim, F.col("text"), max_docs, max_share, copies_once)
    return rows.select("doc_id", F.coalesce(_left("marked"), F.col("text")).alias("text"))
