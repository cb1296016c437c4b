"""Sharding by proportional stratified interleaving.

Rows of each source are put into a seeded random order and get the fractional
rank ``(rank - u) / n`` (``u`` in (0, 1) depends on the source, so that many
one-row sources spread out too).  Sorting all rows by that fraction interleaves
the sources in proportion; equal cuts of the order are the shards, so each has
the mixture of the whole and row counts differ by one at most.

Ranks are counted in hash ranges: a source's rows fall into about sqrt(N)
ranges, ranges are counted first (with map-side partial counts), running totals
give each range its offset, and rows are only sorted inside a range.  No task
sees a whole source, however large it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DRAWS, cut, drawn, null_safe_key


def _range_of(h: Column, n: int) -> Column:
    """0..n-1, growing with the draw ``h``."""
    return F.floor(h.cast("double") / F.lit(DRAWS) * F.lit(float(n))).cast("long")


def shard_by_mixture(
    docs: DataFrame,
    n_shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Return ``id_col, size, text_crc32, law, shard, slot, grown_shard, source``.

    ``size`` is the UTF-8 length of the text plus 1.  The law is ``rows``:
    counts of any two shards differ by one at most.  ``slot`` numbers a shard's
    rows from 0 without gaps.  ``grown_shard`` is null, as this law moves rows
    when the number of shards changes.

    Null texts have size 1 and CRC 0; a null source is a stratum of its own;
    repeated rows each get a slot; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        null_safe_key(source_col).alias("stratum"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        drawn(seed, F.col(id_col)).alias("h"),
    )
    total = docs.count()
    n = max(1, total)
    ranges = math.ceil(math.sqrt(n))
    order = ["h", "doc_id", "size", "text_crc32"]

    # rank inside the source
    ranged = rows.withColumn("part", _range_of(F.col("h"), ranges))
    by_source = Window.partitionBy("stratum")
    counted = (
        docs.select(null_safe_key(source_col).alias("stratum"), _range_of(drawn(seed, F.col(id_col)), ranges).alias("part"))
        .groupBy("stratum", "part")
        .count()
        .withColumn("before", F.sum("count").over(by_source.orderBy("part")) - F.col("count"))
        .withColumn("stratum_rows", F.sum("count").over(by_source))
        .drop("count")
    )
    in_range = Window.partitionBy("stratum", "part").orderBy(*order)
    shift = drawn(seed + 1, F.col("stratum")) / F.lit(DRAWS)
    placed = cut(
        ranged.join(counted, ["stratum", "part"])
        .withColumn("rank", F.col("before") + F.row_number().over(in_range))
        .withColumn("at", (F.col("rank") - shift) / F.col("stratum_rows"))
        .withColumn("piece", F.least(F.floor(F.col("at") * F.lit(float(ranges))), F.lit(ranges - 1)).cast("long"))
        .drop("part", "before", "stratum_rows", "rank")
    )

    # rank in the whole interleaving; the running total is over sqrt(N) counts
    pieces = placed.groupBy("piece").count().withColumn("first", F.sum("count").over(Window.orderBy("piece")) - F.col("count")).drop("count")
    in_piece = Window.partitionBy("piece").orderBy("at", "stratum", *order)
    return (
        placed.join(pieces, "piece")
        .withColumn("position", F.col("first") + F.row_number().over(in_piece) - 1)
        .withColumn("shard", F.expr(f"cast(position * {n_shards}L div {n}L as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"position - (shard * {n}L + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "source",
        )
    )
