"""Token counts from an exact length histogram.

Every document is encoded once; documents are then counted by encoded length.
The histogram answers every question about lengths: suffix sums give the
documents and tokens at or beyond each length, hence totals, quantiles and the
tokens left after truncation to any context limit.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Lengths in one running-total group: groups are summed first, then lengths inside.
GROUP_LENGTHS = 4096
#: Runs of white space from this length on are cut out of the text; the pattern's
#: look-ahead would otherwise run out of stack in runs of about a million.
LONG_RUN = 10_000
#: What ``\s`` matches (Unicode's White_Space).
WHITE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class TokenCounter:
    """Number of tokens of a text.

    A long run of white space is one piece under ``\\s+(?!\\S)``, but for its last
    character, which goes with what follows; so the text is cut around it and
    the parts are summed.  Probes tell whether the pattern treats runs that way;
    if it doesn't, texts are encoded in one go.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, long_run: int = LONG_RUN):
        import tiktoken

        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.runs = re.compile(f"{WHITE}{{2,}}").finditer
        probes = [f"{a}{run}{b}" for a in ("", "x", "1", "'s", "?") for run in ("   ", "\n\n", " \n\t", "\u3000\xa0 ") for b in ("", "x", "1", "'s", "?")]
        safe = all(self.in_parts(p) == self.in_one(p) for p in probes)
        self.runs = re.compile(f"{WHITE}{{{long_run},}}").finditer
        self.count = self.in_parts if safe else self.in_one

    def in_one(self, text: str) -> int:
        return len(self.model.encode_ordinary(text))

    def in_parts(self, text: str) -> int:
        total = at = 0
        for run in self.runs(text):
            start, end = run.span()
            end -= end < len(text)
            total += self.in_one(text[at:start]) + len(self.model._encode_single_piece(text[start:end].encode()))
            at = end
        return total + self.in_one(text[at:] if at else text)


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``n_tokens`` (long) per row, with the columns in ``keep``.

    Null and empty texts have 0 tokens; texts of any length are encoded whole,
    white space of any length included; repeated rows and ties count each;
    an empty table gives no rows.  Columns not in ``keep`` are ignored;
    ``keep`` may not name ``n_tokens``.
    """
    if "n_tokens" in keep:
        raise ValueError("n_tokens is the result's own column")
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, fixed in size
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("n_tokens"))
    schema = rows.drop("n_tokens").schema.add("n_tokens", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(shared.value, pattern).count
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(work, schema)


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents by encoded length with suffix sums, from rows ``n_tokens`` (and ``by``).

    One row a length that occurs: ``n_tokens, n_docs, docs_at_least,
    tokens_at_least`` (documents of this length or longer, and their tokens),
    ``truncated_total`` (tokens of all documents when each is cut to this
    length), ``docs_total, tokens_total`` and ``quantile`` (share of documents
    no longer than this).  Sums run in two levels, groups of lengths and lengths
    inside a group.  Rows without a length are left out, as they have none;
    equal lengths are one row, repeated rows count each, a null in ``by`` is a
    value of its own, columns beside these are ignored, and an empty table gives
    no rows.  ``by`` may not name a column of the result.
    """
    by = list(by)
    counts = cut(lengths.where(F.col("n_tokens").isNotNull()).groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    grouped = counts.withColumn("grp", F.floor(F.col("n_tokens") / GROUP_LENGTHS)).withColumn("n_tok", F.col("n_tokens") * F.col("n_docs"))
    above = Window.partitionBy(*by).orderBy(F.col("grp").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    groups = (
        grouped.groupBy(*by, "grp")
        .agg(F.sum("n_docs").alias("d"), F.sum("n_tok").alias("t"))
        .select(
            *by,
            "grp",
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(every).alias("docs_total"),
            F.sum("t").over(every).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy(*by, "grp").orderBy(F.col("n_tokens").desc())
    at_least = lambda column, more: (F.sum(column).over(inside) + F.col(more)).cast("long")
    same = [grouped[c].eqNullSafe(groups[c]) for c in (*by, "grp")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = grouped.join(groups, condition).drop(*[groups[c] for c in (*by, "grp")])
    return joined.select(
        *by,
        F.col("n_tokens").cast("long").alias("n_tokens"),
        "n_docs",
        at_least("n_docs", "docs_above").alias("docs_at_least"),
        at_least("n_tok", "tokens_above").alias("tokens_at_least"),
        F.col("docs_total").cast("long").alias("docs_total"),
        F.col("tokens_total").cast("long").alias("tokens_total"),
    ).select(
        "*",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row ``context_limit, tokens``: all tokens when documents are cut to ``limit`` (0 without rows)."""
    return histogram.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).cast("long").alias("tokens"),
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row ``q, n_tokens``: the smallest length that a share ``q`` of documents doesn't pass (null without rows)."""
    return histogram.where(F.col("quantile") >= q).agg(F.lit(float(q)).alias("q"), F.min("n_tokens").alias("n_tokens"))
