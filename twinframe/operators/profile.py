"""Profiles: one row a column, and the questions that key finding and matching ask."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType, StringType

from ..functions.coerce import as_number, as_time, is_time

# Shapes of text that a column may consist of.
PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "url": r"^https?://\S+$",
    "currency": r"^\s*-?\s*\(?\s*[$£€¥₪₹¢]\s*-?[\d,]+(\.\d+)?\)?\s*$",
    "date": r"^\d{4}-\d{1,2}-\d{1,2}|^\d{1,2}/\d{1,2}/\d{4}",
    "phone": r"^\+?[\d\s().-]{7,20}$",
    "identifier": r"^[A-Za-z]{1,5}[-_#]?\d+$",
}
MOJIBAKE_MARKS = r"Ã.|â€|Â."


def _column(c: str):
    return F.col(f"`{c}`")


def distinct_counts(df: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """``place, distinct``: how many different combinations each group of columns has, nulls among them.

    Each group is an aggregation of its own over its columns alone, so rows are
    not expanded by group and partial results are as small as the distinct values.
    """
    out = None
    for i, group in enumerate(groups):
        one = df.groupBy(*[_column(c) for c in group]).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("distinct")).select(F.lit(i).alias("place"), "distinct")
        out = one if out is None else out.unionByName(one)
    return out


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, data_type, row_count, non_null_count, null_percent, unique_count, cardinality, min_value, max_value.

    One pass when ``exact`` is off (approximate distinct counts); exact distinct
    counts take one aggregation a column beside it.
    """
    names = list(columns or df.columns)
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(names):
        aggs += [F.count(_column(c)).alias(f"n{i}"), F.min(_column(c)).cast("string").alias(f"lo{i}"), F.max(_column(c)).cast("string").alias(f"hi{i}")]
        if not exact:
            aggs.append(F.approx_count_distinct(_column(c)).alias(f"u{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(c).alias("column_name"),
            F.lit(kinds[c]).alias("data_type"),
            F.col("rows").alias("row_count"),
            F.col(f"n{i}").alias("non_null_count"),
            F.col(f"lo{i}").alias("min_value"),
            F.col(f"hi{i}").alias("max_value"),
            *([] if exact else [F.col(f"u{i}").alias("unique_count")]),
        )
        for i, c in enumerate(names)
    ]
    facts = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if exact:
        # a null is no value
        facts = facts.join(distinct_counts(df, [[c] for c in names]), "place").withColumn("unique_count", F.col("distinct") - (F.col("non_null_count") < F.col("row_count")).cast("long"))
    n = F.col("row_count")
    share = lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0))
    return facts.select(
        "column_name",
        "data_type",
        "row_count",
        "non_null_count",
        F.round(100.0 * share(n - F.col("non_null_count")), 2).alias("null_percent"),
        "unique_count",
        F.round(share(F.col("unique_count")), 4).alias("cardinality"),
        "min_value",
        "max_value",
    )


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 3, rows: int = 1000) -> DataFrame:
    """column_name, sample_values: up to ``n`` filled values as text from the first ``rows`` rows, for people to look at."""
    names = list(columns or df.columns)
    some = df.select(*[_column(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)]).limit(rows)
    one = some.agg(*[F.slice(F.collect_list(f"c{i}"), 1, n).alias(f"s{i}") for i in range(len(names))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sample_values")) for i, c in enumerate(names)])))


def save_profile(df: DataFrame, path: str | Path, columns: Sequence[str] | None = None, exact: bool = False) -> dict:
    """The profile with sample values as JSON, by column; returns it too."""
    samples = {r["column_name"]: r["sample_values"] for r in sample_values(df, columns).collect()}
    found = {r["column_name"]: r.asDict() | {"sample_values": samples[r["column_name"]]} for r in profile(df, columns, exact).collect()}
    out = {"row_count": next((r["row_count"] for r in found.values()), 0), "columns": found}
    Path(path).write_text(json.dumps(out, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return out


#: Rows in a bracket that one task may sort; accuracy of the quantiles that narrow brackets, and how far from the place they are taken.
BRACKET_ROWS, ACCURACY, MARGIN = 100_000, 10_000, 2e-4


def order_statistics(df: DataFrame, wanted: Sequence[tuple[str, int]], rows: dict[str, int], bracket_rows: int = BRACKET_ROWS) -> list[float]:
    """For each (column, place) the value at that place of the column's sorted filled values, exactly.

    Every round finds approximate quantiles close to either side of each place
    and counts the rows below, at, between and at them.  The place is at one of
    the two values, or the next bracket is what lies between its neighbours; one
    with few enough rows is sorted by one task.  So no task ever holds a whole
    column, and rounds grow with the logarithm of the rows.
    """
    found: dict[int, float] = {}
    brackets = {i: (None, None, 0, rows[c]) for i, (c, _) in enumerate(wanted)}  # bounds that are not part of it, rows below and inside

    def inside(i: int):
        x = _column(wanted[i][0]).cast("double")
        low, high, _, _ = brackets[i]
        keep = F.lit(True) if low is None else x > low
        return F.when(keep if high is None else keep & (x < high), x)

    while large := [i for i in brackets if i not in found and brackets[i][3] > bracket_rows]:
        aggs = []
        for i in large:
            _, _, below, n = brackets[i]
            at = (wanted[i][1] - below) / n
            aggs.append(F.percentile_approx(inside(i), [max(0.0, at - MARGIN), min(1.0, at + MARGIN)], F.lit(ACCURACY)).alias(f"b{i}"))
        near = df.agg(*aggs).first()
        aggs = []
        for i in large:
            x, (a, b) = inside(i), near[f"b{i}"]
            aggs += [F.count_if(c).alias(f"{k}{i}") for k, c in (("u", x < a), ("a", x == a), ("m", (x > a) & (x < b)), ("b", x == b))]
        counts = df.agg(*aggs).first()
        for i in large:
            low, high, below, n = brackets[i]
            a, b = near[f"b{i}"]
            edges = [("", low, a, counts[f"u{i}"]), (a, None, None, counts[f"a{i}"]), ("", a, b, counts[f"m{i}"])]
            edges += [(b, None, None, counts[f"b{i}"] if b != a else 0)]
            edges += [("", b, high, n - sum(e[3] for e in edges))]
            for value, left, right, count in edges:
                if wanted[i][1] < below + count:
                    if value != "":
                        found[i] = value
                    brackets[i] = (left, right, below, count)
                    break
                below += count
    left = [i for i in brackets if i not in found]
    if left:
        some = df.select(*[inside(i).alias(f"x{i}") for i in left])
        # half a place further, so that rounding can't reach another one
        share = {i: (wanted[i][1] - brackets[i][2] + 0.5) / brackets[i][3] for i in left}
        row = some.agg(*[F.expr(f"percentile_disc({share[i]!r}D) WITHIN GROUP (ORDER BY x{i})").alias(f"v{i}") for i in left]).first()
        found |= {i: row[f"v{i}"] for i in left}
    return [found[i] for i in range(len(wanted))]


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], bracket_rows: int = BRACKET_ROWS) -> dict[str, list[float | None]]:
    """Exact quantiles of the filled values as doubles, between two values in proportion; None for empty columns."""
    found = df.agg(*[F.count(_column(c).cast("double")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    rows = {c: found[f"n{i}"] for i, c in enumerate(columns)}
    if all(n <= bracket_rows for n in rows.values()):
        one = df.agg(*[F.percentile(_column(c).cast("double"), list(shares)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: list(one[f"q{i}"] or [None] * len(shares)) for i, c in enumerate(columns)}
    places = {(c, q): q * (rows[c] - 1) for c in columns if rows[c] for q in shares}
    wanted = sorted({(c, int(p) + up) for (c, _), p in places.items() for up in (0, 1) if int(p) + up < rows[c]})
    values = dict(zip(wanted, order_statistics(df, wanted, rows, bracket_rows)))
    out: dict[str, list[float | None]] = {}
    for c in columns:
        out[c] = [None] * len(shares)
        for k, q in enumerate(shares if rows[c] else ()):
            p = places[c, q]
            low = values[c, int(p)]
            high = values.get((c, int(p) + 1), low)
            # the same formula as the engine's own percentile
            out[c][k] = low if low == high else (int(p) + 1 - p) * low + (p - int(p)) * high
    return out


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: mean, std, min, max and exact quartiles."""
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x = _column(c).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
                q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values: value, count, percent of filled rows; ties by value."""
    filled = df.where(_column(column).isNotNull())
    total = filled.agg(F.count(F.lit(1)).alias("total"))
    counts = filled.groupBy(_column(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    first = counts.orderBy(F.col("count").desc(), "value").limit(n)
    return first.join(F.broadcast(total)).select("value", "count", F.round(100.0 * F.col("count") / F.col("total"), 2).alias("percent"))


def outliers(df: DataFrame, column: str, key: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond ``factor`` interquartile ranges of the quartiles: key, value."""
    low, high = quantiles(df, [column], [0.25, 0.75])[column]
    x = _column(column).cast("double")
    rows = df.select(_column(key).alias("key"), x.alias("value"))
    if low is None:
        return rows.where(F.lit(False))
    return rows.where((F.col("value") < low - factor * (high - low)) | (F.col("value") > high + factor * (high - low)))


def key_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column: column_name, is_unique (every row filled and different)."""
    p = profile(df, columns)
    return p.select("column_name", ((F.col("unique_count") == F.col("row_count")) & (F.col("row_count") > 0)).alias("is_unique"))


def composite_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairs of columns and whether they identify rows together."""
    pairs = list(combinations(columns, 2))
    names = F.array(*[F.lit(f"{a}+{b}") for a, b in pairs])
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    counts = distinct_counts(df, pairs).join(F.broadcast(total))
    return counts.select(names[F.col("place")].alias("columns"), F.col("distinct").alias("unique_count"), (F.col("distinct") == F.col("rows")).alias("is_unique"))


def patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a text column: column_name, pattern (the first that 80 % of filled rows match, else null), broken_text (rows with marks of a wrong encoding)."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        t = _column(c).cast("string")
        aggs += [F.count(t).alias(f"n{i}"), F.count_if(t.rlike(MOJIBAKE_MARKS)).alias(f"m{i}")]
        found = F.when(F.lit(False), F.lit(""))
        for j, (name, pattern) in enumerate(PATTERNS.items()):
            aggs.append(F.count_if(t.rlike(pattern)).alias(f"p{i}_{j}"))
            found = found.when((F.col(f"n{i}") > 0) & (F.col(f"p{i}_{j}") >= 0.8 * F.col(f"n{i}")), name)
        rows.append(F.struct(F.lit(c).alias("column_name"), found.alias("pattern"), F.col(f"m{i}").alias("broken_text")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def inferred_types(df: DataFrame) -> dict[str, str]:
    """integer, float, string, date, boolean or null for each column; texts by what they hold."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    aggs = [F.count(_column(f.name)).alias(f"n_{i}") for i, f in enumerate(df.schema)]
    for i, c in enumerate(texts):
        x = as_number(_column(c), StringType())
        aggs += [F.count(x).alias(f"x{i}"), F.count_if(x == F.floor(x)).alias(f"i{i}"), F.count(as_time(_column(c), StringType())).alias(f"t{i}"), F.count_if(F.lower(_column(c)).isin("true", "false", "t", "f", "yes", "no")).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for k, f in enumerate(df.schema):
        filled = row[f"n_{k}"]
        if not filled:
            out[f.name] = "null"
        elif f.name in texts:
            i = texts.index(f.name)
            out[f.name] = "integer" if row[f"i{i}"] == filled else "float" if row[f"x{i}"] == filled else "date" if row[f"t{i}"] == filled else "boolean" if row[f"b{i}"] == filled else "string"
        else:
            kind = f.dataType
            out[f.name] = "integer" if isinstance(kind, IntegralType) else "float" if isinstance(kind, NumericType) else "boolean" if isinstance(kind, BooleanType) else "date" if is_time(kind) else "string"
    return out


def value_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """One row: left_distinct, right_distinct, shared (distinct values as text in both)."""
    a = left.select(_column(left_column).cast("string").alias("v")).where("v is not null").distinct().withColumn("l", F.lit(1))
    b = right.select(_column(right_column).cast("string").alias("v")).where("v is not null").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "v", "full_outer")
    return both.agg(F.count("l").alias("left_distinct"), F.count("r").alias("right_distinct"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
