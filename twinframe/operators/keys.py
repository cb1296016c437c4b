"""Key uniqueness: checks, examples, and the gate before a comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyValidationError(ValueError):
    """The chosen key does not identify rows."""


@dataclass(frozen=True)
class KeyCheck:
    keys: tuple[str, ...]
    total_rows: int
    unique_values: int
    duplicate_rows: int
    duplicate_groups: int
    null_rows: int

    @property
    def is_valid(self) -> bool:
        return self.duplicate_rows == 0

    @property
    def duplicate_percent(self) -> float:
        return round(100.0 * self.duplicate_rows / self.total_rows, 2) if self.total_rows else 0.0

    @property
    def verdict(self) -> str:
        if self.duplicate_rows == 0:
            return "PERFECT"
        return "PARTIAL" if self.unique_values > 0.95 * self.total_rows else "FAILED"


def canonical(column: str) -> Column:
    """Keys match as trimmed text."""
    return F.trim(F.col(f"`{column}`").cast("string"))


def all_filled(keys: Sequence[str]) -> Column:
    out = F.col(f"`{keys[0]}`").isNotNull()
    for k in keys[1:]:
        out = out & F.col(f"`{k}`").isNotNull()
    return out


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: total_rows (keys not null), unique_values, duplicate_rows, duplicate_groups, null_rows.

    One shuffle on the canonical key, with partial counts before it; rows with a
    null in the key are one group of their own and are counted apart.
    """
    key = F.struct(*[canonical(k).alias(f"k{i}") for i, k in enumerate(keys)])
    groups = df.groupBy(F.when(all_filled(keys), key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    whole = F.col("key").isNotNull()
    count = lambda c: F.coalesce(F.sum(F.when(whole, c)), F.lit(0)).cast("long")
    return groups.agg(
        count(F.col("n")).alias("total_rows"),
        count(F.lit(1)).alias("unique_values"),
        count(F.col("n") - 1).alias("duplicate_rows"),
        count((F.col("n") > 1).cast("long")).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0)).cast("long").alias("null_rows"),
    )


def check_key(df: DataFrame, keys: Sequence[str]) -> KeyCheck:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyValidationError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return KeyCheck(tuple(keys), **key_counts(df, keys).first().asDict())


def duplicate_examples(df: DataFrame, keys: Sequence[str], limit: int = 10) -> DataFrame:
    """The keys with most rows (null keys too), with their ``duplicate_count``; ties by key."""
    by = [F.col(f"`{k}`") for k in keys]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("duplicate_count")).where("duplicate_count > 1").orderBy(F.col("duplicate_count").desc(), *[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(limit)


def require_unique(left: DataFrame, left_keys: Sequence[str], right: DataFrame, right_keys: Sequence[str]) -> tuple[KeyCheck, KeyCheck]:
    """Both sides' checks; raises at the first side whose key repeats."""
    checks = []
    for side, df, keys in (("left", left, left_keys), ("right", right, right_keys)):
        found = check_key(df, keys)
        if not found.is_valid:
            raise KeyValidationError(
                f"{side} key ({', '.join(keys)}) is not unique: {found.duplicate_rows} duplicate rows in {found.duplicate_groups} groups; "
                "choose another key or add a column to it"
            )
        checks.append(found)
    return checks[0], checks[1]


def candidate_table(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """One row a candidate key: key, and the counts of :func:`key_counts`."""
    out = None
    for keys in candidates:
        row = key_counts(df, keys).select(F.lit("+".join(keys)).alias("key"), "*")
        out = row if out is None else out.unionByName(row)
    return out
