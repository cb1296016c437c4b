"""Data-quality checks over whole tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.coerce import as_number, as_time
from .keys import duplicate_examples, key_counts

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"


@dataclass(frozen=True)
class Issue:
    severity: str
    category: str
    message: str
    details: dict = field(default_factory=dict)


@dataclass
class Report:
    issues: list[Issue] = field(default_factory=list)
    statistics: dict = field(default_factory=dict)

    @property
    def is_valid(self) -> bool:
        return not any(i.severity == ERROR for i in self.issues)

    def merge(self, other: Report) -> None:
        self.issues += other.issues
        self.statistics |= other.statistics


def issue_table(df: DataFrame, *validators: Validator) -> DataFrame:
    """One row an issue: severity, category, column_name, count (null where an issue has none)."""
    issues = [i for v in validators for i in v.validate(df).issues]
    number = lambda d: next((int(d[k]) for k in ("numeric", "count", "groups") if k in d), None)
    return df.sparkSession.createDataFrame([(i.severity, i.category, i.details.get("column"), number(i.details)) for i in issues], "severity string, category string, column_name string, count bigint")


class Validator(ABC):
    @abstractmethod
    def validate(self, df: DataFrame) -> Report: ...


class SchemaValidator(Validator):
    """Empty tables, repeated names, and text columns that mix numbers with words."""

    def validate(self, df: DataFrame) -> Report:
        out = Report(statistics={"column_count": len(df.columns), "dtypes": {t: [k for _, k in df.dtypes].count(t) for _, t in df.dtypes}})
        repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
        if repeated:
            out.issues.append(Issue(ERROR, "schema", f"repeated columns: {', '.join(repeated)}", {"columns": repeated}))
            return out
        texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(as_number(F.col(f"`{c}`"), StringType()).isNotNull()).alias(f"n{i}") for i, c in enumerate(texts)],
            *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(texts)],
        ).first()
        out.statistics["row_count"] = row["rows"]
        if not row["rows"]:
            out.issues.append(Issue(ERROR, "schema", "the table is empty"))
            return out
        for i, c in enumerate(texts):
            if 0 < row[f"n{i}"] < row[f"c{i}"]:
                out.issues.append(Issue(WARNING, "schema", f"column {c} mixes numbers and text", {"column": c, "numeric": row[f"n{i}"], "filled": row[f"c{i}"]}))
        return out


@dataclass
class TypeValidator(Validator):
    """Types that differ from the expected ones; text columns that hold only numbers."""

    expected: Mapping[str, str] = field(default_factory=dict)

    def validate(self, df: DataFrame) -> Report:
        out, kinds = Report(), dict(df.dtypes)
        for c, kind in self.expected.items():
            if c in kinds and kinds[c] != kind:
                out.issues.append(Issue(WARNING, "dtype", f"column {c} is {kinds[c]}, expected {kind}", {"column": c}))
        texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        if texts:
            row = df.agg(*[F.bool_and(as_number(F.col(f"`{c}`"), StringType()).isNotNull() | F.col(f"`{c}`").isNull()).alias(f"a{i}") for i, c in enumerate(texts)], *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
            out.issues += [Issue(INFO, "dtype", f"column {c} holds numbers as text", {"column": c}) for i, c in enumerate(texts) if row[f"a{i}"] and row[f"c{i}"]]
        return out


@dataclass
class KeyValidator(Validator):
    """Missing key columns and null keys are errors, repeated keys a warning."""

    keys: Sequence[str] = ()

    def validate(self, df: DataFrame) -> Report:
        out = Report()
        missing = [k for k in self.keys if k not in df.columns]
        if missing:
            out.issues.append(Issue(ERROR, "key", f"missing key columns: {', '.join(missing)}", {"columns": missing}))
            return out
        if not self.keys:
            return out
        nulls = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{k}`").isNull()).alias(f"n{i}") for i, k in enumerate(self.keys)]).first()
        for i, k in enumerate(self.keys):
            if nulls[f"n{i}"]:
                out.issues.append(Issue(ERROR, "key", f"{nulls[f'n{i}']} nulls in key {k}", {"column": k, "count": nulls[f"n{i}"], "percent": round(100.0 * nulls[f"n{i}"] / nulls["rows"], 2)}))
        counts = key_counts(df, self.keys).first()
        out.statistics["unique_keys"] = counts["unique_values"]
        if counts["duplicate_rows"]:
            examples = [r.asDict() for r in duplicate_examples(df, self.keys, 10).collect()]
            out.issues.append(Issue(WARNING, "key", f"{counts['duplicate_rows']} duplicate keys", {"groups": counts["duplicate_groups"], "examples": examples}))
        return out


class DuplicateRowValidator(Validator):
    def validate(self, df: DataFrame) -> Report:
        n = duplicate_row_count(df).first()["duplicate_rows"]
        return Report([Issue(WARNING, "duplicates", f"{n} fully duplicate rows", {"count": n})] if n else [])


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """One row: total_rows, distinct_rows, duplicate_rows."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n_"))
    return groups.agg(F.coalesce(F.sum("n_"), F.lit(0)).cast("long").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))


def null_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a column: column_name, null_count, null_percent; one pass over the table."""
    names = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"), F.when(F.col("rows") > 0, F.round(100.0 * F.col(f"n{i}") / F.col("rows"), 2)).otherwise(0.0).alias("null_percent")) for i, c in enumerate(names)])
    return one.select(F.inline(rows))


def type_histogram(df: DataFrame) -> DataFrame:
    """One row a type: data_type, columns."""
    kinds = [k for _, k in df.dtypes]
    return df.sparkSession.createDataFrame([(k, kinds.count(k)) for k in sorted(set(kinds))], "data_type string, columns bigint")


def on_or_before(df: DataFrame, column: str, cutoff: str) -> DataFrame:
    """Rows whose date in ``column``, read in any of the known formats, is not after ``cutoff``; rows without a date go."""
    day = as_time(F.col(f"`{column}`"), df.schema[column].dataType)
    return df.where(day <= F.lit(cutoff).cast("timestamp_ntz"))


def validate(df: DataFrame, keys: Sequence[str] = (), expected: Mapping[str, str] | None = None, fail_fast: bool = False, sample: int | None = None) -> Report:
    """Schema, types, keys and duplicate rows in this order; ``sample`` rows only if given."""
    rows = df.limit(sample) if sample else df
    out = Report()
    for step in (SchemaValidator(), TypeValidator(expected or {}), KeyValidator(keys), DuplicateRowValidator()):
        out.merge(step.validate(rows))
        if any(i.severity == ERROR for i in out.issues) and (fail_fast or isinstance(step, SchemaValidator)):
            break
    return out
