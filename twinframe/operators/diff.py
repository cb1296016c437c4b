"""Comparison of two keyed tables.

Everything comes from one full outer join on the canonical key: the status of
each row, the states of its cells, and from these the summary, the long form,
the per-column statistics and the report layouts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property, reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import APART, UNEQUAL, TextRules, cell_state, cells_differ, shown
from ..plans.alignment import Alignment, align
from .keys import all_filled, canonical, require_unique

KEY_SEPARATOR = " | "
LONG_FORM = ("Key", "Differing Column", "Left Value", "Right Value", "Difference Type", "Entire Column Different")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint in the folder that the cluster names, or else blocks on disk."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


class Comparison:
    """``left`` against ``right``; frames are lazy until a result is asked for."""

    def __init__(
        self,
        left: DataFrame,
        right: DataFrame,
        keys: Sequence[str] = (),
        values: Sequence[str] = (),
        column_map: Mapping[str, str] | None = None,
        exclude: Sequence[str] = (),
        tolerance: float = 0.01,
        rules: TextRules = TextRules(),
        check_keys: bool = False,
    ):
        self.left, self.right, self.tolerance, self.rules = left, right, tolerance, rules
        self.plan: Alignment = align(left.columns, right.columns, keys, values, column_map, exclude)
        if check_keys:
            require_unique(left, [k for k, _ in self.plan.keys], right, [k for _, k in self.plan.keys])

    # ---- the one join
    def _side(self, df: DataFrame, which: int) -> DataFrame:
        """Canonical keys ``_k0..`` and the row itself as a struct, narrowed to what is compared.

        Rows with a null in the key match nothing, so they may go anywhere: a
        number of their own in ``_spread`` keeps them out of one partition.
        """
        name = "lr"[which]
        used = [p[which] for p in (*self.plan.keys, *self.plan.values)]
        return df.select(
            *[canonical(p[which]).alias(f"_k{i}") for i, p in enumerate(self.plan.keys)],
            F.when(all_filled([p[which] for p in self.plan.keys]), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(which), F.monotonically_increasing_id())).alias("_spread"),
            F.struct(*[F.col(f"`{c}`").alias(f"{name}{j}") for j, c in enumerate(used)]).alias(name),
        )

    @cached_property
    def aligned(self) -> DataFrame:
        """One row a pair or a lone row: ``status``, ``l``, ``r``; null keys never match."""
        on = [*(f"_k{i}" for i in range(len(self.plan.keys))), "_spread"]
        joined = self._side(self.left, 0).join(self._side(self.right, 1), on, "full_outer")
        status = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
        return joined.select(status.alias("status"), "l", "r")

    def _cell(self, j: int) -> tuple[Column, Column]:
        at = len(self.plan.keys) + j
        return F.col(f"l.l{at}"), F.col(f"r.r{at}")

    def _kinds(self, j: int):
        a, b = self.plan.values[j]
        return self.left.schema[a].dataType, self.right.schema[b].dataType

    def _differs(self, j: int, tolerance: float) -> Column:
        (left, right), (a, b) = self._cell(j), self._kinds(j)
        return cells_differ(left, a, right, b, tolerance, self.rules)

    # ---- counts
    def _count_rows(self) -> list[Column]:
        is_ = lambda s: F.count_if(F.col("status") == s)
        return [
            (is_("both") + is_("left")).alias("total_left"),
            (is_("both") + is_("right")).alias("total_right"),
            is_("both").alias("matched_rows"),
            is_("left").alias("only_in_left"),
            is_("right").alias("only_in_right"),
        ]

    def counts(self) -> DataFrame:
        """One row: totals, matches, lone rows."""
        return self.aligned.select("status").agg(*self._count_rows())

    def summary(self) -> DataFrame:
        """One row: counts, rows that differ (within tolerance and exactly) and rates in percent.

        Each cell is read once; its state says whether it differs exactly and
        whether it does so beyond the tolerance.
        """
        n = len(self.plan.values)
        both = F.col("status") == "both"
        states = []
        for j in range(n):
            (left, right), (a, b) = self._cell(j), self._kinds(j)
            states.append(F.when(both, cell_state(left, a, right, b, self.tolerance, self.rules)).alias(f"s{j}"))
        any_of = lambda bit: reduce(or_, [F.col(f"s{j}").bitwiseAND(bit) > 0 for j in range(n)]) if n else F.lit(False)
        out = self.aligned.select("status", *states).agg(
            *self._count_rows(), F.count_if(any_of(APART)).alias("value_differences"), F.count_if(any_of(UNEQUAL)).alias("value_differences_exact")
        )
        m, left, right = F.col("matched_rows"), F.col("total_left"), F.col("total_right")
        return out.select(
            "*",
            _rate(m, left + right - m).alias("match_rate"),
            _rate(m, left).alias("left_coverage"),
            _rate(m, right).alias("right_coverage"),
            _rate(F.col("value_differences"), m).alias("difference_rate"),
        )

    def only_in(self, side: str) -> DataFrame:
        """All columns of the rows that only ``left`` or ``right`` has, keys that are null among them."""
        df, other, own, its = (self.left, self.right, 0, 1) if side == "left" else (self.right, self.left, 1, 0)
        keys = other.where(all_filled([p[its] for p in self.plan.keys])).select(*[canonical(p[its]).alias(f"_o{i}") for i, p in enumerate(self.plan.keys)])
        on = reduce(lambda a, b: a & b, [canonical(p[own]) == F.col(f"_o{i}") for i, p in enumerate(self.plan.keys)])
        return df.join(keys, on, "left_anti")

    def column_stats(self, tolerance: float | None = None) -> DataFrame:
        """One row a value column: matched_rows, different_rows, entire_column (``true``/``false``)."""
        use = self.tolerance if tolerance is None else tolerance
        names = [a for a, _ in self.plan.values]
        one = self.aligned.where("status = 'both'").agg(
            F.count(F.lit(1)).alias("m"), *[F.count_if(self._differs(j, use)).alias(f"d{j}") for j in range(len(names))]
        )
        rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col("m").alias("matched_rows"), F.col(f"d{j}").alias("different_rows")) for j, n in enumerate(names)])
        entire = (F.col("different_rows") == F.col("matched_rows")) & (F.col("matched_rows") > 0)
        return one.select(F.inline(rows)).withColumn("entire_column", F.when(entire, "true").otherwise("false"))

    # ---- long form
    def _key(self) -> Column:
        parts = [F.col(f"l.l{i}") for i in range(len(self.plan.keys))]
        return parts[0] if len(parts) == 1 else F.concat_ws(KEY_SEPARATOR, *[F.trim(p.cast("string")) for p in parts])

    def cells(self, tolerance: float = 0.0) -> DataFrame:
        """One row a differing cell; exact unless a tolerance is given (exports are exact)."""
        found = []
        for j, (a, b) in enumerate(self.plan.values):
            left, right = self._cell(j)
            kind = F.when(left.isNull(), "Missing in Left").when(right.isNull(), "Missing in Right").otherwise("Different Values")
            cell = F.struct(
                F.lit(a).alias("Differing Column"),
                shown(left, self.left.schema[a].dataType).alias("Left Value"),
                shown(right, self.right.schema[b].dataType).alias("Right Value"),
                kind.alias("Difference Type"),
            )
            found.append(F.when(self._differs(j, tolerance), cell))
        both = self.aligned.where("status = 'both'")
        if not found:
            return both.where(F.lit(False)).select(self._key().alias("Key"), *[F.lit(None).cast("string").alias(c) for c in LONG_FORM[1:5]])
        return both.select(self._key().alias("Key"), F.explode(F.array_compact(F.array(*found))).alias("cell")).select("Key", "cell.*")

    def annotated(self) -> DataFrame:
        """The long form with ``Entire Column Different``; the flags are one row a column, so they are broadcast.

        The cells are computed once and kept: a column differs everywhere if it
        has as many cells there as rows are matched, a number that needs the
        keys only.
        """
        rows = kept(self.cells())
        found = rows.groupBy("Differing Column").agg(F.count(F.lit(1)).alias("n"))
        flags = found.join(F.broadcast(self.counts().select("matched_rows"))).select(
            "Differing Column", F.when(F.col("n") == F.col("matched_rows"), "true").otherwise("false").alias("Entire Column Different")
        )
        return rows.join(F.broadcast(flags), "Differing Column").select(*LONG_FORM)

    @cached_property
    def long_form(self) -> DataFrame:
        """:meth:`annotated`, computed once for all layouts of this comparison."""
        return kept(self.annotated())

    def full_export(self, annotated: DataFrame | None = None) -> DataFrame:
        """One row (the first key) for each column that differs everywhere, all cells of the others."""
        rows = annotated if annotated is not None else self.long_form
        entire = F.col("Entire Column Different") == "true"
        whole = rows.where(entire).groupBy("Differing Column").agg(F.min(F.struct(*LONG_FORM[:1], *LONG_FORM[2:])).alias("first"))
        return whole.select("first.Key", "Differing Column", *[f"first.`{c}`" for c in LONG_FORM[2:]]).unionByName(rows.where(~entire))

    def audit_export(self, annotated: DataFrame | None = None) -> DataFrame:
        rows = annotated if annotated is not None else self.annotated()
        return rows.select("*", F.current_timestamp().alias("audit_timestamp"), F.lit("row_level_audit").alias("audit_type"))

    def smart_preview(self, limit: int = 1000, samples: int = 10, order: Sequence[str] = ("Differing Column", "Key"), annotated: DataFrame | None = None) -> DataFrame:
        """Summaries of entire columns (sample 2), the first cells of others (1), then cells of keys not yet shown (0).

        First rows are taken by sort and limit, never by a window over all rows.
        """
        rows = annotated if annotated is not None else self.long_form
        by = [F.col(f"`{c}`") for c in order]
        entire = F.col("Entire Column Different") == "true"
        w = Window.partitionBy("Differing Column").orderBy(*by)
        summaries = rows.where(entire).withColumn("_n", F.row_number().over(w)).where("_n <= 1").drop("_n")
        first = rows.where(~entire).orderBy(*by).limit(samples)
        shown_keys = summaries.select("Key").union(first.select("Key")).distinct()
        rest = rows.join(shown_keys, "Key", "left_anti").orderBy(*by).limit(max(0, limit - samples - 1))
        out = lambda df, n: df.select(
            "Differing Column", "Key", "Left Value", "Right Value", "Difference Type", F.col("Entire Column Different").alias("entire_column"), F.lit(n).cast("long").alias("sample")
        )
        return out(summaries, 2).unionByName(out(first, 1)).unionByName(out(rest, 0)).orderBy(*by, F.col("sample").desc())

    def simple_preview(self, limit: int = 1000, annotated: DataFrame | None = None) -> DataFrame:
        rows = annotated if annotated is not None else self.annotated()
        return rows.orderBy("Key", "Differing Column").limit(limit)

    def plain_preview(self, limit: int = 1000) -> DataFrame:
        """Five columns, without the flag."""
        return self.cells().orderBy("Key", "Differing Column").limit(limit)
