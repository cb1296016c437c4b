"""Registered queries of the comparison engine, and their SQL.

The standard pair is two views of ``orders`` that differ in known ways; see
:func:`pair` and ``PAIR_SQL``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .functions import coerce, text
from .functions.names import rename_all
from .operators import diff, keys, profile, validate
from .sources.readers import custom_sql, read_csv

ENTIRE_COLUMN_VALUES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------ the standard pair
def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    left = orders.where(k % 20 != 3)
    right = orders.where(k % 25 != 4).withColumns(
        {
            "o_totalprice": F.when(k % 7 == 0, F.col("o_totalprice") + 1.5).when(k % 11 == 0, F.col("o_totalprice") + 0.005).otherwise(F.col("o_totalprice")),
            "o_orderpriority": F.when(k % 5 == 0, F.lower(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))).otherwise(F.col("o_orderpriority")),
            "o_orderstatus": F.when(k % 13 != 0, F.col("o_orderstatus")),
            "o_orderdate": F.when(k % 3 == 0, F.date_format(F.to_date("o_orderdate"), "MM/dd/yyyy")).otherwise(F.col("o_orderdate")),
        }
    )
    return left, right


def compared(spark: SparkSession, sf_dir: str, **options) -> diff.Comparison:
    return diff.Comparison(*pair(spark, sf_dir), keys=["o_orderkey"], **options)


PAIR_SQL = """
L AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
      FROM orders WHERE o_orderkey % 20 <> 3),
R AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1.5 WHEN o_orderkey % 11 = 0 THEN o_totalprice + 0.005 ELSE o_totalprice END AS o_totalprice,
             CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate,
             CASE WHEN o_orderkey % 5 = 0 THEN lower(' ' || o_orderpriority || ' ') ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE o_orderkey % 25 <> 4)"""


# ------------------------------------------------------------ the predicate in SQL
def sql_number(x: str) -> str:
    t = f"regexp_replace(CAST({x} AS VARCHAR), '\\s*[$£€¥₪₹¢]\\s*', '', 'g')"
    return f"TRY_CAST(trim(regexp_replace(regexp_replace(replace({t}, ',', ''), '^\\(', '-'), '\\)$', '')) AS DOUBLE)"


def sql_time(x: str) -> str:
    forms = "['%m/%d/%Y', '%m/%d/%Y %H:%M', '%d/%m/%Y', '%Y-%m-%d', '%m-%d-%Y', '%Y/%m/%d', '%d-%m-%Y']"
    return f"coalesce(TRY_CAST(CAST({x} AS VARCHAR) AS TIMESTAMP), try_strptime(CAST({x} AS VARCHAR), {forms}))"


def sql_text(x: str) -> str:
    return f"trim(lower(trim(CAST({x} AS VARCHAR))), '''\"')"


def sql_differs(a: str, b: str, tolerance: float) -> str:
    na, nb, ta, tb = sql_number(a), sql_number(b), sql_time(a), sql_time(b)
    la, lb = f"lower(CAST({a} AS VARCHAR))", f"lower(CAST({b} AS VARCHAR))"
    words, yes = "('true','t','yes','false','f','no')", "('true','t','yes')"
    number = f"abs({na} - {nb}) > {tolerance}" if tolerance else f"{na} <> {nb}"
    return (
        f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN FALSE WHEN {a} IS NULL OR {b} IS NULL THEN TRUE "
        f"WHEN {na} IS NOT NULL AND {nb} IS NOT NULL THEN {number} "
        f"WHEN {ta} IS NOT NULL AND {tb} IS NOT NULL THEN {ta} <> {tb} "
        f"WHEN {la} IN {words} AND {lb} IN {words} THEN ({la} IN {yes}) <> ({lb} IN {yes}) "
        f"ELSE {sql_text(a)} <> {sql_text(b)} END)"
    )


def _joined(columns: list[str]) -> str:
    both = ", ".join(f"L.{c} AS l_{c}, R.{c} AS r_{c}" for c in columns)
    return f"J AS (SELECT L.o_orderkey AS k, {both} FROM L JOIN R ON trim(CAST(L.o_orderkey AS VARCHAR)) = trim(CAST(R.o_orderkey AS VARCHAR)))"


def _cells_sql(tolerance: float, columns: list[str] = ENTIRE_COLUMN_VALUES) -> str:
    parts = [
        f"SELECT k AS \"Key\", '{c}' AS \"Differing Column\", CAST(l_{c} AS VARCHAR) AS \"Left Value\", CAST(r_{c} AS VARCHAR) AS \"Right Value\", "
        f"CASE WHEN l_{c} IS NULL THEN 'Missing in Left' WHEN r_{c} IS NULL THEN 'Missing in Right' ELSE 'Different Values' END AS \"Difference Type\" "
        f"FROM J WHERE {sql_differs(f'l_{c}', f'r_{c}', tolerance)}"
        for c in columns
    ]
    return "C AS (" + " UNION ALL ".join(parts) + ")"


def _stats_sql(tolerance: float) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(*) AS matched_rows, count(*) FILTER (WHERE {sql_differs(f'l_{c}', f'r_{c}', tolerance)}) AS different_rows FROM J"
        for c in ENTIRE_COLUMN_VALUES
    ]
    return "S AS (SELECT *, CASE WHEN different_rows = matched_rows AND matched_rows > 0 THEN 'true' ELSE 'false' END AS entire_column FROM (" + " UNION ALL ".join(parts) + "))"


def _annotated_sql() -> str:
    return f'WITH {PAIR_SQL}, {_joined(ENTIRE_COLUMN_VALUES)}, {_cells_sql(0)}, {_stats_sql(0)}, A AS (SELECT C.*, S.entire_column AS "Entire Column Different" FROM C JOIN S ON C."Differing Column" = S.column_name)'


def _any_differs(tolerance: float) -> str:
    return " OR ".join(sql_differs(f"l_{c}", f"r_{c}", tolerance) for c in ENTIRE_COLUMN_VALUES)


def _summary_sql() -> str:
    return f"""
WITH {PAIR_SQL}, {_joined(ENTIRE_COLUMN_VALUES)},
T AS (SELECT (SELECT count(*) FROM L) AS l, (SELECT count(*) FROM R) AS r, count(*) AS m,
             count(*) FILTER (WHERE {_any_differs(0.01)}) AS near, count(*) FILTER (WHERE {_any_differs(0)}) AS exact FROM J)
SELECT l AS total_left, r AS total_right, m AS matched_rows, l - m AS only_in_left, r - m AS only_in_right,
       near AS value_differences, exact AS value_differences_exact,
       round(100.0::DOUBLE * m / (l + r - m), 2) AS match_rate, round(100.0::DOUBLE * m / l, 2) AS left_coverage,
       round(100.0::DOUBLE * m / r, 2) AS right_coverage, round(100.0::DOUBLE * near / m, 2) AS difference_rate FROM T"""


# ------------------------------------------------------------ a pair whose column differs everywhere
def shifted(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    right = c.withColumns({"c_nationkey": F.col("c_nationkey") + 1, "c_mktsegment": F.when(F.col("c_custkey") % 10 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))})
    return diff.Comparison(c, right, keys=["c_custkey"], tolerance=0.0)


def _shifted_sql() -> str:
    cells = [
        f"""SELECT c_custkey AS "Key", '{c}' AS "Differing Column", CAST({c} AS VARCHAR) AS "Left Value", {r} AS "Right Value", 'Different Values' AS "Difference Type", '{e}' AS "Entire Column Different"
FROM customer WHERE {w}"""
        for c, r, e, w in (
            ("c_nationkey", "CAST(c_nationkey + 1 AS VARCHAR)", "true", "TRUE"),
            ("c_mktsegment", "'OTHER'", "false", "c_custkey % 10 = 0 AND lower(c_mktsegment) <> 'other'"),
        )
    ]
    return "A AS (" + " UNION ALL ".join(cells) + ")"


_ENTIRE_SQL = """SELECT "Differing Column", "Key", "Left Value", "Right Value", "Difference Type", "Entire Column Different" AS entire_column, CAST({n} AS BIGINT) AS sample FROM {t}"""


def _preview_sql(annotated: str, limit: int, samples: int) -> str:
    by = '"Differing Column", "Key"'
    return (
        f'{annotated}, S1 AS (SELECT * FROM A WHERE "Entire Column Different" = \'true\' QUALIFY row_number() OVER (PARTITION BY "Differing Column" ORDER BY {by}) <= 1), '
        f'S2 AS (SELECT * FROM A WHERE "Entire Column Different" = \'false\' ORDER BY {by} LIMIT {samples}), '
        f'S3 AS (SELECT * FROM A WHERE "Key" NOT IN (SELECT "Key" FROM S1 UNION ALL SELECT "Key" FROM S2) ORDER BY {by} LIMIT {limit - samples - 1}) '
        + " UNION ALL ".join(_ENTIRE_SQL.format(n=n, t=t) for n, t in ((2, "S1"), (1, "S2"), (0, "S3")))
    )


def _full_sql(annotated: str) -> str:
    return (
        f'{annotated} SELECT * FROM (SELECT * FROM A WHERE "Entire Column Different" = \'true\' QUALIFY row_number() OVER (PARTITION BY "Differing Column" ORDER BY "Key") = 1) '
        "UNION ALL SELECT * FROM A WHERE \"Entire Column Different\" = 'false'"
    )


# ------------------------------------------------------------ scalar functions on made-up texts
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awkward texts made from part and customer rows, the same in both engines."""
    k = F.col("p_partkey")
    amount = F.format_string("%d.%02d", (k * 37) % 5000, k % 100)
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("("), amount, F.lit(")"))).when(k % 5 == 1, F.concat(F.lit("$"), amount)).when(k % 5 == 2, F.concat(F.lit("- € "), amount)).when(k % 5 == 3, F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.lit("n/a")).alias("money"),
        F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("All : "), "p_brand", F.lit(" :  "), "p_name")).otherwise(F.concat("p_name", F.lit("  x \t y "))).alias("path"),
        F.element_at(F.array(*map(F.lit, ["t", "TRUE", "1", "yes", "f", "False", "0", "no", "maybe", ""])), (k % 10 + 1).cast("int")).alias("flag"),
        F.when(k % 4 == 0, F.lit("12/30/2024")).when(k % 4 == 1, F.lit("2024-12-30 00:00:00")).when(k % 4 == 2, F.lit("2024/12/30")).otherwise(F.lit("30-12-2024")).alias("day"),
    )


TEXTS_SQL = """X AS (SELECT p_partkey AS id,
  CASE WHEN p_partkey % 5 = 0 THEN '(' || amount || ')' WHEN p_partkey % 5 = 1 THEN '$' || amount WHEN p_partkey % 5 = 2 THEN '- € ' || amount
       WHEN p_partkey % 5 = 3 THEN '1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE 'n/a' END AS money,
  CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'All : ' || p_brand || ' :  ' || p_name ELSE p_name || '  x ' || chr(9) || ' y ' END AS path,
  (['t','TRUE','1','yes','f','False','0','no','maybe',''])[p_partkey % 10 + 1] AS flag,
  CASE p_partkey % 4 WHEN 0 THEN '12/30/2024' WHEN 1 THEN '2024-12-30 00:00:00' WHEN 2 THEN '2024/12/30' ELSE '30-12-2024' END AS day
FROM (SELECT *, printf('%d.%02d', (p_partkey * 37) % 5000, p_partkey % 100) AS amount FROM part))"""


def _wide(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    """lineitem summed to one row an order, against a copy with small and large changes."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    grain = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(F.round(F.col(c) * 100).cast("long")).alias(f"sum_{c[2:]}") for c in cols], *[F.max(F.round(F.col(c) * 100).cast("long")).alias(f"max_{c[2:]}") for c in cols], F.count(F.lit(1)).alias("lines")
    )
    k = F.col("l_orderkey")
    right = grain.withColumns({"sum_quantity": F.when(k % 9 == 0, F.col("sum_quantity") + 1).otherwise(F.col("sum_quantity")), "max_tax": F.when(k % 17 == 0, F.col("max_tax") + 2).otherwise(F.col("max_tax")), "lines": F.col("lines").cast("string")})
    return diff.Comparison(grain, right, keys=["l_orderkey"], tolerance=0.0)


WIDE_SQL = """WITH G AS (SELECT l_orderkey, sum(CAST(round(l_quantity*100) AS BIGINT)) AS q, max(CAST(round(l_tax*100) AS BIGINT)) AS t FROM lineitem GROUP BY 1)
SELECT * FROM (
SELECT l_orderkey AS "Key", 'sum_quantity' AS "Differing Column", CAST(q AS VARCHAR) AS "Left Value", CAST(q + 1 AS VARCHAR) AS "Right Value", 'Different Values' AS "Difference Type" FROM G WHERE l_orderkey % 9 = 0
UNION ALL SELECT l_orderkey, 'max_tax', CAST(t AS VARCHAR), CAST(t + 2 AS VARCHAR), 'Different Values' FROM G WHERE l_orderkey % 17 = 0)"""


def _mapped(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    """Right columns under other names, joined through a column map; keys padded with spaces."""
    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Supplier ID"), F.col("s_name").alias("Name"), F.col("s_acctbal").alias("Balance"))
    right = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" ")).alias("vendor_no"), F.upper("s_name").alias("vendor_name"),
        F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal") + 10).otherwise(F.col("s_acctbal")).alias("vendor_balance"),
    )
    return diff.Comparison(left, right, keys=["supplier_id"], column_map={"vendor_no": "supplier_id", "vendor_name": "name", "vendor_balance": "balance"})


def _mapped_back(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    """The same pair the other way round: the map still goes from the right side's names to the left's."""
    c = _mapped(spark, sf_dir)
    return diff.Comparison(c.right, c.left, keys=["vendor_no"], column_map={"supplier_id": "vendor_no", "name": "vendor_name", "balance": "vendor_balance"})


def _holed(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    """The standard pair with a null in every thirtieth key."""
    sides = [t.select(F.when(F.col("o_orderkey") % 30 != 1, F.col("o_orderkey")).cast("string").alias("k"), "o_orderstatus") for t in pair(spark, sf_dir)]
    return diff.Comparison(*sides, keys=["k"])


def _by_flag(spark: SparkSession, sf_dir: str) -> diff.Comparison:
    """Lines of an order by return flag, against counts that are off for every fourth order."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("lines"))
    k = F.col("l_orderkey")
    right = n.withColumn("lines", F.when(k % 8 == 0, F.lit(None)).when(k % 4 == 0, F.col("lines") + 1).otherwise(F.col("lines")))
    return diff.Comparison(n, right, keys=["l_orderkey", "l_returnflag"], tolerance=0.0)


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as CSV with quotes, line ends and nulls, written to the warehouse folder and read again."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/csv_{uuid.uuid4().hex[:12]}"
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("p_brand")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat("p_name", F.lit(', "quoted"\nline')).alias("p_name"), brand)
    rows.write.options(header=True, escape='"').csv(folder)
    return read_csv(spark, folder, clean=False)


SHAPED = ["mail", "brand", "price", "day", "words"]
#: Endings in a broken encoding.
BROKEN = " caf\u00c3\u00a9 \u00e2\u20ac\u2122 \u00e2\u20ac\" \u00a0."


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of known shapes: each column has one for at least 80 % of its rows but the last."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(k % 10 == 0, F.lit("none")).otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.example"))).alias("mail"),
        F.col("p_brand").alias("brand"),
        F.when(k % 6 != 0, F.concat(F.lit("$"), k.cast("string"), F.lit(".50"))).alias("price"),
        F.when(k % 7 == 0, F.lit("soon")).when(k % 2 == 0, F.lit("2024-02-03")).otherwise(F.lit("2/3/2024")).alias("day"),
        F.when(k % 9 == 0, F.concat("p_name", F.lit(BROKEN))).when(k % 3 == 0, F.lit("https://a.example/x")).otherwise(F.col("p_name")).alias("words"),
    )


SHAPED_SQL = f"""H AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'none' ELSE 'u' || p_partkey || '@mail.example' END AS mail, p_brand AS brand,
  CASE WHEN p_partkey % 6 <> 0 THEN '$' || p_partkey || '.50' END AS price,
  CASE WHEN p_partkey % 7 = 0 THEN 'soon' WHEN p_partkey % 2 = 0 THEN '2024-02-03' ELSE '2/3/2024' END AS day,
  CASE WHEN p_partkey % 9 = 0 THEN p_name || '{BROKEN}' WHEN p_partkey % 3 = 0 THEN 'https://a.example/x' ELSE p_name END AS words FROM part)"""


def _pattern_sql(c: str) -> str:
    shapes = " ".join(f"WHEN count(*) FILTER (WHERE regexp_matches({c}, '{p}')) >= 0.8 * count({c}) THEN '{n}'" for n, p in profile.PATTERNS.items())
    return f"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN NULL {shapes} END AS pattern, count(*) FILTER (WHERE regexp_matches({c}, '{profile.MOJIBAKE_MARKS}')) AS broken_text FROM H"


def queries() -> dict:
    on_pair = lambda f, **o: lambda spark, d: f(compared(spark, d, **o))
    x = lambda f: lambda spark, d: f(_texts(spark, d))
    of = lambda name, f: lambda spark, d: f(table(spark, d, name))
    kind = StringType()
    return {
        "diff_summary": on_pair(lambda c: c.summary()),
        "diff_match_count": on_pair(lambda c: c.counts().select("matched_rows")),
        "only_in_left": on_pair(lambda c: c.only_in("left")),
        "only_in_right": on_pair(lambda c: c.only_in("right")),
        "summary_rates": on_pair(lambda c: c.summary().select("match_rate", "left_coverage", "right_coverage", "difference_rate")),
        "value_diff_rows_tol": on_pair(lambda c: c.cells(0.01).select("Key").distinct()),
        "value_diff_rows_exact": on_pair(lambda c: c.cells(0.0).select("Key").distinct()),
        "value_diff_cells": on_pair(lambda c: c.cells(0.0)),
        "value_diff_typed": on_pair(lambda c: c.cells(0.01).groupBy("Differing Column", "Difference Type").agg(F.count(F.lit(1)).alias("cells"))),
        "column_stats": on_pair(lambda c: c.column_stats(0.01)),
        "annotated_cells": on_pair(lambda c: c.annotated()),
        "entire_column_flags": lambda spark, d: shifted(spark, d).annotated(),
        "hybrid_full_export": lambda spark, d: shifted(spark, d).full_export(),
        "smart_preview": lambda spark, d: shifted(spark, d).smart_preview(60, 10),
        "simple_preview": on_pair(lambda c: c.simple_preview(500)),
        "plain_preview": on_pair(lambda c: c.plain_preview(200)),
        "audit_export": on_pair(lambda c: c.audit_export().drop("audit_timestamp")),
        "column_mapped_diff": lambda spark, d: _mapped(spark, d).cells(0.01),
        "renamed_columns_diff": lambda spark, d: _mapped(spark, d).summary(),
        "multi_column_wide_diff": lambda spark, d: _wide(spark, d).cells(),
        "null_key_handling": lambda spark, d: diff.Comparison(
            *[t.select(F.when(F.col("o_orderkey") % 30 != 1, F.col("o_orderkey")).alias("k"), "o_orderstatus") for t in pair(spark, d)], keys=["k"]
        ).counts(),
        "key_uniqueness_single": of("orders", lambda t: keys.key_counts(t, ["o_custkey"])),
        "key_uniqueness_composite": of("lineitem", lambda t: keys.key_counts(t, ["l_orderkey", "l_linenumber"])),
        "key_candidates_verdict": of("conversations", lambda t: keys.candidate_table(t, [["conv_id"], ["turn"], ["conv_id", "turn"]])),
        "duplicate_examples": of("lineitem", lambda t: keys.duplicate_examples(t, ["l_orderkey", "l_linenumber"])),
        "coerce_numeric": of("orders", lambda t: t.select("o_orderkey", coerce.as_number(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".50 ")), kind).alias("number"))),
        "coerce_currency": x(lambda t: t.select("id", coerce.as_number(F.col("money"), kind).alias("number"))),
        "coerce_date": x(lambda t: t.select("id", coerce.as_time(F.col("day"), kind).alias("moment"))),
        "coerce_boolean": x(lambda t: t.select("id", coerce.as_yes_no(F.col("flag"), kind).alias("yes_no"))),
        "coerce_string": x(lambda t: t.select("id", coerce.as_text(F.concat(F.lit("'"), "path", F.lit("\""))).alias("plain"))),
        "strip_hierarchy": x(lambda t: t.select("id", text.strip_hierarchy("path").alias("leaf"))),
        "collapse_spaces": x(lambda t: t.select("id", text.collapse_spaces("path").alias("plain"))),
        "currency_to_decimal": x(lambda t: t.select("id", text.currency_to_decimal("money").cast("double").alias("amount"))),
        "currency_to_float": x(lambda t: t.select("id", text.currency_to_float("money").alias("amount"))),
        "boolean_t_f": x(lambda t: t.select("id", text.boolean_t_f("flag").alias("flag"))),
        "unicode_clean": of("documents", lambda t: t.select("doc_id", text.unicode_clean("text").alias("plain"))),
        "text_normalize": of("documents", lambda t: t.select("doc_id", text.normalize_text("text").alias("plain"))),
        "upper_lower_round": of("part", lambda t: t.select("p_partkey", *[text.NORMALIZERS[n](F.col(c)).alias(n) for n, c in (("upper", "p_name"), ("lower", "p_brand"), ("numeric_round", "p_retailprice"))])),
        "validate_nulls": lambda spark, d: validate.null_table(pair(spark, d)[1]),
        "validate_duplicates": of("lineitem", lambda t: validate.duplicate_row_count(t.select("l_orderkey", "l_linenumber", "l_returnflag"))),
        "full_row_duplicates": of("orders", validate.duplicate_row_count),
        "profile_columns": of("customer", lambda t: profile.profile(t, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])),
        "profile_percentiles": of("orders", lambda t: profile.numeric_statistics(t, ["o_totalprice", "o_custkey"])),
        "profile_top_values": of("orders", lambda t: profile.top_values(t, "o_orderpriority", 3)),
        "profile_outliers": of("events", lambda t: profile.outliers(t, "value", "event_id")),
        "profile_patterns": lambda spark, d: profile.patterns(_shaped(spark, d), SHAPED),
        "key_candidates": of("orders", lambda t: profile.key_candidates(t, ["o_orderkey", "o_custkey", "o_orderstatus"])),
        "composite_candidates": of("conversations", lambda t: profile.composite_candidates(t, ["conv_id", "turn", "role"])),
        "value_overlap": lambda spark, d: profile.value_overlap(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey"),
        "custom_sql_source": of("part", lambda t: custom_sql(t.sparkSession, t, "SELECT p_brand, count(*) AS parts, max(p_size) AS largest FROM {table} GROUP BY p_brand;", "parts")),
        "cutoff_filter": of("orders", lambda t: validate.on_or_before(t, "o_orderdate", "1995-06-30").agg(F.count(F.lit(1)).alias("kept"), F.max("o_orderdate").alias("latest"))),
        "cutoff_text_dates": x(lambda t: validate.on_or_before(t.withColumn("day", F.when(F.col("id") % 3 == 0, F.lit("1/5/2025")).otherwise(F.col("day"))), "day", "2024-12-31").select("id")),
        "normalize_boolean": x(lambda t: t.select("id", text.normalize_boolean(F.concat(F.lit(" "), "flag")).alias("flag"))),
        "boolean_keep_yes_no": x(lambda t: t.select("id", text.boolean_t_f("flag", keep_yes_no=True).alias("flag"))),
        "safe_cast": x(lambda t: t.select("id", text.safe_cast("flag", "int").cast("string").alias("number"))),
        "display_text": x(lambda t: t.select("id", text.normalize_for_display(F.concat("path", F.lit(BROKEN))).alias("shown"))),
        "text_equality": x(lambda t: t.select("id", text.normalized_equal("path", F.when(F.col("id") % 2 == 0, F.regexp_replace("path", " ", "\u00a0  ")).otherwise(F.concat("path", F.lit("\u2019")))).alias("same"))),
        "frame_normalize": of("part", lambda t: text.normalize_frame(t.select("p_partkey", F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "\u00a0 \t")).alias("p_name"), F.concat("p_brand", F.lit("\u200b")).alias("p_brand")))),
        "collision_safe_rename": of("part", lambda t: rename_all(t.select(F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("part-key"), F.col("p_brand").alias("PART  KEY!")))),
        "csv_round_trip": _csv_round_trip,
        "validate_schema": x(lambda t: validate.issue_table(t.select("money", "flag", "path"), validate.SchemaValidator())),
        "validate_types": of("orders", lambda t: validate.issue_table(t.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus"), validate.TypeValidator({"o_orderkey": "string"}))),
        "validate_keys": lambda spark, d: validate.issue_table(pair(spark, d)[1], validate.KeyValidator(["o_orderstatus"])),
        "type_histogram": of("customer", lambda t: validate.type_histogram(t.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"))),
        "empty_relation_guard": on_pair(lambda c: c.cells(), exclude=ENTIRE_COLUMN_VALUES),
        "only_in_limited": on_pair(lambda c: c.only_in("left").orderBy("o_orderkey").limit(50)),
        "only_in_null_keys": lambda spark, d: _holed(spark, d).only_in("left"),
        "two_sided_key_check": lambda spark, d: keys.key_counts(pair(spark, d)[0], ["o_custkey"]).withColumn("side", F.lit("left")).unionByName(keys.key_counts(pair(spark, d)[1], ["o_custkey"]).withColumn("side", F.lit("right"))),
        "composite_key_diff": lambda spark, d: _by_flag(spark, d).cells(),
        "excluded_columns": on_pair(lambda c: c.column_stats(0.0), exclude=["o_orderdate", "o_totalprice"]),
        "strict_text_rules": on_pair(lambda c: c.cells(), values=["o_orderpriority"], rules=coerce.TextRules(False, False)),
        "column_stats_exact": on_pair(lambda c: c.column_stats(0.0)),
        "mapped_from_right": lambda spark, d: _mapped_back(spark, d).cells(0.01),
    }


def oracle_sql() -> dict[str, str]:
    j = f"WITH {PAIR_SQL}, {_joined(ENTIRE_COLUMN_VALUES)}"
    annotated = _annotated_sql()
    shift = f"WITH {_shifted_sql()}"
    tx = f"WITH {TEXTS_SQL} "
    lone = lambda a, b: f"WITH {PAIR_SQL} SELECT * FROM {a} WHERE NOT EXISTS (SELECT 1 FROM {b} WHERE {b}.o_orderkey = {a}.o_orderkey)"
    candidate = lambda cols: f"SELECT '{'+'.join(cols)}' AS key, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_values, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(0 AS BIGINT) AS null_rows FROM (SELECT count(*) AS n FROM conversations GROUP BY {', '.join(cols)})"
    unique = lambda t, cols: f"SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS unique_values, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(0 AS BIGINT) AS null_rows FROM (SELECT count(*) AS n FROM {t} GROUP BY {cols})"
    dup = lambda t, cols: f"SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {t})) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {t})) AS duplicate_rows FROM {t}"
    profile_of = lambda c, kind: f"SELECT '{c}' AS column_name, '{kind}' AS data_type, count(*) AS row_count, count({c}) AS non_null_count, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent, count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS cardinality, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer"
    stats_of = lambda c: f"SELECT '{c}' AS column_name, avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, min({c}::DOUBLE) AS min, max({c}::DOUBLE) AS max, quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75 FROM orders"
    pairs_of = lambda a, b: f"SELECT '{a}+{b}' AS columns, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM conversations)) AS unique_count, (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM conversations)) = count(*) AS is_unique FROM conversations"
    mapped = """M AS (SELECT s_suppkey AS k, s_acctbal AS a, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 10 ELSE s_acctbal END AS b FROM supplier)"""
    return {
        "diff_summary": _summary_sql(),
        "diff_match_count": f"{j} SELECT count(*) AS matched_rows FROM J",
        "only_in_left": lone("L", "R"),
        "only_in_right": lone("R", "L"),
        "summary_rates": f"SELECT match_rate, left_coverage, right_coverage, difference_rate FROM ({_summary_sql()})",
        "value_diff_rows_tol": f'{j} SELECT k AS "Key" FROM J WHERE {_any_differs(0.01)}',
        "value_diff_rows_exact": f'{j} SELECT k AS "Key" FROM J WHERE {_any_differs(0)}',
        "value_diff_cells": f"{j}, {_cells_sql(0)} SELECT * FROM C",
        "value_diff_typed": f'{j}, {_cells_sql(0.01)} SELECT "Differing Column", "Difference Type", count(*) AS cells FROM C GROUP BY ALL',
        "column_stats": f"{j}, {_stats_sql(0.01)} SELECT * FROM S",
        "annotated_cells": f"{annotated} SELECT * FROM A",
        "entire_column_flags": f"{shift} SELECT * FROM A",
        "hybrid_full_export": _full_sql(shift),
        "smart_preview": _preview_sql(shift, 60, 10),
        "simple_preview": f'{annotated} SELECT * FROM A ORDER BY "Key", "Differing Column" LIMIT 500',
        "plain_preview": f'{j}, {_cells_sql(0)} SELECT * FROM C ORDER BY "Key", "Differing Column" LIMIT 200',
        "audit_export": f"{annotated} SELECT *, 'row_level_audit' AS audit_type FROM A",
        "column_mapped_diff": f"WITH {mapped} SELECT k AS \"Key\", 'Balance' AS \"Differing Column\", CAST(a AS VARCHAR) AS \"Left Value\", CAST(b AS VARCHAR) AS \"Right Value\", 'Different Values' AS \"Difference Type\" FROM M WHERE abs(a - b) > 0.01",
        "renamed_columns_diff": f"WITH {mapped}, T AS (SELECT count(*) AS n, count(*) FILTER (WHERE abs(a - b) > 0.01) AS d FROM M) SELECT n AS total_left, n AS total_right, n AS matched_rows, 0::BIGINT AS only_in_left, 0::BIGINT AS only_in_right, d AS value_differences, d AS value_differences_exact, 100.0::DOUBLE AS match_rate, 100.0::DOUBLE AS left_coverage, 100.0::DOUBLE AS right_coverage, round(100.0::DOUBLE * d / n, 2) AS difference_rate FROM T",
        "multi_column_wide_diff": WIDE_SQL,
        "null_key_handling": f"WITH {PAIR_SQL}, M AS (SELECT count(*) AS m FROM L JOIN R USING (o_orderkey) WHERE o_orderkey % 30 <> 1) SELECT (SELECT count(*) FROM L) AS total_left, (SELECT count(*) FROM R) AS total_right, m AS matched_rows, (SELECT count(*) FROM L) - m AS only_in_left, (SELECT count(*) FROM R) - m AS only_in_right FROM M",
        "key_uniqueness_single": unique("orders", "o_custkey"),
        "key_uniqueness_composite": unique("lineitem", "l_orderkey, l_linenumber"),
        "key_candidates_verdict": " UNION ALL ".join(map(candidate, (["conv_id"], ["turn"], ["conv_id", "turn"]))),
        "duplicate_examples": "SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY duplicate_count DESC, l_orderkey, l_linenumber LIMIT 10",
        "coerce_numeric": "SELECT o_orderkey, TRY_CAST(trim(' ' || o_custkey || '.50 ') AS DOUBLE) AS number FROM orders",
        "coerce_currency": f"{tx} SELECT id, {sql_number('money')} AS number FROM X",
        "coerce_date": f"{tx} SELECT id, {sql_time('day')} AS moment FROM X",
        "coerce_boolean": f"{tx} SELECT id, CASE WHEN lower(flag) IN ('true','t','yes') THEN TRUE WHEN lower(flag) IN ('false','f','no') THEN FALSE END AS yes_no FROM X",
        "coerce_string": f"""{tx} SELECT id, {sql_text("'''' || path || '\"'")} AS plain FROM X""",
        "strip_hierarchy": f"{tx} SELECT id, CASE WHEN contains(path, ':') THEN trim(split_part(path, ':', -1)) ELSE path END AS leaf FROM X",
        "collapse_spaces": rf"{tx} SELECT id, trim(regexp_replace(path, '\s+', ' ', 'g')) AS plain FROM X",
        "currency_to_decimal": f"{tx} SELECT id, TRY_CAST(CASE WHEN money LIKE '(%)' THEN '-' || replace(replace(money, '(', ''), ')', '') ELSE replace(replace(money, '$', ''), ',', '') END AS DECIMAL(18,2))::DOUBLE AS amount FROM X",
        "currency_to_float": f"{tx} SELECT id, TRY_CAST(CASE WHEN money LIKE '(%)' THEN '-' || replace(replace(money, '(', ''), ')', '') ELSE replace(replace(money, '$', ''), ',', '') END AS DOUBLE) AS amount FROM X",
        "boolean_t_f": f"{tx} SELECT id, CASE WHEN lower(flag) IN ('t','true','1','yes') THEN 't' WHEN lower(flag) IN ('f','false','0','no') THEN 'f' END AS flag FROM X",
        "unicode_clean": r"SELECT doc_id, trim(regexp_replace(translate(strip_accents(text), '–—', '--'), '\s+', ' ', 'g')) AS plain FROM documents",
        "text_normalize": r"SELECT doc_id, nullif(trim(regexp_replace(translate(nfc_normalize(text), '`´–—‐', '''''---'), '\s+', ' ', 'g')), '') AS plain FROM documents",
        "upper_lower_round": "SELECT p_partkey, upper(p_name) AS upper, lower(p_brand) AS lower, round(p_retailprice, 2) AS numeric_round FROM part",
        "validate_nulls": f"WITH {PAIR_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS null_percent FROM R" for c in ["o_orderkey", *ENTIRE_COLUMN_VALUES]),
        "validate_duplicates": dup("lineitem", "l_orderkey, l_linenumber, l_returnflag"),
        "full_row_duplicates": dup("orders", "*"),
        "profile_columns": " UNION ALL ".join(profile_of(c, k) for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"))),
        "profile_percentiles": f"{stats_of('o_totalprice')} UNION ALL {stats_of('o_custkey')}",
        "profile_top_values": "SELECT o_orderpriority AS value, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 3",
        "profile_outliers": "WITH Q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id AS key, value FROM events, Q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)",
        "profile_patterns": f"WITH {SHAPED_SQL} " + " UNION ALL ".join(map(_pattern_sql, SHAPED)),
        "key_candidates": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) = count(*) AS is_unique FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")),
        "composite_candidates": " UNION ALL ".join(pairs_of(a, b) for a, b in (("conv_id", "turn"), ("conv_id", "role"), ("turn", "role"))),
        "value_overlap": "SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS left_distinct, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_distinct, (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS shared",
        "custom_sql_source": "SELECT p_brand, count(*) AS parts, max(p_size) AS largest FROM part GROUP BY p_brand",
        "cutoff_filter": "SELECT count(*) AS kept, max(o_orderdate) AS latest FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30'",
        "cutoff_text_dates": f"{tx} SELECT id FROM X WHERE id % 3 <> 0",
        "normalize_boolean": f"{tx} SELECT id, CASE WHEN lower(trim(flag)) IN ('t','true','1','yes','y') THEN 't' WHEN lower(trim(flag)) IN ('f','false','0','no','n') THEN 'f' END AS flag FROM X",
        "boolean_keep_yes_no": f"{tx} SELECT id, CASE WHEN lower(flag) IN ('yes','no') THEN lower(flag) WHEN lower(flag) IN ('t','true','1') THEN 't' WHEN lower(flag) IN ('f','false','0') THEN 'f' END AS flag FROM X",
        "safe_cast": f"{tx} SELECT id, CASE WHEN flag IN ('0', '1') THEN flag END AS number FROM X",
        "display_text": f"{tx} SELECT id, replace(replace(replace(replace(path || '{BROKEN}', chr(160), ' '), chr(195) || chr(169), 'é'), chr(226) || chr(8364) || chr(8482), chr(39)), chr(226) || chr(8364) || chr(34), '—') AS shown FROM X",
        "text_equality": f"{tx} SELECT id, id % 2 = 0 AS same FROM X",
        "frame_normalize": "SELECT p_partkey, p_name, p_brand FROM part",
        "collision_safe_rename": "SELECT p_partkey AS part_key, p_name AS part_key_2, p_brand AS part_key_3 FROM part",
        "csv_round_trip": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', \"quoted\"' || chr(10) || 'line' AS p_name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS p_brand FROM part",
        "validate_schema": f"{tx} SELECT 'WARNING' AS severity, 'schema' AS category, c AS column_name, n AS count FROM (SELECT 'money' AS c, count({sql_number('money')}) AS n, count(money) AS filled FROM X UNION ALL SELECT 'flag', count({sql_number('flag')}), count(flag) FROM X UNION ALL SELECT 'path', count({sql_number('path')}), count(path) FROM X) WHERE n > 0 AND n < filled",
        "validate_types": "SELECT 'WARNING' AS severity, 'dtype' AS category, 'o_orderkey' AS column_name, CAST(NULL AS BIGINT) AS count UNION ALL SELECT 'INFO', 'dtype', 'o_custkey', NULL FROM orders HAVING count(o_custkey) = count(*)",
        "validate_keys": f"WITH {PAIR_SQL} SELECT 'ERROR' AS severity, 'key' AS category, 'o_orderstatus' AS column_name, count(*) AS count FROM R WHERE o_orderstatus IS NULL HAVING count(*) > 0 UNION ALL SELECT 'WARNING', 'key', NULL, count(*) FROM (SELECT o_orderstatus FROM R WHERE o_orderstatus IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0",
        "type_histogram": "SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END AS data_type, count(*) AS columns FROM (DESCRIBE SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer) GROUP BY 1",
        "empty_relation_guard": "SELECT o_orderkey AS \"Key\", '' AS \"Differing Column\", '' AS \"Left Value\", '' AS \"Right Value\", '' AS \"Difference Type\" FROM orders WHERE FALSE",
        "only_in_limited": f"SELECT * FROM ({lone('L', 'R')}) ORDER BY o_orderkey LIMIT 50",
        "only_in_null_keys": f"WITH {PAIR_SQL} SELECT CASE WHEN o_orderkey % 30 <> 1 THEN CAST(o_orderkey AS VARCHAR) END AS k, o_orderstatus FROM L WHERE o_orderkey % 30 = 1 OR o_orderkey NOT IN (SELECT o_orderkey FROM R)",
        "two_sided_key_check": f"WITH {PAIR_SQL} SELECT 'left' AS side, * FROM ({unique('L', 'o_custkey')}) UNION ALL SELECT 'right', * FROM ({unique('R', 'o_custkey')})",
        "composite_key_diff": "SELECT l_orderkey || ' | ' || l_returnflag AS \"Key\", 'lines' AS \"Differing Column\", CAST(n AS VARCHAR) AS \"Left Value\", CASE WHEN l_orderkey % 8 <> 0 THEN CAST(n + 1 AS VARCHAR) END AS \"Right Value\", CASE WHEN l_orderkey % 8 = 0 THEN 'Missing in Right' ELSE 'Different Values' END AS \"Difference Type\" FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) WHERE l_orderkey % 4 = 0",
        "excluded_columns": f"{j}, {_stats_sql(0)} SELECT * FROM S WHERE column_name NOT IN ('o_orderdate', 'o_totalprice')",
        "strict_text_rules": f"WITH {PAIR_SQL}, {_joined(['o_orderpriority'])} SELECT k AS \"Key\", 'o_orderpriority' AS \"Differing Column\", l_o_orderpriority AS \"Left Value\", r_o_orderpriority AS \"Right Value\", 'Different Values' AS \"Difference Type\" FROM J WHERE l_o_orderpriority <> r_o_orderpriority",
        "column_stats_exact": f"{j}, {_stats_sql(0)} SELECT * FROM S",
        "mapped_from_right": f"WITH {mapped} SELECT ' ' || k || ' ' AS \"Key\", 'vendor_balance' AS \"Differing Column\", CAST(b AS VARCHAR) AS \"Left Value\", CAST(a AS VARCHAR) AS \"Right Value\", 'Different Values' AS \"Difference Type\" FROM M WHERE abs(a - b) > 0.01",
    }
