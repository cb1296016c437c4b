"""A synthetic table and its altered partner, made row by row from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names to draw from.
FIRST = ("Anna", "Ben", "Carla", "David", "Elena", "Felix")
LAST = ("Meyer", "Novak", "Olsen", "Perez", "Rossi", "Smith")
DEPARTMENTS = ("Sales", "Finance", "Engineering", "Support")


def _draw(salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n))


def _pick(values: tuple[str, ...], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(salt, len(values)) + 1).cast("int"))


def base_table(spark: SparkSession, rows: int, metrics: int = 5) -> DataFrame:
    """Customers with awkward text: double spaces, currency, accents, hierarchies, mixed booleans."""
    every = lambda n: F.col("id") % n == 0
    df = spark.range(1, rows + 1)
    first, last = _pick(FIRST, 1), _pick(LAST, 2)
    amount = (_draw(3, 1_000_000) / 100).cast("decimal(12,2)")
    return df.select(
        "id",
        F.format_string("CUST%08d", "id").alias("customer_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(first, F.when(every(10), "  ").otherwise(" "), last).alias("full_name"),
        F.concat(F.lower(first), F.when(every(20), "é").otherwise(""), F.col("id").cast("string"), F.lit("@example.com")).alias("email"),
        (_draw(4, 60) + 18).cast("int").alias("age"),
        (_draw(5, 10_000_000) / 100 - 20000).alias("account_balance"),
        F.when(every(3), F.concat(F.lit("$"), F.format_number(amount, 2))).otherwise(amount.cast("string")).alias("transaction_amount"),
        _pick(("T", "F", "true", "false", "1", "0"), 6).alias("is_active"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), _draw(7, 1500).cast("int")), "yyyy-MM-dd").alias("created_date"),
        F.when(every(5), F.concat(F.lit("Company : "), _pick(DEPARTMENTS, 8))).otherwise(_pick(DEPARTMENTS, 8)).alias("department"),
        *[(_draw(20 + i, 100_000) / 1000).alias(f"metric_{i + 1}") for i in range(metrics)],
    )


def altered(df: DataFrame) -> DataFrame:
    """The partner: 5 % of rows gone, 10 % changed, 5 % new (ids beyond the largest)."""
    lot = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(100))
    kept = df.where(lot >= 5)
    changed = kept.withColumns(
        {
            "account_balance": F.when(lot.between(5, 14), F.col("account_balance") + 100).otherwise(F.col("account_balance")),
            "email": F.when(lot.between(10, 14), F.upper("email")).otherwise(F.col("email")),
        }
    )
    top = df.agg(F.max("id").alias("top"))
    new = df.where(lot >= 95).join(F.broadcast(top)).withColumn("id", F.col("id") + F.col("top")).drop("top")
    return changed.unionByName(new)
