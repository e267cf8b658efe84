"""Data checks: each returns its violations, and an empty result is a pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most days between two quotes of a currency (fixed value).
MOST_GAP_DAYS = 5


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent row."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def accepted_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def unmasked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) of personal data that is no hex digest: one pass over all columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("p")).select("p.*").where("value is not null and not value rlike '^[0-9a-f]{64}$'")


def fx_gaps(rates: DataFrame, most: int = MOST_GAP_DAYS) -> DataFrame:
    """Quotes that follow the one before by more than ``most`` days."""
    w = Window.partitionBy("currency").orderBy("quote_date")
    gap = rates.select("currency", "quote_date").distinct().withColumn("previous", F.lag("quote_date").over(w))
    days = F.datediff("quote_date", "previous").cast("long")
    return gap.where(days > most).select(F.lit("gap between quotes").alias("problem"), "currency", F.col("previous").alias("from_date"), F.col("quote_date").alias("to_date"), days.alias("days"))


def fx_tail(needed: DataFrame, rates: DataFrame, most: int = MOST_GAP_DAYS) -> DataFrame:
    """Currencies whose last needed day is more than ``most`` days after their last quote, or that have none.

    needed: (currency, day).
    """
    need = needed.groupBy("currency").agg(F.max("day").alias("needed"))
    have = rates.groupBy("currency").agg(F.max("quote_date").alias("available"))
    days = F.datediff("needed", "available").cast("long")
    return need.join(have, "currency", "left").where(F.col("available").isNull() | (days > most)).select(F.lit("no quote up to the last payment").alias("problem"), "currency", F.col("available").alias("from_date"), F.col("needed").alias("to_date"), days.alias("days"))


def fx_coverage(needed: DataFrame, rates: DataFrame, most: int = MOST_GAP_DAYS) -> DataFrame:
    return fx_gaps(rates, most).unionByName(fx_tail(needed, rates, most))


def freshness(df: DataFrame, column: str, as_of: Column | datetime, warn_minutes: int = 10, error_minutes: int = 30) -> DataFrame:
    """One row: the last time, its age in seconds at ``as_of`` and a status. There is no clock in it."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 1_000_000
    return df.agg(F.max(column).alias("last_at")).select("last_at", F.floor(age).cast("long").alias("age_seconds")).withColumn("status", F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > error_minutes * 60), "error").when(F.col("age_seconds") > warn_minutes * 60, "warn").otherwise("pass"))


def fingerprint(df: DataFrame, columns: list[str], leaf: int = 4096, depth: int = 3) -> DataFrame:
    """One row: count and md5 of all rows in order, the same for the same rows in any order and partitioning.

    Rows are digested alone, and digests are hashed in a tree by their prefixes, three hex digits a
    level: what meets in one place are about ``leaf`` digests, whatever the table. The depth follows
    from the count, so equal tables have equal trees; it is ``depth`` at least, a multiple of three.
    Copies of one row count as often as they are.
    """
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]))
    total = df.count()
    while total > leaf * 16**depth:
        depth += 3
    copies = df.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    told = F.when(F.col("n") == 1, F.col("h")).otherwise(F.concat_ws("x", "h", "n"))
    cells = copies.select(F.substring("h", 1, depth).alias("cell"), "n", told.alias("h"))
    for level in range(depth, -1, -3):
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "h"))), lambda s: s["h"]), "|")
        cells = cells.groupBy(F.substring("cell", 1, level).alias("up") if level else F.lit("").alias("up")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.md5(whole).alias("h")).withColumnRenamed("up", "cell")
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.max("h"), F.md5(F.lit(""))).alias("digest"))


def reconcile(log_keys: DataFrame, source_keys: DataFrame) -> DataFrame:
    """(key, problem): keys inserted in the log but not in the source, and the reverse."""
    a, b = log_keys.toDF("key").distinct(), source_keys.toDF("key").distinct()
    return a.join(b, "key", "left_anti").withColumn("problem", F.lit("not in source")).unionByName(b.join(a, "key", "left_anti").withColumn("problem", F.lit("not in log")))


def all_present(*probes: DataFrame) -> DataFrame:
    """One row: whether each probe has a row."""
    each = [p.limit(1).select(F.lit(i).alias("probe")) for i, p in enumerate(probes)]
    every = each[0]
    for p in each[1:]:
        every = every.unionByName(p)
    return every.agg((F.count_distinct("probe") == len(probes)).alias("ready"))
