"""Dimensions and facts of a star schema over a cleaned history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar

#: A dimension's first version opens here, so facts from before it are covered.
BEGINNING = "1900-01-01 00:00:00"


def surrogate(*parts: Column) -> Column:
    """md5 of the parts as text, joined by a bar; null if any part is null."""
    text = [p.cast("string") for p in parts]
    joined = text[0]
    for p in text[1:]:
        joined = F.concat(joined, F.lit("|"), p)
    return F.md5(joined)


def collapse_transactions(rows: DataFrame, keys: list[str], order: str, transaction: list[str]) -> DataFrame:
    """The last version of each key in each transaction."""
    w = Window.partitionBy(*keys, *transaction).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def scd2(rows: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """Adds valid_from, valid_to (half open), first_seen_at and is_current; the first version opens at BEGINNING."""
    w = Window.partitionBy(*keys).orderBy(order)
    kind = rows.schema[time].dataType
    return rows.withColumns({
        "valid_from": F.when(F.lag(order).over(w).isNull(), F.lit(BEGINNING).cast(kind)).otherwise(F.col(time)),
        "valid_to": F.lead(time).over(w),
        "first_seen_at": F.col(time),
        "is_current": F.lead(order).over(w).isNull(),
    })


def as_of(facts: DataFrame, versions: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Facts with ``columns`` of the version of their key that held at their time; nulls if there is none.

    An equality on the key with the range as residual: Catalyst picks a broadcast, hash or merge
    join by size and splits skewed keys.
    """
    v = versions.select(F.col(key).alias("__key"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), *columns)
    held = (F.col("__key") == F.col(key)) & (F.col(time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(time) < F.col("__to")))
    return facts.join(v, held, "left").drop("__key", "__from", "__to")


def currencies(*sources: DataFrame, base: str) -> DataFrame:
    """All currencies of one-column frames, with a key and whether each is the base."""
    every = sources[0].toDF("currency")
    for s in sources[1:]:
        every = every.union(s.toDF("currency"))
    return every.distinct().select(surrogate(F.col("currency")).alias("currency_sk"), "currency", (F.col("currency") == base).alias("is_base_currency"))


def dates(*sources: DataFrame) -> DataFrame:
    """A row for every day from the first to the last date of one-column frames."""
    every = sources[0].toDF("d")
    for s in sources[1:]:
        every = every.unionByName(s.toDF("d"))
    bounds = every.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return calendar.date_parts(calendar.date_spine(bounds, "a", "b"))


def payments_fact(payments: DataFrame, customers: DataFrame, merchants: DataFrame, days: DataFrame, money: DataFrame, rates: DataFrame, strict: bool = False, base: str = "BRL") -> DataFrame:
    """Live payments with the keys of their dimensions and the amount in the base currency.

    customers are versions, joined as of the payment; the rate is that of the payment's very day. A
    missing rate counts as 1, as the contract of this fact has it, and ``rate_missing`` tells; with
    ``strict`` the amount is null then.
    """
    from .fx import convert

    day = F.to_date("created_at")
    live = payments.where("not is_deleted").withColumn("__day", day)
    with_customer = as_of(live, customers, "customer_id", "created_at", ["customer_sk"])
    joined = (
        with_customer.join(merchants.select("merchant_id", "merchant_sk"), "merchant_id", "left")
        .join(days.select(F.col("date_day").alias("__day"), "date_sk"), "__day", "left")
        .join(money.select("currency", "currency_sk"), "currency", "left")
        .join(rates.select("currency", F.col("quote_date").alias("__day"), "rate_brl"), ["currency", "__day"], "left")
    )
    amount = convert(F.col("amount"), F.col("rate_brl"), F.col("currency") == base, strict)
    missing = (F.col("currency") != base) & F.col("rate_brl").isNull()
    return joined.select(surrogate(F.col("payment_id")).alias("payment_sk"), "customer_sk", "merchant_sk", "date_sk", "currency_sk", "payment_id", F.col("amount").alias("amount_original"), amount.alias("amount_brl"), missing.alias("rate_missing"), "currency", "status", "created_at")
