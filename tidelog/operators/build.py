"""Materialising: cleaned histories, staging views, dimensions and facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import dimensions, fx
from .contracts import CUSTOMERS, MERCHANTS, PAYMENTS, Contract
from .history import build_history

BASE = "BRL"


def overwrite(df: DataFrame, path: str) -> int:
    """Replaces the whole table at a path, and returns its rows as the write itself observed them."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").parquet(path)
    return seen.get["n"]


def build_histories(spark: SparkSession, log: DataFrame, root: str, mask: Callable[[Column], Column], contracts: tuple[Contract, ...] = (CUSTOMERS, MERCHANTS, PAYMENTS), validate: bool = True) -> dict[str, int]:
    """Rebuilds the cleaned history of each contract's table under ``root``; rows by table. A table that the log lacks gets an empty history."""
    return {c.table: overwrite(build_history(log.where(F.col("table_name") == c.table), c, mask, validate=validate), f"{root}/{c.table}") for c in contracts}


def current(history: DataFrame, contract: Contract) -> DataFrame:
    """Staging of a table of which only the present state counts: the current version of each key, deleted ones marked."""
    return history.where("is_current").select(*contract.names, "is_deleted", "change_lsn_numeric", "change_commit_time")


def versions(history: DataFrame, contract: Contract) -> DataFrame:
    """Staging of a table of which every version counts: the last one in each transaction."""
    once = dimensions.collapse_transactions(history, contract.keys, "change_lsn_numeric", ["change_xid", "change_commit_time"])
    return once.select(*contract.names, "is_deleted", "change_lsn_numeric", "change_commit_time")


def dim_merchant(staged: DataFrame) -> DataFrame:
    """One row a merchant, overwritten in place (no versions); deleted ones stay and say so."""
    return staged.select(dimensions.surrogate(F.col("merchant_id")).alias("merchant_sk"), "merchant_id", "legal_name", "category", "country", "is_deleted")


def dim_customer(staged: DataFrame) -> DataFrame:
    """A row for each version of a customer, with the time in which it held."""
    v = dimensions.scd2(staged, ["customer_id"], "change_lsn_numeric", "change_commit_time")
    sk = dimensions.surrogate(F.col("customer_id"), F.col("change_lsn_numeric")).alias("customer_sk")
    return v.select(sk, "customer_id", "full_name", "email", "cpf", "valid_from", "valid_to", "first_seen_at", "is_current", "is_deleted")


def gold(customers: DataFrame, merchants: DataFrame, payments: DataFrame, rates: DataFrame, base: str = BASE) -> dict[str, DataFrame]:
    """Dimensions and the fact, by name, from cleaned histories and rates (currency, quote_date, rate_brl)."""
    paid = current(payments, PAYMENTS)
    customer = dim_customer(versions(customers, CUSTOMERS))
    merchant = dim_merchant(current(merchants, MERCHANTS))
    money = dimensions.currencies(paid.select("currency"), rates.select("currency"), base=base)
    days = dimensions.dates(paid.select(F.to_date("created_at")), rates.select("quote_date"))
    fact = dimensions.payments_fact(paid, customer, merchant, days, money, rates, base=base)
    return {"dim_customer": customer, "dim_merchant": merchant, "dim_currency": money, "dim_date": days, "fct_payment": fact}


def build_gold(spark: SparkSession, histories: str, rates: DataFrame, root: str, base: str = BASE) -> dict[str, int]:
    """Staging as views over the histories, dimensions and the fact as tables under ``root``; rows by table."""
    read = {c.table: spark.read.parquet(f"{histories}/{c.table}") for c in (CUSTOMERS, MERCHANTS, PAYMENTS)}
    current(read["payments"], PAYMENTS).createOrReplaceTempView("stg_payments")
    current(read["merchants"], MERCHANTS).createOrReplaceTempView("stg_merchants")
    versions(read["customers"], CUSTOMERS).createOrReplaceTempView("stg_customers")
    rates.createOrReplaceTempView("stg_fx_rates")
    tables = gold(read["customers"], read["merchants"], read["payments"], rates, base)
    return {name: overwrite(df, f"{root}/{name}") for name, df in tables.items()}


def rebuild(spark: SparkSession, log: DataFrame, observations: DataFrame, root: str, mask: Callable[[Column], Column], base: str = BASE) -> dict[str, int]:
    """Histories, then dimensions and the fact, all rebuilt from the log: the same inputs give the same tables. Rows by table."""
    rows = build_histories(spark, log, f"{root}/silver", mask)
    quoted = fx.merge(observations, observations.limit(0)).select("currency", "quote_date", "rate_brl")
    return rows | build_gold(spark, f"{root}/silver", quoted, f"{root}/gold", base)
