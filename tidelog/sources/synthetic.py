"""Change logs made of tables: initial snapshots, and seeded synthetic changes for fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lsn import format_lsn
from ..operators.contracts import Contract

# Fixed values of the synthetic source: what its columns may hold, and how often a payment brings further changes.
STATUSES = ("authorized", "captured", "refunded", "failed")
CURRENCIES = ("BRL", "USD", "EUR")
CATEGORIES = ("retail", "marketplace", "services", "travel")
UPDATED, RENAMED, TOUCHED = 0.4, 0.1, 0.05


def text_map(columns: list[str]) -> Column:
    """A row as a map of text, as the log holds it."""
    return F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))


def snapshot(table: DataFrame, contract: Contract, position: int, time: Column, system_id: str) -> DataFrame:
    """A table's present rows as inserts at one position of the log, from before its first change.

    A stream carries changes made after it began only; with a snapshot before it, rows that never
    change are there too. Rows that the stream then inserts again are later versions.
    """
    return table.select(
        F.lit("snapshot").alias("source"), F.lit(system_id).alias("source_system_id"), format_lsn(F.lit(position).cast("long")).alias("lsn"), F.lit(position).cast("long").alias("lsn_numeric"), F.lit(0).cast("long").alias("xid"),
        time.alias("commit_time"), F.lit("insert").alias("action"), F.lit(contract.namespace).alias("schema_name"), F.lit(contract.table).alias("table_name"), text_map(contract.keys).alias("key"), F.lit(None).cast("map<string,string>").alias("before"), text_map(contract.names).alias("after"),
    )


def draw(seed: int, tag: str, *keys: Column) -> Column:
    """A number from 0 to 1 that follows from a seed, a tag and keys alone."""
    text = F.concat_ws("|", F.lit(f"{seed}|{tag}"), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def synthetic_changes(spark: SparkSession, payments: int, customers: int, merchants: int, seed: int = 1) -> DataFrame:
    """(step, kind, table_name, action, key_id, amount_cents, currency, status) of a seeded load, in the order of step and kind.

    Each step inserts a payment; with fixed chances it also updates the status of one of the last
    fifty, renames a customer, and touches a merchant. Every choice is a draw from its step, so any
    part of the load can be made anywhere, and again.
    """
    n = F.col("step")
    u = lambda tag: draw(seed, tag, n)
    of = lambda tag, size: (F.floor(u(tag) * size) + 1).cast("long")
    none = lambda kind: F.lit(None).cast(kind)

    def change(kind: int, table: str, action: str, key: Column, amount=None, currency=None, status=None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(table).alias("table_name"), F.lit(action).alias("action"), key.cast("long").alias("key_id"), (none("long") if amount is None else amount.cast("long")).alias("amount_cents"), (none("string") if currency is None else currency).alias("currency"), (none("string") if status is None else status).alias("status"))

    recent = n - F.floor(u("recent") * F.least(n, F.lit(50))).cast("long")
    each = F.array(
        change(0, "payments", "insert", n, F.floor(F.lit(500) + u("amount") * 499_500), pick(CURRENCIES, u("currency")), F.lit("pending")),
        F.when(u("updated") < UPDATED, change(1, "payments", "update", recent, status=pick(STATUSES, u("status")))),
        F.when(u("renamed") < RENAMED, change(2, "customers", "update", of("customer", customers))),
        F.when(u("touched") < TOUCHED, change(3, "merchants", "update", of("merchant", merchants))),
    )
    steps = spark.range(1, payments + 1).withColumnRenamed("id", "step")
    return steps.select("step", F.explode(F.array_compact(each)).alias("c")).select("step", "c.*")
