"""The given tables as inputs of the engine: a change log, payments, rates and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lsn import format_lsn
from ..operators.contracts import Attribute, Contract
from ..sources.tables import table

#: The contract of the log made from ``events``.
EVENTS = Contract("events", (Attribute("user_id", "int8", key=True), Attribute("event_type", "text"), Attribute("v", "numeric", precision=14, scale=2), Attribute("p", "text", pii=True)))
BASE_CURRENCY = "P"
TRUNCATE_EVERY = 4999


def change_log(spark: SparkSession, sf_dir: str, truncates: bool = True) -> DataFrame:
    """events as a change log: error deletes, signup inserts, other types update; ``v`` is there for signup and
    purchase, ``p`` for click, else unchanged; every 4999th event truncates too."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    user = F.col("user_id").cast("string")
    has_v, has_p = F.col("event_type").isin("signup", "purchase"), F.col("event_type") == "click"
    def entry(name: str, value, there):
        return F.struct(F.lit(name).alias("k"), value.alias("v"), there.alias("here"))

    entries = F.array(
        entry("user_id", user, F.lit(True)),
        entry("event_type", F.col("event_type"), F.lit(True)),
        entry("v", F.col("value").cast("decimal(14,2)").cast("string"), has_v),
        entry("p", F.col("props"), has_p),
    )
    here = F.filter(entries, lambda x: x["here"])
    after = F.when(action != "delete", F.map_from_arrays(F.transform(here, lambda x: x["k"]), F.transform(here, lambda x: x["v"])))
    common = [F.lit("1").alias("source_system_id"), format_lsn(F.col("event_id")).alias("lsn"), F.col("event_id").alias("lsn_numeric"), F.dayofmonth("ts").cast("long").alias("xid"), F.col("ts").alias("commit_time")]
    changes = e.select(*common, action.alias("action"), F.lit("events").alias("table_name"), F.create_map(F.lit("user_id"), user).alias("key"), after.alias("after"))
    if not truncates:
        return changes
    none = F.lit(None).cast("map<string,string>")
    cut = e.where(F.col("event_id") % TRUNCATE_EVERY == 0).select(*common, F.lit("truncate").alias("action"), F.lit("events").alias("table_name"), none.alias("key"), none.alias("after"))
    return changes.unionByName(cut)


def replayed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as taken in at least once: a tenth of them twice."""
    e = table(spark, sf_dir, "events")
    return e.unionByName(e.where("event_id % 10 = 0"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"), F.col("o_orderstatus").alias("currency"), F.col("o_orderpriority").alias("status"), F.col("o_orderdate").alias("created_at"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes by line status and working day; the base currency is never quoted."""
    day = F.to_date("l_shipdate")
    line = table(spark, sf_dir, "lineitem").where(F.weekday(day) < 5)
    return line.groupBy(F.col("l_linestatus").alias("currency"), day.alias("quote_date")).agg((F.lit(1) + F.max(F.col("l_discount").cast("decimal(18,8)"))).cast("decimal(18,8)").alias("rate_brl"))


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, transaction and its last change, typed, ready for scd2."""
    from ..operators.dimensions import collapse_transactions
    from ..operators.history import build_history

    history = build_history(change_log(spark, sf_dir), EVENTS, lambda c: c, validate=False)
    return collapse_transactions(history, ["user_id"], "change_lsn_numeric", ["change_xid", "change_commit_time"])


def source_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of all three source tables.

    customer, supplier and orders rows are inserted; every third customer is renamed and every
    fiftieth deleted, every fourth merchant changes its category, and every payment its status, but
    every fortieth, which is deleted. A tenth of the rows come twice.
    """
    none = F.lit(None).cast("map<string,string>")

    def entries(**values) -> Column:
        return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.cast("string") for v in values.values()]))

    def change(k: int, action: str, key: Column, after: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(action).alias("action"), key.alias("key"), after.alias("after"))

    def log(rows: DataFrame, name: str, base: int, number: Column, time: Column, changes: list[Column]) -> DataFrame:
        each = rows.select(number.alias("number"), time.alias("time"), F.explode(F.array_compact(F.array(*changes))).alias("c"))
        position = F.lit(base).cast("long") + F.col("number") * 10 + F.col("c.k")
        return each.select(
            F.lit("7").alias("source_system_id"), F.lit("public").alias("schema_name"), F.lit(name).alias("table_name"), F.col("c.action").alias("action"), position.alias("lsn_numeric"), format_lsn(position).alias("lsn"),
            position.alias("xid"), (F.col("time") + F.make_dt_interval(days=F.col("c.k"))).alias("commit_time"), F.col("c.key").alias("key"), F.col("c.after").alias("after"),
        )

    start = F.lit("1994-01-01 00:00:00").cast("timestamp")
    stamp = F.lit("1994-01-01 00:00:00")
    c, ck = table(spark, sf_dir, "customer"), F.col("c_custkey")
    key = entries(customer_id=ck)
    cpf = F.lpad(ck.cast("string"), 11, "0")
    customers = log(c, "customers", 1_000_000_000, ck, start, [
        change(0, "insert", key, entries(customer_id=ck, full_name=F.col("c_name"), email=F.concat("c_name", F.lit("@example.invalid")), cpf=cpf, created_at=stamp, updated_at=stamp)),
        F.when(ck % 3 == 0, change(1, "update", key, entries(customer_id=ck, full_name=F.concat("c_name", F.lit(".")), updated_at=stamp))),
        F.when(ck % 50 == 0, change(2, "delete", key, none)),
    ])
    s, sk = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    key = entries(merchant_id=sk)
    merchants = log(s, "merchants", 2_000_000_000, sk, start, [
        change(0, "insert", key, entries(merchant_id=sk, legal_name=F.col("s_name"), category=F.lit("retail"), country=F.lit("BR"), created_at=stamp, updated_at=stamp)),
        F.when(sk % 4 == 0, change(1, "update", key, entries(merchant_id=sk, category=F.lit("travel"), updated_at=stamp))),
    ])
    o, ok = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = entries(payment_id=ok)
    made = F.col("o_orderdate").cast("timestamp")
    payments = log(o, "payments", 3_000_000_000, ok, made, [
        change(0, "insert", key, entries(payment_id=ok, customer_id=F.col("o_custkey"), merchant_id=ok % 100 + 1, amount=F.col("o_totalprice").cast("decimal(14,2)"), currency=F.col("o_orderstatus"), status=F.lit("pending"), created_at=made, updated_at=made)),
        F.when(ok % 40 != 0, change(1, "update", key, entries(payment_id=ok, status=F.lit("captured"), updated_at=made))).otherwise(change(1, "delete", key, none)),
    ])
    whole = customers.unionByName(merchants).unionByName(payments)
    return whole.unionByName(whole.where("lsn_numeric % 100 < 10"))
