"""From a change log to a cleaned, typed history of every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .contracts import Contract, ContractError


def key_text(keys: list[str]) -> Column:
    """The key of a change as JSON: maps cannot be compared, text can."""
    return F.to_json(F.struct(*[F.col("key").getItem(k).alias(k) for k in keys]))


def without_replays(log: DataFrame, identity: list[str]) -> DataFrame:
    """One row for each identity. Replays are equal but for when they were taken in, so any of them serves."""
    return log.dropDuplicates(identity)


def replay_conflicts(log: DataFrame, identity: list[str], content: list[Column]) -> DataFrame:
    """Identities whose rows differ in content: a healthy log has none. A null differs from any value, and from a null in another place."""
    said = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(content)]), {"ignoreNullFields": "false"})
    return log.groupBy(*identity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(said).alias("n_versions")).where("n_versions > 1")


def carry_forward(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], present: dict[str, Column] | None = None) -> DataFrame:
    """Adds each value as last known up to the row, in the order of its key's changes.

    Without ``present`` a null is unknown and the value before it holds. With it, a value is known
    wherever ``present`` is true, so a true null replaces the value before it.
    All values share one window: one shuffle and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {}
    for name, value in values.items():
        if present is None:
            out[name] = F.last(value, ignorenulls=True).over(w)
        else:
            out[name] = F.last(F.when(present[name], F.struct(value.alias("v"))), ignorenulls=True).over(w).getField("v")
    return rows.withColumns(out)


def mark_current(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``is_current``: no later change of the key. Reuses the ascending order of carry_forward; the order must be unique in a key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("is_current", F.lead(order).over(w).isNull())


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def truncate_boundary(truncates: DataFrame, order: str = "lsn_numeric", text: str = "lsn") -> DataFrame:
    """One row: position and text of the last truncate, nulls if there is none."""
    return truncates.agg(F.max(order).alias("truncate_order"), F.max_by(text, order).alias("truncate_text"))


def apply_truncates(rows: DataFrame, boundary: DataFrame, order: str = "lsn_numeric") -> DataFrame:
    """Adds ``truncated_at_lsn`` to current rows from before the last truncate. The boundary is one row, so it is broadcast."""
    joined = rows.crossJoin(F.broadcast(boundary))
    return joined.withColumn("truncated_at_lsn", F.when(F.col("is_current") & (F.col(order) < F.col("truncate_order")), F.col("truncate_text"))).drop("truncate_order", "truncate_text")


def cast_probe(rows: DataFrame, raw: dict[str, tuple[Column, str]], order: str) -> DataFrame:
    """One row for each column (raw value, type): how many values its type refuses, and the first such."""
    refused = {n: value.isNotNull() & value.try_cast(kind).isNull() for n, (value, kind) in raw.items()}
    aggs = [x for n, (value, _) in raw.items() for x in (F.count_if(refused[n]).alias(f"{n}__n"), F.min_by(F.when(refused[n], value), F.when(refused[n], F.col(order))).alias(f"{n}__v"))]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(kind).alias("type_name"), F.col(f"{n}__n").alias("n_refused"), F.col(f"{n}__v").alias("first_refused")) for n, (_, kind) in raw.items()])).alias("p")).select("p.*")


def source_instances(log: DataFrame) -> DataFrame:
    """One row: how many source instances wrote the log, and how many rows name none."""
    return log.agg(F.count_distinct("source_system_id").alias("n_instances"), F.count_if(F.col("source_system_id").isNull()).alias("n_null"))


def require_one_source(log: DataFrame) -> None:
    """Positions compare within one instance only."""
    r = source_instances(log).first()
    if r["n_null"] or r["n_instances"] > 1:
        raise ContractError(f"the log mixes {r['n_instances']} source instances and has {r['n_null']} rows without one")


def require_castable(rows: DataFrame, raw: dict[str, tuple[Column, str]], order: str) -> None:
    bad = [f"column {r['column_name']}: {r['first_refused']!r} is no {r['type_name']}" for r in cast_probe(rows, raw, order).where("n_refused > 0").collect()]  # a row for each column
    if bad:
        raise ContractError("; ".join(bad))


def cleaned(log: DataFrame, contract: Contract, strict_nulls: bool = False) -> DataFrame:
    """The changes of one table without replays, with every column as text carried forward, and ``is_current``.

    The key comes from the key map if a first change has no row (a delete seen without its insert).
    """
    keys = contract.keys
    base = log.where("action != 'truncate'").withColumns({f"key_{k}": F.col("key").getItem(k) for k in keys})
    base = without_replays(base, [*(f"key_{k}" for k in keys), "lsn_numeric"])
    parts = [f"key_{k}" for k in keys]
    values = {f"raw_{n}": F.col("after").getItem(n) for n in contract.names}
    present = {f"raw_{n}": F.coalesce(F.map_contains_key("after", F.lit(n)), F.lit(False)) for n in contract.names} if strict_nulls else None
    rows = carry_forward(base, parts, "lsn_numeric", values, present)
    rows = rows.withColumns({f"raw_{k}": F.coalesce(f"raw_{k}", f"key_{k}") for k in keys})
    return mark_current(rows, parts, "lsn_numeric")


def build_history(log: DataFrame, contract: Contract, mask: Callable[[Column], Column], strict_nulls: bool = False, validate: bool = True) -> DataFrame:
    """The cleaned history of one table: every version, typed and masked, with its flags and change columns."""
    if validate:
        require_one_source(log)
    rows = cleaned(log, contract, strict_nulls)
    if validate:
        require_castable(rows, {a.name: (F.col(f"raw_{a.name}"), a.spark_type().simpleString()) for a in contract.attributes}, "lsn_numeric")
    rows = apply_truncates(rows, truncate_boundary(log.where("action = 'truncate'")))
    typed = [mask(F.col(f"raw_{a.name}")).alias(a.name) if a.pii else F.col(f"raw_{a.name}").cast(a.spark_type()).alias(a.name) for a in contract.attributes]
    deleted = (F.col("action") == "delete") | F.col("truncated_at_lsn").isNotNull()
    return rows.select(*typed, "is_current", deleted.alias("is_deleted"), "truncated_at_lsn", F.col("lsn").alias("change_lsn"), F.col("lsn_numeric").alias("change_lsn_numeric"), F.col("xid").alias("change_xid"), F.col("commit_time").alias("change_commit_time"))


def split_key_changes(log: DataFrame, keys: list[str]) -> DataFrame:
    """Updates that change the key become a delete of the old key and an insert of the new one."""
    old = F.create_map(*[x for k in keys for x in (F.lit(k), F.col("before").getItem(k))])
    moved = (F.col("action") == "update") & F.col("before").isNotNull()
    changed = F.lit(False)
    for k in keys:
        changed = changed | (F.col("before").getItem(k).isNotNull() & (F.col("before").getItem(k) != F.col("key").getItem(k)))
    moved = F.coalesce(moved & changed, F.lit(False))
    none = F.lit(None).cast("map<string,string>")
    as_is = F.struct(F.col("action"), F.col("key"), F.col("before"), F.col("after"))
    pair = F.array(F.struct(F.lit("delete").alias("action"), old.alias("key"), F.col("before"), none.alias("after")), F.struct(F.lit("insert").alias("action"), F.col("key"), none.alias("before"), F.col("after")))
    parts = F.explode(F.when(moved, pair).otherwise(F.array(as_is)))
    return log.withColumn("__c", parts).select(*[F.col(f"__c.{c}") if c in ("action", "key", "before", "after") else F.col(c) for c in log.columns])
