"""Declared contracts of source tables, and what violates them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type numbers of the wire protocol by name.
TYPE_OIDS = {"bool": 16, "int8": 20, "int4": 23, "text": 25, "bpchar": 1042, "varchar": 1043, "date": 1082, "timestamptz": 1184, "numeric": 1700}
_SPARK = {"bool": T.BooleanType(), "int8": T.LongType(), "int4": T.IntegerType(), "text": T.StringType(), "bpchar": T.StringType(), "varchar": T.StringType(), "date": T.DateType(), "timestamptz": T.TimestampType()}


class ContractError(ValueError):
    """Data does not honour its contract; nothing of it may be written."""


@dataclass(frozen=True)
class Attribute:
    name: str
    type: str
    key: bool = False
    pii: bool = False
    precision: int | None = None
    scale: int | None = None

    def spark_type(self) -> T.DataType:
        if self.type == "numeric":
            return T.DecimalType(self.precision or 38, 9 if self.scale is None else self.scale)
        if self.type not in _SPARK:
            raise ContractError(f"column {self.name}: no type registered for {self.type}")
        return _SPARK[self.type]


@dataclass(frozen=True)
class Contract:
    table: str
    attributes: tuple[Attribute, ...] = field(default_factory=tuple)
    namespace: str = "public"

    @property
    def qualified_name(self) -> str:
        return f"{self.namespace}.{self.table}"

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def keys(self) -> list[str]:
        return [a.name for a in self.attributes if a.key]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.spark_type(), not a.key, {"pii": a.pii}) for a in self.attributes])


def _times(*names: str) -> tuple[Attribute, ...]:
    return tuple(Attribute(n, "timestamptz") for n in names)


CUSTOMERS = Contract("customers", (Attribute("customer_id", "int8", key=True), Attribute("full_name", "text"), Attribute("email", "text", pii=True), Attribute("cpf", "bpchar", pii=True), *_times("created_at", "updated_at")))
MERCHANTS = Contract("merchants", (Attribute("merchant_id", "int8", key=True), Attribute("legal_name", "text"), Attribute("category", "text"), Attribute("country", "bpchar"), *_times("created_at", "updated_at")))
PAYMENTS = Contract("payments", (Attribute("payment_id", "int8", key=True), Attribute("customer_id", "int8"), Attribute("merchant_id", "int8"), Attribute("amount", "numeric", precision=14, scale=2), Attribute("currency", "bpchar"), Attribute("status", "text"), *_times("created_at", "updated_at")))
CONTRACTS = {c.qualified_name: c for c in (CUSTOMERS, MERCHANTS, PAYMENTS)}


def contract_for(namespace: str, table: str) -> Contract | None:
    """The contract of a table, by its schema too: a table of another schema with the same name has none."""
    return CONTRACTS.get(f"{namespace}.{table}")


def relation_violations(contract: Contract | None, table: str, columns: list[tuple[str, int, bool]], lsn: str = "") -> list[str]:
    """How a relation message's columns (name, type number, key flag) differ from the contract."""
    at = f" at {lsn}" if lsn else ""
    if contract is None:
        return [f"{table}: no contract{at}"]
    seen, due = {n: (oid, key) for n, oid, key in columns}, {a.name: a for a in contract.attributes}
    out = [f"{table}.{n}: missing{at}" for n in due if n not in seen] + [f"{table}.{n}: unexpected{at}" for n in seen if n not in due]
    kinds = {v: k for k, v in TYPE_OIDS.items()}
    for n, a in due.items():
        if n in seen:
            oid, key = seen[n]
            if oid != TYPE_OIDS[a.type]:
                out.append(f"{table}.{n}: type {kinds.get(oid, oid)} instead of {a.type}{at}")
            if key != a.key:
                out.append(f"{table}.{n}: {'a key' if key else 'no key'} against the contract{at}")
    return out


def relation_diff(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name, problem) between two (table_name, column_name, type_name) relations, as a full join."""
    a = declared.select("table_name", "column_name", F.col("type_name").alias("declared"))
    b = actual.select("table_name", "column_name", F.col("type_name").alias("actual"))
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "unexpected").when(F.col("declared") != F.col("actual"), "type")
    return a.join(b, ["table_name", "column_name"], "full").withColumn("problem", problem).where("problem is not null").select("table_name", "column_name", "problem")


def row_violations(log: DataFrame, contract: Contract, identity: list[str]) -> DataFrame:
    """(identity, column_name, problem) of changes that the contract does not allow, by action.

    insert: every column, typed; update: the columns present, typed; delete: the keys; truncate:
    nothing. Columns that the contract lacks are ``unexpected``. One pass, a row for each problem.
    """
    problems: list[Column] = []
    after, action = F.col("after"), F.col("action")
    for a in contract.attributes:
        raw = after.getItem(a.name)
        present = F.coalesce(F.map_contains_key(after, F.lit(a.name)), F.lit(False))
        untyped = raw.isNotNull() & raw.try_cast(a.spark_type()).isNull()
        found = F.when((action == "insert") & ~present, "missing").when(action.isin("insert", "update") & present & raw.isNull(), "null").when(action.isin("insert", "update") & untyped, "type")
        if a.key:
            key = F.col("key").getItem(a.name)
            found = F.when((action != "truncate") & (key.isNull() | key.try_cast(a.spark_type()).isNull()), "key").otherwise(found)
        problems.append(F.struct(F.lit(a.name).alias("column_name"), found.alias("problem")))
    unknown = F.array_except(F.coalesce(F.map_keys(after), F.array().cast("array<string>")), F.array(*map(F.lit, contract.names)))
    every = F.concat(F.array(*problems), F.transform(unknown, lambda c: F.struct(c.alias("column_name"), F.lit("unexpected").alias("problem"))))
    return log.select(*identity, F.explode(every).alias("p")).select(*identity, "p.*").where("problem is not null")


def log_violations(log: DataFrame, known: dict[str, Contract] | None = None) -> DataFrame:
    """(qualified_name, lsn_numeric, column_name, problem) of all changes of a log, each by its table's contract; a table without one is a problem of its own."""
    known = CONTRACTS if known is None else known
    name = F.concat_ws(".", "schema_name", "table_name")
    named = log.withColumn("qualified_name", name)
    identity = ["qualified_name", "lsn_numeric"]
    out = named.where(~F.col("qualified_name").isin(list(known))).select(*identity, F.lit(None).cast("string").alias("column_name"), F.lit("no contract").alias("problem"))
    for c in known.values():
        out = out.unionByName(row_violations(named.where(F.col("qualified_name") == c.qualified_name), c, identity))
    return out


def require_valid_rows(log: DataFrame, known: dict[str, Contract] | None = None) -> None:
    """Raises if any change breaks its contract, naming the first few."""
    bad = log_violations(log, known).orderBy("lsn_numeric", "column_name").limit(5).collect()
    if bad:
        raise ContractError("; ".join(f"{r['qualified_name']}{'.' + r['column_name'] if r['column_name'] else ''}: {r['problem']} at {r['lsn_numeric']}" for r in bad))
