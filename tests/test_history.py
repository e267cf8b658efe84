import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelog.operators import contracts, history
from tidelog.operators.contracts import Attribute, Contract, ContractError
from tidelog.sources.tables import CHANGE_LOG

GOODS = Contract("goods", (Attribute("id", "int8", key=True), Attribute("name", "text"), Attribute("price", "numeric", precision=14, scale=2)))


def log(spark, changes, system="1"):
    """changes: (lsn, action, key, after[, before])"""
    out = []
    for c in changes:
        lsn, action, key, after, before = (*c, None)[:5]
        out.append({"source": "s", "source_system_id": system, "lsn": f"0/{lsn:X}", "lsn_numeric": lsn, "xid": lsn, "action": action, "schema_name": "public", "table_name": "goods", "key": key and {"id": key}, "after": after, "before": before})
    return spark.createDataFrame(out, CHANGE_LOG)


def build(spark, changes, **kw):
    return history.build_history(log(spark, changes), GOODS, lambda c: c, **kw)


def test_absent_values_carry_and_deletes_keep_them(spark):
    got = rows(build(spark, [(1, "insert", "7", {"id": "7", "name": "a", "price": "1.50"}), (2, "update", "7", {"id": "7", "price": "2"}), (3, "delete", "7", None)]).select("change_lsn_numeric", "id", "name", F.col("price").cast("string"), "is_current", "is_deleted"))
    assert got == [(1, 7, "a", "1.50", False, False), (2, 7, "a", "2.00", False, False), (3, 7, "a", "2.00", True, True)]


def test_replays_are_dropped(spark):
    once = [(1, "insert", "7", {"id": "7", "name": "a", "price": "1"}), (2, "update", "7", {"id": "7", "name": "b"})]
    assert rows(build(spark, once + once)) == rows(build(spark, once)) != []


def test_conflicting_replays_show(spark):
    one = log(spark, [(1, "insert", "7", {"id": "7", "name": "a"})])
    other = log(spark, [(1, "insert", "7", {"id": "7", "name": "b"})])
    ident, said = ["table_name", "lsn_numeric"], [F.to_json("after")]
    assert history.replay_conflicts(one.unionByName(one), ident, said).count() == 0
    assert history.replay_conflicts(one.unionByName(other), ident, said).count() == 1


def test_truncate_marks_only_current_rows_before_it(spark):
    got = rows(build(spark, [(1, "insert", "7", {"id": "7"}), (2, "update", "7", {"id": "7"}), (3, "truncate", None, None), (4, "insert", "8", {"id": "8"})]).select("change_lsn_numeric", "truncated_at_lsn", "is_deleted"))
    assert got == [(1, None, False), (2, "0/3", True), (4, None, False)]


def test_first_change_a_delete_keeps_the_key(spark):
    assert rows(build(spark, [(1, "delete", "7", None)]).select("id", "name", "is_deleted")) == [(7, None, True)]


def test_true_null_replaces_a_value_only_when_strict(spark):
    changes = [(1, "insert", "7", {"id": "7", "name": "a"}), (2, "update", "7", {"id": "7", "name": None}), (3, "update", "7", {"id": "7"})]
    names = lambda **kw: [r[1] for r in rows(build(spark, changes, **kw).select("change_lsn_numeric", "name"))]
    assert names() == ["a", "a", "a"]
    assert names(strict_nulls=True) == ["a", None, None]


def test_uncastable_value_is_named(spark):
    with pytest.raises(ContractError, match=r"price.*'not-a-number'.*decimal\(14,2\)"):
        build(spark, [(1, "insert", "7", {"id": "7", "price": "not-a-number"})])


def test_mixed_and_missing_instances_are_refused(spark):
    one, two = log(spark, [(1, "insert", "7", {"id": "7"})]), log(spark, [(2, "insert", "8", {"id": "8"})], system="2")
    history.require_one_source(one)
    for bad in (one.unionByName(two), log(spark, [(1, "insert", "7", {"id": "7"})], system=None)):
        with pytest.raises(ContractError):
            history.require_one_source(bad)


def test_key_change_splits_on_request(spark):
    moved = log(spark, [(1, "update", "8", {"id": "8"}, {"id": "7"}), (2, "update", "9", {"id": "9"})])
    got = rows(history.split_key_changes(moved, ["id"]).select("lsn_numeric", "action", F.col("key")["id"]))
    assert got == [(1, "delete", "7"), (1, "insert", "8"), (2, "update", "9")]


def test_relation_violations_name_everything():
    good = [(a.name, contracts.TYPE_OIDS[a.type], a.key) for a in GOODS.attributes]
    assert contracts.relation_violations(GOODS, "goods", good) == []
    bad = [("id", 20, False), ("name", 25, False), ("price", 25, False), ("more", 25, False)]
    found = " ".join(contracts.relation_violations(GOODS, "goods", bad, "0/9"))
    assert "goods.price: type text instead of numeric at 0/9" in found and "goods.more: unexpected" in found and "goods.id: no key" in found
    assert contracts.relation_violations(None, "x", good) == ["x: no contract"]
    with pytest.raises(ContractError):
        Attribute("a", "circle").spark_type()
