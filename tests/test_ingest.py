"""The wire decoder and the streaming path, over dumped frames."""

import json
import os
import urllib.error
import urllib.request
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelog.operators.contracts import CONTRACTS, TYPE_OIDS, ContractError, log_violations
from tidelog.operators.history import without_replays
from tidelog.sources import wire
from tidelog.sources.frames import FrameReader, peek
from tidelog.sources.tables import change_log
from tidelog.sources.wire import Decoder, Writer, WireError
from tidelog.streaming.ingest import event_windows, ingest, ingest_all, sessions, without_replays_stream
from tidelog.streaming.metrics import Metrics, serve

COLUMNS = [(a.name, TYPE_OIDS[a.type], a.key) for a in CONTRACTS["public.merchants"].attributes]


def dump(path, transactions=6, columns=COLUMNS, schema="public", country="BR", files=1):
    """A relation, then transactions of an insert and an update with an unchanged name; the last one truncates."""
    path.mkdir()
    frames, at = [(0, 0, Writer.relation(9, "merchants", columns, schema))], 1000
    for x in range(transactions):
        us = 800_000_000_000_000 + x * 40_000_000_000
        frames.append((at, at, Writer.begin(at + 30, us, 50 + x)))
        if x == transactions - 1:
            frames.append((at + 10, at + 10, Writer.truncate([9], 2)))
        else:
            row = [str(x), f"shop {x}", "retail", country if x == 3 else "BR", "2025-05-08 00:00:00+00", "2025-05-08 00:00:00+00"]
            frames.append((at + 10, at + 10, Writer.insert(9, row)))
            frames.append((at + 20, at + 20, Writer.update(9, [row[0], ..., "travel", *row[3:]])))
        frames.append((at + 30, at + 40, Writer.commit(at + 30, at + 40, us)))
        at += 100
    table = pa.table({"data_start": [f[0] for f in frames], "wal_end": [f[1] for f in frames], "payload": pa.array([f[2] for f in frames], pa.binary())})
    cut = -(-len(frames) // files)
    for k in range(files):
        pq.write_table(table.slice(k * cut, cut), path / f"{k + 1:04d}.parquet", row_group_size=8)
    return str(path)


def test_decoder_reads_what_the_writer_wrote():
    d = Decoder()
    d.decode(Writer.relation(9, "merchants", COLUMNS))
    change = d.decode(Writer.update(9, ["1", ..., None, "BR", "x", "y"], ["1", None, None, None, None, None]))
    assert change.action == "update" and change.unchanged == ("legal_name",) and change.after["category"] is None and "legal_name" not in change.after and change.before["merchant_id"] == "1"
    assert d.decode(Writer.truncate([9], 3)).cascade and d.decode(Writer.begin(5, 0, 7)).xid == 7
    assert wire.lsn_text(0x1_01B08670) == "1/1B08670"


@pytest.mark.parametrize("frame", [b"Z", b"B\0", Writer.commit(1, 2, 3, flags=1), Writer.insert(8, ["1"]), Writer.insert(9, ["1"]), b"I" + (9).to_bytes(4, "big") + b"X"])
def test_decoder_refuses_broken_frames(frame):
    d = Decoder()
    d.decode(Writer.relation(9, "merchants", COLUMNS))
    with pytest.raises(WireError):
        d.decode(frame)


def test_batches_end_at_commits(tmp_path):
    path = dump(tmp_path / "d")
    r, ends = FrameReader({"path": path, "maxRecordsPerBatch": "3"}), []
    for _ in range(5):
        ends.append(r.latestOffset()["lsn"])
    assert ends == [1140, 1340, 1540, 1540, 1540]
    assert [f[2][:1] for f in peek(path, 1440)][-3:] == [b"B", b"T", b"C"]


def run(spark, tmp_path, name, path, **options):
    log = str(tmp_path / f"log-{name}")
    ingest_all(spark, path, log, str(tmp_path / f"ck-{name}"), ingestedAt="2025-06-01T00:00:00+00:00", systemId="7", **options)
    return change_log(spark, log)


def test_batch_size_does_not_show(spark, tmp_path):
    path = dump(tmp_path / "d")
    one, many = run(spark, tmp_path, "one", path), run(spark, tmp_path, "many", path, maxRecordsPerBatch="1")
    assert len(many.inputFiles()) > len(one.inputFiles()) and one.count() == 11
    text = lambda df: rows(df.selectExpr("lsn", "lsn_numeric", "xid", "commit_time", "action", "table_name", "key", "after", "unchanged_toast_columns", "truncate_restart_identity"))
    assert text(one) == text(many)


def test_death_between_write_and_commit_loses_nothing(spark, tmp_path):
    path, log, ck = dump(tmp_path / "d"), str(tmp_path / "log"), str(tmp_path / "ck")

    def die(epoch):
        if epoch == 1:
            raise RuntimeError("killed before the commit")

    q = ingest(spark, path, log, ck, after_write=die, maxRecordsPerBatch="3", systemId="7")
    with pytest.raises(Exception, match="killed"):
        q.processAllAvailable()
    q.stop()
    q = ingest(spark, path, log, ck, maxRecordsPerBatch="3", systemId="7")
    q.processAllAvailable()
    q.stop()
    got = change_log(spark, log)
    assert got.count() > 11, "nothing was written twice: the test shows nothing"
    assert without_replays(got, ["table_name", "lsn_numeric"]).count() == 11


def test_contract_drift_stops_before_any_write(spark, tmp_path):
    drifted = [(n, 1700 if n == "country" else t, k) for n, t, k in COLUMNS]
    with pytest.raises(Exception, match="merchants.country: type numeric instead of bpchar"):
        run(spark, tmp_path, "bad", dump(tmp_path / "d", columns=drifted))
    assert not list((tmp_path).glob("log-bad/**/*.parquet"))


def test_work_follows_new_frames(tmp_path):
    """Frames read a batch are as many in a long log as in a short one."""
    cost = {}
    for n in (20, 80):
        r = FrameReader({"path": dump(tmp_path / f"d{n}", n, files=3), "maxRecordsPerBatch": "4"})
        ends, last = [], None
        while (now := r.latestOffset()) != last:
            ends.append(now["lsn"])
            last = now
        assert ends == sorted(set(ends)) and len(ends) == n // 2
        cost[n] = r.frames_read / len(ends)
    assert abs(cost[20] - cost[80]) < 1


def test_slices_of_offsets_are_the_whole_log(tmp_path):
    path = dump(tmp_path / "d", 9, files=2)
    options = {"path": path, "maxRecordsPerBatch": "3", "systemId": "7", "ingestedAt": "2025-06-01T00:00:00+00:00"}
    r = FrameReader(options)
    start, got = r.initialOffset(), []
    while (end := r.latestOffset()) != start:
        got += r.read(r.partitions(start, end)[0])
        start = end
    whole = FrameReader({**options, "maxRecordsPerBatch": "1000"})
    assert got == list(whole.read(whole.partitions(whole.initialOffset(), whole.latestOffset())[0])) and len(got) == 17
    assert FrameReader({**options, "resume": json.dumps(start)}).latestOffset() == start
    timed = FrameReader({**options, "maxRecordsPerBatch": "1000", "maxSecondsPerBatch": "0"})
    assert timed.latestOffset()["lsn"] == 1040, "a batch whose time is up ends at the next commit"


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    path, log, ck = tmp_path / "d", str(tmp_path / "log"), str(tmp_path / "ck")
    dump(path, 4)
    for more in (False, True, False):
        if more:
            later = tmp_path / "later"
            dump(later, 8)
            frames = pq.read_table(later / "0001.parquet")
            pq.write_table(frames.slice(pq.read_table(path / "0001.parquet").num_rows + 1), path / "0002.parquet")
        metrics = Metrics()
        ingest_all(spark, str(path), log, ck, maxRecordsPerBatch="3", systemId="7", metrics=metrics)
        got = [r["lsn_numeric"] for r in change_log(spark, log).collect()]
        assert len(got) == len(set(got))
        assert sum(metrics.written.values()) == (7 if more or len(got) == 7 else 0)
    assert len(got) == 14


@pytest.mark.parametrize("what, want", [({"country": None}, "public.merchants.country: null at 1310"), ({"schema": "other"}, "merchants: no contract")])
def test_changes_against_their_contract_stop_before_any_write(spark, tmp_path, what, want):
    with pytest.raises(Exception, match=want):
        run(spark, tmp_path, "bad", dump(tmp_path / "d", **what))
    assert not list(tmp_path.glob("log-bad/**/*.parquet"))


def test_a_source_without_a_name_is_refused(tmp_path):
    r = FrameReader({"path": dump(tmp_path / "d")})
    with pytest.raises(ContractError, match="systemId"):
        list(r.read(r.partitions(r.initialOffset(), r.latestOffset())[0]))


def test_violations_of_a_log(spark):
    ok = {"payment_id": "1", "customer_id": "2", "merchant_id": "3", "amount": "1.5", "currency": "BRL", "status": "x", "created_at": "2025-01-01", "updated_at": "2025-01-01"}
    data = [
        ("public", "payments", 1, "insert", {"payment_id": "1"}, ok), ("public", "payments", 2, "update", {"payment_id": "1"}, {"amount": "much"}), ("public", "payments", 3, "delete", {"payment_id": None}, None),
        ("old", "payments", 4, "insert", {"payment_id": "1"}, ok), ("public", "payments", 5, "truncate", None, None), ("public", "payments", 6, "insert", {"payment_id": "1"}, {k: v for k, v in ok.items() if k != "status"}),
    ]
    log = spark.createDataFrame(data, "schema_name string, table_name string, lsn_numeric bigint, action string, key map<string,string>, after map<string,string>")
    got = rows(log_violations(log).select("qualified_name", "lsn_numeric", "column_name", "problem"))
    assert got == sorted([("public.payments", 2, "amount", "type"), ("public.payments", 3, "payment_id", "key"), ("old.payments", 4, None, "no contract"), ("public.payments", 6, "status", "missing")], key=repr)


def test_metrics_are_served():
    m = Metrics()
    m.record({"payments": 3}, 70)
    m.record({"payments": 2, "merchants": 1}, 60)
    server = serve(m, 0)
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        text = urllib.request.urlopen(f"{at}/metrics").read().decode()
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/other")
    finally:
        server.shutdown()
    assert 'cdc_records_written_total{table="payments"} 5\n' in text and "cdc_confirmed_lsn 70\n" in text


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_streams_drop_replays_and_count_windows_and_sessions(spark, tmp_path):
    def land(k, data):
        df = spark.createDataFrame([("t", {"id": i}, n, datetime.fromisoformat(t)) for i, n, t in data], "table_name string, key map<string,string>, lsn_numeric bigint, commit_time timestamp")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(next(iter((tmp_path / "in").glob("part-*"))), (k, k))

    land(1, [("a", 1, "2025-01-01 10:00:00"), ("a", 2, "2025-01-01 10:03:00"), ("b", 1, "2025-01-01 10:04:00"), ("a", 2, "2025-01-01 10:03:00")])
    land(2, [("a", 2, "2025-01-01 10:03:00"), ("b", 9, "2025-01-01 10:25:00"), ("a", 3, "2025-01-01 10:26:00")])
    land(3, [("a", 8, "2025-01-01 12:00:00"), ("b", 1, "2025-01-01 10:04:00")])
    source = lambda: spark.readStream.schema("table_name string, key map<string,string>, lsn_numeric bigint, commit_time timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = drained(without_replays_stream(source(), ["id"], "1 day"), "once").selectExpr("key['id'] AS k", "lsn_numeric")
    assert rows(got) == [("a", 1), ("a", 2), ("a", 3), ("a", 8), ("b", 1), ("b", 9)]
    plain = without_replays_stream(source(), ["id"], "1 day")
    wide = drained(event_windows(plain.drop("lsn_numeric"), "commit_time", "10 minutes", "5 minutes", delay=None), "wide", "update")
    most = {str(r["s"])[11:16]: r["n"] for r in wide.groupBy(F.col("window.start").alias("s")).agg(F.max("n").alias("n")).collect()}
    assert most == {"09:55": 3, "10:00": 3, "10:20": 2, "10:25": 2, "11:55": 1, "12:00": 1}
    by = drained(sessions(source().selectExpr("key['id'] AS id", "commit_time"), "commit_time", "id", "10 minutes", "5 minutes"), "gaps")
    told = {(r["id"], str(r["session_window"]["start"])[11:16], r["n"]) for r in by.collect()}
    assert told >= {("b", "10:25", 1), ("a", "10:26", 1)} and ("a", "12:00", 1) not in told
