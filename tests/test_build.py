"""Materialised tables, rates, series and fingerprints."""

import threading
from datetime import date, datetime, timezone
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelog.functions import masking
from tidelog.operators import build, checks, fx, monitor
from tidelog.operators.contracts import MERCHANTS, ContractError
from tidelog.plans import testdata as T

DIR = "/root/testdata/sf0.001"


def observations(spark):
    return T.rates(spark, DIR).select(F.lit("sgs").alias("source"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ingested_at"), F.lit(1).alias("series_code"), "currency", "quote_date", "rate_brl")


def test_two_rebuilds_are_equal(spark, tmp_path):
    log, prints = T.source_log(spark, DIR), []
    for k, given in enumerate((log, log.repartition(5))):
        root = str(tmp_path / "lake")  # the second rebuild overwrites the first
        counts = build.rebuild(spark, given, observations(spark), root, masking.masker("key"), base=T.BASE_CURRENCY)
        tables = {n: spark.read.parquet(f"{root}/gold/{n}") for n in ("dim_customer", "dim_merchant", "dim_currency", "dim_date", "fct_payment")}
        assert all(counts[n] == df.count() > 0 for n, df in tables.items())
        prints.append({n: tuple(checks.fingerprint(df, sorted(df.columns)).first()) for n, df in tables.items()})
    assert prints[0] == prints[1]
    assert checks.unmasked(tables["dim_customer"], ["email", "cpf"]).count() == 0
    assert spark.table("stg_payments").count() == counts["fct_payment"] + spark.table("stg_payments").where("is_deleted").count()
    assert spark.table("stg_merchants").where("category = 'travel'").count() == tables["dim_merchant"].where("category = 'travel'").count() > 0
    assert spark.read.parquet(f"{root}/silver/payments").count() == counts["payments"]


def test_a_broken_log_replaces_nothing(spark, tmp_path):
    root = str(tmp_path / "silver")
    log = T.source_log(spark, DIR).where("table_name = 'merchants'")
    build.build_histories(spark, log, root, masking.masker("key"), (MERCHANTS,))
    before = rows(spark.read.parquet(f"{root}/merchants"))
    with pytest.raises(ContractError, match="source instances"):
        build.build_histories(spark, log.withColumn("source_system_id", F.col("key")["merchant_id"]), root, masking.masker("key"), (MERCHANTS,))
    bad = log.withColumn("after", F.when(F.col("key")["merchant_id"] == "3", F.map_concat(F.map_filter("after", lambda k, _: k != "created_at"), F.create_map(F.lit("created_at"), F.lit("soon")))).otherwise(F.col("after")))
    with pytest.raises(ContractError, match="created_at: 'soon' is no timestamp"):
        build.build_histories(spark, bad, root, masking.masker("key"), (MERCHANTS,))
    assert rows(spark.read.parquet(f"{root}/merchants")) == before


def test_fingerprints_see_rows_and_copies_but_no_order(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 7).alias("b"))
    plain = checks.fingerprint(df, ["a", "b"]).first()
    for leaf in (4096, 0.1, 0.0001):
        same = {tuple(checks.fingerprint(x, ["a", "b"], leaf).first()) for x in (df, df.repartition(7), df.orderBy(F.desc("a")))}
        assert len(same) == 1
        for other in (df.where("a <> '5'"), df.unionByName(df.limit(1)), df.withColumn("b", F.when(F.col("a") == "9", None).otherwise(F.col("b")))):
            assert tuple(checks.fingerprint(other, ["a", "b"], leaf).first()) not in same
    assert plain["n_rows"] == 3000 and checks.fingerprint(df.limit(0), ["a"]).first()["n_rows"] == 0


def test_runs_of_low_windows_meet_at_midnight(spark):
    at = lambda m: datetime.fromtimestamp(1_700_000_000 // 86400 * 86400 + 60 * m, timezone.utc).replace(tzinfo=None)
    low = {10, 20, 30, 50, *range(1400, 1480, 10), 2880, 2870}
    series = spark.createDataFrame([(at(m), 0 if m in low else 5) for m in range(0, 3000, 10)], "window_start timestamp_ntz, n bigint")
    got = rows(monitor.heartbeat_alerts(series, rounds=2))
    assert got == sorted([(at(10), at(30), 3), (at(1400), at(1470), 8), (at(2870), at(2880), 2)], key=repr)
    assert monitor.heartbeat_alerts(series.limit(0)).count() == 0


def test_rolling_counts_and_firing_by_table(spark):
    data = [("a", datetime(2025, 1, 1, 0, 0, s)) for s in (1, 2, 59)] + [("b", datetime(2025, 1, 1, 0, 4, 30)), ("a", datetime(2025, 1, 1, 0, 4, 31))]
    events = spark.createDataFrame(data, "t string, ts timestamp_ntz")
    series = monitor.rolling(events, "ts", "1 minute", "30 seconds", ["t"])
    for t in "ab":
        for r in series.where(F.col("t") == t).collect():
            inside = [x for k, x in data if k == t and 0 <= (r["instant"] - x).total_seconds() < 60]
            assert r["n"] == len(inside)
    assert series.count() == 2 * 10
    assert rows(monitor.firing(series, "30 seconds", "1 minute", by=["t"]).where("t = 'a'")) == [("a", datetime(2025, 1, 1, 0, 3, 0)), ("a", datetime(2025, 1, 1, 0, 3, 30)), ("a", datetime(2025, 1, 1, 0, 4, 0)), ("a", datetime(2025, 1, 1, 0, 4, 30))]
    with pytest.raises(ValueError, match="multiple"):
        monitor.rolling(events, "ts", "1 minute", "45 seconds")


def test_months_are_rewritten_from_what_was_merged(spark, tmp_path):
    root = str(tmp_path / "fx")

    def quotes(*data):
        return spark.createDataFrame([("sgs", datetime(2025, 1, k), 1, "USD", d, Decimal(r)) for k, d, r in data], fx.OBSERVATIONS)

    fx.write_months(spark, quotes((1, date(2024, 5, 2), "5.1"), (1, date(2024, 6, 3), "5.2")), root)
    fx.write_months(spark, quotes((2, date(2024, 5, 3), "5.3"), (2, date(2024, 5, 2), "5.4")), root)
    fx.write_months(spark, quotes((1, date(2024, 5, 2), "9.9")), root)
    assert rows(fx.read(spark, root).select("quote_date", F.col("rate_brl").cast("string"))) == [(date(2024, 5, 2), "5.40000000"), (date(2024, 5, 3), "5.30000000"), (date(2024, 6, 3), "5.20000000")]
    assert [p.name for p in tmp_path.iterdir()] == ["fx"], "nothing is left beside it"


def test_feed_over_http(spark):
    class Feed(BaseHTTPRequestHandler):
        def do_GET(self):
            code = 404 if "01%2F07%2F2024" in self.path else 500 if "/9?" in self.path else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b'[{"data": "03/06/2024", "valor": "5.25"}]' if self.path.startswith("/1?formato=json&dataInicial=01%2F06%2F2024&dataFinal=30%2F06%2F2024") else b"[]")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        fetch = fx.http_fetch(f"http://127.0.0.1:{server.server_port}/{{}}")
        got = fx.extract(spark, "USD", date(2024, 6, 1), date(2024, 7, 9), fetch, datetime(2025, 1, 1))
        assert [(r["quote_date"], r["rate_brl"]) for r in got.collect()] == [(date(2024, 6, 3), Decimal("5.25"))]
        with pytest.raises(OSError):
            fetch(9, date(2024, 6, 1), date(2024, 6, 2))
        with pytest.raises(ValueError):
            fetch(1, date(2024, 6, 2), date(2024, 6, 1))
    finally:
        server.shutdown()
