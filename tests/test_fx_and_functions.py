import hashlib
import hmac
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidelog.functions import lsn, masking
from tidelog.operators import checks, dimensions, fx, monitor
from tidelog.operators.contracts import ContractError

NOW = datetime(2026, 9, 1)


def feed(log=None):
    def fetch(series, start, end):
        if log is not None:
            log.append((series, start, end))
        days = [date.fromordinal(d) for d in range(start.toordinal(), end.toordinal() + 1)]
        return "[" + ",".join(f'{{"data":"{d:%d/%m/%Y}","valor":"{5 + d.day / 100:.2f}"}}' for d in days if d.weekday() < 5) + "]"

    return fetch


def test_months_are_clipped():
    assert fx.months(date(2026, 6, 15), date(2026, 8, 26)) == [(date(2026, 6, 15), date(2026, 6, 30)), (date(2026, 7, 1), date(2026, 7, 31)), (date(2026, 8, 1), date(2026, 8, 26))]


@pytest.mark.parametrize("body", ["<html>", "{}", '[{"data":"2026-01-02","valor":"5"}]', '[{"data":"02/01/2026","valor":"x"}]', '[{"data":"02/01/2026","valor":"5","more":"1"}]', '[{"data":"02/01/2026","valor":"-1"}]'])
def test_broken_answers_are_refused(body):
    with pytest.raises(ContractError):
        fx.parse_payload(body)


def test_reruns_and_late_backfills_keep_every_day(spark, tmp_path):
    root = str(tmp_path / "fx")
    take = lambda a, b: fx.write_months(spark, fx.extract(spark, "USD", a, b, feed(), NOW), root)
    take(date(2026, 8, 1), date(2026, 8, 26))
    whole = rows(fx.read(spark, root).select("quote_date", "rate_brl"))
    take(date(2026, 8, 3), date(2026, 8, 7))
    assert rows(fx.read(spark, root).select("quote_date", "rate_brl")) == whole and len(whole) == 18
    take(date(2026, 7, 1), date(2026, 7, 2))
    assert fx.read(spark, root).count() == 20
    last = fx.watermark(fx.read(spark, root)).first()["last_quote_date"]
    assert fx.resume_from(last, date(2020, 1, 1)) == date(2026, 8, 1)


def test_an_empty_window_and_the_future(spark):
    assert fx.extract(spark, "EUR", date(2026, 8, 1), date(2026, 8, 2), lambda *a: None, NOW).count() == 0
    with pytest.raises(ContractError, match="future"):
        fx.extract(spark, "EUR", date(2026, 8, 1), date(2027, 1, 1), feed(), NOW)


def test_missing_rates(spark):
    df = spark.createDataFrame([(Decimal("10.05"), Decimal("5.1"), False), (Decimal("10.05"), None, False), (Decimal("10.05"), None, True)], "a decimal(14,2), r decimal(18,8), base boolean")
    got = lambda strict: [r[0] and str(r[0]) for r in df.select(fx.convert(F.col("a"), F.col("r"), F.col("base"), strict)).collect()]
    assert got(False) == ["51.26", "10.05", "10.05"] and got(True) == ["51.26", None, "10.05"]


@pytest.mark.parametrize("key", ["k", "x" * 100])
def test_masks_agree_with_hmac(spark, key):
    values = ["ana@example.com", "", "São Paulo", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = [None if v is None else hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in values]
    for native in (True, False):
        assert [r[0] for r in df.select(masking.masker(key, native=native)(F.col("v"))).collect()] == want


def test_masking_fails_closed(caplog):
    with pytest.raises(masking.MaskingError):
        masking.masker(None)
    masking.masker(None, mode="off")
    assert len(caplog.records) == 3


def test_lsn_and_small_scalars(spark):
    df = spark.createDataFrame([(0x1_01B08670,), (0,), ((1 << 62) + 5,)], "n bigint")
    got = df.select("n", lsn.format_lsn(F.col("n")).alias("t")).withColumn("back", lsn.parse_lsn(F.col("t"))).collect()
    assert [r["t"] for r in got] == ["1/1B08670", "0/0", "40000000/5"] and all(r["n"] == r["back"] for r in got)
    one = spark.range(1).select(lsn.full_offset(F.lit("2025-01-01 00:00:00+00")), lsn.iso_date(F.lit("31/12/2025")), lsn.iso_date(F.lit("2025-12-31")), lsn.iso_date(F.lit("31/02/2025")), lsn.wire_timestamp(F.lit(0).cast("long")).cast("string"), lsn.pretty_size(F.lit(20 * 1024).cast("long"))).first()
    assert tuple(one) == ("2025-01-01 00:00:00+00:00", date(2025, 12, 31), None, None, "2000-01-01 00:00:00", "20 kB")


def test_versions_and_as_of(spark):
    v = spark.createDataFrame([(1, 10, datetime(2024, 1, 2)), (1, 20, datetime(2024, 1, 5)), (2, 30, datetime(2024, 1, 3))], "k int, o int, t timestamp_ntz")
    dim = dimensions.scd2(v, ["k"], "o", "t")
    facts = spark.createDataFrame([(1, datetime(1999, 1, 1)), (1, datetime(2024, 1, 5)), (3, datetime(2024, 1, 1))], "k int, at timestamp_ntz")
    assert rows(dimensions.as_of(facts, dim, "k", "at", ["o"]).select("k", "o")) == [(1, 10), (1, 20), (3, None)]
    assert dimensions.dates(spark.createDataFrame([], "d date")).count() == 0


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(500).withColumn("x", F.col("id") % 7)
    a, b = (checks.fingerprint(f, ["id", "x"]).first() for f in (df.repartition(7), df.repartition(3, "x")))
    assert a == b and a["n_rows"] == 500
    assert checks.fingerprint(df.withColumn("x", F.lit(1)), ["id", "x"]).first()["digest"] != a["digest"]


def test_alerts_can_fire_and_stay_silent(spark):
    at = lambda m: (datetime(2024, 1, 1, 0, m),)
    series = monitor.windows(spark.createDataFrame([at(1), at(2), at(45)], "t timestamp"), "t", "10 minutes")
    assert [r["n"] for r in series.orderBy("window_start").collect()] == [2, 0, 0, 0, 1]
    assert monitor.heartbeat_alerts(series, 1, 3).count() == 1 and monitor.heartbeat_alerts(series, 1, 4).count() == 0
    assert monitor.vacuous(series).count() == 0 and monitor.vacuous(series.where("n > 9")).count() == 1
    assert monitor.retained_log(spark.createDataFrame([], "slot_name string, restart_lsn bigint, position bigint"), "position").first()["retained"] == 0
