"""Alert rules over heartbeat, write-rate and retained-log series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds (fixed values): records in ten minutes, and retained bytes.
LEAST_RECORDS, MOST_RETAINED = 1, 52_428_800


def windows(events: DataFrame, time: str, width: str, by: list[str] | None = None) -> DataFrame:
    """(by, window_start, n) of tumbling windows, the empty ones between first and last included."""
    by = by or []
    start = F.window(F.col(time), width)["start"]
    counts = events.groupBy(*by, start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).where("a is not null")
    spine = bounds.select(F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("window_start"))
    if by:
        spine = spine.crossJoin(counts.select(*by).distinct())
    return spine.join(counts, [*by, "window_start"], "left").select(*by, "window_start", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rolling(events: DataFrame, time: str, width: str, step: str, by: list[str] | None = None) -> DataFrame:
    """(by, instant, n): events in the ``width`` up to each instant on the grid of ``step``, from the first event to the last, zeros included.

    Events are counted by step first, and each count is dealt to the instants that see it, so no
    window function orders the series. ``width`` must be a multiple of ``step``.
    """
    by, w, s = by or [], _micros(width), _micros(step)
    if w % s:
        raise ValueError(f"{width} is no multiple of {step}")
    kind = events.schema[time].dataType
    us = F.unix_micros(F.col(time).cast("timestamp"))
    slot = (F.ceil(us / F.lit(s)) * s).cast("long")  # the first instant that sees the event
    counts = events.groupBy(*by, slot.alias("__slot")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.withColumn("__t", F.explode(F.sequence(F.col("__slot"), F.col("__slot") + (w - s), F.lit(s).cast("long")))).groupBy(*by, "__t").agg(F.sum("n").alias("n"))
    bounds = counts.agg(F.min("__slot").alias("a"), F.max("__slot").alias("b")).where("a is not null")
    spine = bounds.select(F.explode(F.sequence("a", "b", F.lit(s).cast("long"))).alias("__t"))
    if by:
        spine = spine.crossJoin(counts.select(*by).distinct())
    return spine.join(seen, [*by, "__t"], "left").select(*by, F.timestamp_micros("__t").cast(kind).alias("instant"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _micros(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def firing(series: DataFrame, step: str, held_for: str, least: int = LEAST_RECORDS, by: list[str] | None = None) -> DataFrame:
    """(by, instant) of the instants at which an alert fires: n was below ``least`` there and at all instants of the time ``held_for`` before.

    series: (by, instant, n) on a grid of ``step``. Each low instant is dealt to those that look back on
    it; one fires if all of them are low.
    """
    by, s = by or [], _micros(step)
    back = _micros(held_for) // s
    us = F.unix_micros(F.col("instant").cast("timestamp"))
    low = series.where(F.col("n") < least).select(*by, F.explode(F.sequence(us, us + back * s, F.lit(s).cast("long"))).alias("__t"))
    full = low.groupBy(*by, "__t").agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") == back + 1)
    there = series.select(*by, "instant", us.alias("__t"))
    return there.join(full, [*by, "__t"], "left_semi").select(*by, "instant")


def heartbeat_alerts(series: DataFrame, least: int = LEAST_RECORDS, rounds: int = 1, width: str = "10 minutes") -> DataFrame:
    """(first_window, last_window, n_windows) of runs of at least ``rounds`` windows below ``least`` (gaps and islands).

    Runs are found a day at a time, and those that meet at midnight are joined: what meets in one
    task are the runs, not the windows.
    """
    step = F.lit(_micros(width)).cast("long")
    us = F.unix_micros(F.col("window_start").cast("timestamp"))
    low = series.where(F.col("n") < least).select("window_start", us.alias("t"), F.floor(us / F.lit(86_400_000_000)).alias("day"))
    in_day = Window.partitionBy("day").orderBy("t")
    daily = low.withColumn("run", F.col("t") - step * F.row_number().over(in_day)).groupBy("day", "run").agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"), F.min("t").alias("ta"), F.max("t").alias("tb"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("ta")  # runs of low windows only
    begins = F.when(F.col("ta") - F.lag("tb").over(order) == step, 0).otherwise(1)
    joined = daily.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    runs = joined.groupBy("run").agg(F.min("a").alias("first_window"), F.max("b").alias("last_window"), F.sum("n").alias("n_windows"))
    return runs.where(F.col("n_windows") >= rounds).drop("run")


def retained_log(slots: DataFrame, position: str, most: int = MOST_RETAINED) -> DataFrame:
    """One row: the most bytes any slot (slot_name, restart_lsn) retains at a position, and whether that is too many."""
    return slots.agg(F.coalesce(F.max(F.col(position) - F.col("restart_lsn")), F.lit(0)).cast("long").alias("retained")).withColumn("firing", F.col("retained") > most)


def vacuous(series: DataFrame) -> DataFrame:
    """One row if a rule's series has no data at all: no data is an alert of its own."""
    return series.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no data").alias("problem"))
