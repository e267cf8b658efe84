"""Calendars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_weekday(day: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(day) + 1


def date_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each day of each row's span, as ``date_day``; none for a null span."""
    return bounds.where(F.col(first).isNotNull() & F.col(last).isNotNull()).select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("date_day"))


def date_parts(days: DataFrame, day: str = "date_day") -> DataFrame:
    d = F.col(day)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_sk"),
        d.alias("date_day"),
        F.year(d).cast("long").alias("year"),
        F.month(d).cast("long").alias("month"),
        F.dayofmonth(d).cast("long").alias("day_of_month"),
        iso_weekday(d).cast("long").alias("iso_day_of_week"),
        (iso_weekday(d) >= 6).alias("is_weekend"),
    )


def month_windows(spans: DataFrame, start: str, end: str) -> DataFrame:
    """(window_start, window_end) of each calendar month of each span, clipped to it."""
    month = F.explode(F.sequence(F.trunc(F.col(start), "MM"), F.col(end), F.expr("interval 1 month")))
    return spans.withColumn("__m", month).select(F.greatest(F.col(start), F.col("__m")).alias("window_start"), F.least(F.col(end), F.last_day("__m")).alias("window_end"))


def span(spark: SparkSession, start: date, end: date) -> DataFrame:
    return spark.createDataFrame([(start, end)], "start date, end date")
