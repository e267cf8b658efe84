"""Daily exchange rates: extraction by month, merge, watermark, conversion."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contracts import ContractError

OBSERVATIONS = "source string, ingested_at timestamp, series_code int, currency string, quote_date date, rate_brl decimal(18,8)"
#: Series of the daily feed by currency (fixed values).
SERIES = {"USD": 1, "EUR": 21619}


def convert(amount: Column, rate: Column, is_base: Column, strict: bool = False) -> Column:
    """The amount in the base currency, decimal(18,2), half up. A missing rate counts as 1, or with ``strict`` as null."""
    factor = F.when(is_base, F.lit(Decimal(1)).cast("decimal(18,8)")).otherwise(rate) if strict else F.coalesce(rate, F.lit(Decimal(1)).cast("decimal(18,8)"))
    return F.round(amount.cast("decimal(14,2)") * factor, 2).cast("decimal(18,2)")


def watermark(observations: DataFrame) -> DataFrame:
    """The last quoted day of each currency."""
    return observations.groupBy("currency").agg(F.max("quote_date").alias("last_quote_date"))


def resume_from(last: date | None, default: date) -> date:
    """Extraction resumes at the start of the watermark's month, whose file is rewritten whole."""
    return last.replace(day=1) if last else default


def months(start: date, end: date) -> list[tuple[date, date]]:
    """Calendar months from start to end, clipped to them."""
    out, a = [], start
    while a <= end:
        following = (a.replace(day=1) + timedelta(days=32)).replace(day=1)
        out.append((a, min(end, following - timedelta(days=1))))
        a = following
    return out


def parse_payload(body: str) -> list[tuple[date, Decimal]]:
    """(day, rate) of a response: a JSON list of {"data": "DD/MM/YYYY", "valor": "1.23"} and nothing else."""
    try:
        rows = json.loads(body)
    except ValueError as e:
        raise ContractError(f"the feed did not answer with JSON: {body[:80]!r}") from e
    out = []
    if not isinstance(rows, list):
        raise ContractError("the feed did not answer with a list")
    for r in rows:
        if not isinstance(r, dict) or set(r) != {"data", "valor"} or not all(isinstance(v, str) for v in r.values()):
            raise ContractError(f"unexpected observation {r!r}")
        if not re.fullmatch(r"\d{2}/\d{2}/\d{4}", r["data"]):
            raise ContractError(f"no DD/MM/YYYY date: {r['data']!r}")
        try:
            rate = Decimal(r["valor"])
        except InvalidOperation as e:
            raise ContractError(f"no rate: {r['valor']!r}") from e
        if not rate.is_finite() or rate <= 0:
            raise ContractError(f"no positive rate: {r['valor']!r}")
        out.append((datetime.strptime(r["data"], "%d/%m/%Y").date(), rate))
    return out


def http_fetch(url: str, timeout: float = 30.0) -> Callable[[int, date, date], str | None]:
    """A ``fetch`` over HTTP: ``url`` has a place {} for the series; 404 means that a window has no quotes; other errors are raised."""

    def fetch(series: int, start: date, end: date) -> str | None:
        if start > end:
            raise ValueError(f"a window from {start} to {end}")
        query = urllib.parse.urlencode({"formato": "json", "dataInicial": f"{start:%d/%m/%Y}", "dataFinal": f"{end:%d/%m/%Y}"})
        try:
            with urllib.request.urlopen(f"{url.format(series)}?{query}", timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    return fetch


def extract(spark: SparkSession, currency: str, start: date, end: date, fetch: Callable[[int, date, date], str | None], now: datetime) -> DataFrame:
    """Observations of a currency: one request for each month, ``fetch(series, start, end)`` giving the body or None for none.

    The feed is a few rows a month, so it is read by the driver; a day in the future is refused.
    """
    if end > now.date():
        raise ContractError(f"{end} is in the future")
    rows = []
    for a, b in months(start, end):
        body = fetch(SERIES[currency], a, b)
        rows += [("sgs", now, SERIES[currency], currency, d, r) for d, r in (parse_payload(body) if body is not None else [])]
    return spark.createDataFrame(rows, OBSERVATIONS)


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of observations; of the same currency and day the one taken in last, then the new one.

    Rewriting a month from what was merged loses no day of it, in whatever order windows arrive.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy("currency", "quote_date").orderBy(F.desc("ingested_at"), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def write_months(spark: SparkSession, new: DataFrame, root: str) -> None:
    """Merge observations into the months they touch under ``root`` and overwrite those only.

    What is merged is written beside ``root`` first, as the files that it is read from are replaced.
    """
    from ..sources.tables import delete, exists

    with_parts = lambda df: df.withColumns({"currency_p": F.col("currency"), "month": F.date_format("quote_date", "yyyy-MM")})
    new, beside = with_parts(new), f"{root.rstrip('/')}-{uuid.uuid4().hex}"
    if exists(spark, root):
        touched = new.select("currency_p", "month").distinct()
        old = spark.read.schema(OBSERVATIONS + ", currency_p string, month string").parquet(root).join(touched, ["currency_p", "month"], "left_semi")
        merged = with_parts(merge(old.drop("currency_p", "month"), new.drop("currency_p", "month")))
        merged.write.parquet(beside)
        new = spark.read.schema(merged.schema).parquet(beside)
    try:
        new.repartition("currency_p", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("currency_p", "month").parquet(root)
    finally:
        delete(spark, beside)


def read(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OBSERVATIONS + ", currency_p string, month string").parquet(root).drop("currency_p", "month")
