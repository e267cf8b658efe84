"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage works on all that the one before it kept, and is written as Parquet in the shared folder
before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, minhash_near, mixing, quality, secret_scan
from tidelog.llm.common import Scratch, closing_scratch, table
from tidelog.llm.queries import MIX_MOST, MIX_TOTAL, MIX_WEIGHTS, quality_model, vocabulary
from tidelog.session import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null text is scored as an empty one. Rows without an id are scored too, and teach nothing;
    rows that repeat an id are each judged by their own text. Without a trusted label no document
    is rejected. An empty table stays empty; no column but ``text`` decides.
    """
    ship(spark)
    model = quality_model(spark, docs, sf_dir)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(rows, model, 0.3, id_col="row").where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, one without an id last.

    Null texts and texts without a word are classes of their own and stay. Rows that repeat an id
    and differ in text are documents of their own; of rows that repeat id and text one stays, of
    those that tie for the smallest id the one with the smallest address. Very long texts are
    compared whole. An empty table stays empty; other columns do not decide.
    """
    ship(spark)
    return minhash_near.without_near_duplicates(docs, 0.8)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked and lengths brought up to date.

    A null text stays null with its length as it was; rows without an id or with a repeated one,
    and repeated rows, each keep their place; texts are scanned whole. An empty table stays empty.
    """
    ship(spark)
    masked = secret_scan.redact(docs)
    return masked.select(*[F.when(F.col("text").isNull(), F.col(c)).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix passes over it, rounded: not at all, once or twice.

    A null or empty text has no words to take and goes. A null source is a source of its own. Rows
    without an id, with a repeated one, or that repeat another row are each passed over by
    themselves. An empty table stays empty.
    """
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    mixed = mixing.mix(rows, F.array("source"), MIX_WEIGHTS, MIX_TOTAL, MIX_MOST, keep=("row",)).where("passes > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the digest of what they decode to; a null text has no tokens."""
    ship(spark)
    return bpe.encode(docs, vocabulary(), ("ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: No stage is expressible in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch, before = Scratch(spark), None
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with closing_scratch():  # what a stage writes on its way goes with it
            docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
