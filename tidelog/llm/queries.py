"""The thin queries of this subpackage: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, fingerprint, hmm_lm, html_extract, langid, minhash_near, mixing, quality, secret_scan, vector_near
from .common import in_fold, table

#: Weights of the sources in order, their share of all words, and the most passes over a document.
MIX_WEIGHTS, MIX_TOTAL, MIX_MOST = (5.0, 2.0, 1.0), 1.5, 2


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", in_fold("doc_id", 4, 2).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("held_out",))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model | None:
    """Learned from labels outside the held-out fold, and unlabelled texts of docs outside it."""
    good = table(spark, sf_dir, "labels").where((F.col("quality") == 1) & ~in_fold("doc_id", 5, 0)).select("doc_id")
    return quality.train(docs.where(~in_fold("doc_id", 5, 0)), good)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, docs, sf_dir)
    return quality.score(docs.withColumn("held_out", in_fold("doc_id", 5, 0)), model, 0.3, keep=("held_out",))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    every = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(every, lambda s: s["kinds"].isin([r.kind for r in secret_scan.BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"), MIX_WEIGHTS, MIX_TOTAL, MIX_MOST)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = hmm_lm.score(docs, ~in_fold("doc_id", 5, 1))
    return scored.withColumn("held_out", in_fold("doc_id", 5, 1)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ("ids_sha256", "decoded_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES = (op1_language_id, op2_embedding_near_dedup, op3_quality_classifier, op4_secret_scan, op5_minhash_near_dedup, op6_html_extraction, op7_source_mixing, op8_lm_scoring, op9_bpe, op10_fingerprints, pipeline)


def queries() -> dict:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """None of these is expressible in SQL over whole tables; tests compare them with brute force."""
    return {}
