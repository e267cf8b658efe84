"""Reading tables and paths, on whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The change log: append-only, one row a change, tuples as maps of text.
CHANGE_LOG = (
    "source string, source_system_id string, ingested_at timestamp, lsn string, lsn_numeric bigint, xid bigint, commit_time timestamp, action string, schema_name string, table_name string, "
    "key map<string,string>, before map<string,string>, after map<string,string>, unchanged_toast_columns array<string>, truncate_cascade boolean, truncate_restart_identity boolean"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, root: str, table_name: str | None = None) -> DataFrame:
    """The log under ``root``, partitioned by table and commit day; a table name prunes partitions."""
    log = spark.read.schema(CHANGE_LOG + ", dt date").option("mergeSchema", "false").parquet(root).drop("dt")
    return log if table_name is None else log.where(log["table_name"] == table_name)


def glob(spark: SparkSession, pattern: str, schema: str | None = None) -> DataFrame:
    """All Parquet files under a pattern, at any depth."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).parquet(pattern)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _at(spark, path)
    return system.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it, if it is there."""
    system, p = _at(spark, path)
    system.delete(p, True)
