"""The streaming path: frames to the change log, confirmed after the write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contracts import CONTRACTS, require_valid_rows
from ..operators.history import key_text
from ..sources.frames import FrameDump
from .metrics import Metrics, counts_of, observed


def change_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(FrameDump)
    return spark.readStream.format("frame_dump").options(**options).load(path)


def append_to_log(batch: DataFrame, root: str) -> tuple[dict[str, int], int | None]:
    """Append a batch to the log, by table and commit day. Late changes go to the day they were committed.

    Returns the rows written by table and their last position, as observed by the write itself.
    """
    rows, seen = observed(batch, sorted({c.table for c in CONTRACTS.values()}))
    rows.withColumn("dt", F.to_date("commit_time")).repartition("table_name", "dt").write.mode("append").partitionBy("table_name", "dt").option("compression", "zstd").parquet(root)
    return counts_of(seen)


def resume_offset(spark: SparkSession, checkpoint: str) -> str | None:
    """The last offset that a query planned at its checkpoint, as the frame source's ``resume``; None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    system = folder.getFileSystem(conf)
    if not system.exists(folder):
        return None
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    batches = sorted(int(n) for n in names if n.isdigit())
    if not batches:
        return None
    lines = spark.read.option("wholetext", True).text(f"{checkpoint}/offsets/{batches[-1]}").first()["value"].splitlines()
    return next((x for x in reversed(lines) if x.startswith("{") and '"lsn"' in x), None)  # version, metadata, then a line a source


def ingest(spark: SparkSession, path: str, root: str, checkpoint: str, after_write: Callable[[int], None] | None = None, metrics: Metrics | None = None, **options: str) -> StreamingQuery:
    """Copies a frame dump to the log in batches that end at commits, until it is stopped; see ingest_all.

    Every change is held against its table's contract before any row of its batch is written
    (option contracts=off turns that off). At least once: if the query dies between the write and
    its commit, the batch is written again, and ``without_replays`` drops the copies.
    ``after_write`` is a hook for tests of that.
    """
    resume = resume_offset(spark, checkpoint)
    if resume:
        options["resume"] = resume

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # read once, for the check and the write
        try:
            if options.get("contracts", "on") == "on":
                require_valid_rows(batch)
            written, position = append_to_log(batch, root)
        finally:
            batch.unpersist()
        if after_write:
            after_write(epoch)
        if metrics:
            metrics.record(written, position)

    return change_stream(spark, path, **options).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()


def ingest_all(spark: SparkSession, path: str, root: str, checkpoint: str, **options) -> None:
    """Copies what a frame dump has now, and returns; raises what stopped it."""
    query = ingest(spark, path, root, checkpoint, **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def without_replays_stream(log: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Replays dropped in a stream: by table, key and position, remembered for ``delay`` of commit time."""
    return log.withColumn("key_json", key_text(keys)).withWatermark("commit_time", delay).dropDuplicatesWithinWatermark(["table_name", "key_json", "lsn_numeric"]).drop("key_json")


def event_windows(events: DataFrame, time: str, width: str, slide: str | None = None, delay: str | None = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Counts of tumbling or sliding event-time windows. Without ``delay`` the stream's own watermark holds, as after without_replays_stream."""
    return (events.withWatermark(time, delay) if delay else events).groupBy(*(by or []), F.window(time, width, slide)).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, by: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Counts of sessions that a pause of ``gap`` ends."""
    return events.withWatermark(time, delay).groupBy(F.col(by), F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
