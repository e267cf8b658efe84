"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI, AQE and static overwrite.

    ``shuffle_partitions`` stays unset on a cluster: start from about 128 MB of shuffle a
    partition and let AQE merge the small ones.
    """
    builder = SparkSession.builder.master(master).appName("tidelog")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of a batch that goes to a Python worker, where the session has Spark's default of 64 MB: a worker and its JVM hold a few at once.
BATCH, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16777216b"

_ready: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, and bound the batches that go to them.

    Locally by the path; on a cluster the package also goes there as a zip, once an application.
    """
    if spark.conf.get(BATCH) == BATCH_DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _ready:
        return
    root = Path(__file__).resolve().parent.parent
    known = sc.environment.get("PYTHONPATH", "")
    if str(root) not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), known) if x)
    if not sc.master.startswith("local"):
        target = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted((root / "tidelog").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(target))
    _ready.add(sc.applicationId)
