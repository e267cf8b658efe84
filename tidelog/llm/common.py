"""What the operators of this subpackage share: folds, samples, scratch tables, order, links."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LEAST_SHARE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def in_fold(key: str, n: int, held: int) -> Column:
    """Whether a row is held out; a null key is in no fold and so is not."""
    return F.coalesce(fold(key, n) == held, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- memory of Python workers ------------------------------------------------------------------

#: What an operator keeps in a worker from task to task, by its name: see keep_only.
KEPT: dict[str, dict] = {}


def keep_only(name: str | None = None) -> None:
    """Empties what other operators keep in this worker, as workers are used again by whatever comes next."""
    for other, held in KEPT.items():
        if other != name:
            held.clear()


def tidy() -> None:
    """Gives memory that was freed back to the machine: workers live on, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.malloc_trim  # noqa: B018
        return libc
    except (OSError, AttributeError):
        return None


_LIBC = _libc()

# --- bounded samples ------------------------------------------------------------------------


def sampled(df: DataFrame, key: str, most: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key: the same rows in every run.

    For fitting only. ``total`` is the row count if it is known already.
    """
    total = df.count() if total is None else total
    if total <= most:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(span)) < int(span * most / total))


# --- tables in the shared folder -------------------------------------------------------------


class Scratch:
    """Written tables in the folder that the cluster shares, to cut lineage and survive lost executors.

    The folder is that of ``spark.checkpoint.dir``, or the one the session was given. Without either
    a cluster is refused; a local session gets a folder of its own, as all its tasks see that.
    """

    #: Folders of this process that still hold tables.
    live: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            if shared is None and not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelog-"))
        self.root = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.n = 0
        Scratch.live.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in tables:
            self._delete(df._scratch_path)

    def close(self) -> None:
        """Delete all tables: what was made of them must have been written."""
        self._delete(self.root)
        Scratch.live.remove(self)

    def _delete(self, name: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def closing_scratch() -> Iterator[None]:
    """Closes, at its end, every scratch that was opened inside it: results must have been written elsewhere by then."""
    before = list(Scratch.live)
    yield
    for s in [s for s in Scratch.live if s not in before]:
        s.close()


# --- hot keys --------------------------------------------------------------------------------


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """(keys, parts) of the keys that have more rows than half a partition's share of ``total``.

    As the counts add up to ``total`` at most, these are at most two for each partition, however
    many rows there are: they may be collected and broadcast. ``parts`` is over how many parts such
    a key's rows are dealt.
    """
    share = max(_LEAST_SHARE, total // (2 * partitions(counts.sparkSession)))
    return counts.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("parts"))


def gathered(hot: DataFrame) -> DataFrame | None:
    """Hot keys as a local table, so that joins read them without counting again; None if there is none."""
    rows = hot.collect()  # two a partition at most
    return hot.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def split_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has one row a key, with rows of hot keys dealt to parts.

    A row of ``many`` goes to a part of its key by a hash of ``by`` and of its partition (rows that
    are equal in everything are split by the latter); the row of ``one`` goes to each part. Other
    keys have one part. Columns: keys, then those of many and one.
    """
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot.select(*keys, F.col("parts").alias("__parts")))  # two a partition at most
    part = F.coalesce(F.pmod(F.xxhash64(*by, F.spark_partition_id()), F.col("__parts")), F.lit(0)).cast("int")
    a = many.join(hot, keys, "left").withColumn("__part", part).drop("__parts")
    b = one.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")


# --- neighbours in a total order ---------------------------------------------------------------


def assigned(df: DataFrame, order: list[str], before: bool = False, after: bool = True, per_sample: int = 64) -> DataFrame:
    """Rows with the range of ``order`` they belong to, and borrowed neighbours.

    Each range also gets the first row of the next non-empty one (``after``) and the last row of the
    one before (``before``), so a pass over a sorted range sees every row's neighbours and no row's
    neighbours depend on the partitioning. Adds ``part`` and ``own`` (false for a borrowed row).
    Only keys go to the driver: a bounded sample for the bounds, then one first and one last key for
    each range. ``order`` must be a total order (rows that repeat a key stay together); nulls come
    first. Costly columns are best made after this, so that they are made once.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    keys = df.select(*order)
    sample = sorted((tuple(r) for r in sampled(keys.withColumn("__k", F.concat_ws("\x00", *[F.col(c).cast("string") for c in order])), "__k", per_sample * n, 7).drop("__k").collect()), key=_null_first)
    bounds = sorted({sample[i * len(sample) // n] for i in range(1, n)}, key=_null_first) if sample else []
    at = _range_of(bounds)(F.struct(*order))
    ends = keys.withColumn("part", at).groupBy("part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).orderBy("part").collect()  # one row a partition
    lends: list[tuple[int, int, tuple]] = []
    for here, there in zip(ends, ends[1:]):
        if after:
            lends.append((here["part"], there["part"], tuple(there["first"])))
        if before:
            lends.append((there["part"], here["part"], tuple(here["last"])))
    dealt = df.withColumn("part", at).withColumn("own", F.lit(True))
    to = {}
    for target, home, key in lends:
        to.setdefault((home, _null_first(key)), []).append(target)
    if to:
        schema = df.select(*order).schema
        extra = spark.createDataFrame([(home, *key, target) for target, home, key in lends], "home int, " + ", ".join(f"`__{f.name}` {f.dataType.simpleString()}" for f in schema) + ", target int")
        match = [F.col("part") == F.col("home"), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order]]
        on = match[0]
        for m in match[1:]:
            on = on & m
        lent = dealt.join(F.broadcast(extra), on).select(*df.columns, F.col("target").alias("part"), F.lit(False).alias("own"))  # at most two rows a partition
        dealt = dealt.unionByName(lent)
    return dealt


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Assigned rows dealt out, a range to a partition, and sorted there."""
    return rows.repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("part", *order)


def _null_first(key) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in key)


def _range_of(bounds: list[tuple]):
    """A function of a struct of keys: how many of the sorted bounds are at most it."""
    plain = [_null_first(b) for b in bounds]

    @F.arrow_udf("int")
    def range_of(keys):
        import pyarrow as pa

        columns = [keys.field(i).to_pylist() for i in range(keys.type.num_fields)]
        return pa.array([bisect_right(plain, _null_first(k)) for k in zip(*columns)], pa.int32())

    return range_of


# --- connected components ----------------------------------------------------------------------


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (a[i], b[i]) that a union-find needs to join what they join."""
    parent, used = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            used.append((x, y))
    return used


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v), component being its smallest node.

    Alternating large-star and small-star rounds: each links every neighbour straight to the
    smallest known node, so the number of rounds follows the logarithm of the diameter, and edges
    never outnumber the input's. Minima are aggregated before the shuffle; the neighbours of a hub
    are dealt to parts, each of which gets the hub's one row of the minima.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, mark = _written(e, scratch)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = split_join(both, low.drop("n"), ["u"], hot_keys(low, ["u"], 2 * mark[0]), ["v"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = split_join(large, low.drop("n"), ["u"], hot_keys(low, ["u"], mark[0]), ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("s")).select("s.*").where("u != v").distinct()
        nxt, now = _written(small, scratch)
        scratch.drop(e)
        e, done, mark = nxt, now == mark, now
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _written(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    e = scratch.write(e)
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return e, (r["n"], r["h"])
