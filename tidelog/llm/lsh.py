"""Near-duplicate classes by banded signatures and exact verification, for any measure of shingle sets.

1. Documents of equal shingles collapse to the one with the smallest id.
2. Signatures are cut to bands; documents that share a band's key are candidates.
3. A star round verifies each document of a bucket with the bucket's smallest one: as many pairs as
   rows. Verified links give components.
4. Where a bucket still holds several components, all its pairs between different ones whose
   signatures and weights allow the threshold are verified in place, block by block.

So a bucket of many copies costs a pair a row, and pairs that step 3 leaves open are still compared:
every candidate pair ends in one component, or verified, or ruled out by its signature.

A row is addressed by a 128-bit hash of its id and text, never by its id alone, so rows that share
an id and differ are documents of their own. Groups of copies, buckets and classes that hold more
than a partition's share of rows are dealt to parts wherever they are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import Scratch, components, forest, gathered, hot_keys, keep_only, split_join, tidy

WIDTH = 5
#: Rows and bytes of texts (or bodies) of a block; a longer text is a block of its own.
BLOCK, BLOCK_BYTES = 256, 2_000_000
_COLUMNS = 4096


class Measure:
    """What classes need of a similarity of shingle sets. Shingles are sorted and distinct."""

    bands: int
    rows: int
    #: How many of the bands, the last ones, are of plain sets. With any, the plain similarity may link a pair too.
    plain: int = 0

    def signature(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def signatures(self, rows: DataFrame) -> DataFrame:
        """What classes need of each row (id, k1, k2, text) that has a word: see signatures."""
        return signatures(rows, self)

    def bodies(self, rows: DataFrame, sigs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted rows (node, k1, k2), from which sets makes shingles and weights."""
        return rows.join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")

    def sets(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(s, self.weights(s, c)) for s, c in shingle_sets(texts)]

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        """Weighted Jaccard of (shingles, weights) of two documents: sum of minima over sum of maxima."""
        (x, v), (y, w) = a[:2], b[:2]
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        low = float(np.minimum(v[i], w[j]).sum())
        return low / (float(v.sum()) + float(w.sum()) - low) if low else 0.0

    @staticmethod
    def number(s: tuple) -> int:
        """How many shingles a document has: a third item tells it where the first leaves some out."""
        return s[2] if len(s) > 2 else len(s[0])


def shingle_sets(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of five lower-case words and their counts, for each whole text of a column."""
    for _, h, at in textvec.words(textvec.lower(column)):
        for s in textvec.shingles(h, at, WIDTH):
            yield np.unique(s, return_counts=True)


def digest(shingles: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
    both = textvec.mix(shingles * np.uint64(0x9E3779B97F4A7C15) + counts.astype(np.uint64))
    return int(both.sum().astype(np.int64)), int(textvec.mix(both ^ np.uint64(0xA5A5A5A5)).sum().astype(np.int64))


def address(id_col: str, text_col: str) -> list[Column]:
    """The address of a row: k1 and k2, hashes of its id and text; nulls count as such."""
    both = [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col), F.lit("\x00"))]
    return [F.xxhash64(F.lit(1), *both).alias("k1"), F.xxhash64(F.lit(2), *both[::-1]).alias("k2")]


def has_word(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def signatures(rows: DataFrame, measure: Measure) -> DataFrame:
    """id, k1, k2, d1, d2 (digest of the shingles and counts), weight and signature of each text that has a word."""
    shared = rows.sparkSession.sparkContext.broadcast(measure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep, d1, d2, weight, sig = [], [], [], [], []
            for i, (s, c) in enumerate(shingle_sets(batch.column(3))):
                if not len(s):
                    continue
                keep.append(i)
                for d, x in zip((d1, d2), digest(s, c)):
                    d.append(x)
                weight.append(float(m.weights(s, c).sum()))
                sig.append(m.signature(s, c).astype("<u4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(weight, pa.float64()), pa.array(sig, pa.binary())], ["id", "k1", "k2", "d1", "d2", "weight", "sig"])

    return rows.select("id", "k1", "k2", "text").mapInArrow(run, "id bigint, k1 bigint, k2 bigint, d1 bigint, d2 bigint, weight double, sig binary")


def keys_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of signatures (rows of a matrix), by band; bands never share a key but by chance."""
    parts = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(textvec.seeded(29, bands), (len(sig), bands))
    for r in range(rows):
        key = textvec.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def band_keys(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node): a row for each band of each signature."""

    @F.arrow_udf("array<bigint>")
    def keys(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int64()))
        key = keys_of(np.stack([np.frombuffer(s.as_py(), "<u4") for s in column]), bands, rows)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1)))

    return sigs.select(F.explode(keys("sig")).alias("key"), "node")


def verified(pairs: DataFrame, texts: DataFrame, measure: Measure, threshold: float, hot: DataFrame | None = None) -> DataFrame:
    """Pairs (u, v) of nodes whose texts (node, text) reach the threshold, with their similarity. hot: (v, parts) of a v with many pairs."""
    shared = pairs.sparkSession.sparkContext.broadcast(measure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                left, right = (m.sets(batch.column(k)) for k in (2, 3))
                sim = [m.similarity(x, y) for x, y in zip(left, right)]
                keep = pa.array([i for i, s in enumerate(sim) if s >= threshold], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sim, pa.float64()).take(keep)], ["u", "v", "similarity"])
        tidy()

    a = texts.select(F.col("node").alias("u"), F.col("text").alias("tu"))
    b = texts.select(F.col("node").alias("v"), F.col("text").alias("tv"))
    return split_join(pairs.join(a, "u"), b, ["v"], hot, ["u"]).select("u", "v", "tu", "tv").mapInArrow(run, "u bigint, v bigint, similarity double")


def common_weights(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums of minima of all pairs of (shingles, weights), by products of matrices.

    A shingle's weights become steps: min(v, w) is the sum of the steps that both reach. Steps that
    one document alone reaches are left out; the others are multiplied some thousand at a time.
    """
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    shingle, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    order = np.lexsort((weight, shingle))
    doc, shingle, weight = doc[order], shingle[order], weight[order]
    new_shingle = np.concatenate([[True], shingle[1:] != shingle[:-1]])
    new_step = new_shingle | np.concatenate([[True], weight[1:] != weight[:-1]])
    step = np.cumsum(new_step) - 1
    first = np.flatnonzero(new_step)
    size = weight[first] - np.where(new_shingle[first], 0, weight[np.maximum(first - 1, 0)])
    lowest = step[np.maximum.accumulate(np.where(new_shingle, np.arange(len(shingle)), 0))]
    times = step - lowest + 1  # a weight reaches its own step and those below it
    at = np.repeat(step - times + 1, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc = np.repeat(doc, times)
    often = np.bincount(at, minlength=len(size))
    name = np.cumsum(often > 1) - 1
    keep = often[at] > 1
    at, doc, root = name[at[keep]], doc[keep], np.sqrt(size[often > 1])
    order = np.argsort(at, kind="stable")
    at, doc = at[order], doc[order]
    out = np.zeros((n, n))
    for a in range(0, len(root), _COLUMNS):
        i, j = np.searchsorted(at, (a, a + _COLUMNS))
        m = np.zeros((n, min(_COLUMNS, len(root) - a)), np.float32)
        m[doc[i:j], at[i:j] - a] = root[at[i:j]]
        out += m @ m.T
    return out


def open_links(members: DataFrame, sizes: DataFrame, measure: Measure, threshold: float, hot: DataFrame | None = None) -> DataFrame:
    """Verified links (u, v) between documents of one bucket and different components, as spanning forests.

    members: key, node, component, weight, sig, text; sizes: key, n, bytes; hot: (key, parts) of
    large buckets. A large bucket is cut to blocks of bounded rows and bytes and each pair of blocks
    is a task, which verifies its pairs and returns no more links than it has rows. A pair is
    verified in the first band that it shares. Ruled out are pairs whose weights differ too much to
    reach the threshold, and those with fewer equal signature values than the threshold would give
    five standard deviations below its mean; with plain bands, only those whose equal values there
    are too few as well.
    """
    shared = members.sparkSession.sparkContext.broadcast(measure)
    hashes, minima = (measure.bands - measure.plain) * measure.rows, measure.plain * measure.rows
    least, least_plain = (threshold * n - 5 * (n * threshold * (1 - threshold)) ** 0.5 for n in (hashes, minima))
    cut = sizes.select("key", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("nb"))
    placed = split_join(members, cut, ["key"], hot, ["node"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "component", "weight", "sig", "text")

    def run(group: pa.Table) -> pa.Table:
        keep_only()
        tidy()
        m = shared.value
        i, j, key = (group.column(c)[0].as_py() for c in ("i", "j", "key"))
        ids, comp, weight, block = (group.column(c).to_numpy() for c in ("node", "component", "weight", "b"))
        sig = np.stack([np.frombuffer(s.as_py(), "<u4") for s in group.column("sig")])
        keys = keys_of(sig, m.bands, m.rows)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        xs, ys = [], []
        for x in left:
            y = right[(ids[right] > ids[x]) & (comp[right] != comp[x])] if i == j else right[comp[right] != comp[x]]
            near = np.minimum(weight[y], weight[x]) >= (threshold - 1e-9) * np.maximum(weight[y], weight[x])
            equal = sig[y] == sig[x]
            near &= equal[:, :hashes].sum(1) >= least
            if minima:
                near |= equal[:, hashes:].sum(1) >= least_plain
            y = y[near]
            if len(y):
                band = (keys[y] == keys[x]).argmax(1)
                y = y[keys[x, band] == key]
                xs.append(np.full(len(y), x))
                ys.append(y)
        none = [np.zeros(0, np.int64)]
        x, y = np.concatenate(xs or none), np.concatenate(ys or none)
        if len(x):
            used, to = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y = to[: len(x)], to[len(x) :]
            sets = m.sets(group.column("text").take(pa.array(used)))
            if len(x) > 4 * len(used):
                low = common_weights(sets)[x, y]
                w = weight[used]
                sim = low / np.maximum(w[x] + w[y] - low, 1e-300)
                if minima:
                    low = common_weights([(s[0], np.ones(len(s[0]))) for s in sets])[x, y]
                    n = np.array([m.number(s) for s in sets])
                    sim = np.maximum(sim, low / (n[x] + n[y] - low))
                for k in np.flatnonzero(np.abs(sim - threshold) < 1e-4):
                    sim[k] = m.similarity(sets[x[k]], sets[y[k]])
            else:
                sim = np.array([m.similarity(sets[p], sets[q]) for p, q in zip(x, y)])
            good = sim >= threshold
            pairs = forest(len(used), x[good], y[good])
            x, y = (used[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
        return pa.table({"u": pa.array(np.maximum(ids[x], ids[y])), "v": pa.array(np.minimum(ids[x], ids[y]))})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u bigint, v bigint").distinct()


class Classes:
    """Near-duplicate classes of the rows of a table, held in scratch tables.

    rows: (id, text, k1, k2) of docs; hot: addresses that repeat in many rows, as for split_join;
    repeated: whether any address repeats; told: (k1, k2, class_id, kept), a row for each address
    whose text has a word. One address of each class is kept: that of the smallest id, nulls last,
    and of equal ids the smallest address.
    """

    def __init__(self, docs: DataFrame, measure: Measure, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None):
        scratch = scratch or Scratch(docs.sparkSession)
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *address(id_col, text_col))
        worded = self.rows.where(has_word("text"))
        again = scratch.write(worded.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        self.repeated = not again.isEmpty()
        self.hot = gathered(hot_keys(again, ["k1", "k2"], docs.count())) if self.repeated else None
        distinct = worded.dropDuplicates(["k1", "k2"]) if self.repeated else worded

        sigs = scratch.write(measure.signatures(distinct))
        n = sigs.count()
        member = scratch.write(sigs.select("k1", "k2", "d1", "d2"))
        best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
        groups = sigs.groupBy("d1", "d2").agg(best, F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"), F.first("sig").alias("sig"))
        groups = scratch.write(groups.withColumn("node", F.monotonically_increasing_id()))
        reps = groups.select("node", "weight", "sig")

        keys = band_keys(reps, measure.bands, measure.rows)
        lead = scratch.write(keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        buckets = gathered(hot_keys(lead, ["key"], n * measure.bands))
        keys = scratch.write(split_join(keys, lead.select("key", "lead"), ["key"], buckets, ["node"]))
        star = scratch.write(keys.where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct())
        wanted = groups.join(star.select(F.col("u").alias("node")).union(star.select("v")).distinct(), "node").select("node", "best.k1", "best.k2")
        texts = scratch.write(measure.bodies(distinct, sigs, wanted))
        scratch.drop(sigs)

        hubs = gathered(hot_keys(star.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], star.count()))
        linked = scratch.write(verified(star, texts, measure, threshold, hubs).select("u", "v"))
        found = scratch.write(components(linked, scratch))
        of = keys.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        sizes = of.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
        still = split_join(of, sizes, ["key"], buckets, ["node"]).join(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "node")
        still = scratch.write(still)
        total = still.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        crowded = gathered(hot_keys(total, ["key"], still.count()))
        more = scratch.write(open_links(still.drop("bytes").join(reps, "node").join(texts, "node"), total, measure, threshold, crowded))
        if not more.isEmpty():
            found = scratch.write(components(found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch))
        scratch.drop(keys, star, texts, linked, still)

        whole = found.join(groups.select("node", "best"), "node").groupBy("component").agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("n"))
        wide = gathered(hot_keys(whole, ["component"], n))
        of_node = split_join(found, whole.select("component", "best"), ["component"], wide, ["node"]).select("node", F.col("best").alias("first"))
        of_group = groups.select("node", "d1", "d2", "best").join(of_node, "node", "left").select("d1", "d2", F.coalesce("first", "best").alias("first"))
        copied = gathered(hot_keys(groups, ["d1", "d2"], n))
        told = split_join(member, of_group, ["d1", "d2"], copied, ["k1"])
        self.told = told.select("k1", "k2", F.col("first.id").alias("class_id"), ((F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2"))).alias("kept"))

    def table(self) -> DataFrame:
        """(id_col, class_id, kept) of every row of docs."""
        rows = self.docs.select(F.col(self.id_col), *address(self.id_col, self.text_col))
        out = split_join(rows, self.told.withColumn("told", F.lit(True)), ["k1", "k2"], self.hot, ["k1"], "left")
        own = F.col(self.id_col).cast("long")
        return out.select(self.id_col, F.when(F.col("told"), F.col("class_id")).otherwise(own).alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"))

    def representatives(self) -> DataFrame:
        """One whole row of each class, and every row whose text has no word."""
        keyed = self.docs.withColumns({f"__{k}": c for k, c in zip(("k1", "k2"), address(self.id_col, self.text_col))})
        kept = self.told.where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
        hot = self.hot.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}) if self.hot is not None else None
        out = split_join(keyed.where(has_word(self.text_col)), kept.hint("shuffle_hash"), ["__k1", "__k2"], hot, ["__k1"])
        if self.repeated:
            out = out.dropDuplicates(["__k1", "__k2"])
        return out.select(*self.docs.columns).unionByName(self.docs.where(~has_word(self.text_col)))


def classes(docs: DataFrame, measure: Measure, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id_col, class_id, kept) of every row of docs: the smallest id of its near-duplicate class, and whether the row stands for it.

    A text without a word (also a null) is a class of its own. Texts of fewer than five words are
    one shingle. Rows that repeat an id and differ in text are documents of their own; rows that
    repeat both are one document, and all are kept or none. A row without an id is a document like
    others; a class without any id has a null class_id. Of rows that tie for the smallest id the
    one with the smallest address stays. An empty table gives an empty result; other columns are
    not read.
    """
    return Classes(docs, measure, threshold, id_col, text_col, scratch).table()
