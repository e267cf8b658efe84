"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

Weights are term frequency times inverse document frequency of runs of five words. Improved
consistent weighted sampling draws from each document shingle and quantised weight pairs that two
documents share with a probability equal to their weighted Jaccard similarity; the samples are
banded, and candidates are verified by the exact weighted Jaccard similarity.

The more copies a text has, the less its shingles weigh beside those of an edit, which stand in one
document: in a large group of near copies the weighted similarity falls, and the more so the larger
the corpus is. So a pair is also linked if the plain Jaccard similarity of its sets of shingles
reaches the threshold, and some bands of plain minima stand beside those of the samples.

Document frequencies are exact, of whole shingle hashes over all documents, and stay distributed:
each group of documents sends its distinct shingles to slices by hash, a slice adds them up and
answers each group with those that stand in more than one document. No others can be shared, so a
document's body for verification is its repeated shingles with their weights, and one shingle with
the weight of all the others.

The gamma and uniform variables of the sampling come from a fixed table of 2^13 entries that each
hash function addresses in its own way; where entries tie, the smaller shingle is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh, textvec
from .common import keep_only, partitions, tidy

CELL_BITS = 20
GROUP_BYTES = 6_000_000
SLICE_BYTES = 24_000_000
#: Bands of plain minima.
PLAIN_BANDS = 8
_TABLE_BITS = 13
_AT_ONCE = 1 << 15


def _variables() -> tuple[np.ndarray, ...]:
    n = 1 << _TABLE_BITS
    u = (textvec.seeded(41, 5 * n) >> np.uint64(11)).astype(np.float64).reshape(5, n) / 2**53 + 2**-54
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return tuple(x.astype(np.float32) for x in (r, 1 / r, np.log(c), u[4]))


class Frequencies:
    """Inverse document frequencies, log(1 + documents / documents with the shingle). keys: sorted shingles of more than one document."""

    def __init__(self, documents: int, keys: np.ndarray, counts: np.ndarray):
        self.documents, self.keys, self.counts = documents, keys, counts

    def counts_of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(shingles), np.int64)
        i = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
        return np.where(self.keys[i] == shingles, self.counts[i], 1).astype(np.int64)

    def inverse(self, counts: np.ndarray) -> np.ndarray:
        return np.log1p(max(1, self.documents) / counts).astype(np.float32).astype(np.float64)


class WeightedMeasure(lsh.Measure):
    """TF-IDF weights and their consistent samples, then plain minima.

    idf: Frequencies, or float32 by the top bits of a shingle; as copies do not lower the latter,
    they go without plain bands unless asked for. bands: of samples; plain: of minima.
    """

    def __init__(self, idf: Frequencies | np.ndarray | None, bands: int = 14, rows: int = 3, plain: int | None = None):
        self.plain = (0 if isinstance(idf, np.ndarray) else PLAIN_BANDS) if plain is None else plain
        self.idf, self.bands, self.rows = idf, bands + self.plain, rows
        self.steps = textvec.seeded(43, bands * rows) | np.uint64(1)
        self.plain_steps = textvec.seeded(47, self.plain * rows) | np.uint64(1)
        self.r, self.inverse, self.log_c, self.beta = _variables()

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if isinstance(self.idf, Frequencies):
            return counts * self.idf.inverse(self.idf.counts_of(shingles))
        return counts * self.idf[shingles >> np.uint64(64 - CELL_BITS)].astype(np.float64)

    def signature(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.samples(shingles, self.weights(shingles, counts))

    def samples(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        log_w = np.log(weights).astype(np.float32)
        block = max(1, _AT_ONCE // len(shingles))
        out = np.empty(len(self.steps), np.uint64)
        for j in range(0, len(self.steps), block):  # some hash functions at once, in cache
            steps = self.steps[j : j + block, None]
            at = (shingles * steps) >> np.uint64(64 - _TABLE_BITS)
            beta, r = self.beta[at], self.r[at]
            t = np.floor(log_w * self.inverse[at] + beta)
            k = np.argmin(self.log_c[at] - r * (t - beta + np.float32(1)), axis=1)
            level = t[np.arange(len(k)), k].astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            out[j : j + block] = shingles[k] * steps[:, 0] + level
        return np.concatenate([textvec.mix(out) & np.uint64(0xFFFFFFFF), self.minima(shingles)])

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of each plain minimum."""
        return textvec.mix(np.array([(shingles * step).min() for step in self.plain_steps], np.uint64)) & np.uint64(0xFFFF)

    def similarity(self, a: tuple, b: tuple) -> float:
        """The weighted Jaccard similarity or, with plain bands, the plain one if that is larger."""
        weighted = super().similarity(a, b)
        if not self.plain:
            return weighted
        both, n = len(np.intersect1d(a[0], b[0], assume_unique=True)), self.number(a) + self.number(b)
        return max(weighted, both / (n - both))


def _documents(rows: DataFrame) -> tuple[int, int, int]:
    """Texts that have a word, texts, and bytes of texts."""
    r = rows.agg(F.sum(F.col("text").rlike(r"[^\x20\x09-\x0D]").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    return r["n"] or 0, r["rows"], r["bytes"] or 0


def _grouped(rows: DataFrame, n: int, size: int) -> DataFrame:
    groups = max(1, size // GROUP_BYTES + 1, min(partitions(rows.sparkSession), n // 64))
    return rows.select("id", "k1", "k2", "text", F.pmod(F.xxhash64("k1", "k2"), F.lit(groups)).alias("group"))


def _packed(keys: np.ndarray) -> bytes:
    """Differences of sorted keys, first all low bytes, last all high ones: the latter are zeros, which compression removes."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().cumsum(dtype=np.uint64)


def repeated_shingles(grouped: DataFrame, size: int) -> DataFrame:
    """(group, keys, counts): for each group of texts, its shingles that stand in more than one document, and in how many; a row a slice."""
    slices = max(partitions(grouped.sparkSession), size // SLICE_BYTES + 1)

    def ask(group: pa.Table) -> pa.Table:
        keep_only()
        tidy()
        held = [s for s, _ in lsh.shingle_sets(group.column("text"))]
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        of = ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)  # ranges of keys
        present = np.unique(of)
        cut = [*np.searchsorted(of, present).tolist(), len(of)]
        parts = [slice(a, b) for a, b in zip(cut, cut[1:])]
        return pa.table({
            "slice": pa.array(present, pa.int64()),
            "group": pa.array([group.column("group")[0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([_packed(keys[x]) for x in parts], pa.binary()),
            "counts": pa.array([counts[x].astype("<u4").tobytes() for x in parts], pa.binary()),
        })

    def add(cell: pa.Table) -> pa.Table:
        keep_only()
        tidy()
        keys = [_unpacked(k.as_py()) for k in cell.column("keys")]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(c.as_py(), "<u4") for c in cell.column("counts")]))[at].astype("<u4")
        parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"group": cell.column("group"), "keys": pa.array([_packed(k[t > 1]) for k, t in zip(keys, parts)], pa.binary()), "counts": pa.array([t[t > 1].tobytes() for t in parts], pa.binary())})

    asked = grouped.groupBy("group").applyInArrow(ask, "slice bigint, group bigint, keys binary, counts binary")
    return asked.groupBy("slice").applyInArrow(add, "group bigint, keys binary, counts binary")


def _told(documents: int, told: pa.Table) -> Frequencies:
    keys = np.concatenate([np.zeros(0, np.uint64), *[_unpacked(k.as_py()) for k in told.column("keys")]])
    counts = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(c.as_py(), "<u4") for c in told.column("counts")]])
    order = np.argsort(keys)
    return Frequencies(documents, keys[order], counts[order])


class CorpusMeasure(WeightedMeasure):
    """Weights by the frequencies of the corpus, which each group of its documents looks up."""

    def __init__(self, bands: int = 14, rows: int = 3, plain: int | None = None):
        super().__init__(None, bands, rows, plain)

    def signatures(self, rows: DataFrame) -> DataFrame:
        """id, address, digest, weight and signature as lsh.signatures, and the body: shingles, then weights, then how many shingles the text has."""
        documents, n, size = _documents(rows)
        grouped = _grouped(rows, n, size)
        shared = rows.sparkSession.sparkContext.broadcast(self)
        kinds = (*[pa.int64()] * 5, pa.float64(), pa.binary(), pa.binary())

        def sign(texts: pa.Table, told: pa.Table) -> pa.Table:
            keep_only()
            tidy()
            m, frequencies = shared.value, _told(documents, told)
            of, out = [texts.column(c).to_pylist() for c in ("id", "k1", "k2")], []
            for i, (s, c) in enumerate(lsh.shingle_sets(texts.column("text"))):
                if len(s):
                    often = frequencies.counts_of(s)
                    w = c * frequencies.inverse(often)
                    out.append((*(x[i] for x in of), *lsh.digest(s, c), float(w.sum()), m.samples(s, w).astype("<u4").tobytes(), _body(s, w, often > 1)))
            return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * len(kinds), kinds)], ["id", "k1", "k2", "d1", "d2", "weight", "sig", "body"])

        return grouped.groupBy("group").cogroup(repeated_shingles(grouped, size).groupBy("group")).applyInArrow(sign, "id bigint, k1 bigint, k2 bigint, d1 bigint, d2 bigint, weight double, sig binary, body binary")

    def bodies(self, rows: DataFrame, sigs: DataFrame, wanted: DataFrame) -> DataFrame:
        return sigs.select("k1", "k2", F.col("body").alias("text")).join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("node", "text")

    def sets(self, texts) -> list[tuple]:
        out = []
        for body in texts:
            b = body.as_buffer()
            n = b.size // 12
            out.append((np.frombuffer(b, np.uint64, n), np.frombuffer(b, np.float32, n, 8 * n).astype(np.float64), int(np.frombuffer(b, "<u4", 1, 12 * n)[0])))
        return out


def _body(shingles: np.ndarray, weights: np.ndarray, repeated: np.ndarray) -> bytes:
    keep = repeated.copy()
    if not repeated.all():
        first = int(np.argmin(repeated))
        weights = weights.copy()
        weights[first], keep[first] = weights[~repeated].sum(), True
    return shingles[keep].tobytes() + weights[keep].astype(np.float32).tobytes() + np.array([len(shingles)], "<u4").tobytes()


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """The frequencies of all whole texts, gathered: for tables whose repeated shingles fit the driver."""
    rows = docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("k1"), F.lit(0).alias("k2"))
    documents, n, size = _documents(rows)
    told = _told(documents, repeated_shingles(_grouped(rows, n, size), size).toArrow())
    keys, first = np.unique(told.keys, return_index=True)
    return Frequencies(documents, keys, told.counts[first])


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 14, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ``class_id`` (smallest id of its near-duplicate class), ``kept`` (it is that one).

    See lsh.classes for nulls, empty and very long texts, ties, repeated rows and empty tables. With 14 bands of 3, a pair of
    weighted similarity 0.8 shares no band once in 25,000. A pair of plain similarity 0.8 shares none of the 8 plain bands
    once in 320, and none at all once in 10,000 at a weighted similarity of 0.6, once in 1,300 at 0.45.
    """
    return lsh.classes(docs, CorpusMeasure(bands, rows), threshold, id_col, text_col)


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 14, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of docs of each near-duplicate class, and every row whose text has no word; see lsh.classes."""
    return lsh.Classes(docs, CorpusMeasure(bands, rows), threshold, id_col, text_col).representatives()
