"""MinHash fingerprints of whole texts.

A text's shingles of five lower-case words go through universal hash permutations (multiply and
add modulo 2^64, upper half), vectorised in numpy; a fingerprint holds each one's minimum. The
share of equal minima estimates the Jaccard similarity of two texts. ``near_duplicates`` joins the
bands of fingerprints in Spark and verifies candidates by the exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lsh, textvec
from .common import assigned, in_order

_AT_ONCE = 1 << 15


class MinHash(lsh.Measure):
    """Plain sets of shingles: all weights are 1."""

    def __init__(self, bands: int = 16, rows: int = 8, seed: int = 53):
        self.bands, self.rows = bands, rows
        self.mul = textvec.seeded(seed, bands * rows) | np.uint64(1)
        self.add = textvec.seeded(seed + 1, bands * rows)

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.ones(len(shingles))

    def signature(self, shingles: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The minimum of each permutation, 32 bits; all bits set if there is no shingle."""
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint64)
        if len(shingles):
            block = max(1, _AT_ONCE // len(shingles))
            for j in range(0, len(out), block):
                out[j : j + block] = (shingles * self.mul[j : j + block, None] + self.add[j : j + block, None]).min(1) >> np.uint64(32)
        return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``class_id`` and ``kept`` by bands of fingerprints, verified by Jaccard similarity; see lsh.classes.

    With 25 bands of 5, a pair at the threshold of 0.8 shares no band once in 20,000.
    """
    return lsh.classes(docs, MinHash(bands, rows), threshold, id_col, text_col)


def _prints(texts: pa.Array, m: MinHash) -> tuple[np.ndarray, list[str]]:
    """Fingerprints of texts as a matrix, and as text: the hex digits of the minima, in order.

    A text without a word, which has no shingle, is told apart by its own digest: two such texts
    are alike if equal. Equal texts have equal fingerprints.
    """
    out = np.empty((len(texts), len(m.mul)), np.uint64)
    i = 0
    for _, h, at in textvec.words(textvec.lower(texts)):
        for s in textvec.shingles(h, at, lsh.WIDTH):
            if len(s):
                out[i] = m.signature(s)
            else:
                whole = np.frombuffer(sha256((texts[i].as_py() or "").encode()).digest(), "<u8")
                out[i] = textvec.mix(np.resize(whole, len(m.mul)) + m.mul) >> np.uint64(32)
            i += 1
    return out, [row.tobytes().hex() for row in out.astype(">u4")]


def fingerprints(docs: DataFrame, measure: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``fingerprint`` of every row; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(measure or MinHash())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_prints(batch.column(1), shared.value)[1], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edits(docs: DataFrame, measure: MinHash | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like it is to the edited text and the next one.

    The next document is that with the next larger id, after the last the first; a null text counts
    as empty, a null id comes first, and rows that repeat an id stand by their text. Texts move
    once, to ranges of ids; a range borrows the first row of the next, so nothing depends on the
    partitioning. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(measure or MinHash())
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = docs.agg(F.min(id_col).alias("m"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("n")).first()
    first_rows = rows.where(F.col("id").isNull() if least["n"] else F.col("id").eqNullSafe(F.lit(least["m"]).cast(kind)))
    first = spark.sparkContext.broadcast((first_rows.agg(F.min("text").alias("t")).first() or {"t": ""})["t"] or "")  # one text
    dealt = in_order(assigned(rows, ["id"]), ["id", "text"])
    schema = f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    step = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held: list[tuple] = []  # rows (part, own, id, text) whose next one is not known yet

        def flush(more: bool) -> Iterator[pa.RecordBatch]:
            count = len(held) - 1 if more else len(held)
            now = held[:count]
            following = [held[i + 1][3] if i + 1 < len(held) and held[i + 1][0] == now[i][0] else first.value for i in range(count)]
            own = [i for i in range(count) if now[i][1]]
            if own:
                texts = [r[3] for r in now]
                changed = [edited(texts[i], following[i]) for i in own]
                # each text's fingerprint serves as its own and as the next of the one before
                wanted = texts + [following[i] for i in own if i + 1 >= count or now[i + 1][0] != now[i][0]]
                a, a_hex = _prints(pa.array(wanted, pa.large_string()), m)
                b, b_hex = _prints(pa.array(changed, pa.large_string()), m)
                extra = iter(range(count, len(wanted)))
                nxt = [i + 1 if i + 1 < count and now[i + 1][0] == now[i][0] else next(extra) for i in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([now[i][2] for i in own], id_type),
                        pa.array([len(texts[i]) for i in own], pa.int64()),
                        pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                        pa.array([a_hex[i] for i in own]),
                        pa.array(b_hex),
                        pa.array((a[own] == b).mean(1)),
                        pa.array((a[own] == a[nxt]).mean(1)),
                    ],
                    names,
                )
            del held[:count]

        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                held += zip(*(batch.column(i).to_pylist() for i in range(4)))
                yield from flush(True)
        yield from flush(False)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return dealt.select("part", "own", "id", "text").mapInArrow(run, schema)
