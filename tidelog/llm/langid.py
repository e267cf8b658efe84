"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (n = 1 to 3)
that both hold, over the geometric mean of their numbers of n-grams. A Nyström map on landmark
texts turns it into features, and one-versus-rest kernel ridge regression is fitted on them. Whole
texts are scored a batch at a time: presence matrix by landmark matrix, by coefficients.

n-grams are hashed to 2^18 buckets, so any script can be learned; a text's n-grams are taken over
all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

BITS = 18
ORDERS = 3
_MAY_BE_LETTER = re.compile(r"[^\W\d_]").finditer  # also numerals such as ² and Ⅷ
_STEPS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAY_BE_LETTER(text))


def presence(text: str, room: np.ndarray) -> int:
    """Marks the buckets of a text's n-grams in ``room`` (cleared first) and returns their number."""
    room[:] = False
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(points), np.uint32)
    for k in range(min(ORDERS, len(points))):
        h = h[: len(points) - k] + points[k:] * _STEPS[k]
        m = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        room[(m ^ (m >> np.uint32(12))) >> np.uint32(32 - BITS)] = True
    return int(np.count_nonzero(room))


@dataclass
class Model:
    langs: list[str]
    columns: np.ndarray  # buckets that any landmark holds
    landmarks: np.ndarray  # presence of those, over the root of their number, by landmark
    weights: np.ndarray  # landmarks by languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """One-versus-rest values, about -1 to 1, by text and language."""
        room = np.zeros(1 << BITS, bool)
        rows, norms = np.zeros((len(texts), len(self.columns)), np.float32), np.ones(len(texts))
        for i, text in enumerate(texts):
            norms[i] = max(1, presence(text, room)) ** 0.5
            rows[i] = room[self.columns]
        return (rows @ self.landmarks.T).astype(np.float64) / norms[:, None] @ self.weights


def fit(rows: list[tuple[str, np.ndarray]], n_landmarks: int, ridge: float) -> Model:
    """A model of (language, buckets) rows; the first rows of each language are landmarks."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    each, seen = max(1, n_landmarks // len(langs)), dict.fromkeys(langs, 0)
    chosen = []
    for i, (lang, buckets) in enumerate(rows):
        if seen[lang] < each and len(buckets):
            seen[lang] += 1
            chosen.append(i)
    columns = np.unique(np.concatenate([np.zeros(0, np.int64), *[rows[i][1] for i in chosen]])).astype(np.int64)

    def dense(buckets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns), np.float32)
        out[np.searchsorted(columns, buckets[np.isin(buckets, columns)])] = 1
        return out

    landmarks = np.stack([dense(rows[i][1]) / len(rows[i][1]) ** 0.5 for i in chosen]) if chosen else np.zeros((0, 0), np.float32)
    kernel = np.stack([landmarks @ dense(b) / max(1, len(b)) ** 0.5 for _, b in rows]).astype(np.float64)
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    lift = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ lift
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _ in rows])
    count = {x: sum(lang == x for lang, _ in rows) for x in langs}
    weight = np.array([len(rows) / (len(langs) * count[lang]) for lang, _ in rows])  # languages weigh the same
    solved = np.linalg.solve(phi.T @ (phi * weight[:, None]) + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    return Model(langs, columns, landmarks, lift @ solved)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, n_landmarks: int = 160, ridge: float = 1e-4, seed: int = 5) -> Model:
    """Fits on a bounded sample: about ``per_lang`` texts of each language, chosen by a hash of the id.

    Rows with a null id, text or language or no letter teach nothing. What reaches the driver are
    the sampled texts' bucket numbers (a few thousand each).
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not counts:
        return fit([], n_landmarks, ridge)
    span = 1 << 30
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(span, int(span * per_lang / n))))])
    order = F.pmod(F.xxhash64(F.lit(seed), F.col("id").cast("string")), F.lit(span))
    picked = known.withColumn("order", order).where(F.col("order") < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.zeros(1 << BITS, bool)
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                presence(text, room)
                out.append(np.flatnonzero(room).astype(np.int32).tobytes() if has_letter(text) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["order", "id", "lang", "buckets"])

    got = picked.select("order", F.col("id").cast("string").alias("id"), "lang", "text").mapInArrow(run, "order bigint, id string, lang string, buckets binary").where("buckets is not null").collect()
    rows = sorted((r["order"], r["id"], r["lang"], bytes(r["buckets"])) for r in got)
    return fit([(lang, np.frombuffer(b, np.int32)) for _, _, lang, b in rows], n_landmarks, ridge)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), batch: int = 128) -> DataFrame:
    """id, ``keep`` columns, ``lang_pred`` and ``score`` (0 to 1) of every row.

    ``und`` with score 0 for a null text, one without a letter, or a model that has learned
    nothing; of equal scores the language first in order. Repeated rows each get theirs; an empty
    table gives an empty result; other columns are not read. The model (some MB, bounded by the
    number of landmarks) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    schema = chosen.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                texts = part.column(part.num_columns - 1).to_pylist()
                told = [i for i, t in enumerate(texts) if m.langs and t is not None and has_letter(t)]
                langs, score = ["und"] * len(texts), [0.0] * len(texts)
                if told:
                    values = m.scores([texts[i] for i in told])
                    for i, best, row in zip(told, values.argmax(1), values):
                        langs[i], score[i] = m.langs[best], float(min(1.0, max(0.0, (row[best] + 1) / 2)))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs), pa.array(score)], schema.names)

    return chosen.mapInArrow(run, schema)
