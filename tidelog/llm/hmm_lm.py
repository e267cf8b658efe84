"""A hidden Markov language model over whole texts.

Tokens are words, with A-Z in lower case, and an end. Training counts every token of the training
texts; the most frequent types are symbols of their own, the others go by classes of their last
three bytes, and a token's probability is that of its symbol in the hidden state times its share of
the symbol. Baum-Welch: the first parameters follow from which symbols stand beside which in all
training texts; then, in each pass over all of them, every partition sums its expected counts and
the sums are added up. Nothing is learned from a sample. The scaled
forward recursion gives the exact likelihood of each whole text: probabilities of all sequences of
types, an unknown one among them, that close with an end sum to one.

Counts stay distributed: they lie in slices by hash, a group of texts asks each slice for the
distinct tokens it needs, and nothing of the size of the vocabulary reaches a driver or a broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import Scratch, partitions

CLASS_BITS = 9
N_CLASSES = 1 << CLASS_BITS
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = textvec.seeded(61, 3) | np.uint64(1)
TOKENS_AT_ONCE = 400_000
#: Parts of one in which expected counts are added up, as whole numbers.
COUNTED = 1 << 16
#: Random signs of a symbol, by which its neighbours are counted.
SIGNS = 16
#: Bytes of training text whose counts lie in one slice, and bytes of text of one group.
SLICE_BYTES, GROUP_BYTES = 24_000_000, 3_000_000


def token_keys(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, 64-bit keys of the words, offsets by text) in chunks; a key's top bits are its class."""
    data, off = textvec.utf8(column)
    for a, b in textvec.chunks(off):
        part, at = _LOWER[data[off[a] : off[b]]], off[a : b + 1] - off[a]
        h, words = textvec.word_hashes(part, at)
        if len(h):
            starts, ends, _ = textvec.word_spans(part, at)
            tail = np.zeros(len(h), np.uint64)
            for k in range(3):
                i = ends - 1 - k
                tail += np.where(i >= starts, part[np.maximum(i, 0)], 0).astype(np.uint64) * _TAIL[k]
            h = (textvec.mix(tail) >> np.uint64(64 - CLASS_BITS) << np.uint64(64 - CLASS_BITS)) | (h >> np.uint64(CLASS_BITS))
        yield a, h, words


def _slice_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (textvec.mix(keys) % np.uint64(n)).astype(np.int64)


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


@dataclass
class Vocabulary:
    """What every task knows of the counts: totals, and the frequent types. Symbols: frequent types, classes, end, unknown."""

    keys: np.ndarray  # of frequent types, sorted
    counts: np.ndarray
    class_mass: np.ndarray  # of the other types, by class: sum of count + 0.5
    ends: int
    tokens: int
    types: int
    singles: int  # types seen once

    @property
    def n_symbols(self) -> int:
        return len(self.keys) + N_CLASSES + 2

    @property
    def end(self) -> int:
        return self.n_symbols - 2

    @property
    def total(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """Symbols of words as if each were known."""
        out = len(self.keys) + (keys >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = at[hit]
        return out

    @property
    def unknown(self) -> float:
        """Probability of the unknown type: the share of tokens whose type was seen once (Good and Turing), within bounds."""
        return min(0.5, max(0.5 / self.total, self.singles / max(1, self.tokens)))

    def symbol_probabilities(self) -> np.ndarray:
        known = np.concatenate([self.counts + 0.5, self.class_mass, [self.ends + 0.5 if self.ends else 0.0]])
        return np.append(known * ((1 - self.unknown) / known.sum() if self.ends else 0), self.unknown if self.ends else 1.0)


@dataclass
class HMM:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # symbols by states

    @classmethod
    def first(cls, p: np.ndarray, states: int) -> HMM:
        noise = (textvec.seeded(67, len(p) * states) >> np.uint64(11)).astype(np.float64).reshape(len(p), states) / 2**53
        return cls(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), _emissions(p[:, None] * (0.5 + noise), p))

    @classmethod
    def beside(cls, near: np.ndarray, p: np.ndarray, states: int) -> HMM:
        """States of symbols with alike neighbours: spherical k-means of the rows of near (see neighbours), soft assignments."""

        def unit(x: np.ndarray) -> np.ndarray:
            return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)

        w = np.where(near.any(1), p, 0)
        x = unit(near.astype(np.float64))
        x = unit(x - (x * w[:, None]).sum(0) / max(w.sum(), 1e-300))
        w = np.sqrt(w)[:, None]
        centres = x[[int(np.argmax(w))]]
        for _ in range(states - 1):
            centres = np.vstack([centres, x[np.argmax((1 - (x @ centres.T).max(1)) * w[:, 0])]])
        for _ in range(30):
            own = (x @ centres.T).argmax(1)
            centres = unit(np.stack([(x * w)[own == k].sum(0) if w[own == k].any() else centres[k] for k in range(states)]))
        share = np.exp(4 * (x @ centres.T))
        share /= share.sum(1, keepdims=True)
        share[~near.any(1)] = 1 / states
        plain = cls.first(p, states)
        return cls(plain.start, plain.move, _emissions(p[:, None] * (0.02 + share), p))

    @classmethod
    def from_counts(cls, counts: "Counts", p: np.ndarray, strength: float) -> HMM:
        """Parameters of expected counts; emissions are smoothed by the symbols' overall probabilities."""
        start = (counts.start + 0.1) / (counts.start + 0.1).sum()
        move = counts.move + 0.1
        return cls(start, move / move.sum(1, keepdims=True), _emissions(counts.emit + strength * p[:, None], p))


def _emissions(amount: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Amounts by symbol and state as probabilities; the unknown symbol, which training never shows, keeps its own."""
    known = amount[:-1].sum(0)
    return np.vstack([amount[:-1] * ((1 - p[-1]) / np.where(known > 0, known, 1)), np.full((1, amount.shape[1]), p[-1])])


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log10: float = 0.0

    @classmethod
    def none(cls, states: int, symbols: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))

    def rows(self) -> np.ndarray:
        """A row for each symbol, each state's moves, the start and the likelihood, as whole multiples of 1 / COUNTED: their sums do not depend on an order."""
        last = np.zeros((1, len(self.start)))
        last[0, 0] = self.log10
        return np.rint(np.vstack([self.emit, self.move, self.start, last]) * COUNTED).astype(np.int64)

    @classmethod
    def of(cls, rows: np.ndarray, states: int) -> Counts:
        x = rows / COUNTED
        return cls(x[-2], x[-2 - states : -2], x[: -2 - states], float(x[-1, 0]))


def _by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts from long to short: rows of each step in a by-time layout (offsets), and each token's row there."""
    steps = int(lengths[0])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    offsets = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return offsets, offsets[step] + np.repeat(np.arange(len(lengths)), lengths)


def forward(model: HMM, sequences: list[np.ndarray], counts: Counts | None = None) -> np.ndarray:
    """log10 likelihood of symbol sequences by the scaled forward recursion; adds expected counts if asked.

    Sequences are not empty. All of them move a step at a time together; single precision with a
    scale at each step, logarithms in double.
    """
    if not sequences:
        return np.zeros(0)
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    offsets, rows = _by_time(lengths)
    symbol = np.empty(len(rows), np.int64)
    symbol[rows] = np.concatenate([sequences[i] for i in order])
    peak = model.emit.max(1)
    lift = (model.emit / np.maximum(peak, 1e-300)[:, None]).astype(np.float32)[symbol]
    move = model.move.astype(np.float32)
    alpha, scale = np.empty_like(lift), np.empty(len(rows), np.float32)
    a = np.broadcast_to(model.start.astype(np.float32), (len(lengths), len(model.start)))
    at = offsets.tolist()
    for t in range(len(at) - 1):
        o, e = at[t], at[t + 1]
        x = (a[: e - o] @ move if t else a) * lift[o:e]
        s = x.sum(1)
        x /= s[:, None]
        alpha[o:e], scale[o:e] = x, s
        a = x
    logs = np.log10(scale.astype(np.float64)) + np.log10(np.maximum(peak, 1e-300))[symbol]
    text_of = np.empty(len(rows), np.int64)
    text_of[rows] = np.repeat(np.arange(len(lengths)), lengths)
    out = np.empty(len(sequences))
    out[order] = np.bincount(text_of, logs, len(lengths))
    if counts is not None:
        beta = np.ones_like(lift)
        back = move.T.copy()
        for t in range(len(at) - 2, 0, -1):
            o, e = at[t], at[t + 1]
            before = at[t - 1]
            beta[before : before + e - o] = (lift[o:e] * beta[o:e] / scale[o:e, None]) @ back
        later = np.arange(offsets[1], len(rows))
        step = np.repeat(np.arange(1, len(at) - 1), np.diff(offsets)[1:])
        earlier = later - offsets[step] + offsets[step - 1]
        counts.move += model.move * (alpha[earlier].T.astype(np.float64) @ (lift[later] * beta[later] / scale[later, None]).astype(np.float64))
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        counts.start += gamma[: at[1]].sum(0, dtype=np.float64)
        for k in range(gamma.shape[1]):
            counts.emit[:, k] += np.bincount(symbol, gamma[:, k], len(counts.emit))
        counts.log10 += float(out.sum())
    return out


def _portions(lengths: list[int]) -> Iterator[list[int]]:
    """Indices of texts by length, in portions of a bounded number of tokens (or one text)."""
    now, n = [], 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if now and n + lengths[i] > TOKENS_AT_ONCE:
            yield now
            now, n = [], 0
        now.append(i)
        n += lengths[i]
    if now:
        yield now


def _sequences(column, vocabulary: Vocabulary) -> list[np.ndarray]:
    out = []
    for _, keys, at in token_keys(column):
        symbols = vocabulary.symbols(keys).astype(np.int32)
        out += [np.append(symbols[a:b], np.int32(vocabulary.end)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def count_tokens(texts: DataFrame, slices: int) -> DataFrame:
    """(slice, keys, counts): the counts of all words of a text column, a row for each slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            return _sliced(keys, counts, slices)

        for batch in batches:
            for _, keys, _ in token_keys(batch.column(0)):
                k, c = np.unique(keys, return_counts=True)
                held.append((k, c.astype(np.int64)))
                size += len(k)
                if size > 1_500_000:
                    k, c = _counted(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
                    held, size = [(k, c)], len(k)
                    if size > 1_000_000:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_py(), np.uint64) for k in group.column("keys")])
        counts = np.concatenate([np.frombuffer(c.as_py(), np.int64) for c in group.column("counts")])
        keys, counts = _counted(keys, counts)
        return pa.table({"slice": group.column("slice").slice(0, 1), "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    schema = "slice bigint, keys binary, counts binary"
    return texts.mapInArrow(count, schema).groupBy("slice").applyInArrow(merge, schema)


def _sliced(keys: np.ndarray, counts: np.ndarray, slices: int) -> pa.RecordBatch:
    of = _slice_of(keys, slices)
    order = np.argsort(of, kind="stable")  # keys stay sorted in each slice
    keys, counts, of = keys[order], counts[order], of[order]
    present = np.unique(of)
    cut = [*np.searchsorted(of, present).tolist(), len(of)]
    return pa.RecordBatch.from_arrays(
        [pa.array(present, pa.int64()), pa.array([keys[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["slice", "keys", "counts"]
    )


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(counts)).astype(np.int64)


def vocabulary_of(table: DataFrame, ends: int, frequent: int) -> Vocabulary:
    """Totals of a table of counts, and its most frequent types: at most ``frequent``."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0):
                counts = np.frombuffer(c.as_py(), np.int64)
                bins = _bin(counts)
                here = np.unique(bins)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array([int((bins == b).sum()) for b in here]), pa.array([int(counts[bins == b].sum()) for b in here])], ["bin", "types", "tokens"])

    bins = sorted(((r["bin"], r["types"], r["tokens"]) for r in table.select("counts").mapInArrow(summary, "bin bigint, types bigint, tokens bigint").groupBy("bin").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()), reverse=True)  # eight rows for each power of two
    cut, room = 1 << 40, frequent
    for b, types, _ in bins:
        if types > room:
            break
        room, cut = room - types, b

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kept = np.zeros(N_CLASSES), []
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, counts = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int64)
                top = _bin(counts) >= cut
                kept.append((keys[top], counts[top]))
                mass += np.bincount((keys[~top] >> np.uint64(64 - CLASS_BITS)).astype(np.int64), counts[~top] + 0.5, N_CLASSES)
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in kept]]).view(np.int64)
        counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in kept]]).astype(np.float64)
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(keys) + [False] * len(some)), pa.array(np.concatenate([keys, some])), pa.array(np.concatenate([counts, mass[some]]))], ["top", "key", "value"])

    got = table.select("keys", "counts").mapInArrow(split, "top boolean, key bigint, value double").groupBy("top", "key").agg(F.sum("value").alias("value")).collect()  # a row for each frequent type and class
    top = sorted((int(np.array(r["key"], np.int64).view(np.uint64)), int(r["value"])) for r in got if r["top"])
    mass = np.zeros(N_CLASSES)
    for r in got:
        if not r["top"]:
            mass[r["key"]] = r["value"]
    return Vocabulary(np.array([k for k, _ in top], np.uint64), np.array([c for _, c in top], np.int64), mass, ends, sum(n for _, _, n in bins) + ends, sum(t for _, t, _ in bins) + (ends > 0), sum(t for b, t, _ in bins if b == 0) + (ends == 1))


def train(texts: DataFrame, vocabulary: Vocabulary, states: int = 8, passes: int = 2, least_gain: float = 0.002, strength: float = 500.0) -> HMM:
    """Baum-Welch over all (id, text) rows, from a start that follows from the neighbours of symbols in all of them.

    There are at least one and at most ``passes`` passes; they end when one has raised the log10
    likelihood of a token by less than ``least_gain``. Each map task emits its expected counts once,
    a row a symbol, and rows are summed by symbol: what meets in one sum is a number a task.
    """
    p = vocabulary.symbol_probabilities()
    if not vocabulary.tokens:
        return HMM.first(p, states)
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)  # some hundred kB, whatever the corpus
    model = HMM.beside(neighbours(texts.select("text"), shared, len(p)), p, states)
    before = None
    for _ in range(passes):
        counts = expected(texts.select("text"), shared, model, len(p))
        model = HMM.from_counts(counts, p, strength)
        if before is not None and counts.log10 - before < least_gain * vocabulary.tokens:
            break
        before = counts.log10
    return model


def count_beside(sequences: list[np.ndarray], near: np.ndarray) -> None:
    """Adds, to each symbol's row of near, the signs of the symbols before it, then of those behind it."""
    if not sequences:
        return
    x = np.concatenate(sequences)
    inside = np.ones(len(x), bool)
    inside[np.cumsum([len(s) for s in sequences]) - 1] = False
    at = np.flatnonzero(inside)
    a, b = x[at], x[at + 1]
    signs = (textvec.seeded(71, SIGNS * len(near)) >> np.uint64(63)).astype(np.float64).reshape(SIGNS, len(near)) * 2 - 1
    for k in range(SIGNS):
        near[:, k] += np.bincount(b, signs[k][a], len(near)).astype(np.int64)
        near[:, SIGNS + k] += np.bincount(a, signs[k][b], len(near)).astype(np.int64)


def neighbours(texts: DataFrame, vocabulary, symbols: int) -> np.ndarray:
    """For each symbol, sums of signs of its neighbours in all of a text column: random projections of its rows and columns of the counts of pairs. vocabulary: broadcast."""
    names = [f"c{k}" for k in range(2 * SIGNS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.zeros((symbols, 2 * SIGNS), np.int64)
        for batch in batches:
            sequences = _sequences(batch.column(0), vocabulary.value)
            for some in _portions([len(s) for s in sequences]):
                count_beside([sequences[i] for i in some], near)
        some = np.flatnonzero(near.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(near[some, k]) for k in range(2 * SIGNS))], ["row", *names])

    sums = texts.mapInArrow(count, "row bigint, " + ", ".join(f"{n} bigint" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    total = np.zeros((symbols, 2 * SIGNS), np.int64)
    for r in sums.collect():  # a row for each symbol: some thousand
        total[r["row"]] = r[1:]
    return total


def expected(texts: DataFrame, vocabulary, model: HMM, symbols: int) -> Counts:
    """Expected counts of a model over a text column. vocabulary: broadcast."""
    states = len(model.start)
    now = texts.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, any_ = Counts.none(states, symbols), False
        for batch in batches:
            sequences = _sequences(batch.column(0), vocabulary.value)
            any_ = any_ or bool(sequences)
            for some in _portions([len(s) for s in sequences]):
                forward(now.value, [sequences[i] for i in some], counts)
        if any_:
            rows = counts.rows()
            some = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(rows[some, k]) for k in range(states))], ["row", *names])

    sums = texts.mapInArrow(expect, "row bigint, " + ", ".join(f"{n} bigint" for n in names)).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    total = np.zeros((symbols + states + 2, states), np.int64)
    for r in sums.collect():  # a row for each symbol: some thousand
        total[r["row"]] = r[1:]
    return Counts.of(total, states)


def score(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", states: int = 8, frequent: int = 4096, passes: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Learns from the rows of docs where ``training`` (a boolean column) holds and scores all rows.

    Returns id, n_tokens, n_known, train_tokens, base_score (smoothed unigrams) and score (the
    model), both log10. A null text counts as empty: an end and nothing else. Without any training
    text each token has probability 1 in the base and the model is uniform. Rows that repeat an id
    each get theirs. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("learn").cast("long")).alias("ends"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    size = sizes["bytes"] or 0
    slices = max(partitions(spark), size // SLICE_BYTES + 1)
    learn = rows.where("learn").select("id", "text")
    table = scratch.write(count_tokens(learn.select("text"), slices))
    vocabulary = vocabulary_of(table, sizes["ends"] or 0, frequent)
    model = train(learn, vocabulary, states, passes=passes)
    groups = max(1, size // GROUP_BYTES + 1, min(partitions(spark), (sizes["n"] or 0) // 64))
    parts = max(partitions(spark), min(groups, 4 * partitions(spark)))  # small ones, so that no task gets many groups
    shared = spark.sparkContext.broadcast((vocabulary, model))

    grouped = rows.select("id", "text", F.pmod(F.xxhash64(F.col("id").cast("string"), F.octet_length("text")), F.lit(groups)).alias("group")).repartition(parts, "group")

    def ask(group: pa.Table) -> pa.Table:
        v = shared.value[0]
        wanted = [np.unique(keys) for _, keys, _ in token_keys(group.column("text"))]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted]))
        keys = keys[v.symbols(keys) >= len(v.keys)]
        cells = _sliced(keys, np.zeros(len(keys), np.int64), slices)
        g = group.column("group")[0].as_py()
        return pa.table({"slice": cells.column(0), "group": pa.array([g] * cells.num_rows, pa.int64()), "keys": cells.column(1)})

    asked = grouped.groupBy("group").applyInArrow(ask, "slice bigint, group bigint, keys binary")
    both = table.select("slice", F.lit(-1).cast("long").alias("group"), "keys", "counts").unionByName(asked.withColumn("counts", F.lit(None).cast("binary")))
    dealt = both.repartition(partitions(spark), "slice").sortWithinPartitions("slice", "group")  # a slice's counts come before what is asked of it

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, have, n = -1, None, None
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                keys = np.frombuffer(row["keys"], np.uint64)
                if row["group"] < 0:
                    at, have, n = row["slice"], keys, np.frombuffer(row["counts"], np.int64)
                    continue
                if row["slice"] != at:
                    at, have, n = row["slice"], np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if not len(have):
                    continue
                i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[i] == keys
                yield pa.RecordBatch.from_arrays([pa.array([row["group"]], pa.int64()), pa.array([keys[hit].tobytes()], pa.binary()), pa.array([n[i[hit]].tobytes()], pa.binary())], ["group", "keys", "counts"])

    answers = dealt.mapInArrow(answer, "group bigint, keys binary, counts binary")
    schema = f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def judge(texts: pa.Table, told: pa.Table) -> pa.Table:
        v, m = shared.value
        keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(k.as_py(), np.uint64) for k in told.column("keys")]])
        n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(c.as_py(), np.int64) for c in told.column("counts")]])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        sequences, base, known, share = [], [], [], []
        end_base = np.log10((v.ends + 0.5) / v.total)
        for _, words, at in token_keys(texts.column("text")):
            symbol = v.symbols(words)
            rare = symbol >= len(v.keys)
            c = np.zeros(len(words), np.int64)
            c[~rare] = v.counts[symbol[~rare]]
            if len(keys) and rare.any():
                i = np.minimum(np.searchsorted(keys, words[rare]), len(keys) - 1)
                c[rare] = np.where(keys[i] == words[rare], n[i], 0)
            new = c == 0
            inside = np.zeros(len(words))
            old = rare & ~new
            inside[old] = np.log10((c[old] + 0.5) / v.class_mass[symbol[old] - len(v.keys)])
            symbol[new] = v.n_symbols - 1
            log = np.log10((c + 0.5) / v.total)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                sequences.append(np.append(symbol[a:b], v.end if v.ends else v.n_symbols - 1))
                known.append(int((~new[a:b]).sum()) + (v.ends > 0))
                base.append(float(log[a:b].sum() + end_base))
                share.append(float(inside[a:b].sum()))
        total = np.zeros(len(sequences))
        for some in _portions([len(s) for s in sequences]):
            total[some] = forward(m, [sequences[i] for i in some])
        return pa.table({
            id_col: texts.column("id"),
            "n_tokens": pa.array([len(s) for s in sequences], pa.int64()),
            "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([v.tokens] * len(sequences), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(total + np.array(share), pa.float64()),
        })

    return grouped.groupBy("group").cogroup(answers.repartition(parts, "group").groupBy("group")).applyInArrow(judge, schema)
