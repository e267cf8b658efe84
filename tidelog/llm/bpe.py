"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton over the vocabulary finds the longest token that starts at
each byte of a piece. From the left, the longest token is tried; it stands if its pair with the
token before is one that merging would leave apart (the pair-compatibility table), else the next
shorter token, else one step back. Each position is given up once at most, so the time is linear
in the piece, and the result is exactly that of merging in order of rank.

Decoding: the vocabulary's bytes lie end to end with a table of offsets, and ids are decoded by
gathering their byte ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, keep_only

#: The pre-tokenizer's pattern (fixed values of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces remembered by one Python worker; beyond it the memory begins anew. Results do not depend on it.
REMEMBERED = 250_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library (truncation and padding unused)."""

    def __init__(self, content: str):
        import ahocorasick
        import regex

        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("unsupported BPE options")
        letters = byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        # a token's place: single bytes first, then in order of the merges that make it
        self.text = [bytes([b]) for b in range(256)]
        self.place = {t: b for b, t in enumerate(self.text)}
        self.split = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = (bytes(letters[c] for c in t) for t in (m.split(" ") if isinstance(m, str) else m))
            pair, whole = (self.place[a], self.place[b]), a + b
            if whole not in self.place:
                self.place[whole] = len(self.text)
                self.text.append(whole)
                self.split.append(pair)
            self.joined.setdefault(pair, self.place[whole])
        self.size = [len(t) for t in self.text]
        self.id = [ids[t] for t in self.text]
        self.packed = [np.uint32(i).tobytes() for i in self.id]
        self.automaton = ahocorasick.Automaton()
        for place, t in enumerate(self.text):
            self.automaton.add_word(t.decode("latin-1"), place)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PATTERN).findall
        self.special = {t["content"]: np.uint32(t["id"]).tobytes() for t in spec.get("added_tokens", [])}
        if any(t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("unsupported options of added tokens")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.loose = regex.compile(r" \s|\s ").search
        by_id = {i: t for t, i in ids.items()} | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        sizes = np.array([len(by_id.get(i, b"")) for i in range(max(by_id) + 1)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    # -- pairs ---------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens would end with just these two."""
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' merges again and again; at each state, a merge across
        # the seam that comes before the one just undone would have happened first.
        before = len(self.text)
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < before:
                return False
            if left > right and left >= 256:
                before, left = left, self.split[left][1]
            elif right >= 256:
                before, right = right + 1, self.split[right][0]
            else:
                return True

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        found = self.shorter.get(token)
        if found is None:
            t = self.text[token]
            found = next((self.place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.place), -1)
            self.shorter[token] = found
        return found

    # -- encoding ------------------------------------------------------------------------------

    def tokens(self, piece: bytes) -> list[int]:
        """Places of the tokens of one piece of the pre-tokenizer."""
        whole = self.place.get(piece)
        if whole is not None and len(piece) <= 2:
            return [whole]
        n, size, letters = len(piece), self.size, piece.decode("latin-1")
        matches = self.automaton.iter_long(letters)  # from the left, the longest token each time
        out: list[int] = []
        dead = bytearray(n + 1)
        apart, at, token = self.apart, 0, next(matches)[1]
        fresh = True  # token is the longest that starts at ``at``
        while True:
            end = at + size[token]
            if not dead[end] and (not out or (apart.get((out[-1], token)) or self.compatible(out[-1], token))):
                out.append(token)
                at = end
                if at == n:
                    return out
                if not fresh:
                    matches, fresh = self.automaton.iter_long(letters, at), True
                token = next(matches)[1]
                continue
            fresh = False
            token = self.next_shorter(token)
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = self.next_shorter(token)

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            packed = self.packed
            found = b"".join([packed[t] for t in self.tokens(piece.encode())])
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        if self.loose(text):
            return b"".join(map(self._piece, self.pieces(text)))
        # Where a single space stands between characters that are none, a piece ends before it:
        # what lies between such spaces can be encoded on its own, and remembered.
        first, *rest = text.split(" ")
        spaced, known, out = self.spaced, self.known, [b"".join(map(self._piece, self.pieces(first)))]
        for run in rest:
            found = spaced.get(run)
            if found is None:
                found = b"".join(map(self._piece, self.pieces(" " + run)))
                if len(run) <= 64:
                    if len(spaced) >= REMEMBERED:
                        spaced.clear()
                    spaced[run] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None:
            return self._plain(text)
        parts = self.cut(text) if any(s in text for s in self.special) else [text]
        return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        raw = self.bytes[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_loaded: dict[str, ByteBPE] = KEPT.setdefault("bpe", {})


def _of(content: str) -> ByteBPE:
    keep_only("bpe")
    if content not in _loaded:
        _loaded.clear()
        _loaded[content] = ByteBPE(content)
    return _loaded[content]


_KINDS = {"ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, ``n_tokens`` and the outputs asked for.

    vocabulary: path of the vocabulary on the driver; its content goes to the executors (some MB,
    whatever the corpus). outputs: ``ids`` (array of int), ``ids_sha256`` (of the ids as
    little-endian 32-bit integers), ``decoded_sha256`` (of the text decoded from the ids, in UTF-8).
    A null text counts as empty and has no tokens. Repeated rows and other columns do not matter:
    only these two columns are read. An empty table gives an empty result.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", "n_tokens bigint", *(f"{o} {_KINDS[o]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(content.value)
        make = {
            "ids": lambda packed: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), "<i4"))),
            "ids_sha256": lambda packed: pa.array([sha256(p).hexdigest() for p in packed]),
            "decoded_sha256": lambda packed: pa.array([sha256(bpe.decode(p)).hexdigest() for p in packed]),
        }
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                packed = [bpe.encode(t or "") for t in _strings(batch.column(1))]
                counts = pa.array([len(p) // 4 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, *(make[o](packed) for o in outputs)], [id_col, "n_tokens", *outputs])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ``text`` decoded from an array of ids; null and empty arrays give an empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(content.value)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], "<u4").tobytes()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def _strings(column: pa.Array, step: int = 256) -> Iterator[str | None]:
    """Python strings of a column, some at a time."""
    for a in range(0, len(column), step):
        yield from column.slice(a, step).to_pylist()
