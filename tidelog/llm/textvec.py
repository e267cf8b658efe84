"""Vectorised text primitives over Arrow string columns.

Everything works on the UTF-8 bytes of many texts at once, in chunks of about a megabyte, so
temporaries stay in cache and memory does not follow the batch size. A text longer than a chunk
is a chunk of its own: texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the word separators [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

CHUNK_BYTES = 1 << 20
_POSITIONS = 1024


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values for a seed, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = seeded(11, 256)
_BYTE[SPACE] = 0
_PLACE = seeded(13, _POSITIONS) | np.uint64(1)
_STEP = seeded(17, 64) | np.uint64(1)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a chunk, and each text's offsets in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = SPACE[data]
    edge = np.ones(n + 1, bool)  # a text or a separator begins here
    edge[1:n] = space[:-1]
    edge[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(edge[:n] & ~space)
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    inner = off[1:-1]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a chunk, and each text's offsets in them."""
    starts, ends, at = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), at
    first = starts[0]
    place = np.arange(first, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = _BYTE[data[first:]] * _PLACE[place & (_POSITIONS - 1)]
    return mix(np.add.reduceat(value, starts - first) + (ends - starts).astype(np.uint64)), at


def words(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of each text in them) for chunks of a string column."""
    data, off = utf8(column)
    for a, b in chunks(off):
        h, at = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        yield a, h, at


def word_counts(column) -> np.ndarray:
    """Number of words of each text."""
    data, off = utf8(column)
    counts = [np.zeros(0, np.int64)]
    for a, b in chunks(off):
        counts.append(np.diff(word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])[2]))
    return np.concatenate(counts)


def shingles(h: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text of a chunk the hashes of its runs of ``width`` words, in order.

    A text of fewer words, but not of none, has one shingle of them all; of none, none.
    """
    n = len(h)
    if n >= width:
        run = h[: n - width + 1] * _STEP[0]
        for k in range(1, width):
            run = run + h[k : n - width + 1 + k] * _STEP[k]
        run = mix(run)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield run[a : b - width + 1]
        elif b > a:
            yield mix((h[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def lower(column):
    """Lower-cased texts."""
    return pc.utf8_lower(column)
