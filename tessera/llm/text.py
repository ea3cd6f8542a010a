"""Vectorised text helpers that run inside Arrow tasks.

A task never works on a whole Arrow batch at once: ``chunks`` hands out pieces of half a
megabyte of text, so a worker's memory does not depend on how many rows or how long the
texts of a batch are (one very long text is one chunk of its own).  A worker serves the tasks
of many stages: what it has freed goes back to the system when the last piece is done.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and odd multipliers), element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd pseudo-random 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE_VALUE = salts(256, 101)
_PLACE = salts(256, 202)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = salts(max(n, 2 * len(_PLACE)), 202)
    return _PLACE


#: A-Z to a-z, all else as it is (other bytes of UTF-8 are 0x80 or more)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: separators of words: ASCII white space
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: separators of words: every ASCII byte but 0-9, A-Z, a-z
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64
    else:
        wide = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=wide)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):        # another C library than glibc
    _trim = None


def give_back() -> None:
    """Return the memory that this process has freed to the system.  Allocators keep it for
    later use, so a reused worker would hold the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


BATCH_ROWS = 1000


def small_batches(spark) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from here on in this session: what a task and
    its worker hold of long texts at a time.  A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def filter_rows(text: pa.Array, keep) -> pa.Array:
    """``keep(bytes, offsets)`` of an array of texts, piece by piece."""
    parts = [keep(*utf8(piece.column(0))) for piece in chunks([pa.RecordBatch.from_arrays([text], names=["text"])])]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool), pa.bool_())


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of at most ``limit`` bytes of ``text`` (one row at least)."""
    try:
        for batch in batches:
            _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            at, n = 0, batch.num_rows
            while at < n:
                end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
                yield batch.slice(at, end - at)
                at = end
    finally:
        give_back()


def word_hashes(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words (maximal runs of non-separator bytes, A-Z lower-cased) of
    the texts, the word index at which each text begins (one more than texts), and the
    byte at which each word begins."""
    size, n = len(raw), len(offs) - 1
    if size == 0:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    inside = ~separators[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < size]
    begins[cuts] = inside[cuts]          # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offs)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), bounds, starts
    letters = LOWER[raw[inside]]
    first = np.cumsum(inside, dtype=np.int64)[starts] - 1
    lengths = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
    value = _BYTE_VALUE[letters] * _places(int(lengths.max()))[place]
    return mix64(np.add.reduceat(value, first)), bounds, starts


def combine(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive elements."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(seed))
    for j, s in enumerate(salts(width, seed)):
        out += hashes[j:j + n] * s
    return mix64(out)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int, separators: np.ndarray = SPACE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; a text of fewer
    words has its whole sequence as the one shingle, a text without words none."""
    words, bounds, _ = word_hashes(raw, offs, separators)
    runs = combine(words, width, 11)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= width:
            s = np.sort(runs[a:b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            out.append(combine(words[a:b], n, 1000 + int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
