"""Byte-pair encoding and decoding (operator 6) with a published vocabulary.

Reads the file of a tokenizer (normaliser, split pattern, byte alphabet, merge ranks) and
encodes with its own merge loop: a priority queue of (rank, position) over a doubly linked
list of symbols.  An entry is stale when a symbol it names has been merged or changed since;
stale entries are skipped when they surface.  Decoding concatenates vocabulary strings.

Normalisation here is NFC, runs of white space to one blank, lower case per character;
words are runs of letters, single numerals, contractions and runs of other signs; white
space is dropped, so a text may be cut at white space first and every piece encoded once
per cache life.  The strings of the vocabulary's special tokens are taken out of the raw
text before anything else, as the library does.  The cache holds at most ``CACHE`` pieces
and is emptied when full: it bounds memory, every piece is still encoded.

NULL is the empty text, which has no ids.  Rows are handled one by one: ties, repeated rows
and extra columns have no effect on each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.text import chunks, give_back

CACHE = 150_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies:
    visible Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


_PLACE = (1 << 40) - 1


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Apply the merges of lowest rank, leftmost first, until none is left.

    ``merges`` maps a pair (left id << 20 | right id) to (rank << 20 | id of the merged
    symbol); a queue entry is that value and the place of the left symbol in one integer.
    It is stale when the pair now standing at its place has another value."""
    n = len(symbols)
    queue = [v << 40 | i for i in range(n - 1) if (v := merges.get(symbols[i] << 20 | symbols[i + 1])) is not None]
    if not queue:
        return symbols
    heapq.heapify(queue)
    symbols, get, push, pop = [*symbols, -1], merges.get, heapq.heappush, heapq.heappop
    left, right = list(range(-1, n)), list(range(1, n + 2))         # n: the end mark
    while queue:
        entry = pop(queue)
        i, value = entry & _PLACE, entry >> 40
        j, at = right[i], symbols[i]
        if at < 0 or j >= n or get(at << 20 | symbols[j]) != value:
            continue                                                # stale
        at = symbols[i] = value & 0xFFFFF
        symbols[j] = -1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (v := get(at << 20 | symbols[k])) is not None:
                push(queue, v << 40 | i)
        h = left[i]
        if h >= 0 and (v := get(symbols[h] << 20 | at)) is not None:
            push(queue, v << 40 | h)
    return [t for t in symbols if t >= 0]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Cache(dict):
    """Results by key in two generations of at most ``CACHE`` entries: when the young one is
    full it becomes the old one, and entries used again move up.  Bounds memory only."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        suffix = model.get("end_of_word_suffix") or ""
        self.letter = {c: vocab[c] for c in byte_alphabet()}
        self.last = {c: vocab[c + suffix] for c in byte_alphabet()}
        self.byte = [self.letter[c] for c in byte_alphabet()]
        self.last_byte = [self.last[c] for c in byte_alphabet()]
        self.pattern = re.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
                                  .replace(r"[\p{L}]", "[^\\W\\d_]").replace(r"[\p{N}]", r"\d")
                                  .replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), re.ASCII)
        self.library = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.asarray([i], dtype="<u4").tobytes() for t, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.strings = [""] * (max(chain(vocab.values(), special.values())) + 1)
        for t, i in chain(vocab.items(), special.items()):
            self.strings[i] = t
        self.words = _Cache(self.word_ids)
        self.pieces = _Cache(self.piece_ids)

    def word_ids(self, word: str) -> bytes:
        """Ids of a normalised word."""
        symbols = [self.byte[b] for b in word.encode("utf-8")]
        symbols[-1] = self.last_byte[word.encode("utf-8")[-1]]
        return _packed(merge_symbols(symbols, self.merges))

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a run of characters without white space."""
        if piece.isascii():
            return b"".join(map(self.words.__getitem__, self.pattern.findall(piece.lower())))
        if piece.isalpha() and max(piece) < "\u0130":
            return self.words["".join(c.lower() for c in unicodedata.normalize("NFC", piece))]
        # other signs: which of them are letters or numerals is the library's table to say
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return b"".join(_packed(merge_symbols([*(self.letter[c] for c in w[:-1]), self.last[w[-1]]], self.merges)) for w, _ in cut)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _cut(text)))
        return b"".join(self.special[part] if part in self.special
                        else b"".join(map(self.pieces.__getitem__, _cut(part))) for part in self.split.split(text))

    def decode(self, ids) -> str:
        """Vocabulary strings one after another; the vocabulary names no decoder, for which
        the library sets a blank between them."""
        return " ".join(map(self.strings.__getitem__, ids))


#: str.split() also cuts at the four information separators, which are no white space here
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANK = regex.compile(r"\s+")


def _cut(text: str) -> list[str]:
    if text.isprintable() or not _SEPARATORS.search(text):
        return text.split()
    return [p for p in _BLANK.split(text) if p]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row of ``docs``; ``path`` is
    the vocabulary file, present on every machine."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for piece in chunks(batches):
                raw = [own.encode(t or "") for t in piece.column(1).to_pylist()]
                ids = [np.frombuffer(r, dtype="<u4") for r in raw]
                cols = [piece.column(0), pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                        pa.array([hashlib.sha256(own.decode(i.tolist()).encode("utf-8")).hexdigest() for i in ids], pa.string())]
                if with_ids:
                    cols.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:            # a worker serves other stages too: what it has learnt goes with the task
            own.words.forget()
            own.pieces.forget()
            give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
