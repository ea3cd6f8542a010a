"""Benchmark decontamination (operator 2): which documents hold which benchmark items.

A document holds an item when some stretch of its words is within an edit distance of
``floor(edits * words of the item)`` from the item (words put in, left out or changed).  Words
are runs of letters and digits (and all that is not ASCII), lower-cased A-Z.

1. Windows begin at anchors: word pairs whose hash is the least of some ``NEAR`` neighbouring
   pairs, so that a copied passage has the same anchors inside as the item.  Windows are
   item-sized: of the size classes (each about 1.4 times the one before) an item has its own,
   the largest that fits, and the ``SHORTER`` below it, for windows that begin at its later words.
2. A window is embedded by the random walk of Chakraborty, Goldenberg and Koucky: 2 * size
   steps; each step puts out the word under the pointer, and a random bit of (step, word)
   says whether the pointer moves on.  Few edits become few differing steps.
3. Bit-sampling LSH: ``SAMPLES`` steps, one from each part of the walk, make a key; ``REPEATS`` walks
   per size, chosen so that items with all the edits allowed are found with 0.9 or more
   at every length from ``SHORT`` words on (measured: 0.92 and more, all from 16 words on).
4. Documents' keys are joined to the items' keys.  Two filters of fixed size (``FILTER_BITS``
   bits each, made by Spark from the anchors and keys of all items) drop nearly all
   windows before the join; what passes by chance finds no partner there.
5. Every candidate is verified by the exact edit distance on the whole words.  Candidates are
   gathered by document, so a text moves once at most (texts without any do not move: a
   broadcast bitmap of the document ids knows them), and only the words about each candidate go
   on to its item.

Items of fewer than ``SHORT`` words are too short to embed: an item with at most k edits, cut into
k + 1 pieces, has one piece that no edit touches, so every run of words that equals a piece is a
candidate for step 5.

An anchor begins a window only if its word pair is one of some item's anchors.  Items of
fewer than 5 words allow no edit and match exactly; NULL items and items without words match
nothing, nor do NULL and empty texts;
documents without a doc_id are not searched; repeated doc_ids count as one document.
Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minhash import among, id_bitmap, without
from tessera.llm.text import NOT_ALNUM, chunks, combine, mix64, salts, small_batches, utf8, word_hashes
from tessera.session import cut_lineage

NEAR = 4
SHORT, SHORTER = 8, 3
REPEATS, SAMPLES = 16, 5
EDITS = 0.2
FILTER_BITS = 22
_FILTER_MASK = np.uint64((1 << FILTER_BITS) - 1)
_PAIR = salts(2, 41)


def anchors(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, pair hashes) of the anchors of all texts."""
    n = len(words)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pair = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    pair[:-1] = mix64(words[:-1] * _PAIR[0] + words[1:] * _PAIR[1])
    last = bounds[1:] - 1
    last = last[last >= 0]
    pair[last] = np.iinfo(np.uint64).max                # a pair never reaches into the next text
    padded = np.append(pair, np.full(NEAR - 1, np.iinfo(np.uint64).max, dtype=np.uint64))
    least = padded[:n].copy()
    for j in range(1, NEAR):
        np.minimum(least, padded[j:j + n], out=least)
    chosen = np.zeros(n, dtype=bool)
    for j in range(NEAR):
        chosen[j:] |= pair[j:] == least[:n - j]
    chosen[last] = False
    at = np.flatnonzero(chosen)
    return at, pair[at]


def walk_keys(words: np.ndarray, at: np.ndarray, end: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window size, keys, whole) for every size and repetition: keys of the windows that
    begin at ``at`` in texts that end at ``end``, and whether all sampled words lie before
    that end (no key else).  One walk serves all sizes of a repetition."""
    longest = 2 * max(sizes)
    for repeat in range(REPEATS):
        move = salts(longest, 1000 + repeat)
        # one step out of each of SAMPLES equal parts of the walk
        steps = {s: ((np.arange(SAMPLES) + np.random.default_rng([s, repeat]).random(SAMPLES)) * (2 * s / SAMPLES)).astype(int)
                 for s in sizes}
        keys = {s: np.full(len(at), np.uint64(s * 64 + repeat)) for s in sizes}
        whole = {s: np.ones(len(at), dtype=bool) for s in sizes}
        pointer = at.copy()
        for j in range(max(int(s[-1]) for s in steps.values()) + 1):
            inside = pointer < end
            word = np.where(inside, words[np.minimum(pointer, len(words) - 1)], np.uint64(0))
            for s, some in steps.items():
                if j in some:
                    keys[s] = mix64(keys[s] ^ word)
                    whole[s] &= inside
            pointer += ((word * move[j]) >> np.uint64(63)).astype(np.int64)
        for s in sizes:
            yield s, keys[s], whole[s]


def sizes_of(n: int) -> list[int]:
    """Window sizes of an item of n words: the largest classes that fit (6 words, which chance
    finds in much text, for the shortest items only)."""
    classes, exact = [6] if n < 12 else [], 6 * 2 ** 0.5
    while round(exact) <= n:
        classes.append(round(exact))
        exact *= 2 ** 0.5
    return classes[-1 - SHORTER:]


_KEYS = "item_id long, place long, words long, pair long, size long, key long"      # of pieces: pair NULL, size less than 0


def _rows(item_id, place, words, pair, size, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (item_id, place, words, pair, size, key)],
                                      names=[c.split(" ")[0] for c in _KEYS.split(", ")])


def run_keys(words: np.ndarray, length: int) -> np.ndarray:
    """Keys of the runs of ``length`` words that begin at each word."""
    return combine(words, length, 5000 + length)


def cuts(n: int, edits: float) -> np.ndarray:
    """Where the pieces of an item of n words begin, and n: one piece more than edits."""
    pieces = int(np.floor(edits * n)) + 1
    return np.arange(pieces + 1) * n // pieces


def _item_keys(edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            words, bounds, _ = word_hashes(*utf8(piece.column(1)), NOT_ALNUM)
            n = np.diff(bounds)
            ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero((n > 0) & (n < SHORT)):
                ends = cuts(int(n[i]), edits)
                keys = [run_keys(words[bounds[i] + a:bounds[i] + b], int(b - a))[0] for a, b in zip(ends[:-1], ends[1:])]
                yield _rows(np.full(len(keys), ids[i]), ends[:-1], np.full(len(keys), n[i]), [None] * len(keys), -np.diff(ends), np.array(keys).view(np.int64))
            at, pair = anchors(words, bounds)
            item = np.searchsorted(bounds, at, side="right") - 1
            own = n[item] >= SHORT
            at, pair, item = at[own], pair[own], item[own]
            if not len(at):
                continue
            sizes = [{*sizes_of(k)} for k in n.tolist()]
            for size, keys, fits in walk_keys(words, at, bounds[item + 1], sorted(set().union(*sizes))):
                fits &= np.array([size in own for own in sizes])[item]
                yield _rows(ids[item[fits]], (at - bounds[item])[fits], n[item[fits]], pair[fits].view(np.int64),
                            np.full(int(fits.sum()), size), keys[fits].view(np.int64))
    return run


def bit_filter(values: DataFrame, column: str) -> np.ndarray:
    """Which low FILTER_BITS bits occur, as booleans: made by Spark, of fixed size."""
    low = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = values.select(low.alias("l")).select(F.shiftright("l", 6).alias("w"), F.expr("shiftleft(1L, cast(l & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).collect()      # at most 2 ** (FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for r in rows:
        table[r["w"]] = r["b"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _window_keys(pair_filter, key_filter, sizes: list[int], lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs_known, keys_known = pair_filter.value, key_filter.value
        for piece in chunks(batches):
            words, bounds, _ = word_hashes(*utf8(piece.column(1)), NOT_ALNUM)
            ids = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)

            def found(at: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
                doc = np.searchsorted(bounds, at, side="right") - 1
                return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(at - bounds[doc]), pa.array(keys.view(np.int64))],
                                                  names=["doc_id", "at", "key"])

            for length in lengths:
                keys = run_keys(words, length)
                at = np.flatnonzero(keys_known[(keys & _FILTER_MASK).astype(np.int64)])
                at = at[at + length <= bounds[np.searchsorted(bounds, at, side="right")]]      # in one text
                yield found(at, keys[at])
            if not sizes:
                continue
            at, pair = anchors(words, bounds)
            at = at[pairs_known[(pair & _FILTER_MASK).astype(np.int64)]]
            if not len(at):
                continue
            end = bounds[np.searchsorted(bounds, at, side="right")]
            for _, keys, whole in walk_keys(words, at, end, sizes):
                hit = whole & keys_known[(keys & _FILTER_MASK).astype(np.int64)]
                yield found(at[hit], keys[hit])
    return run


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance between ``item`` and any stretch of ``text``."""
    index = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, word in enumerate(item, 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (text != word), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - index) + index
    return int(row.min())


def _stretches(edits: float):
    """(doc_id, item_id, exact, about): hashes of the words of each candidate's own place, and with as
    many words before and after it as the edits allow and the region leaves open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            docs, doc_at, _ = word_hashes(*utf8(piece.column(1)), NOT_ALNUM)
            asks = piece.column(2)
            row = np.repeat(np.arange(piece.num_rows), pc.list_value_length(asks).to_numpy())
            item, start, n = (c.to_numpy() for c in asks.flatten().flatten())
            slack = np.floor(edits * n).astype(np.int64) + 8
            begin, end = doc_at[row], doc_at[row + 1]
            at = begin + start

            def cut(a: np.ndarray, b: np.ndarray, some: slice) -> pa.Array:
                return pa.array([docs[x:y].tobytes() for x, y in zip(np.clip(a, begin, end)[some], np.clip(b, begin, end)[some])], pa.binary())

            for k in range(0, len(row), 1024):
                some = slice(k, k + 1024)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(pa.array(row[some])), pa.array(item[some]), cut(at, at + n, some),
                    cut(at - slack, at + n + slack, some)], names=["doc_id", "item_id", "exact", "about"])
    return run


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunks(batches):
        words, at, _ = word_hashes(*utf8(piece.column(1)), NOT_ALNUM)
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                                         names=["item_id", "item"])


def _verify(edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for exact, about, item in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                item = np.frombuffer(item, np.uint64)
                found.append((0 if exact == item.tobytes() else distance(item, np.frombuffer(about, np.uint64)), len(item)))
            d, n = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d), pa.array(n)],
                                             names=["doc_id", "item_id", "distance", "n_words"]).filter(pa.array(d <= np.floor(edits * n)))
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, distance, n_words, similarity) of every document and item it holds:
    the least edit distance in words, and 1 - distance / n_words."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    keys = cut_lineage(items.mapInArrow(_item_keys(edits), _KEYS), "item_keys")
    every = sorted(r[0] for r in keys.select("size").distinct().collect())       # size classes, and lengths of pieces
    sizes, lengths = [s for s in every if s > 0], [-s for s in every if s < 0]
    if not every:
        return spark.createDataFrame([], "doc_id long, item_id long, distance long, n_words long, similarity double")
    known = [spark.sparkContext.broadcast(bit_filter(keys.filter(f"{c} is not null"), c)) for c in ("pair", "key")]
    windows = docs.mapInArrow(_window_keys(*known, sizes, lengths), "doc_id long, at long, key long")
    start = F.col("at") - F.col("place")
    near = (windows.join(keys.select("key", "item_id", "place", "words").distinct(), "key")
            .groupBy("doc_id", "item_id", "words", F.floor(start / 8).alias("region")).agg(F.min(start).alias("start")))
    asks = cut_lineage(near.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "start", "words")).alias("asks")), "candidates")
    texts = among(docs, "doc_id", id_bitmap(asks, "doc_id")).join(asks, "doc_id").select("doc_id", "text", "asks")
    # written, so that no stage has two Python steps: each would keep a worker for every core
    places = cut_lineage(texts.mapInArrow(_stretches(edits), "doc_id long, item_id long, exact binary, about binary"), "places")
    pairs = places.join(cut_lineage(items.mapInArrow(_item_words, "item_id long, item binary"), "item_words"), "item_id") \
        .select("doc_id", "item_id", "exact", "about", "item")
    held = pairs.mapInArrow(_verify(edits), "doc_id long, item_id long, distance long, n_words long")
    return held.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("n_words").alias("n_words")) \
        .withColumn("similarity", 1 - F.col("distance") / F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns as they are; rows of other documents do
    not move."""
    held = cut_lineage(contaminated(docs, benchmark, edits).select("doc_id").distinct(), "held")
    return without(docs, "doc_id", held)
