"""Token ids in binary files (operator 7).

Documents are encoded with a published tokenizer, sorted by doc_id over all partitions and
written as files; reading them back gives each document's ids again.

File (``.tok``), all integers little-endian: the four bytes ``TOK1``, the number of distinct
ids and these ids (32 bits each) by falling frequency in this file; then blocks.  A block
has four 64-bit numbers (documents, ids, control bytes, data bytes), the doc_ids (64 bits
each), the documents' numbers of ids (64 bits each), the control bytes and the data bytes.
Data are the ids' frequency ranks in one to four bytes; a control byte holds the lengths
(less one, two bits each, lowest first) of four of them.  The reader finds the lengths of a
control byte in a table of 256 rows and gathers all values of a block at once.

A file holds at most ``FILE_IDS`` ids (or one document), so neither the writer's nor the
reader's memory grows with the partition.  NULL is the empty text; each document ends with
the end id.  Documents with equal doc_id follow one another in order of their texts; NULL
doc_ids stand first.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.files import created, new_folder, opened, paths
from tessera.llm.text import chunks
from tessera.session import cut_lineage

FILE_IDS = 4_000_000
CACHE, CHUNK_BYTES = 400_000, 4 << 20
MAGIC = b"TOK1"
NO_ID = np.iinfo(np.int64).min          # doc_id NULL in a file

#: control byte -> byte lengths of its four values
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


class Encoder:
    """Texts to ids by the library, each distinct word once.

    The splitter of a byte-level vocabulary ties one blank to the word after it and has no
    other context, so a text whose only white space is single blanks and single line ends
    may be cut into words.  Arrow cuts and numbers the words of a chunk; only its distinct words
    are looked up (new ones go through the library in one call), and
    numpy gathers the ids of all places.  Other texts, and those that may hold a special token, go
    through the library whole."""

    #: white space other than single blanks and line ends between words, or the start of a special token
    _ODD = (r"  |\n\n| \n|\n |<\||^[ \n]|[ \n]$|^$|"
            r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        names = self.library.get_vocab()
        self.leads = np.zeros(max(names.values()) + 1, dtype=bool)         # tokens that begin with a blank or are a line end
        self.leads[[i for name, i in names.items() if name[:1] == "\u0120"] + self._whole("\n")] = True
        self.words = pa.array([], pa.string())       # known words; their ids are flat[begin:begin + size]
        self.begin = self.size = self.used = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        """Keeps the more used half of the words."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[:CACHE // 2])
        size = self.size[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[keep] - (ends - size), size)]
        self.words, self.begin, self.size, self.used = self.words.take(pa.array(keep)), ends - size, size, self.used[keep] // 2

    def _learn(self, new: pa.Array) -> None:
        flat, begin, size, base = [self.flat], [self.begin], [self.size], len(self.flat)
        for at in range(0, len(new), 5000):
            part = new.slice(at, 5000)
            lines = pc.if_else(pc.starts_with(part, "\n"), part, pc.binary_join_element_wise(" ", part, ""))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "")[0].as_py()
            ids = np.asarray(self._whole(text), dtype="<u4")
            # a word's blank or line end is in its first token and in no other
            first = np.flatnonzero(self.leads[ids])
            if len(first) != len(part):
                each = [self._whole(w) for w in lines.to_pylist()]
                ids, first = np.concatenate([np.asarray(e, dtype="<u4") for e in each]), np.cumsum([0, *map(len, each[:-1])])
            begin.append(base + first)
            size.append(np.diff(np.append(first, len(ids))))
            flat.append(ids)
            base += len(ids)
        self.words = pa.concat_arrays([self.words, new])
        self.flat, self.begin, self.size = map(np.concatenate, (flat, begin, size))
        self.used = np.append(self.used, np.zeros(len(new), dtype=np.int64))

    def _entries(self, words: pa.Array) -> np.ndarray:
        """Places in the cache of distinct words: "x" is that word after a blank, "\\nx" after a line end."""
        if len(self.words) >= CACHE:
            self._forget()
        found = pc.index_in(words, value_set=self.words)
        unseen = found.is_null().to_numpy(zero_copy_only=False)
        out = found.fill_null(0).to_numpy().astype(np.int64)
        out[unseen] = len(self.words) + np.arange(int(unseen.sum()))
        if unseen.any():
            self._learn(words.filter(pa.array(unseen)))
        self.used[out] += 1
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), the texts free of ``_ODD``."""
        # the first word stands after a line end too, which is taken off again
        cut = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        words = pc.split_pattern(cut, " ")
        coded = pc.list_flatten(words).dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        first = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))[:-1]
        n, start = self.size[entry], self.begin[entry]
        start[first] += 1
        n[first] -= 1
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1]) + np.repeat(start - (ends - n), n)], np.add.reduceat(n, first)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers; NULL is the empty text."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self._ODD).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)
        if not odd.all():
            ids, n = self._plain(texts.filter(pa.array(~odd)))
            for i, part in zip(np.flatnonzero(~odd).tolist(), np.split(ids, np.cumsum(n)[:-1])):
                out[i] = part
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.asarray(self._whole(texts[i].as_py()), dtype="<u4")
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned integers below 2 ** 32."""
    values = np.asarray(values, dtype="<u4")
    pad = -len(values) % 4
    padded = np.append(values, np.zeros(pad, "<u4"))
    code = (padded >= 1 << 8).astype(np.uint8) + (padded >= 1 << 16) + (padded >= 1 << 24)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) <= code[:len(values), None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    if n and ends[-1] != len(data):
        raise ValueError("data bytes do not match control bytes")
    starts, source = ends - lengths, np.frombuffer(data, np.uint8)
    out = np.zeros(n, dtype=np.uint32)
    for place in range(4):
        has = lengths > place
        out[has] |= source[starts[has] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def write_file(out, doc_ids: list[int | None], ids: list[np.ndarray], block: int = 1 << 18) -> None:
    every = np.concatenate(ids)
    counts = np.bincount(every)                     # as long as the vocabulary
    by_rank = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    rank = np.empty(len(counts), dtype="<u4")
    rank[by_rank] = np.arange(len(by_rank), dtype="<u4")
    out.write(MAGIC + np.uint32(len(by_rank)).tobytes() + by_rank.astype("<u4").tobytes())
    lengths = np.array([len(i) for i in ids], dtype="<i8")
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ids):
        before = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, before + block, side="right")))
        values = rank[every[before:int(ends[to - 1])]]
        control, data = pack(values)
        out.write(np.array([to - at, len(values), len(control), len(data)], dtype="<i8").tobytes())
        out.write(np.array([NO_ID if d is None else d for d in doc_ids[at:to]], dtype="<i8").tobytes())
        out.write(lengths[at:to].tobytes() + control + data)
        at = to


def read_file(stream) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(doc_ids, ids of each) block by block."""
    def exactly(n: int) -> bytes:
        got = stream.read(n)
        if len(got) != n:
            raise ValueError("the file ends within a block")
        return got

    if exactly(4) != MAGIC:
        raise ValueError("not a token file")
    by_rank = np.frombuffer(exactly(4 * int(np.frombuffer(exactly(4), "<u4")[0])), "<u4")
    while head := stream.read(32):
        docs, n, controls, size = np.frombuffer(head, "<i8").tolist()
        doc_ids = np.frombuffer(exactly(8 * docs), "<i8")
        lengths = np.frombuffer(exactly(8 * docs), "<i8")
        ids = by_rank[unpack(exactly(controls), exactly(size), n)]
        yield doc_ids, np.split(ids, np.cumsum(lengths)[:-1])


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the files of ``docs`` (doc_id, text) into ``folder`` when it is run: one row
    (part, file, docs, ids) per file.  Files are in order of (part, file)."""
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), encoder(path)
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        n, held = 0, 0

        def close() -> pa.RecordBatch:
            with created(folder, f"{part:08d}-{n:08d}.tok") as out:
                write_file(out, doc_ids, ids)
            return pa.RecordBatch.from_pydict({"part": [part], "file": [n], "docs": [len(ids)], "ids": [held]})

        for piece in chunks(batches, limit=CHUNK_BYTES):
            for d, i in zip(piece.column(0).to_pylist(), own.encode(piece.column(1))):
                if ids and held + len(i) + 1 > FILE_IDS:
                    yield close()
                    ids, doc_ids, n, held = [], [], n + 1, 0
                ids.append(np.concatenate([i, end]))
                doc_ids.append(d)
                held += len(i) + 1
        if ids:
            yield close()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return ordered.mapInArrow(run, "part long, file long, docs long, ids long")


def read(spark, folder: str) -> DataFrame:
    """(part, file, place, doc_id, before, n_tokens, ids_crc32) per document of the files:
    ``before`` are the ids of the file before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                part, file = map(int, os.path.basename(path).split(".")[0].split("-"))
                before = place = 0
                with opened(path) as stream:
                    for doc_ids, ids in read_file(stream):
                        sizes = np.array([len(i) for i in ids], dtype=np.int64)
                        m = len(ids)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(m, part)), pa.array(np.full(m, file)), pa.array(np.arange(place, place + m)),
                            pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(before + np.cumsum(sizes) - sizes), pa.array(sizes),
                            pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())],
                            names=["part", "file", "place", "doc_id", "before", "n_tokens", "ids_crc32"])
                        before, place = before + int(sizes.sum()), place + m

    return paths(spark, folder, ".tok").mapInArrow(
        run, "part long, file long, place long, doc_id long, before long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, read back from the files written."""
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    written = cut_lineage(write(docs, path, folder, end_id), "manifest")
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per partition
    parts = written.groupBy("part").agg(F.sum("ids").alias("ids")) \
        .select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.select("part", "file", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("file_start")).join(parts, "part") \
        .select("part", "file", (F.col("part_start") + F.col("file_start")).alias("file_start"))
    return read(spark, folder).join(files, ["part", "file"]) \
        .select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
