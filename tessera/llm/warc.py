"""WARC archives, one Zstandard frame per record (operator 8).

An archive (``.warc.zst``) begins with a skippable frame that holds the dictionary, as the
public WARC-Zstandard draft lays down: magic number 0x184D2A5D, 32-bit length, dictionary.
Each record then is a frame of its own.  The reader loads the dictionary from that frame,
decodes frame after frame, and checks of every record the version line, the named headers,
Content-Length against the block, the block digest, and for responses the payload digest
and the HTTP Content-Length against the payload.

Records whose payloads are equal and have at least ``LEAST`` bytes: those of the largest
page_id are responses, the others are revisits (profile identical-payload-digest) that name
it in WARC-Refers-To and keep the payload's length in the HTTP header.  NULL html is the
empty payload, a NULL url is left out, a NULL page_id has the record id ``none`` and comes
before every number.  Rows that repeat the largest page_id are all responses.  The dictionary
is trained on ``SAMPLE`` pages at most (the bound of a documented sample; it changes only
the size of the files), and is empty where there is too little to train on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import created, new_folder, opened, paths
from tessera.llm.text import chunks
from tessera.session import cut_lineage

LEAST = 1000
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 20_000, 64 << 10
SKIPPABLE = 0x184D2A5D
FILE_BYTES = 64 << 20                   # payload bytes after which a new archive is begun
DATE = "1970-01-01T00:00:00Z"           # the table has no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(none|-?\d+)>", urn)
    if not m:
        raise ValueError(f"record id {urn!r}")
    return None if m[1] == "none" else int(m[1])


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")))
    head.append(("WARC-Payload-Digest", _digest(payload)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    head += [("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line {line[:80]!r}")
        if name.lower() in out:
            raise ValueError(f"header {name} twice")
        out[name.lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """A checked record: page_id, url, record_type, refers_to, payload (None for a revisit),
    payload_bytes, payload_digest (hex)."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not gap:
        raise ValueError("not a WARC record")
    named = _headers(lines)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - named.keys():
        raise ValueError(f"headers missing: {sorted(missing)}")
    n = int(named["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    if _digest(block) != named["warc-block-digest"]:
        raise ValueError("block digest does not match")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_headers(http.partition(b"\r\n")[2])["content-length"])
    kind, digest = named["warc-type"], named["warc-payload-digest"]
    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError("payload does not match its digest or length")
    if kind == "revisit" and (payload or named.get("warc-profile") != PROFILE):
        raise ValueError("revisit record with a payload or without its profile")
    if kind not in ("response", "revisit"):
        raise ValueError(f"record type {kind!r}")
    return {"page_id": _page(named["warc-record-id"]), "url": named.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page(named["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None, "payload_bytes": length,
            "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex()}


def write_archive(out, dictionary: bytes, records: Iterator[bytes]) -> None:
    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=True, write_checksum=True)
    for r in records:
        out.write(press.compress(r))


def read_archive(stream, step: int = 64 << 10) -> Iterator[bytes]:
    """One decoded frame after the other; memory is bounded by the largest record."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    dictionary = stream.read(size)
    if len(dictionary) != size:
        raise ValueError("the archive ends within its dictionary")
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if size else None)
    rest = b""
    while rest or (rest := stream.read(step)):
        frame, out = open_.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := stream.read(step)):
                raise ValueError("the archive ends within a frame")
        yield b"".join(out)


def train(pages: DataFrame) -> bytes:
    """A dictionary from at most SAMPLE pages, chosen by a hash of their id: first the ids alone, then
    the beginnings of their pages."""
    ids = pages.filter(F.length("html") > 0).select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    some = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").filter(F.length("html") > 0) \
        .select(F.substring("html", 1, SAMPLE_BYTES).alias("html")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sorted(r[0].encode("utf-8") for r in some)).as_bytes()
    except zstandard.ZstdError:         # too few or too short
        return b""


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, revisit, refers_to): which record each page becomes.  Pages under
    ``LEAST`` bytes have no partner and stay where they are."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce("html", F.lit("")).alias("html"))
    marked = full.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"),
                         F.octet_length("html").alias("size"))
    groups = marked.select("digest", "size", "page_id").filter(f"size >= {LEAST}").groupBy("digest", "size") \
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    large = marked.filter(f"size >= {LEAST}").join(groups, ["digest", "size"], "left").select(
        "page_id", "url", "html", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
        F.col("first").alias("refers_to"))
    small = full.filter(F.octet_length("html") < LEAST).select("*", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers_to"))
    return large.unionByName(small)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives when it is run: one row (archive, records) each."""
    dictionary = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        pieces = chunks(batches, "html")
        waiting = next(pieces, None)
        while waiting is not None:
            name, count, size = f"{part:08d}-{n:08d}.warc.zst", 0, 0

            def records() -> Iterator[bytes]:
                nonlocal waiting, count, size
                while waiting is not None and size < FILE_BYTES:
                    for row in waiting.to_pylist():
                        payload = row["html"].encode("utf-8")
                        count, size = count + 1, size + len(payload)
                        yield record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                    waiting = next(pieces, None)

            with created(folder, name) as out:
                write_archive(out, dictionary, records())
            n += 1
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count]})

    return plan(pages).mapInArrow(run, "archive string, records long")


SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string")


def read(spark, folder: str, html: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, html]) per
    record; html is NULL for revisits.  Records are decoded and checked in either case."""
    schema = SCHEMA + ", html string" * html
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()][:len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as stream:
                    rows, held = [], 0
                    for data in read_archive(stream):
                        r = parse(data)
                        if html:
                            r["html"] = None if r["payload"] is None else r["payload"].decode("utf-8")
                        rows.append(r)
                        held += len(data)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)

    return paths(spark, folder, ".warc.zst").mapInArrow(run, schema)


def round_trip(pages: DataFrame, html: bool = True) -> DataFrame:
    """The records of ``pages`` (page_id, url, html), read back from archives just written."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    if cut_lineage(write(pages, folder), "manifest").isEmpty():
        return spark.createDataFrame([], SCHEMA + ", html string" * html)
    return read(spark, folder, html)
