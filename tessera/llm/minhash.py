"""MinHash near-duplicate detection (operator 1).

A text's set is its distinct ``width``-word shingles.  Method:

1. one-permutation hashing: every shingle is hashed once; the sorted distinct hashes are
   cut into ``bands * rows`` equal ranges and the least hash of each range is kept;
2. optimal densification: an empty bin takes the value of the first filled bin in a random
   order of its own (one fixed random permutation of all bins per bin);
3. banding: each run of ``rows`` bins (the low 16 bits of each are kept) is hashed to a bucket
   key;
4. star-shaped candidate edges: each bucket ties its members to its least member (the hub);
5. every candidate is confirmed on the full shingle sets; confirmed links and exact copies
   give components;
6. a star loses a link when two members resemble each other and not the hub.  So buckets
   whose members are in different components after step 5 are looked at again.  In buckets
   of at most ``FEW`` members all members of different components are compared.  Larger ones
   get up to ``HUBS`` further hubs, first the member that shares most buckets with others
   (of many copies of one text: that text), as long as new links are found and their members
   are more than ``AT_ONCE`` blocks of step 7;
7. the members of larger buckets that are still apart are compared all with all: buckets
   that share members make a cluster, a cluster's members are dealt to blocks, and each pair
   of blocks is one cell.  A cell finds the members that are likely linked to one of another
   component by their bins, then compares these on the full shingle sets, and gives only the
   links that join components.

Equal sets meet by their digest before step 3, so a group of exact copies enters the
buckets as one member, and copies are never paired.  Up to step 6 candidates grow in
proportion to members and keys; the rows of step 7 grow with (members / ``BLOCK``) * members of a
cluster that no hub joins.  Two texts at the threshold of 0.85 share no bucket with
probability 6e-11 (0.8: 1e-7); a pair is left out by its bins with 3e-7.

In ``near_duplicates`` rows that share a doc_id are one node (linked if any of their texts is).  NULL and empty
texts and texts without words have an empty set: linked with nothing.  Rows with a NULL
doc_id are returned with a NULL component and stay.  An empty table gives an empty result.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import labels, star_forest, turned
from tessera.llm.text import SPACE, chunks, mix64, salts, shingle_sets, small_batches, utf8
from tessera.session import cut_lineage

BANDS, ROWS = 40, 5
FEW, HUBS = 16, 4
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20     # members and shingles of a block on average
AT_ONCE = 8                              # blocks that are compared all with all before any further hub
SLOTS, SLOT_BITS = 1024, 32768           # SLOT_BITS is the size of Spark's bitmaps

SIGNED = "doc_id long, n_shingles long, digest binary, bins binary"


def _bin_orders(bins: int) -> np.ndarray:
    """For each bin its own random order of all bins."""
    return np.argsort(mix64(np.arange(bins * bins, dtype=np.uint64) + np.uint64(77)).reshape(bins, bins), axis=1)


def signature(shingles: np.ndarray, edges: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Least hash of each bin; empty bins densified.  ``shingles``: sorted, not empty."""
    at = np.searchsorted(shingles, edges)
    filled = at < np.append(at[1:], len(shingles))
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        tried = orders[empty]
        donor = tried[np.arange(len(empty)), np.argmax(filled[tried], axis=1)]
        out[empty] = out[donor]
    return out


def _sign(width: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(bins, dtype=np.float64) * (2.0 ** 64 / bins)).astype(np.uint64)
        orders = _bin_orders(bins)
        for piece in chunks(batches):
            sets = shingle_sets(*utf8(piece.column(1)), width)
            short = [signature(s, edges, orders).astype("<u2").tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                piece.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array(short, pa.binary())], names=["doc_id", "n_shingles", "digest", "bins"])
    return run


def _band(bands: int, rows: int):
    """(rep, size, keys): a hash of each run of ``rows`` bins (low 16 bits each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, band = salts(rows, 31), salts(bands, 32)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([np.frombuffer(b, "<u2") for b in batch.column(2).to_pylist()]).astype(np.uint64)
            keys = mix64((table.reshape(len(table), bands, rows) * place).sum(axis=2, dtype=np.uint64) + band).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(keys), pa.list_(pa.int64()))],
                                             names=["rep", "size", "keys"])
    return run


def _likely(share: tuple[int, int]):
    """Pairs whose share of equal bins is not more than five standard deviations below what
    the threshold would give (a set of n shingles fills n bins of its own at most)."""
    t = share[0] / share[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(2).to_numpy()
            equal = np.array([(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean()
                              for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())], dtype=float)
            bins = len(batch.column(3)[0].as_py()) // 2 if batch.num_rows else 1
            keep = equal >= t - 5 * np.sqrt(t * (1 - t) / np.minimum(least, bins))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _confirm(width: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text_b"):
            left = shingle_sets(*utf8(piece.column(2)), width)
            right = shingle_sets(*utf8(piece.column(3)), width)
            keep = []
            for a, b in zip(left, right):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and share[1] * both >= share[0] * (len(a) + len(b) - both))
            yield piece.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


CELL = "cluster long, i int, j int, rep long, component long, block int"


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a cell's two blocks (the same twice in a block's cell with itself)."""
    block = cell.column("block").to_numpy()
    return np.flatnonzero(block == cell.column("i")[0].as_py()), np.flatnonzero(block == cell.column("j")[0].as_py())


def _cell_likely(share: tuple[int, int]):
    """The members of a cell with a likely partner (as in ``_likely``) of another component."""
    t = share[0] / share[1]

    def run(cell: pa.Table) -> pa.Table:
        left, right = _sides(cell)
        table = np.stack([np.frombuffer(b, "<u2") for b in cell.column("bins").to_pylist()])
        size, component = cell.column("size").to_numpy(), cell.column("component").to_numpy()
        hit = np.zeros(len(table), dtype=bool)
        for x in left:
            other = right[(component[right] != component[x]) & (size[right] * share[1] >= size[x] * share[0])
                          & (size[x] * share[1] >= size[right] * share[0])]
            least = np.minimum(np.minimum(size[other], size[x]), table.shape[1])
            likely = other[(table[other] == table[x]).mean(axis=1) >= t - 5 * np.sqrt(t * (1 - t) / least)]
            hit[likely] = True
            hit[x] |= len(likely) > 0
        return cell.filter(pa.array(hit)).select([c.split(" ")[0] for c in CELL.split(", ")])
    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``."""
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for at in range(0, len(known), 4096):
        some = known[at:at + 4096]
        out += _holds(left, some) @ _holds(right, some).T
    return out


def _holds(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), dtype=np.float32)
    for row, s in zip(out, sets):
        s = s[np.searchsorted(s, known[0]):np.searchsorted(s, known[-1], side="right")]
        at = np.searchsorted(known, s)
        row[at[known[at] == s]] = 1
    return out


def _cell_links(width: int, share: tuple[int, int]):
    """(a, b): links of a cell that join components, confirmed on the full shingle sets."""
    def run(cell: pa.Table) -> pa.Table:
        left, right = _sides(cell)
        pairs = []
        if len(left) and len(right):
            sets = shingle_sets(*utf8(cell.column("text")), width)
            rep, label = cell.column("rep").to_numpy(), cell.column("component").to_numpy().copy()
            size = np.array([len(s) for s in sets])
            both = _common([sets[x] for x in left], [sets[x] for x in right])
            for x, common in zip(left, both):
                linked = right[(common > 0) & (share[1] * common >= share[0] * (size[x] + size[right] - common))]
                for other in np.unique(label[linked]):
                    if other != label[x]:
                        pairs.append((rep[x], rep[linked[label[linked] == other][0]]))
                        label[label == other] = label[x]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})
    return run


def at_once(over: DataFrame) -> bool:
    """Whether the members (rep, size) are of ``AT_ONCE`` blocks at most: all their pairs are then
    few cells, less work than a round of hubs and the search for components after it."""
    left = over.dropDuplicates(["rep"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return max(left["n"] / BLOCK, left["size"] / BLOCK_SHINGLES) <= AT_ONCE


def compare_all(over: DataFrame, reps: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): links between members (bucket, rep, size, hub, component) of different components
    whose buckets are the same or tied by common members: all pairs, in cells of two blocks."""
    cluster = labels(star_forest(turned(over.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))) \
        .withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    placed = cut_lineage(over.select("rep", "size", "component").dropDuplicates(["rep"]).join(cluster, "rep"), "clusters")
    blocks = placed.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES))
                                           .cast("int").alias("blocks"))
    cells = placed.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .join(reps.select("rep", "bins"), "rep").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "block", "size", "bins")
    likely = cut_lineage(cells.groupBy("cluster", "i", "j").applyInArrow(_cell_likely(share), CELL), "likely")
    return likely.join(texts.withColumnRenamed("doc_id", "rep"), "rep").groupBy("cluster", "i", "j") \
        .applyInArrow(_cell_links(width, share), "a long, b long")


def _slot(key: str):
    """(slot, bit) of an id in a bitmap of SLOTS rows of SLOT_BITS bits."""
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SLOTS * SLOT_BITS))
    return F.floor(place / SLOT_BITS).cast("int").alias("slot"), (place % SLOT_BITS).cast("int").alias("bit")


def id_bitmap(ids: DataFrame, key: str) -> DataFrame:
    """(slot, bits): a hashed bitmap of the ids, 4 MB whatever their number."""
    return cut_lineage(ids.select(*_slot(key)).repartition("slot").groupBy("slot")
                       .agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap")


def among(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the bitmap, and without moving
    any: the bitmap is broadcast.  Others may stay by chance (all of them when there are far
    more ids than bits), so an exact join must follow; no row in the bitmap is lost."""
    slot, bit = _slot(key)
    byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
    return rows.select("*", slot, bit).join(F.broadcast(bitmap), "slot") \
        .filter(F.getbit(byte, F.col("bit") % 8) == 1).select(rows.columns)


def confirm(pairs: DataFrame, docs: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least share[0] / share[1] in common.

    ``pairs`` is a table that was written before.  Pairs carry a salt from b, so the pairs of a
    hub are dealt to as many tasks as there are shuffle partitions.  Texts are asked for by
    doc_id: a hub's once per salt, a member's once per pair; a text moves to its requests and
    from there to its pair."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(n)))
    hubs = pairs.groupBy(F.col("a").alias("doc_id")).agg(F.collect_set("salt").alias("salts"))       # n at most
    left = docs.join(hubs, "doc_id").select(F.col("doc_id").alias("a"), F.explode("salts").alias("salt"), F.col("text").alias("text_a"))
    right = docs.join(pairs.withColumn("doc_id", F.col("b")), "doc_id").select("a", "salt", "b", F.col("text").alias("text_b"))
    return left.join(right, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, share), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100),
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    Texts are linked when share[1] * |A and B| >= share[0] * |A or B|.  component_id is the
    least doc_id reachable over links, kept whether that is the row's own doc_id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut_lineage(docs.mapInArrow(_sign(width, bands * rows), SIGNED), "signed")
    known = signed.filter("doc_id is not null and digest is not null")
    groups = cut_lineage(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"),
                                         F.min(F.struct("doc_id", "n_shingles", "bins")).alias("first")), "groups")
    reps = groups.select("rep", F.col("first.n_shingles").alias("size"), F.col("first.bins").alias("bins"))

    def alike(x: str, y: str):
        return (F.col(x) * share[1] >= F.col(y) * share[0]) & (F.col(y) * share[1] >= F.col(x) * share[0])

    def bucketed(rows: DataFrame) -> DataFrame:
        # rows (bucket, rep, size) of buckets of two members or more, with hub and n
        shared = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.min_by("size", "rep").alias("hub_size"),
                                            F.count(F.lit(1)).alias("n")).filter("n > 1")
        return cut_lineage(rows.join(shared, "bucket"), "members")

    def stars(rows: DataFrame) -> DataFrame:
        return rows.filter("rep > hub").filter(alike("size", "hub_size")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))

    def few(rows: DataFrame) -> DataFrame:
        small = rows.filter(F.col("n") <= FEW)
        x = small.select("bucket", F.col("rep").alias("a"), F.col("size").alias("size_a"), F.col("component").alias("comp_a"))
        y = small.select("bucket", F.col("rep").alias("b"), F.col("size").alias("size_b"), F.col("component").alias("comp_b"))
        return x.join(y, "bucket").filter("a < b and comp_a <> comp_b").filter(alike("size_a", "size_b")).select("a", "b")

    def torn(rows: DataFrame, found: DataFrame) -> DataFrame:
        # rows of buckets with members of different components, top: the next hub of a larger one, the member of
        # most ties that has not been its hub (hubs come in falling order of (ties, rep), last is the latest)
        placed = rows.join(found.withColumnRenamed("node", "rep"), "rep", "left") \
            .withColumn("component", F.coalesce("component", "rep"))
        new = (F.col("n") > FEW) & (F.col("rep") != F.col("hub")) & (F.col("last").isNull() | (F.struct("ties", "rep") < F.col("last")))
        apart = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"),
                                             F.max(F.when(new, F.struct("ties", "rep", "size", "component"))).alias("top"))
        return cut_lineage(placed.join(apart.filter("p < q").select("bucket", "top"), "bucket"), "torn")

    members = bucketed(reps.select("rep", "size", "bins").mapInArrow(_band(bands, rows), "rep long, size long, keys array<long>")
                       .select("rep", "size", F.posexplode("keys").alias("band", "key"))
                       .select(F.xxhash64("band", "key").alias("bucket"), "rep", "size"))
    asked = id_bitmap(members, "rep")        # every pair below is of members
    texts = cut_lineage(among(docs, "doc_id", asked), "texts")
    first = cut_lineage(stars(members).distinct(), "pairs")
    copies = known.join(groups.filter("n > 1").select("digest", "rep"), "digest").filter("doc_id <> rep") \
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    forest = star_forest(turned(confirm(first, texts, width, share).unionByName(copies)))

    def with_links(forest: DataFrame, more: DataFrame) -> DataFrame:
        return turned(forest.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(more))

    known_reps = among(reps, "rep", asked)
    a, b = (known_reps.select(F.col("rep").alias(c), F.col("size").alias(f"size_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab")

    def central(over: DataFrame) -> DataFrame:
        # the pairs of a larger bucket's next hub with members of other components
        return over.select("rep", "size", "component", F.col("top.rep").alias("top"), F.col("top.size").alias("top_size"),
                           F.col("top.component").alias("top_component")) \
            .filter("component <> top_component").filter(alike("size", "top_size")) \
            .select(F.least("top", "rep").alias("a"), F.greatest("top", "rep").alias("b"))

    def likely(pairs: DataFrame) -> DataFrame:
        return cut_lineage(pairs.distinct().join(first, ["a", "b"], "left_anti").join(a, "a").join(b, "b")
                           .select("a", "b", F.least("size_a", "size_b").alias("least"), "bins_a", "bins_b")
                           .mapInArrow(_likely(share), "a long, b long"), "pairs")

    ties = members.groupBy("rep").agg(F.sum("n").alias("ties"))
    left = torn(members.join(ties, "rep").withColumn("last", F.lit(None).cast("struct<ties: bigint, rep: bigint>")), labels(forest))
    small, more = few(left), []              # small: pairs that no round has taken along yet
    for _ in range(HUBS):
        over = left.filter(F.col("n") > FEW)
        if at_once(over):
            break
        rest = likely(central(over) if small is None else central(over).unionByName(small))
        small = None
        if rest.isEmpty():
            break
        grown = with_links(forest, confirm(rest, texts, width, share))
        if grown.count() == forest.count():          # no link was found
            break
        forest = star_forest(grown)
        latest = F.when(F.col("top").isNotNull(), F.struct("top.ties", "top.rep")).otherwise(F.col("last"))
        left = torn(over.withColumn("last", latest).drop("component", "top"), labels(forest))
    rest = None if small is None else likely(small)
    if rest is not None and not rest.isEmpty():
        more.append(confirm(rest, texts, width, share))
    over = left.filter(F.col("n") > FEW)
    if not over.isEmpty():
        more.append(compare_all(over, known_reps, texts, width, share))
    if more:
        forest = star_forest(with_links(forest, reduce(DataFrame.unionByName, more)))

    found = labels(forest)
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone`` (key).  Rows that a broadcast bitmap of ``gone`` (4 MB
    at any size) does not know stay where they are; the others are joined exactly."""
    slot, bit = _slot("key")
    byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
    known = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).cast("long").alias("key")).select("row", "key", slot, bit) \
        .join(F.broadcast(id_bitmap(gone, key)), "slot", "left").select("row", "key", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False)).alias("maybe"))
    sure = known.filter(~F.col("maybe"))
    rest = known.filter("maybe").join(gone.select(F.col(key).cast("long").alias("key")), "key", "left_anti").select("row", "key", "maybe")
    return sure.unionByName(rest).select("row.*")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least doc_id (rows
    without one come last; of equal ones any).  Rows are linked by their own texts only: rows
    that share a doc_id and differ in text stay, and rows without a doc_id are compared like all
    others.  Rows without words stay."""
    own = "row"
    while own in docs.columns:
        own += "_"
    rows = cut_lineage(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    ids = rows.select(F.col(own).alias("doc_id"), F.col("doc_id").alias("name"))
    groups = near_duplicates(rows.select(F.col(own).alias("doc_id"), "text"), **how).select("doc_id", "component_id")
    first = groups.join(ids, "doc_id").groupBy("component_id") \
        .agg(F.min(F.struct(F.col("name").isNull().alias("last"), "name", "doc_id")).alias("first"))
    gone = groups.join(first.select("first.doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias(own))
    return without(rows, own, cut_lineage(gone, "gone")).drop(own)
