"""Sharding (operator 13): balanced label propagation, DataFrame functions only.

Documents with equal texts are linked.  Law ``rows``: the shards' numbers of documents are at
most one apart; under it, links between shards are to be few.

1. each row of the table gets a row number, and its text's size and digests; only these move
   from here on.  Linked rows (those that share a digest) begin in a shard by the hash of their
   row number.  Texts with more copies than a shard has places (fewer texts than shards) take no
   part in the rounds: their rows are numbered and fill one shard after the other, the rest of
   the linked rows begins in the places that are left;
2. rounds of label propagation.  A linked row's neighbours in a shard are the rows of its digest
   there, counted by (digest, shard) with partial sums: a text that fills a third of the table is
   one row per shard here.  Every row wants to go to the shard with most of its neighbours among
   those that have room, if it has more neighbours there than at home (ties by a hash, the
   same for all rows of a digest, so no two of them swap places);
3. capacity quotas: a shard admits as many newcomers as it has room for linked rows (its share
   of the whole table: single rows can go anywhere and wait).  Where more want to come,
   classes of small texts' groups go first; in the class that fits in part, groups are admitted by
   a hash threshold, groups that are large against the room row by row.  The admitted
   moves are joined to the rows and the table is written; the rounds end when no row
   wants to move, after ``ROUNDS`` at the latest;
4. levelling: rows of each shard are numbered (those that fill shards, whole groups, torn ones); those
   beyond the shard's share, and all single rows, are numbered once more and dealt to the
   places that are left.  The numbers are the slots.

Numbers are counted in hash buckets of rows with offsets, so no task orders a shard.  Only tables
of shards x 64 classes and of shards x buckets reach one task or the driver.

NULL and empty texts are equal texts of size 1 and checksum 0.  Repeated rows and rows with a
NULL doc_id are rows like any others.  With fewer rows than shards some shards stay empty; an
empty table gives no rows.  Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

SHARDS, ROUNDS = 16, 12
BUCKETS = 4096


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _pick(values: list[int], at: Column) -> Column:
    """The value of a short list for each row."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)


def _share(*names) -> Column:
    """A number in [0, 1) by the hash of the columns."""
    return F.pmod(F.xxhash64(*names), F.lit(1 << 30)) / F.lit(float(1 << 30))


def described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, size, text_crc32, digest) of every row; the texts stay where they are."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.unhex(F.md5(text)).alias("digest"))


def wishes(at: DataFrame, room: list[int]) -> DataFrame:
    """(digest, shard, target, n, copies): where the rows of each text in each shard want to go.
    ``at``: (digest, shard, n); ``room``: linked rows that each shard can still take."""
    mine = F.struct(F.col("n"), F.xxhash64("digest", "shard").alias("tie"), F.col("shard"))
    open_ = F.filter("places", lambda p: F.element_at(F.array(*[F.lit(r > 0) for r in room]), p["shard"] + 1))
    return at.groupBy("digest").agg(F.sum("n").alias("copies"), F.collect_list(mine).alias("places")) \
        .withColumn("best", F.array_max(open_)).filter("best is not null") \
        .select("digest", "copies", "best", F.explode("places").alias("p")) \
        .filter(F.col("p") < F.col("best")) \
        .select("digest", F.col("p.shard").alias("shard"), F.col("best.shard").alias("target"), F.col("p.n").alias("n"), "copies")


def admitted(wanted: DataFrame, room: list[int]) -> DataFrame:
    """(digest, shard, target, share, whole) of the moves that the quotas let in: ``share`` of
    the rows, or of the texts where ``whole``."""
    size = F.floor(F.log2(F.col("copies"))).cast("int").alias("class")
    wanted = wanted.select("*", size)
    asked = {(r["target"], r["class"]): r["n"] for r in wanted.groupBy("target", "class").agg(F.sum("n").alias("n")).collect()}
    left, shares = list(room), {}
    for target, kind in sorted(asked):
        n = asked[target, kind]
        take = max(0, min(n, left[target]))
        shares[target, kind] = (take / n, (2 << kind) * 16 <= max(take, 1))
        left[target] -= take
    if not shares:
        return wanted.select("digest", "shard", "target", F.lit(1.0).alias("share"), F.lit(True).alias("whole")).limit(0)
    key = F.col("target") * 64 + F.col("class")
    table = F.create_map(*[x for (t, c), (share, _) in shares.items() for x in (F.lit(t * 64 + c), F.lit(float(share)))])
    whole = F.create_map(*[x for (t, c), (_, w) in shares.items() for x in (F.lit(t * 64 + c), F.lit(bool(w)))])
    return wanted.select("digest", "shard", "target", F.element_at(table, key).alias("share"), F.element_at(whole, key).alias("whole")) \
        .filter("share > 0").filter(~F.col("whole") | (_share("digest", "target") < F.col("share")))


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(row, digest, shard) after label propagation."""
    shards = len(quota)
    for _ in range(rounds):
        at = cut_lineage(linked.groupBy("digest", "shard").agg(F.count(F.lit(1)).alias("n")), "places")
        load = {r["shard"]: r["n"] for r in at.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [quota[s] - load.get(s, 0) for s in range(shards)]
        moves = cut_lineage(admitted(wishes(at, room), room), "moves")
        if moves.isEmpty():
            break
        goes = F.col("target").isNotNull() & (F.col("whole") | (_share("row", "target") < F.col("share")))
        linked = cut_lineage(linked.join(moves, ["digest", "shard"], "left")
                             .select("row", "digest", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard")), "linked")
    return linked


def numbered(rows: DataFrame, group: str, first: Column, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 within each ``group`` (0 to a few hundred): by
    ``first`` (a small integer), then by hash bucket and row number."""
    placed = rows.withColumn("bucket", first * buckets + F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n")) \
        .select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("row")) - 1
    return placed.withColumn("inside", inside).join(offsets, [group, "bucket"]) \
        .withColumn("number", (F.col("offset") + F.col("inside")).cast("long")).drop("bucket", "inside", "offset")


def filled(rows: DataFrame, copies: DataFrame, quota: list[int]) -> tuple[DataFrame | None, list[int]]:
    """(row, digest, shard) of the texts that no shard can hold, and the rows of them in each
    shard.  There are fewer such texts than shards."""
    large = copies.filter(F.col("copies") > max(quota)).orderBy(F.desc("copies"), "digest").collect()
    if not large:
        return None, [0] * len(quota)
    before = [sum(r["copies"] for r in large[:i]) for i in range(len(large) + 1)]
    ends = [sum(quota[:s + 1]) for s in range(len(quota))]
    which = F.array_position(F.array(*[F.lit(bytes(r["digest"])) for r in large]), F.col("digest")).cast("int") - 1
    number = numbered(rows.filter(F.col("copies") > max(quota)).select("row", "digest", which.alias("text")), "text", F.lit(0))
    place = F.col("number") + _pick(before[:-1], F.col("text"))
    shard = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)).alias("shard")
    return cut_lineage(number.select("row", "digest", shard), "filled"), [max(0, min(q, before[-1] - (e - q))) for q, e in zip(quota, ends)]


def shards(docs: DataFrame, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``."""
    rows = cut_lineage(described(docs), "rows")
    quota = quotas(rows.count(), n)
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = cut_lineage(rows.join(copies, "digest", "left"), "counted")

    fixed, taken = filled(rows, copies, quota)
    free = [q - t for q, t in zip(quota, taken)]
    begin = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    if fixed is not None:
        ends = [sum(free[:s + 1]) for s in range(n)]
        place = F.pmod(F.xxhash64("row"), F.lit(max(ends[-1], 1)))
        begin = F.least(F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)), F.lit(n - 1))
    linked = rows.filter(F.col("copies").isNotNull() & (F.lit(fixed is None) | (F.col("copies") <= max(quota)))) \
        .select("row", "digest", begin.alias("shard"))
    linked = propagate(linked, free, rounds)
    torn = linked.groupBy("digest", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("digest") \
        .agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    linked = linked.join(torn, "digest", "left").select("row", "shard", F.when(F.col("parts").isNull(), 1).otherwise(2).alias("first"))
    if fixed is not None:
        linked = linked.unionByName(fixed.select("row", "shard", F.lit(0).alias("first")))
    linked = cut_lineage(numbered(linked, "shard", F.col("first")).select("row", "shard", "number"), "numbered")
    stays = F.col("number") < _pick(quota, F.col("shard"))
    kept = {r["shard"]: r["n"] for r in linked.filter(stays).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends, total = [], 0                      # of the places that are left
    for s in range(n):
        total += quota[s] - kept.get(s, 0)
        ends.append(total)

    free = rows.filter("copies is null").select("row").unionByName(linked.filter(~stays).select("row"))
    free = numbered(free.withColumn("all", F.lit(0)), "all", F.lit(0))
    to = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("number")))
    dealt = free.select("row", to.alias("shard"), "number").withColumn(
        "number", F.col("number") - _pick([e - (quota[s] - kept.get(s, 0)) - kept.get(s, 0) for s, e in enumerate(ends)], F.col("shard")))
    placed = linked.filter(stays).unionByName(dealt).withColumnRenamed("number", "slot")
    return rows.join(placed, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                                           F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
