"""Source divergence audit (operator 11): how far the sources of a language differ in words.

Rows of a language's matrix are its sources, columns its kept terms, cells the counts.  Each
source gives each kept term the exact price ``1 + (10**9 * (count + 5)) div (N + 5 * V)``; two
sources differ by the sum of absolute price differences over all V kept terms.

The matrix is mostly zero, and a source's zeros all have one price.  So it is held as k²-trees
(k = 2): the terms of a language are dealt by hash to strips of about ``STRIP`` columns, its
sources to blocks of ``SIDE`` rows, and a task gets one strip of one pair of blocks.  There the
columns are cut into squares of ``SIDE``; each square is a quadtree that stores four bits for
every node that is not all zero, a child is found by counting the ones before its bit.  The
trees of two blocks are walked together, pairs of nodes over the same columns at a time:

* both quadrants zero: each pair of their rows gets (columns) * |price of 0 - price of 0|;
* otherwise both are cut in four, down to single cells, which are priced one against one.

Columns of a strip without any cell in either block are priced in the same way afterwards, from
the number of columns walked.  A task holds at most 2 * ``SIDE`` rows of one strip, whatever
the size of the corpus, of a source or of a term.

NULL text, lang and source are ''.  A language without kept terms has V = 0: its pairs have
value 0 and it has no rows of part ``term``.  A language of one source has no pairs.  Empty
tables give no rows; very long texts are read in whole, one at a time; repeated rows count
again; columns other than text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.text import LOWER, chunks, utf8
from tessera.session import cut_lineage

SCALE, PRIOR = 1_000_000_000, 5
LEAST_DOCS, RANKS = 30, 50
LEVELS = 6
SIDE, STRIP = 1 << LEVELS, 512
PIECE = 2 << 20         # bytes of text whose terms are counted before they leave a task

#: bytes of terms (A-Z lower-cased, a-z, 0x80 and above) as they are, all others a blank
TERM = np.where((np.arange(256) >= 0x80) | ((LOWER >= 97) & (LOWER <= 122)), LOWER, 32).astype(np.uint8)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.fill_null("").dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each piece of (lang, source, text)."""
    for piece in chunks(batches, limit=PIECE):
        raw, offs = utf8(piece.column(2))
        kind = pa.int64() if offs[-1] >= 1 << 31 else pa.int32()
        texts = pa.Array.from_buffers(pa.large_string() if kind == pa.int64() else pa.string(), piece.num_rows,
                                      [None, pa.py_buffer(offs.astype(kind.to_pandas_dtype())), pa.py_buffer(TERM[raw])])
        words = pc.ascii_split_whitespace(texts)
        doc = pc.list_parent_indices(words).to_numpy().astype(np.int64)
        coded = pc.list_flatten(words).dictionary_encode()
        term, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
        if empty >= 0:
            doc, term = doc[term != empty], term[term != empty]
        if not len(term):
            continue
        lang, langs = _codes(piece.column(0))
        source, sources = _codes(piece.column(1))
        group = lang * len(sources) + source
        cells, n = np.unique(doc * len(vocabulary) + term, return_counts=True)
        cells = group[cells // len(vocabulary)] * len(vocabulary) + cells % len(vocabulary)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        at = cells[first] // len(vocabulary)
        yield pa.RecordBatch.from_arrays([
            langs.take(pa.array(at // len(sources))), sources.take(pa.array(at % len(sources))),
            vocabulary.take(pa.array(cells[first] % len(vocabulary))).cast(pa.string()),
            pa.array(np.add.reduceat(n[order], first)), pa.array(np.diff(np.append(first, len(cells))))],
            names=["lang", "source", "term", "n", "docs"])


class Tree:
    """k²-tree forest of one block over a strip: a root bit per square, then for every node
    that is not all zero the bits of its four children, level by level."""

    def __init__(self, row: np.ndarray, column: np.ndarray, price: np.ndarray, squares: int):
        spread = np.zeros(len(row), dtype=np.int64)
        for bit in range(LEVELS):
            spread |= ((row >> bit) & 1) << (2 * bit + 1) | ((column >> bit) & 1) << (2 * bit)
        code = (column >> LEVELS) << (2 * LEVELS) | spread
        order = np.argsort(code)
        self.price = price[order]
        nodes = [np.unique(code >> (2 * (LEVELS - level))) for level in range(LEVELS + 1)]
        roots = np.zeros(squares, dtype=bool)
        roots[nodes[0]] = True
        self.bits, self.ranks = [roots], [np.cumsum(roots) - 1]
        for above, below in zip(nodes, nodes[1:]):
            bits = np.zeros(4 * len(above), dtype=bool)
            bits[4 * np.searchsorted(above, below >> 2) + (below & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)

    def roots(self, square: np.ndarray) -> np.ndarray:
        return np.where(self.bits[0][square], self.ranks[0][square], -1)

    def children(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Number of each node's child on the next level, -1 where it is all zero."""
        if not len(self.bits[level + 1]):
            return np.full(len(node), -1)
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level + 1][at], self.ranks[level + 1][at], -1)


def walk(a: Tree, b: Tree, zero_a: np.ndarray, zero_b: np.ndarray, columns: int, same: bool) -> np.ndarray:
    """Sum over ``columns`` of |price in a - price in b| for each row of a and row of b; with
    ``same`` (a block against itself) only rows of a before rows of b are walked.  ``zero_a``
    and ``zero_b`` are the rows' prices of a zero."""
    out = np.zeros((SIDE, SIDE), dtype=np.int64)
    rows_a, rows_b = len(zero_a), len(zero_b)
    zero_a, zero_b = (np.pad(z, (0, SIDE - len(z))) for z in (zero_a, zero_b))
    squares = len(a.bits[0])
    for begin in range(0, squares, 4):
        square = np.arange(begin, min(begin + 4, squares))
        p, q = a.roots(square), b.roots(square)
        x = y = np.zeros(len(square), dtype=np.int64)
        col = square.astype(np.int64)
        for level in range(LEVELS + 1):
            width = SIDE >> level
            blank = (p < 0) & (q < 0)
            if blank.any():
                # all-zero quadrants: a count of columns per pair of row ranges
                real = np.clip(columns - col[blank] * width, 0, width)
                zeros = np.zeros((1 << level, 1 << level), dtype=np.int64)
                np.add.at(zeros, (x[blank], y[blank]), real)
                out += np.kron(zeros, np.ones((width, width), dtype=np.int64)) * np.abs(zero_a[:, None] - zero_b[None, :])
                p, q, x, y, col = (v[~blank] for v in (p, q, x, y, col))
            if level == LEVELS:
                break
            right, low_a, low_b = (np.tile(v, len(p)) for v in (np.repeat([0, 1], 4), np.tile(np.repeat([0, 1], 2), 2), np.tile([0, 1], 4)))
            p, q, x, y, col = (np.repeat(v, 8) for v in (p, q, x, y, col))
            x, y, col = 2 * x + low_a, 2 * y + low_b, 2 * col + right
            p, q = a.children(level, p, 2 * low_a + right), b.children(level, q, 2 * low_b + right)
            height = SIDE >> (level + 1)
            there = (x * height < rows_a) & (y * height < rows_b)
            if same:
                there &= x <= y
            p, q, x, y, col = (v[there] for v in (p, q, x, y, col))
        price_a = np.where(p >= 0, a.price[p] if len(a.price) else 0, zero_a[x])
        price_b = np.where(q >= 0, b.price[q] if len(b.price) else 0, zero_b[y])
        np.add.at(out, (x, y), np.abs(price_a - price_b))
    return out


TILE = "lang string, i int, j int, x int, y int, columns int, value long"


def _tile(cell: pa.Table) -> pa.Table:
    """The pairs of rows of two blocks over one strip.  Rows with a NULL term head a block:
    one per matrix row with the price of a zero."""
    i, j, lang = cell.column("i")[0].as_py(), cell.column("j")[0].as_py(), cell.column("lang")[0].as_py()
    cell = cell.combine_chunks()
    block, row = cell.column("block").to_numpy(), cell.column("row").to_numpy().astype(np.int64)
    price, head = cell.column("price").to_numpy(), cell.column("term").is_null().to_numpy()
    coded = pc.dictionary_encode(cell.column("term").combine_chunks())
    term = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    columns = len(coded.dictionary)
    # frequent terms first: zeros then lie together
    place = np.empty(columns, dtype=np.int64)
    place[np.argsort(-np.bincount(term[~head], minlength=columns), kind="stable")] = np.arange(columns)
    trees, zeros = [], []
    for b in (i, j):
        own, heads = (block == b) & ~head, (block == b) & head
        zero = np.zeros(int(heads.sum()), dtype=np.int64)
        zero[row[heads]] = price[heads]
        zeros.append(zero)
        trees.append(Tree(row[own], place[term[own]], price[own], -(-columns // SIDE)))
    sums = walk(trees[0], trees[1], zeros[0], zeros[1], columns, i == j)
    x, y = np.divmod(np.arange(SIDE * SIDE), SIDE)
    real = (x < len(zeros[0])) & (y < len(zeros[1])) & ((x < y) if i == j else True)
    n = int(real.sum())
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()),
                     "x": pa.array(x[real], pa.int32()), "y": pa.array(y[real], pa.int32()),
                     "columns": pa.array([columns] * n, pa.int32()), "value": sums.reshape(-1)[real]})


def _price(count, total, terms) -> Column:
    """Exact at any size: decimals of 38 digits."""
    wide = "decimal(20,0)"
    part = F.lit(SCALE).cast("decimal(10,0)") * (count.cast(wide) + F.lit(PRIOR))
    whole = total.cast(wide) + F.lit(PRIOR) * terms.cast(wide)
    return F.call_function("div", part, whole) + F.lit(1).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): places of each term and documents that have it."""
    texts = docs.select("lang", "source", "text")
    found = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, x, y, value) for rows x < y of each language.  ``cells``: (lang, row, term,
    price); ``groups``: (lang, source, row, terms, zero)."""
    strips = F.greatest(F.lit(1), F.ceil(F.col("terms") / STRIP)).cast("int")
    shape = groups.groupBy("lang").agg(F.first(strips).alias("strips"), F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"),
                                       F.first("terms").alias("terms"))
    heads = groups.filter("terms > 0").join(shape.select("lang", "strips", "blocks"), "lang") \
        .select("lang", "row", F.lit(None).cast("string").alias("term"), F.col("zero").alias("price"), "blocks",
                F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"))
    full = cells.join(shape.select("lang", "strips", "blocks"), "lang") \
        .select("lang", "row", "term", "price", "blocks", F.pmod(F.xxhash64("term"), F.col("strips")).cast("int").alias("strip"))
    dealt = full.unionByName(heads).withColumn("block", F.floor(F.col("row") / SIDE).cast("int")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("lang", "strip", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", (F.col("row") % SIDE).cast("int").alias("row"), "term", "price")
    tiles = dealt.groupBy("lang", "strip", "i", "j").applyInArrow(_tile, TILE)
    walked = tiles.groupBy("lang", (F.col("i") * SIDE + F.col("x")).alias("x"), (F.col("j") * SIDE + F.col("y")).alias("y")) \
        .agg(F.sum("columns").alias("columns"), F.sum("value").alias("value"))
    left = groups.select("lang", F.col("row").alias("x"), "terms", F.col("zero").alias("zero_x"))
    right = groups.select("lang", F.col("row").alias("y"), F.col("zero").alias("zero_y"))
    # strips and columns that neither row's block has a cell in
    rest = (F.col("terms") - F.coalesce("columns", F.lit(0))) * F.abs(F.col("zero_x") - F.col("zero_y"))
    return left.join(right, "lang").filter("x < y").join(walked, ["lang", "x", "y"], "left") \
        .select("lang", "x", "y", (F.coalesce("value", F.lit(0)) + F.coalesce(rest, F.lit(0))).cast("long").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the
    language by their distance, part ``term`` the terms a source prices above its language."""
    text = Window.partitionBy("lang", "term")
    counted = counts(docs).select("lang", "source", "term", "n", F.sum("n").over(text).alias("lang_n"),
                                  F.sum("docs").over(text).alias("lang_docs"), F.row_number().over(text.orderBy("source")).alias("nth"))
    kept = cut_lineage(counted.filter(F.col("lang_docs") >= least_docs).drop("lang_docs"), "kept_terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("nth") == 1).alias("terms"), F.sum("n").alias("lang_total"))
    present = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = present.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
                F.coalesce("lang_total", zero).alias("lang_total"),
                (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("row"))
    groups = cut_lineage(groups.withColumn("zero", F.when(F.col("terms") > 0, _price(zero, F.col("total"), F.col("terms")))), "groups")
    cells = kept.join(groups, ["lang", "source"]) \
        .withColumn("price", _price(F.col("n"), F.col("total"), F.col("terms")))

    above = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                         (F.col("price") - _price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).alias("value")).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)

    found = cut_lineage(pair_values(cells.select("lang", "row", "term", "price"), groups.select("lang", "row", "terms", "zero")), "pairs")
    both = found.unionByName(found.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
    names = groups.select("lang", F.col("row").alias("x"), "source")
    pairs = both.join(names, ["lang", "x"]).join(names.toDF("lang", "y", "item"), ["lang", "y"]) \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(above)
