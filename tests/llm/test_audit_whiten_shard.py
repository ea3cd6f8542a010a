"""Operators 11 to 13 against brute force, and their defined results on odd rows and tables."""

import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, term string, n int, price string, row string, digest string"
ODD = [None, "", " \n", "one", "one", "one", "x" * 30000, "ab " * 9000, "É é 漢字 a1b2", "A\x00b [c] {d} @e"]


def rows_of(pairs):
    return [(i, t, lang, source, "t", 1, "p", "r", "d") for i, (t, lang, source) in enumerate(pairs)]


def brute_divergence(rows, least, ranks):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
             for t, lang, source in rows]
    out = set()
    for lang in {g[0] for g in terms}:
        own = [g for g in terms if g[0] == lang]
        docs = collections.Counter(w for _, _, t in own for w in set(t))
        kept = {w for w, n in docs.items() if n >= least}
        counts = {s: collections.Counter(w for _, x, t in own if x == s for w in t if w in kept) for s in {g[1] for g in own}}
        every = sum(counts.values(), collections.Counter())

        def price(c, w):
            return 1 + 10 ** 9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            parts = {"pair": [(-sum(abs(price(c, w) - price(o, w)) for w in kept), t.encode()) for t, o in counts.items() if t != s],
                     "term": [(price(every, w) - price(c, w), w.encode()) for w in c if price(c, w) > price(every, w)]}
            for part, items in parts.items():
                for rank, (value, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= ranks:
                        out.add((lang, s, part, item.decode(), -value, rank))
    return out


def test_op11_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["É", "漢字"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    pairs = [(" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 40, 200]))).title() if i % 3 else
              " ".join(rng.choices(vocabulary, k=30)), rng.choice(["en", "fr", None, ""]), f"s{rng.randrange(i % 90 + 1)}" if i % 7 else None)
             for i in range(900)]
    pairs += [(t, "odd", "a") for t in ODD] + [(t, "odd", "b") for t in ODD] + [("word word", "alone", "x")] * 3
    docs = spark.createDataFrame(rows_of(pairs), DOC).repartition(5)
    for least, ranks in ((3, 50), (30, 2)):
        got = {tuple(r) for r in divergence.divergence(docs, least, ranks).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == brute_divergence(pairs, least, ranks)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_op11_tree_walk():
    """Joint walk of two trees against plain arrays, with more blocks' rows than cells."""
    rng = np.random.default_rng(3)
    for columns, share in ((1, 0.5), (64, 0.0), (200, 0.02), (130, 0.6)):
        tables, trees, zeros = [], [], []
        for rows in (64, 37):
            cells = rng.random((rows, columns)) < share
            zero = rng.integers(1, 100, rows)
            price = rng.integers(1, 10 ** 9, (rows, columns))
            r, c = np.nonzero(cells)
            trees.append(divergence.Tree(r, c, price[cells], -(-columns // divergence.SIDE)))
            tables.append(np.where(cells, price, zero[:, None]))
            zeros.append(zero)
        want = np.abs(tables[0][:, None, :] - tables[1][None, :, :]).sum(axis=2)
        got = divergence.walk(trees[0], trees[1], zeros[0], zeros[1], columns, False)
        assert (got[:64, :37] == want).all()
        alone = np.abs(tables[0][:, None, :] - tables[0][None, :, :]).sum(axis=2)
        got = divergence.walk(trees[0], trees[0], zeros[0], zeros[0], columns, True)
        assert (np.triu(got, 1) == np.triu(alone, 1)).all()


def test_op11_exact_prices(spark):
    """Counts beyond 2 ** 53 keep all digits."""
    n, total, v = 123456789012345678, 999999999999999989, 7919
    row = spark.range(1).select(divergence._price(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (n + 5) // (total + 5 * v)


def test_op11_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLES["op11_source_divergence"]).fetchall()
    got = queries.op11_source_divergence(spark, SF).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def expected_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100000
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return x, c @ axes / np.sqrt(values), values / np.trace(c.T @ c / len(x))


def compare_whitening(got, vectors, k):
    x, want, explained = expected_whitening(vectors, k)
    n = len(x)
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    table = np.full((n, k), np.nan)
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    assert len(got) == n * k
    sign = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * sign).max() < 1e-7


def test_op12_brute_force(spark):
    rng = np.random.default_rng(12)
    for n, d, k in ((400, 40, 8), (150, 5, 5), (300, 24, 8)):
        v = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 3 + rng.normal(size=d)
        rows = spark.createDataFrame([(i, [float(e) for e in r], 0, "x") for i, r in enumerate(v)],
                                     "vec_id long, embedding array<double>, n int, x string").repartition(6)
        compare_whitening(whitening.whitened(rows).collect(), v, k)


def test_op12_planted_direction():
    """A direction that the random start has no part of is found by the fresh columns, and hard
    spectra (steps, repeated values, a rank below the block) come out as by a dense solver."""
    rng = np.random.default_rng(2)
    d = 60
    for values in (np.r_[100.0, np.linspace(1, 0.9, d - 1)], np.r_[[5.0] * 4, [3.0] * 8, [1.0] * (d - 12)],
                   np.r_[np.logspace(6, 0, 12), np.zeros(d - 12)], 1 + 0.01 * rng.random(d)):
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
        v = (axes * values) @ axes.T
        found = whitening.leading(lambda q: v @ q, d)
        want = np.sort(values)[::-1][:8]
        assert np.abs(found.values - want).max() <= 1e-11 * want[0]
        assert np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0).max() <= 1e-9 * want[0]
        assert np.abs(found.vectors.T @ found.vectors - np.eye(8)).max() < 1e-12


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [2.0, -1.0, 0.25], [0.0, 0.5, 3.0], [1.0, 2.0, 0.5], [-4.0, 1.0, 1.0]]
    bad = [None, [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [1.0, 2.0], [], [1e300, 1.0, 1.0]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)],
                                  "vec_id long, embedding array<double>")
    compare_whitening(whitening.whitened(table).collect(), good, 3)
    for nothing in (table.limit(0), table.filter("vec_id >= 100"), table.filter("vec_id in (0, 3)"), table.filter("vec_id = 1")):
        out = whitening.whitened(nothing)
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0 or nothing.filter("vec_id >= 100").count() > 0
    big = spark.createDataFrame([(None, [3e9, 1.0]), (2, [-3e9, 2.0]), (2, [-3e9, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(big).collect()
    assert {r.deviation for r in got} == {None} and sorted(r.vec_id or 0 for r in got if r.component == 1) == [0, 2, 2]


def check_shards(rows, out, n):
    load = collections.Counter(r.shard for r in out)
    counts = [load.get(s, 0) for s in range(n)]
    assert len(out) == len(rows) and max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in range(n))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} <= {("rows", None)}


def test_op13_groups_stay_whole(spark):
    """Groups of copies that fit a shard stay in one; one that holds a third of all rows lies in
    as few shards as its size needs, and one more."""
    rng = random.Random(13)
    texts = ["hot"] * 600 + [f"group {g}" for g in range(120) for _ in range(rng.choice([2, 3, 5, 9]))]
    texts += [f"single {i}" for i in range(1800 - len(texts))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, digest string, shard int, row int").repartition(7)
    out = sharding.shards(docs).collect()
    check_shards(rows, out, 16)
    in_shards = collections.defaultdict(set)
    for r in out:
        in_shards[r.text_crc32].add(r.shard)
    copies = collections.Counter(zlib.crc32(t.encode()) for t in texts)
    hot = zlib.crc32(b"hot")
    assert len(in_shards[hot]) <= -(-600 // (1800 // 16)) + 1
    torn = [c for c, s in in_shards.items() if c != hot and len(s) > 1]
    assert len(torn) <= 3
    # far fewer cut links than by chance
    assert sum(len(s) - 1 for s in in_shards.values()) < 0.05 * sum(n - 1 for n in copies.values())


def test_op13_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a"), (2, "a"), (2, "b"), (None, "é"), (None, None), (7, "x" * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(rows, sharding.shards(docs).collect(), 16)
    check_shards(rows, sharding.shards(docs, n=3).collect(), 3)
    same = [(5, "same")] * 50
    check_shards(same, sharding.shards(spark.createDataFrame(same, "doc_id long, text string"), n=4).collect(), 4)
    assert sharding.shards(docs.limit(0)).count() == 0


def test_op13_native(spark):
    plan = sharding.shards(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    source = open(sharding.__file__).read()
    assert "Python" not in plan and "Arrow" not in plan and "udf" not in source.lower() and ".rdd" not in source


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_whitening", "op13_sharding"])
def test_registered(name):
    assert name in queries.QUERIES
