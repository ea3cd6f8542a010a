"""Findings of round 3: what a reused worker keeps, what a round of the component search costs."""

from __future__ import annotations

import random
import subprocess
import sys

import pytest

from tessera.llm import bpe, decontaminate, graph, minhash, queries

HOLD = '''
import re
import numpy as np, pyarrow as pa
from tessera.llm.text import chunks

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", f.read()))) / 1024

before = held()
for piece in chunks([pa.RecordBatch.from_arrays([pa.array(["some words"] * 100)], names=["text"])]):
    rows = [np.ones(1000, np.uint8) for _ in range(100_000)]     # small ones, freed below a last one that stays
    last = np.ones(1000, np.uint8)
    most = held()
    del rows
print(before, most, held())
'''


def test_freed_memory_leaves_the_worker():
    before, most, after = map(float, subprocess.run([sys.executable, "-c", HOLD], capture_output=True, text=True, check=True).stdout.split())
    assert most > before + 80 and after < before + 30


def test_op6_cached_ids_are_packed():
    """A word's ids are one bytes object, which a piece of that one word shares."""
    own = bpe.Codec(queries.vocabulary("word_bpe_49k.json"))
    own.encode("unbelievable tokenization")
    assert own.words and all(type(ids) is bytes for ids in own.words.values())
    assert own.pieces["tokenization"] is own.words["tokenization"]


def test_op2_one_python_step_a_stage(spark):
    """The last steps of op2 are one Python step over written tables."""
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "some more " + text), (2, "another text")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(7, text)], "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.distance) for r in found.collect()] == [(1, 7, 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def brute(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {x: top(x) for x in root}


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(3, 2), (2, 1)], [(1, 2), (2, 1), (1, 2)], [(5, 1), (5, 2), (5, 3), (5, 4), (4, 9)],
    [(i, i + 1) for i in range(40)], [(a, b) for r in [random.Random(7)] for a, b in [(r.randrange(300), r.randrange(300)) for _ in range(260)]]])
def test_components(spark, edges):
    """Chains, stars around a larger node, repeated and turned edges: one row per node."""
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == brute(edges)


def test_components_writes(spark, monkeypatch):
    """A finished star forest is seen in the first look: its edges and nodes are written, no more;
    one link between two stars takes one round of both."""
    written = []
    real = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, name: written.append(name) or real(df, name))
    stars = [(0, i) for i in range(1, 30)] + [(100, i) for i in range(101, 130)]
    assert graph.components(spark.createDataFrame(stars, "a long, b long")).count() == 60
    assert written == ["edges", "nodes"]
    written.clear()
    assert {r.component for r in graph.components(spark.createDataFrame(stars + [(0, 100)], "a long, b long")).collect()} == {0}
    assert len(written) <= 4


def test_components_repeated_edges(spark):
    """Many nodes with the same two neighbours make one edge of the two, not one each."""
    edges = [(a, b) for b in range(100, 180) for a in (1, 50)]
    forest = graph.star_forest(graph.turned(spark.createDataFrame(edges, "a long, b long")))
    assert sorted(map(tuple, forest.collect())) == [(u, 1) for u in [50, *range(100, 180)]]


@pytest.mark.parametrize("blocks, looks", [(8, 1), (0, 2)])
def test_op1_few_members_left(spark, monkeypatch, blocks, looks):
    """Texts alike to the last one and not to each other: members of few blocks are compared in one
    go, more of them after rounds of hubs, each with a new look at the buckets; the classes are the same."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(150):
        t = list(base)
        for p in rng.sample(range(0, 400, 4), 8):
            t[p] = f"u{i}_{p}"
        rows.append((i, " ".join(t)))
    rows.append((150, " ".join(base)))
    written = []
    real = minhash.cut_lineage
    monkeypatch.setattr(minhash, "AT_ONCE", blocks)
    monkeypatch.setattr(minhash, "cut_lineage", lambda df, name: written.append(name) or real(df, name))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()
    assert len(got) == 151 and {r.component_id for r in got} == {0}
    assert "hubs" not in written and written.count("torn") == looks
