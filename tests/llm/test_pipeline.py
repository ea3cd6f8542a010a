"""The corpus pipeline, stage by stage, on small input and on odd rows."""

import random

import corpus_pipeline as P
from tessera.llm import queries

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "bpe"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == names, name
        rest = {r.doc_id for r in after.select("doc_id").collect()}
        assert rest and rest <= {r.doc_id for r in before.select("doc_id").collect()}
        before = P.cut_lineage(after, name)
    out = P.STAGES[-1][1](spark, before, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == before.count()


def test_rows_and_planted(spark):
    """Copies, a benchmark passage and odd rows: the copies go down to one, the passage goes."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(1)
    text = " ".join(rng.choices(["the", "of", "and", *map(str, range(200))], k=120))
    rows = [(1, text), (2, text + " end"), (3, text), (4, "Before it. " + item + " After it."), (5, None), (6, ""), (None, "without id"), (7, "alone here now")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = P.decontamination_stage(spark, P.near_dedup_stage(spark, docs, SF), SF)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left.collect()) == [(False, 0), (True, 1), (True, 5), (True, 6), (True, 7)]
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert {*queries.QUERIES, "pipeline"} <= set(names) and set(E.oracle_sql()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_near_dedup_keeps_different_texts(spark):
    """Repeated and missing doc_ids: only rows whose texts are near copies go."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    a, b, c = (" ".join(rng.choices(vocab, k=80)) for _ in range(3))
    rows = [(1, a), (1, b), (None, c), (None, c), (None, c + " end"), (7, b + " end"), (7, "x y"), (7, "x y"), (8, None), (8, None), (9, ""), (None, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "r") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(4)
    kept = P.near_dedup_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert sum(t in (c, c + " end") for _, t in got) == 1
    assert sorted((x for x in got if x[1] not in (c, c + " end")), key=str) == \
        sorted([(1, a), (1, b), (7, "x y"), (8, None), (8, None), (9, ""), (None, " \n ")], key=str)
