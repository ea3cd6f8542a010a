"""The ten operators against brute force, libraries, round trips and held-out accuracy, and
the defined results for NULL, empty, long, tied and repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, chat, decontaminate, fingerprint, license, minhash, quality, queries, tokenfile, toxicity, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, digest string, size int, component string, key string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id at all here"), (5, "é" * 3), (6, "word " * 20000),
       (7, "x" * 50000), (8, "<|endoftext|> \x1c tab\tand  two\r\n\r\nlines "), (9, "Ünïcode ΑΣ İ 漢字 ٣ ½ 👍🏽 é")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts in a table whose other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "d", 1, "c", "k") for i, t in ODD], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words3(text, width=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, width, num, den):
    nodes = {}
    for i, t in rows:
        nodes.setdefault(i, []).append(words3(t, width))
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if any(s and t and den * len(s & t) >= num * len(s | t) for s in nodes[a] for t in nodes[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in nodes}


def test_op1_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = rng.choices(vocab, k=rng.choice([4, 30, 80]))
        for _ in range(30):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ODD[:5])] + [(5, rows[40][1]), (1002, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, num, den in ((3, 85, 100), (5, 80, 100)):
        got = minhash.near_duplicates(df, width, (num, den)).collect()
        want = brute_components(rows, width, num, den)
        assert {(r.doc_id, r.component_id) for r in got} == set(want.items())
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(words3(t, width))) for i, t in rows)


def test_op1_large_torn_group(spark):
    """Many texts of one pattern, alike below the threshold, with linked pairs among them:
    buckets are large, the further keys find the pairs."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        t = list(base)
        for p in rng.sample(range(200), 14):
            t[p] = f"u{i}_{p}"
        rows.append((2 * i, " ".join(t)))
        t[rng.randrange(200)] = "changed"
        rows.append((2 * i + 1, " ".join(t)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()}
    assert got == brute_components(rows, 3, 85, 100)


@pytest.mark.parametrize("place", [500, 1000])
def test_op1_many_copies_of_a_later_text(spark, place):
    """1000 copies alike to one text (0.89) and not to each other (0.79); that text's doc_id is
    in the middle or the last."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(1000):
        t = list(base)
        for p in rng.sample(range(0, 400, 4), 8):
            t[p] = f"u{i}_{p}"
        rows.append((i if i < place else i + 1, " ".join(t)))
    rows.append((place, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in minhash.near_duplicates(df, 3, (85, 100)).collect()} == {0}


def test_op1_many_pairs_without_a_middle(spark, monkeypatch):
    """Pairs in a group alike below the threshold, whose members no hub links: found in cells,
    also with the group dealt to several blocks."""
    rng = random.Random(10)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        t = list(base)
        for p in rng.sample(range(0, 200, 4), 6):
            t[p] = f"u{i}_{p}"
        rows.append((i, " ".join(t)))
        for p in rng.sample(range(2, 200, 4), 4):
            t[p] = f"v{i}_{p}"
        rows.append((1000 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows, 3, 88, 100)
    assert 100 < len(set(want.values())) < 300
    for block in (1024, 50):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, (88, 100)).collect()} == want


def test_op1_odd(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and minhash.near_duplicates(none).count() == 0
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3)) == [(0, i, True) for i in (1, 2, 3)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1


def test_op2_edits(spark, none):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(8, 60)))) for i in range(60)] + [(90, None), (91, "too short"), (None, "a b c d e f g h")]
    rows, truth = [], set()
    for i, t in items[:60]:
        for share in (0, 0.1):
            w = t.split()
            for _ in range(int(share * len(w))):
                w[rng.randrange(len(w))] = "edited"
            truth.add((len(rows), i))
            rows.append((len(rows), " ".join(rng.choices(vocab, k=50)) + ". " + " ".join(w).upper() + "! " + " ".join(rng.choices(vocab, k=50))))
    rows += [(500 + k, " ".join(rng.choices(vocab, k=200))) for k in range(40)] + [(600, None), (601, ""), (None, items[0][1])]
    df = spark.createDataFrame([(i, t, "z", 0) for i, t in rows], "doc_id long, text string, key string, at int")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())

    def edits(a, b):                    # least edit distance of a to a stretch of b, by the book
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {(i, k): edits(words(t), words(d)) for i, d in rows if d and i is not None for k, t in items[:60]
            if (i, k) in truth or len(set(words(t)) & set(words(d))) >= 0.6 * len(set(words(t)))}
    want = {p: e for p, e in want.items() if e <= int(0.2 * len(words(items[p[1]][1])))}
    exact = {p for p, e in want.items() if e == 0}
    assert exact <= set(got) and set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[p].distance == want[p] for p in got)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.count() == len(rows) - len({p[0] for p in got})
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(df, bench.filter("item_id < 0")).count() == 0


def brute_licence(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    places = sorted((i, label) for p, label in license.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


def test_op2_very_short_items(spark):
    """Items of fewer than six words: exact under five, one edit at five."""
    bench = spark.createDataFrame([(1, "Zebra"), (2, "red fox"), (3, "what is it? Paris"), (4, "one two three four five"), (5, "..."), (6, None)],
                                  "item_id long, text string")
    rows = [(10, "a zebra, a fox"), (11, "the red  fox ran"), (12, "red hot fox"), (13, "so what is it Paris"), (14, "what is it London"),
            (15, "one two 3 four five"), (16, "one two 3 4 five"), (17, "four five"), (18, ""), (19, None)]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {(10, 1, 0), (11, 2, 0), (13, 3, 0), (15, 4, 1)}


def test_op2_edit_limit_by_length(spark):
    """Items with as many edits as the limit allows: all found by pieces under 8 words, by the
    embedding alone 0.9 or more from 8 words on and 0.95 or more from 16."""
    rng = random.Random(14)
    vocab = [f"v{i}" for i in range(3000)]
    sizes = (6, 7, 8, 9, 10, 12, 16, 19, 20, 24, 32, 39, 40, 48, 64, 100)
    items, rows = [], []
    for n in sizes:
        for _ in range(60):
            w = rng.choices(vocab, k=n)
            items.append((len(items), " ".join(w)))
            for p in rng.sample(range(n), n // 5):
                w[p] = f"edited{p}"
            rows.append((len(rows), " ".join(rng.choices(vocab, k=30) + w + rng.choices(vocab, k=30))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect() if r.doc_id == r.item_id}
    recall = {n: sum(60 * k + i in got for i in range(60)) / 60 for k, n in enumerate(sizes)}
    print(recall)
    assert all(r == 1 if n < decontaminate.SHORT else r >= (0.9 if n < 16 else 0.95) for n, r in recall.items()), recall


def test_op2_texts_move_once(spark):
    """Items of common words have very many candidates in long texts: one row per document holds them."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    long = " ".join(rng.choices(vocab, k=30000))
    rows = [(i, " ".join(rng.choices(vocab, k=4000))) for i in range(20)] + [(20, long), (21, long), (21, long)]
    bench = spark.createDataFrame([(1, "w1"), (2, "w1 w2 w3 w4 w5"), (3, "unseen here")], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.distance) for r in got if r.item_id == 1} == {(i, 0) for i in range(22)} and not [r for r in got if r.item_id == 3]


def test_op3_brute_force(spark, docs, odd, none):
    extra = ["CC BY cc-by CC BY", "All rights reserved. all RIGHTS\nreserved", "gnu general public license version 3", "xcc by",
             "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nrest", "SPDX-License-Identifier: MIT OR", "é cc by é"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + ODD + [(900 + i, t) for i, t in enumerate(extra)]
    got = license.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == \
        sorted(((i, *brute_licence(t)) for i, t in rows), key=key)
    by = {r.doc_id: r for r in got}
    assert by[904].labels == "apache-2.0,gpl-2.0-only,mit" and by[904].permissive and by[904].score == 1.0
    assert by[905].labels == "unparsed" and by[902].labels == "gpl,gpl-3.0" and by[903].labels == ""
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license.licenses(odd).count() == len(ODD) and license.licenses(none).count() == 0


@pytest.mark.parametrize("text, named, free", [
    ("MIT", {"mit"}, True), ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only", "classpath-exception-2.0"}, False),
    ("GPL-3.0-only or MIT and ISC", {"gpl-3.0-only", "mit", "isc"}, True), ("(GPL-3.0-only or MIT) and GPL-2.0-only", {"gpl-3.0-only", "mit", "gpl-2.0-only"}, False)])
def test_op3_expressions(text, named, free):
    assert license.evaluate(text) == (named, free)


@pytest.mark.parametrize("text, labels, permissive", [
    ("<!-- SPDX-License-Identifier: MIT -->", "mit", True), ("<!--SPDX-License-Identifier: MIT-->", "mit", True),
    ("/* SPDX-License-Identifier: MIT OR GPL-2.0-only */", "gpl-2.0-only,mit", True),
    ("SPDX-License-Identifier: MIT. See the file", "mit", True),
    ("x SPDX-License-Identifier: (MIT OR ISC) AND Zlib this text has no line end", "isc,mit,zlib", True),
    ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0-only,mit", False),
    ("SPDX_License_Identifier: MIT", "mit", True), ("é SPDX - License - Identifier: Zlib\nMIT", "zlib", True),
    ("SPDX-License-Identifier MIT", "mit", True), ("SPDX-License-Identifier: LicenseRef-Own AND MIT", "licenseref-own,mit", False),
    ("SPDX-License-Identifier: foo", "unparsed", None), ("An SPDX license identifier is a tag", "", None),
    ("SPDX-License-Identifier", "", None), ("SPDX-License-Identifier: MIT OR", "unparsed", None), ("SPDX-License-Identifier: (MIT foo", "unparsed", None)])
def test_op3_tag_ends(text, labels, permissive):
    got = license.scan(text, license._automaton())
    assert (got[5], got[7]) == (labels, permissive)


@pytest.mark.parametrize("text", ["", "and", "MIT MIT", "(MIT", "MIT)", "MIT or", "()"])
def test_op3_bad_expressions(text):
    with pytest.raises(license.BadExpression):
        license.evaluate(text)


def test_op4_field(spark, odd, none):
    # marginals against all labellings of short chains
    rng = np.random.default_rng(1)
    gain, bounds, steps = rng.normal(size=7), np.array([0, 3, 4, 7]), rng.normal(size=(2, 2))
    p, pairs = quality.marginals(gain, bounds, steps, pairs=True)
    want, total = [], np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        weights = {s: np.exp(sum(g for g, x in zip(gain[a:b], s) if x) + sum(steps[x, y] for x, y in zip(s, s[1:])))
                   for s in itertools.product((0, 1), repeat=b - a)}
        z = sum(weights.values())
        want += [sum(v for s, v in weights.items() if s[k]) / z for k in range(b - a)]
        for s, v in weights.items():
            for x, y in zip(s, s[1:]):
                total[x, y] += v / z
    assert np.allclose(p, want) and np.allclose(pairs, total)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    field = quality.learn_field(odd, labels, F.lit(True))
    got = quality.score(odd, field).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert quality.score(none, field).count() == 0 and quality.accept(odd, field).columns == odd.columns
    assert quality.learn_field(odd, labels.filter("doc_id < 0"), F.lit(True)).constant == 0.5


def _held_out(spark, query, label, threshold):
    sf = "/root/testdata/sf0.1"
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.score >= threshold).astype(int) == got.predicted).all()
    return (got.predicted == got[label]).mean()


def test_op4_held_out(spark):
    assert _held_out(spark, queries.op4_quality_crf, "quality", 0.7) > 0.97


def test_op10_held_out(spark):
    assert _held_out(spark, queries.op10_toxicity_fm, "toxic", 0.5) > 0.97


def test_op10_pairs(spark, odd, none):
    """Neither word alone is a label, both together are: no sum of single weights says so."""
    rng = random.Random(2)
    sets, labels = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.array([1] * a + [2] * b + sorted(rng.sample(range(10, 60), 5))))
        labels.append(float(a and b))
    machine = toxicity.fit(sets, np.array(labels))
    z, _ = toxicity._value(machine.w0, machine.w, machine.v, np.array([0, 1, 2, 2]), np.array([1, 2, 1, 2]), 3)
    assert z[0] < 0 and z[1] < 0 and z[2] > 0 and machine.v[1] @ machine.v[2] > 0
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")
    machine = toxicity.learn_machine(odd, labels, F.lit(True))
    got = toxicity.score(odd, machine).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, machine).count() == 0 and toxicity.accept(odd, machine).columns == odd.columns


@pytest.mark.parametrize("noise,vocabulary", [(10, 100), (60, 2000)])
def test_op10_pair_neutral_alone(noise, vocabulary):
    """Label 1 if both words or neither: each is neutral alone, and no term is left out for it."""
    rng = random.Random(noise)
    sets, labels = [], []
    for _ in range(5000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        sets.append(np.array([1] * a + [2] * b + sorted(rng.sample(range(10, 10 + vocabulary), noise))))
        labels.append(float(a == b))
    machine = toxicity.fit(sets[:4000], np.array(labels[:4000]))
    held = sets[4000:]
    z, _ = toxicity._value(machine.w0, machine.w, machine.v, np.repeat(np.arange(1000), [len(x) for x in held]), np.concatenate(held), 1000)
    assert ((z > 0) == np.array(labels[4000:])).mean() > 0.95


def test_op10_value():
    rng = np.random.default_rng(4)
    m = toxicity.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    sets = [[0, 2, 5], [], [1]]
    owner, column = np.array([0, 0, 0, 2]), np.array([0, 2, 5, 1])
    want = [0.3 + sum(m.w[i] for i in s) + sum(m.v[i] @ m.v[j] for i, j in itertools.combinations(s, 2)) for s in sets]
    assert np.allclose(toxicity._value(m.w0, m.w, m.v, owner, column, 3)[0], want)


def test_op5_brute_force(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi <turn>"), (1, 1, "assistant", "a\\l\\\\n <b>\n"), (1, 2, "assistant", ""), (1, 3, None, None), (2, 0, "assistant", "é👍🏽 漢\n\n"),
            (2, 1, "assistant", "</turn>\n<turn>assistant\n"), (3, None, "sys\ntem<", "x"), (-7, 0, "user", said), (-7, 1, "assistant", said),
            (None, 0, "assistant", "no id"), (4, 0, "user", "b"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a")]
    rows += [(5, i, "assistant" if i % 2 else "user", f"turn {i} " * 2000) for i in range(120)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, segment int").repartition(6)
    path = queries.vocabulary("byte_bpe_50k.json")
    segments = chat.formatted(df, path)
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a or ''}\n{t or ''}\n" for _, _, a, t in turns).encode()).hexdigest()
    assert segments.filter("conv_id = 5").count() > 1
    t = Tokenizer.from_file(path)
    for r in segments.filter("conv_id < 5").collect():
        assert t.decode(r["ids"], skip_special_tokens=False) == r.formatted and len(r.loss) == len(r["ids"])
    assert chat.digests(chat.formatted(df.limit(0), path)).count() == 0


def test_op6_library(spark, docs, odd, none):
    path = queries.vocabulary("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(6)
    pool = [chr(c) for lo, hi in ((0, 0x250), (0x300, 0x400), (0x1E00, 0x2100), (0x3040, 0x30A0), (0xAC00, 0xAC40), (0x1F600, 0x1F640)) for c in range(lo, hi)]
    texts = [t or "" for _, t in ODD] + [r.text or "" for r in docs.collect()] + ["it's we'LL <|endoftext|>x<|startoftext|> <|end"]
    texts += ["".join(rng.choices(pool + list(" etaion'sd") * 60, k=60)) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    got = bpe.encoded(odd, path).collect()
    assert len(got) == len(ODD) and all(r.n_tokens == len(r["ids"]) for r in got) and bpe.encoded(none, path).count() == 0


def test_op7_library(spark, docs, odd, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id + 100, r.text) for r in docs.collect()] + ODD + [(50, "a\n b"), (51, "a  b\n\nc \n"), (52, "\nx"), (53, "a\tb\xa0c"), (54, "it's 'LL\n's x1y2")]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfile.round_trip(odd, path).count() == len(ODD) and tokenfile.round_trip(none, path).count() == 0


def test_op7_cache_rolls_over(monkeypatch, docs):
    """Ids do not depend on what the cache has kept: it holds 60 words here."""
    monkeypatch.setattr(tokenfile, "CACHE", 60)
    path = queries.vocabulary("byte_bpe_50k.json")
    own, library = tokenfile.Encoder(path), Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [r.text for r in docs.limit(60).collect()] + [t for _, t in ODD] + ["don't can't\nwon't", "one\ntwo three", "1,000 x"]
    for at in range(0, len(texts), 7):
        got = own.encode(pa.array(texts[at:at + 7], pa.string()))
        assert [i.tolist() for i in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[at:at + 7]]
    assert len(own.words) < 5000


def test_op7_several_files_in_a_partition(monkeypatch, spark, docs):
    """A file holds 500 ids here, or one document: starts and ids are as in one file."""
    path = queries.vocabulary("byte_bpe_50k.json")
    whole = {r.doc_id: tuple(r) for r in tokenfile.round_trip(docs, path).collect()}
    monkeypatch.setattr(tokenfile, "FILE_IDS", 500)
    assert {r.doc_id: tuple(r) for r in tokenfile.round_trip(docs, path).collect()} == whole


def test_op7_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 1001):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (tokenfile.unpack(*tokenfile.pack(v), n) == v).all()
    with pytest.raises(ValueError):
        tokenfile.unpack(b"\x00", b"ab", 1)


def test_op8_round_trip(spark):
    big = "<p>" + "payload " * 300
    rows = [(1, "http://a/é b\n", big), (2, None, big), (3, "http://c", big), (3, "http://c", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
            (None, "u", big), (7, "u", ""), (8, "u", "\r\n\r\n" + big), (9, "u", "漢" * 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.html) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i != 3
        want.append((i, "revisit" if revisit else "response", 3 if revisit else None, len(data), hashlib.sha1(data).hexdigest(), None if revisit else html or ""))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_op8_small_pages_and_dictionary(spark):
    """Empty and small pages have no partner; copies of a large page do, one without an id as well."""
    big = "<p>" + "long page " * 30000
    rows = [(i, "u", "" if i % 3 else None, 1) for i in range(60)] + [(100 + i, "u", "x" * 999, 1) for i in range(4)] + \
        [(200 + i, "u", big, 1) for i in range(4)] + [(200, "u", big, 1), (None, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    back = warc.round_trip(pages).collect()
    assert len(back) == len(rows) and {(r.page_id, r.record_type) for r in back if r.payload_bytes > 1000} == \
        {(203, "response"), (200, "revisit"), (201, "revisit"), (202, "revisit"), (None, "revisit")}
    assert all(r.record_type == "response" and r.refers_to is None for r in back if r.payload_bytes < 1000)


def test_op8_validation():
    good = warc.record(1, "http://a", b"x" * 2000, None, False)
    assert warc.parse(good)["payload_bytes"] == 2000
    for bad in (good[:-1], good.replace(b"x" * 2000, b"y" * 2000), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Data"),
                good.replace(b"Content-Length: 2000", b"Content-Length: 1999")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_op9_likeness(spark, docs, odd, none):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    error = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (({tuple(x.split()[j:j + 5]) for j in range(max(1, len(x.split()) - 4))}) for x in (t, edited))
        error.append(got[i].near_edited - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(error))) < 0.06
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    strange = fingerprint.edited_fingerprints(odd).collect()
    assert len(strange) == len(ODD) and {r.fingerprint for r in strange if r.doc_id in (1, 2, 3)} == {""}
    assert fingerprint.edited_fingerprints(none).count() == 0
    plan = fingerprint.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_id_bitmap_keeps_every_asked_row(spark):
    rows = spark.range(-500, 20000).selectExpr("id AS doc_id", "'x' AS text")
    ids = spark.range(-500, 20000, 7).selectExpr("id AS doc_id")
    got = {r.doc_id for r in minhash.among(rows, "doc_id", minhash.id_bitmap(ids, "doc_id")).collect()}
    want = set(range(-500, 20000, 7))
    assert want <= got and len(got - want) < 20
    assert minhash.among(rows, "doc_id", minhash.id_bitmap(ids.limit(0), "doc_id")).count() == 0
