"""Toxicity (operator 10): a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of letters and digits, lower-cased A-Z) and the
first ``HEAD`` bytes of longer words, hashed to ``2 ** HASH_BITS`` numbers.  The score is

    w0 + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

through the logistic function: the factors v let two terms weigh together what neither does
alone.  The pair sum is ((sum of v) ** 2 - sum of v ** 2) / 2, one pass over the terms.

Learning: at most ``SAMPLE`` labelled documents by a hash of doc_id, fitted on the driver.  No term
is left out: the table of ``2 ** HASH_BITS`` rows bounds the model's size, and a penalty per term
keeps noise small.  A weight is penalised unless the term's documents stray from the share of
label 1 by several standard deviations; factors are penalised unless the term strays or is
frequent, for two frequent terms that are neutral alone can decide a label together.  Terms that no
learnt document has weigh nothing.

NULL and empty texts have no terms and the score of w0.  A document of several label rows
takes the largest label; NULL labels are left out.  Without labels, or with one class only,
the score is the share of label 1 (0.5 without labels).  Only the text enters a score.
Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.quality import labelled
from tessera.llm.text import LOWER, NOT_ALNUM, chunks, filter_rows, mix64, small_batches, utf8, word_hashes

SAMPLE = 8000
HASH_BITS, HEAD = 18, 5
FACTORS, EPOCHS = 4, 25
#: penalties: of a term that strays and is frequent, and added for one that does neither
PENALTY, DOUBT = (1e-5, 1e-3), 1.0
#: documents a term needs to be judged by its stray, share of documents that makes it frequent
LEAST, FREQUENT = 5, 0.05
THRESHOLD = 0.5


def terms(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every word and word head, copies kept, in no order."""
    words, bounds, at = word_hashes(raw, offs, NOT_ALNUM)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    # heads: the first HEAD bytes in one number, for words that have them
    whole = at + HEAD <= len(raw)
    for j in range(HEAD):
        whole &= ~NOT_ALNUM[raw[np.minimum(at + j, len(raw) - 1)]]
    whole &= at + HEAD <= offs[1:][owner]
    head = np.zeros(int(whole.sum()), dtype=np.uint64)
    for j in range(HEAD):
        head = head << np.uint64(8) | LOWER[raw[at[whole] + j]].astype(np.uint64)
    keep = np.uint64((1 << HASH_BITS) - 1)
    return (np.concatenate([owner, owner[whole]]),
            np.concatenate([words & keep, mix64(head) & keep]).astype(np.int64))


@dataclass
class Machine:
    """Weights and factors of the term numbers (2 ** HASH_BITS rows)."""
    w0: float
    w: np.ndarray
    v: np.ndarray

    def __post_init__(self):
        self.live = (self.w != 0) | (self.v != 0).any(axis=1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _value(w0: float, w: np.ndarray, v: np.ndarray, owner: np.ndarray, column: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(score before the logistic, sum of factors) of n texts; one row per text and term."""
    linear = np.bincount(owner, w[column], n)
    own = v[column]
    sums = np.stack([np.bincount(owner, own[:, f], n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(owner, (own ** 2).sum(axis=1), n)
    return w0 + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums


def scores(machine: Machine, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    owner, term = terms(raw, offs)
    known = machine.live[term]
    both = np.unique(owner[known] << HASH_BITS | term[known])
    return _logistic(_value(machine.w0, machine.w, machine.v, both >> HASH_BITS, both & ((1 << HASH_BITS) - 1), n)[0])


def fit(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """Logistic loss by Adagrad over mini-batches, with a pull to 0 on weights and factors.
    ``sets``: the distinct terms of each document."""
    n, rows = len(sets), 1 << HASH_BITS
    out = Machine(0.0, np.zeros(rows, np.float32), np.zeros((rows, FACTORS), np.float32))
    if n == 0:
        return out
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    w0 = out.w0 = float(np.log(share / (1 - share)))
    if labels.min() == labels.max() or not sum(map(len, sets)):
        return out
    term, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    expected = counts * share
    # how far a term's documents stray from the share of label 1, in standard deviations
    stray = np.bincount(column, labels[np.repeat(np.arange(n), np.diff(begin))], len(term)) - expected
    stray = np.maximum(np.abs(stray) - 0.5, 0) / np.sqrt(expected * (1 - share) + 0.5) * (counts >= LEAST)
    weak = np.exp(-stray ** 2 / 2)
    idle = np.minimum(weak, np.exp(-counts / (FREQUENT * n)))
    pull_w, pull_v = PENALTY[0] + DOUBT * weak, (PENALTY[1] + DOUBT * idle)[:, None]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(term)), rng.normal(0, 0.1, (len(term), FACTORS)) * (1 - idle)[:, None]
    gw, gv, g0 = np.full(len(term), 1e-2), np.full((len(term), FACTORS), 1e-2), 1e-2
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // 128)):
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in part])
            own = np.repeat(np.arange(len(part)), begin[part + 1] - begin[part])
            some, col = np.unique(column[at], return_inverse=True)
            z, sums = _value(w0, w[some], v[some], own, col, len(part))
            error = (_logistic(z) - labels[part]) * weight[part] / len(part)
            # a machine's slope in w is the sign itself, in v the other terms' factors
            dw = np.bincount(col, error[own], len(some)) + pull_w[some] * w[some]
            other = sums[own] - v[some][col]
            dv = np.stack([np.bincount(col, error[own] * other[:, f], len(some)) for f in range(FACTORS)], axis=1) + pull_v[some] * v[some]
            gw[some] += dw ** 2
            gv[some] += dv ** 2
            g0 += error.sum() ** 2
            w[some] -= 0.3 * dw / np.sqrt(gw[some])
            v[some] -= 0.1 * dv / np.sqrt(gv[some])
            w0 -= 0.3 * error.sum() / np.sqrt(g0)
    out.w[term], out.v[term] = w, v
    return Machine(float(w0), out.w, out.v)


def learn_machine(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = SAMPLE) -> Machine:
    """The machine fitted to ``labels.toxic`` of documents for which ``learn`` holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            owner, term = terms(*utf8(piece.column(1)))
            both = np.unique(owner << HASH_BITS | term)
            cuts = np.searchsorted(both >> HASH_BITS, np.arange(1, piece.num_rows))
            sets = np.split((both & ((1 << HASH_BITS) - 1)).astype("<i4"), cuts)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["doc_id", "label", "terms"])

    chosen = labelled(docs, labels, "toxic", learn, bound).select("doc_id", "text", "label")
    rows = chosen.mapInArrow(run, "doc_id long, label int, terms binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["terms"]))
    return fit([np.frombuffer(r["terms"], "<i4").astype(np.int64) for r in rows], np.array([r["label"] for r in rows], dtype=float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(machine, *utf8(piece.column(1))))],
                                             names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the machine does not take for toxic, columns as they are.  Only
    the texts go to the workers; the rows stay where they are."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        return filter_rows(text, lambda raw, offs: scores(machine, raw, offs) < threshold)
    return docs.filter(accepted("text"))
