"""Quality classifier (operator 4): a linear-chain conditional random field over lines.

Every line of a text gets features of its own and of the lines before and after it (counts
by class of character, words, repetitions); the chain has two states, bad and good, with
learnt transitions.  Forward-backward gives each line's marginal of being good; the
document's quality is their mean weighted by line length, brought to a probability of
label 1 by a logistic step that is fitted with the field.

Learning: only documents are labelled.  Lines of a document of label 1 are taken as good;
lines of a document of label 0 begin as bad and are then judged by the field itself in
rounds (its junk often stands under ordinary lines): soft labels in the chain's likelihood.
At most ``SAMPLE`` labelled documents, by a hash of doc_id, are fitted on the driver.

NULL and empty texts are one empty line and get a score too.  A document of several
label rows takes the largest label; labels that are NULL are left out.  Without labels, or
with one class only, the score is the share of label 1 (0.5 without labels).  Only the text
enters a score.  Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import SPACE, chunks, filter_rows, small_batches, utf8, word_hashes

SAMPLE = 3000
THRESHOLD = 0.7


def _among(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


_CLASSES = [
    _among(bytes(range(65, 91))), _among(bytes(range(97, 123))), _among(bytes(range(0x80, 0x100))), _among(bytes(range(48, 58))),
    _among(b" \t"), _among(b".,;:?'\"()-"), _among(b"!"), _among(b"#$%&*+=<>@^_~\\/[]{}`"), _among(b"|"),
]
OWN = len(_CLASSES) + 7
FEATURES = 3 * OWN + 3


def lines_of(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): bytes of every line, and the line at which each text begins
    (one more than texts).  Every text has one line at least."""
    breaks = np.flatnonzero(raw == 10)
    owner = np.searchsorted(offs, breaks, side="right") - 1
    per = np.bincount(owner, minlength=len(offs) - 1) + 1
    bounds = np.concatenate([[0], np.cumsum(per)])
    starts = np.empty(bounds[-1], dtype=np.int64)
    first = np.zeros(bounds[-1], dtype=bool)
    first[bounds[:-1]] = True
    starts[first], starts[~first] = offs[:-1], breaks + 1
    last = np.zeros(bounds[-1], dtype=bool)
    last[bounds[1:] - 1] = True
    ends = np.empty(bounds[-1], dtype=np.int64)
    ends[last], ends[~last] = offs[1:], breaks
    return starts, ends, bounds


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return (total[ends] - total[starts]).astype(np.float32)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, weights by line, bounds): own, previous and next line's features;
    lengths in bytes (1 at least) weigh the lines."""
    starts, ends, bounds = lines_of(raw, offs)
    size = (ends - starts).astype(np.float32)
    per = np.maximum(size, 1)
    own = np.empty((len(starts), OWN), dtype=np.float32)
    for i, table in enumerate(_CLASSES):
        own[:, i] = _sums(table[raw], starts, ends) / per
    letters = own[:, 0] + own[:, 1]
    words, _, at = word_hashes(raw, offs, SPACE)
    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
    n = (b - a).astype(np.float32)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    same[a[a < len(words)]] = False
    total = np.concatenate([[0], np.cumsum(same, dtype=np.int32)])
    repeats = (total[b] - total[a]).astype(np.float32)
    line_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64)])
    line_hash = line_sum[b] - line_sum[a]
    k = len(_CLASSES)
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = np.minimum(per / np.maximum(n, 1) / 16, 2)           # length of a word
    own[:, k + 2] = repeats / np.maximum(n, 1)
    own[:, k + 3] = own[:, 0] / np.maximum(letters, 0.02)                # capitals among letters
    own[:, k + 4] = n == 0
    own[:, k + 5] = n == 1
    begins = np.zeros(len(starts), dtype=bool)
    begins[bounds[:-1]] = True
    ending = np.zeros(len(starts), dtype=bool)
    ending[bounds[1:] - 1] = True
    own[:, k + 6] = np.concatenate([[False], line_hash[1:] == line_hash[:-1]]) & ~begins
    out = np.zeros((len(starts), FEATURES), dtype=np.float32)
    out[:, :OWN] = own
    out[1:, OWN:2 * OWN] = own[:-1] * ~begins[1:, None]
    out[:-1, 2 * OWN:3 * OWN] = own[1:] * ~ending[:-1, None]
    out[:, -3], out[:, -2], out[:, -1] = begins, ending, 1
    return out, per, bounds


@dataclass
class Field:
    """Weights of state good (bad has none), transitions, and the step to a probability."""
    weights: np.ndarray
    steps: np.ndarray            # log potentials [from, to]; 0 bad, 1 good
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def marginals(gain: np.ndarray, bounds: np.ndarray, steps: np.ndarray,
              pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains side by side.  ``gain``: log potential of good per
    line.  Returns P(good) per line and, if asked, the summed pair marginals [from, to]."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, sorted_length = bounds[:-1][order], length[order]
    e = np.exp(np.clip(gain, -30, 30))
    trans = np.exp(steps)
    n = len(gain)
    ahead = np.empty((n, 2))
    back = np.empty((n, 2))
    live = len(order)
    for t in range(int(sorted_length[0]) if len(order) else 0):
        live = int(np.searchsorted(-sorted_length, -t, side="left"))           # chains longer than t
        at = first[:live] + t
        state = np.ones((live, 2)) if t == 0 else ahead[at - 1] @ trans
        state[:, 1] *= e[at]
        ahead[at] = state / state.sum(axis=1, keepdims=True)
    total = np.zeros((2, 2))
    for t in range(int(sorted_length[0]) - 1 if len(order) else -1, -1, -1):
        live = int(np.searchsorted(-sorted_length, -t, side="left"))
        at = first[:live] + t
        ends = sorted_length[:live] == t + 1
        state = np.ones((live, 2))
        inner = at[~ends]
        if len(inner):
            after = back[inner + 1].copy()
            after[:, 1] *= e[inner + 1]
            state[~ends] = after @ trans.T
            if pairs:
                joint = ahead[inner][:, :, None] * trans * after[:, None, :]
                total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[at] = state / state.sum(axis=1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(axis=1), total


def _document(p: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(p * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def fit(x: np.ndarray, weight: np.ndarray, bounds: np.ndarray, labels: np.ndarray,
        rounds: int = 4, steps: int = 60) -> Field:
    """Maximum likelihood with soft line labels, by Adam; then the logistic step."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Field(np.zeros(x.shape[1]), np.zeros((2, 2)), constant=float(labels.mean()) if len(labels) else 0.5)
    length = np.diff(bounds)
    good = np.repeat(labels, length).astype(np.float64)
    target = good.copy()
    # both classes, and short and long documents, count alike
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    line = np.repeat(share / length, length) * len(labels)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inside = np.ones(len(target), dtype=bool)
    inside[bounds[1:] - 1] = False
    at = np.flatnonzero(inside)
    for turn in range(rounds):
        m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
        for k in range(1, steps + 1):
            p, pairs = marginals(x @ w, bounds, trans, pairs=True)
            seen = np.empty((2, 2))
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] = ((target[at] if i else 1 - target[at]) * (target[at + 1] if j else 1 - target[at + 1])).sum()
            grad = np.concatenate([x.T @ ((target - p) * line) / len(labels) - 1e-4 * w,
                                   ((seen - pairs) / len(target)).ravel() - 1e-2 * trans.ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = 0.25 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
            w += step[:-4]
            trans = np.clip(trans + step[-4:].reshape(2, 2), -3, 3)
        if turn < rounds - 1:
            p, _ = marginals(x @ w, bounds, trans)
            target = np.where(good == 1, 1.0, p)
            # a document of label 0 keeps its worst line bad
            worst = np.minimum.reduceat(p, bounds[:-1])
            target[(good == 0) & (p <= np.repeat(worst, length))] = 0.0
    share_good = _document(marginals(x @ w, bounds, trans)[0], weight, bounds)
    field = Field(w, trans)
    z, a, b = _logit(share_good), 1.0, 0.0
    center = z.mean()
    for _ in range(400):
        q = 1 / (1 + np.exp(-np.clip(a * (z - center) + b, -30, 30)))
        # a little pull to even odds keeps the step finite where the classes part cleanly
        a += 0.2 * (((labels - q) * (z - center)).mean() - 1e-3 * a)
        b += 0.2 * (labels - q).mean()
    field.slope, field.shift = float(max(a, 1e-3)), float(b - a * center)
    return field


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def scores(field: Field, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if len(offs) < 2:
        return np.zeros(0)
    if field.constant is not None:
        return np.full(len(offs) - 1, field.constant)
    x, weight, bounds = features(raw, offs)
    p, _ = marginals(x @ field.weights, bounds, field.steps)
    z = _logit(_document(p, weight, bounds))
    return 1 / (1 + np.exp(-(field.slope * z + field.shift)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` documents for which ``learn`` holds, chosen by a
    hash of doc_id; several label rows of a document count as the largest label."""
    some = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .filter(learn).dropna().groupBy("doc_id").agg(F.max("label").alias("label")))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    some = some.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")


def learn_field(docs: DataFrame, labels: DataFrame, learn: Column, bound: int = SAMPLE) -> Field:
    """The field fitted to ``labels.quality`` of documents for which ``learn`` holds."""
    schema = "doc_id long, label int, lines binary, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            x, weight, bounds = features(*utf8(piece.column(1)))
            yield pa.RecordBatch.from_arrays([
                piece.column(0), piece.column(2),
                pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                pa.array([weight[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["doc_id", "label", "lines", "weights"])

    rows = labelled(docs, labels, "quality", learn, bound).select("doc_id", "text", "label").mapInArrow(run, schema).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["lines"]))
    if not rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    weight = [np.frombuffer(r["weights"], np.float32) for r in rows]
    x = np.concatenate([np.frombuffer(r["lines"], np.float16).reshape(-1, FEATURES) for r in rows]).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in weight])])
    return fit(x, np.concatenate(weight), bounds, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(field, *utf8(piece.column(1))))],
                                             names=["doc_id", "score"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accept(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the field takes for good, columns as they are.  Only
    the texts go to the workers; the rows stay where they are."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        return filter_rows(text, lambda raw, offs: scores(field, raw, offs) >= threshold)
    return docs.filter(accepted("text"))
