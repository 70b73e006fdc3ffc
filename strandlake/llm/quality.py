"""Document quality from a linear-chain conditional random field over lines.

Method. Every line gets features of itself and of its two neighbours (make-up of its
bytes, length, word repetition, repeats in the document). A two-state chain labels
lines good or bad; it is fitted by gradient ascent on the likelihood of lines that
take their document's label. A document's quality is the mean of its lines'
forward-backward marginals, weighted by line length.

Defined cases: null or empty text is one empty line of weight one. Repeated rows are
scored alike. Without usable labels of both kinds every score is the share of good
labels (0.5 without any). An empty table gives an empty table. Result columns replace
input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import without
from strandlake.llm.labelled import training_sample
from strandlake.session import ship

#: Bounds of the training sample: documents, characters of each.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 30_000
#: A document is accepted from this score on.
ACCEPT = 0.3


def _class_table() -> np.ndarray:
    """Byte classes: 0 other letters, 1 A-Z, 2 digits, 3 white space, 4 . , ; : ' " ? - ( ), 5 !, 6 |, 7 other symbols."""
    t = np.full(256, 7, np.uint8)
    t[128:] = 0
    t[ord("a") : ord("z") + 1] = 0
    t[ord("A") : ord("Z") + 1] = 1
    t[ord("0") : ord("9") + 1] = 2
    t[[9, 10, 11, 12, 13, 32]] = 3
    t[list(b".,;:'\"?-()")] = 4
    t[ord("!")] = 5
    t[ord("|")] = 6
    return t


_CLASS = _class_table()
N_OWN = 16


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes and one, lines of each text)."""
    rows, weights, counts = [], [], []
    for text in texts:
        lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
        n = len(lines)
        counts.append(n)
        sizes = np.fromiter(map(len, lines), np.int64, n)
        data = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
        owner = np.repeat(np.arange(n), sizes + 1)
        share = np.bincount(owner * 8 + data, minlength=8 * n).reshape(n, 8).astype(np.float32)
        share[:, 3] -= 1  # the line's own end
        words = [x.split() for x in lines]
        n_words = np.fromiter(map(len, words), np.float32, n)
        distinct = np.fromiter((len(set(w)) for w in words), np.float32, n)
        switches = np.fromiter((sum(map(bytes.__eq__, w, w[1:])) for w in words), np.float32, n)
        seen: dict[bytes, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        f = np.zeros((n, N_OWN), np.float32)
        whole = np.maximum(sizes, 1).astype(np.float32)[:, None]
        f[:, :8] = share / whole
        f[:, 1] = share[:, 1] / np.maximum(share[:, 0] + share[:, 1], 1)
        f[:, 8] = np.log1p(sizes) / 8
        f[:, 9] = np.minimum(sizes / np.maximum(n_words, 1) / 20, 2)
        f[:, 10] = 1 - distinct / np.maximum(n_words, 1)
        f[:, 11] = switches / np.maximum(n_words - 1, 1)
        f[:, 12] = np.fromiter((x[-1:] in (b".", b"?", b"!") for x in lines), np.float32, n)
        f[:, 13] = np.fromiter((min(seen[x] - 1, 4) / 4 if x else 0 for x in lines), np.float32, n)
        f[:, 14] = sizes == 0
        # Word repetition beyond what a text of this many words has of itself.
        f[:, 15] = np.maximum(f[:, 10] - np.log1p(n_words) / 12, 0)
        rows.append(f)
        weights.append(sizes + 1)
    return np.concatenate(rows) if rows else np.zeros((0, N_OWN), np.float32), np.concatenate(weights) if weights else np.zeros(0, np.int64), np.array(counts, np.int64)


def chain_features(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, both neighbours', their squares' roots, and a constant."""
    start = np.cumsum(counts) - counts
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[start] = last[start + counts - 1] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    edge = np.stack([first, last, np.ones(len(own), bool)], 1).astype(np.float32)
    return np.concatenate([own, np.sqrt(np.abs(own)), before, after, edge], 1)


def _logaddexp(a, b):
    return np.logaddexp(a, b)


class LineField:
    """A two-state chain: log-odds of emission are linear; ``move`` holds transition scores."""

    def __init__(self, size: int):
        self.w = np.zeros(size)
        self.move = np.zeros((2, 2))

    def marginals(self, x: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also expected transition counts."""
        e = x @ self.w
        order = np.argsort(-counts, kind="stable")
        start = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
        m = self.move
        forward, backward = e.copy(), np.zeros(len(e))
        for t in range(1, longest):  # log-odds of the states given the lines so far
            at = start[: active[t]] + t
            p = forward[at - 1]
            forward[at] += _logaddexp(p + m[1, 1], m[0, 1]) - _logaddexp(p + m[1, 0], m[0, 0])
        for t in range(longest - 2, -1, -1):
            at = start[: active[t + 1]] + t
            n = backward[at + 1] + e[at + 1]
            backward[at] = _logaddexp(n + m[1, 1], m[1, 0]) - _logaddexp(n + m[0, 1], m[0, 0])
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        if not pairs:
            return p
        inner = np.ones(len(e), bool)
        inner[np.cumsum(counts) - counts] = False
        at = np.flatnonzero(inner)
        f, n = forward[at - 1], backward[at] + e[at]
        s = np.stack([np.full(len(at), m[0, 0]), m[0, 1] + n, m[1, 0] + f, m[1, 1] + f + n], 1)
        s = np.exp(s - s.max(1, keepdims=True))
        return p, (s / s.sum(1, keepdims=True)).sum(0).reshape(2, 2)

    def fit(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 250, rate: float = 0.08, ridge: float = 1e-3) -> None:
        y = np.repeat(label, counts).astype(np.float64)
        inner = (counts - 1).astype(np.float64)
        seen = np.array([[inner[label == 0].sum(), 0], [0, inner[label == 1].sum()]])
        n = len(y)
        theta = np.concatenate([self.w, self.move.ravel()])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.w, self.move = theta[:-4], theta[-4:].reshape(2, 2)
            p, expected = self.marginals(x, counts, True)
            g = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / n
            g -= ridge * theta * np.r_[np.ones(len(self.w)), np.full(4, 10.0)]
            mean = 0.9 * mean + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.w, self.move = theta[:-4], theta[-4:].reshape(2, 2)


class QualityModel:
    """Scores texts from 0 to 1; ``lines`` gives each line's marginal."""

    def __init__(self, field: LineField | None, prior: float):
        self.field, self.prior = field, prior

    @classmethod
    def fit(cls, sample: list[tuple[str, int]]) -> QualityModel:
        label = np.array([y for _, y in sample], np.int64)
        if len(set(label.tolist())) < 2:
            return cls(None, float(label.mean()) if len(label) else 0.5)
        own, _, counts = line_features([t for t, _ in sample])
        x = chain_features(own, counts).astype(np.float64)
        field = LineField(x.shape[1])
        field.fit(x, counts, label)
        return cls(field, float(label.mean()))

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, weight, counts = line_features(texts)
        p = self.field.marginals(chain_features(own, counts), counts) if self.field and len(own) else np.full(len(own), self.prior)
        return p, weight, counts

    def score(self, texts: list[str | None]) -> np.ndarray:
        p, weight, counts = self.lines(texts)
        owner = np.repeat(np.arange(len(counts)), counts)
        return np.bincount(owner, p * weight, len(counts)) / np.maximum(np.bincount(owner, weight, len(counts)), 1)


def train(docs: DataFrame, labels: DataFrame, keep: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> QualityModel:
    return QualityModel.fit(training_sample(docs, labels, label, keep, SAMPLE_DOCS, SAMPLE_CHARS, text, doc_id))


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", accept: float = ACCEPT, score: str = "quality", verdict: str = "accepted") -> DataFrame:
    """``docs`` with quality (double) and accepted (boolean), under the names ``score`` and ``verdict``."""
    ship(docs.sparkSession)
    docs = without(docs, score, verdict)
    names, at = docs.columns, docs.columns.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*inner.schema.fields, T.StructField("quality", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                s = model.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(s >= accept)], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*names, score, verdict)
