"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

Method. A sentence's log-odds are a bias and the weights of its distinct words; a word's
weight is the sum of those of its form, its character n-grams and its stems. A document is
toxic unless all its sentences are clean (noisy-or). Weights are fitted on document
labels by gradient ascent through the noisy-or; the sentence scores then say where
the offence is. Fitted are the FEATURES features that tell most about the labels, on at most
SAMPLE_DOCS labelled documents of at most SAMPLE_CHARS characters; scoring reads every whole text.

Defined cases: null, empty or blank text has no sentence and the score 0. Repeated rows
are scored alike. Without labels of both kinds every score is 0. An empty table gives
an empty table. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import without
from strandlake.llm.labelled import training_sample
from strandlake.session import ship

#: Bounds of the training sample: documents, characters of each; features that are fitted.
SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000
FEATURES = 6000
#: A document counts as toxic from this score on.
TOXIC = 0.7
#: Words whose weights a worker remembers.
CACHE_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_+=~`/\\"


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of sentences."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if not m.group().isspace()]


def word_features(word: str) -> list[str]:
    """The form, its n-grams of three to five characters with marked edges, and stems that go on."""
    marked = f"^{word}$"
    return ["=" + word, *{marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}, *(word[:n] + "+" for n in range(3, min(len(word), 10)))]


def words_of(sentence: str) -> set[str]:
    return {w for w in (x.strip(_EDGE) for x in sentence.lower().split()) if w}


class ToxicityModel:
    def __init__(self, bias: float | None, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_known": {}}

    def _weight(self, raw: str) -> float:
        """Of a word as it stands in lower-cased text."""
        known = self._known
        w = known.get(raw)
        if w is None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            word = raw.strip(_EDGE)
            get = self.weights.get
            w = known[raw] = sum(get(f, 0.0) for f in word_features(word)) if word else 0.0
        return w

    @classmethod
    def fit(cls, sample: list[tuple[str, int]], steps: int = 500, rate: float = 0.15, ridge: float = 3e-6, least: int = 10) -> ToxicityModel:
        label = np.array([y for _, y in sample], np.float64)
        if len(set(label.tolist())) < 2:
            return cls(None, {})
        vocabulary: dict[str, int] = {}
        entry_sentence, entry_word, sentence_doc = [], [], []
        doc_words = []
        for d, (text, _) in enumerate(sample):
            all_words = set()
            for a, b in sentences(text):
                s = len(sentence_doc)
                sentence_doc.append(d)
                for w in sorted(words_of(text[a:b])):
                    entry_sentence.append(s)
                    entry_word.append(vocabulary.setdefault(w, len(vocabulary)))
                    all_words.add(entry_word[-1])
            doc_words.append(all_words)
        form = [word_features(w) for w in vocabulary]
        seen = (Counter(), Counter())
        for d, ws in enumerate(doc_words):
            seen[int(label[d])].update({f for w in ws for f in form[w]})
        n0, n1 = float((label == 0).sum()), float((label == 1).sum())

        def gain(f: str) -> float:
            a, b = seen[1][f], seen[0][f]
            p, q, r = a / n1, b / n0, (a + b) / (n0 + n1)
            h = lambda k, n, p: k * np.log(max(p, 1e-12)) + (n - k) * np.log(max(1 - p, 1e-12))
            return h(a, n1, p) + h(b, n0, q) - h(a, n1, r) - h(b, n0, r)

        usable = [f for f in seen[1].keys() | seen[0].keys() if seen[1][f] + seen[0][f] >= least]
        chosen = sorted(usable, key=lambda f: (-gain(f), f))[:FEATURES]
        number = {f: i for i, f in enumerate(chosen)}
        wf = [(w, number[f]) for w, fs in enumerate(form) for f in fs if f in number]
        wf_word, wf_feature = (np.array(x, np.int64) for x in zip(*wf, strict=True)) if wf else (np.zeros(0, np.int64),) * 2
        es, ew, sd = np.array(entry_sentence, np.int64), np.array(entry_word, np.int64), np.array(sentence_doc, np.int64)
        n_words, n_sent, n_docs = len(vocabulary), len(sd), len(sample)
        theta = np.zeros(len(chosen) + 1)
        theta[-1] = -5.0
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            word = np.bincount(wf_word, theta[wf_feature], n_words)
            z = np.clip(theta[-1] + np.bincount(es, word[ew], n_sent), -40, 40)
            p = 1 / (1 + np.exp(-z))
            clean = np.bincount(sd, np.log1p(-np.minimum(p, 1 - 1e-12)), n_docs)
            toxic = -np.expm1(clean)
            # d log-likelihood / d z of a sentence: p (y / P(toxic) - 1) in a document, by the chain rule.
            pull = label / np.maximum(toxic, 1e-9) - 1
            g_z = p * np.clip(pull, -1, 1e3)[sd]
            g_word = np.bincount(ew, g_z[es], n_words)
            g = np.append(np.bincount(wf_feature, g_word[wf_word], len(chosen)), g_z.sum()) / n_docs
            g[:-1] -= ridge * theta[:-1]
            g[-1] -= ridge * (theta[-1] + 6)
            mean = 0.9 * mean + 0.1 * g
            square = 0.99 * square + 0.01 * g * g
            theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        return cls(float(theta[-1]), {f: float(theta[i]) for f, i in number.items() if abs(theta[i]) > 1e-4})

    def sentence_scores(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, P(toxic)) of each sentence."""
        spans = sentences(text)
        if self.bias is None or not spans:
            return [(a, b, 0.0) for a, b in spans]
        weight, bias = self._weight, self.bias
        z = np.array([bias + sum(map(weight, set(text[a:b].lower().split()))) for a, b in spans])
        return list(zip(*zip(*spans, strict=True), (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist(), strict=True))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.sentence_scores(text)
        clean = sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in found) if found else 0.0
        return float(-np.expm1(clean)), found


def train(docs: DataFrame, labels: DataFrame, keep: Column, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> ToxicityModel:
    return ToxicityModel.fit(training_sample(docs, labels, label, keep, SAMPLE_DOCS, SAMPLE_CHARS, text, doc_id))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, model: ToxicityModel, text: str = "text", offending: float = 0.5) -> DataFrame:
    """``docs`` with toxicity (double) and offending: spans (code points) of sentences from that score on."""
    ship(docs.sparkSession)
    docs = without(docs, "toxicity", "offending")
    names, at = docs.columns, docs.columns.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    schema = T.StructType([*inner.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("offending", _SPANS)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [shared.value.score(x) for x in batch.column(at).to_pylist()]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in s if p >= offending] for _, s in scored]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in scored], pa.float64()), pa.array(spans, spans_type)], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*names, "toxicity", "offending")
