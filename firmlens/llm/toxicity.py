"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence's probability is a logistic score of its
words and word beginnings, the document's is their noisy-or: 1 - prod(1 - p). Only
documents have labels, so training pushes the blame down to the sentences that explain
them, and scoring tells which sentences offend.

The model is fitted on a bounded sample of the labelled rows (`max_train_docs`); scoring
runs over whole texts of all documents in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled documents are fitted, taken by a hash of doc_id.
MAX_TRAIN_DOCS = 8_000
MAX_FEATURES = 4_000
#: Features are hashed to so many bits.
FEATURE_BITS = 22
THRESHOLD = 0.3
_PREFIXES = (4, 5, 6)
_MEMO = 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = "\"'()[]{}<>.,;:!?-|*#$%&"


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; `word` is lower-cased and without marks at its ends."""
    parts = [word, *(f"{word[:n]}~" for n in _PREFIXES if len(word) > n)] if word else []
    return [xxhash.xxh32_intdigest(x.encode()) >> (32 - FEATURE_BITS) for x in parts]


def sentence_features(sentence: str) -> set[int]:
    return {f for w in sentence.lower().split() for f in features(w.strip(_EDGES))}


def select(texts: list[str | None], y: np.ndarray) -> dict[int, float]:
    """The features whose documents' labels differ most from chance, with first weights."""
    n, ones = len(y), float(y.sum())
    seen, bad = np.zeros(1 << FEATURE_BITS, np.int32), np.zeros(1 << FEATURE_BITS, np.int32)
    for text, label in zip(texts, y, strict=True):
        have = np.fromiter(set().union(*map(features, {w.strip(_EDGES) for w in (text or "").lower().split()})), np.int64)
        seen[have] += 1
        if label:
            bad[have] += 1
    rate = ones / n
    at = np.flatnonzero((bad >= 3) & (bad > 2 * seen * rate))
    z = (bad[at] - seen[at] * rate) / np.sqrt(seen[at] * rate * (1 - rate))
    at = at[np.argsort(-z, kind="stable")][: min(MAX_FEATURES, int((z > 4).sum()))]
    first = 0.5 * np.log((bad[at] + 0.1) / ones / ((seen[at] - bad[at] + 0.5) / (n - ones)))
    return dict(zip(at.tolist(), first.tolist(), strict=True))


def fit(texts: list[str | None], labels: list[int], epochs: int = 300) -> dict:
    """Weights of sentence features for documents and their 0/1 labels.

    No toxic or no clean documents give a model that scores the share of toxic ones throughout.
    """
    y = np.array(labels, float)
    n, ones = len(y), float(y.sum())
    if not n or not ones or ones == n:
        return {"bias": -30.0, "weights": {}, "share": ones / n if n else 0.0}
    first = select(texts, y)
    index = {f: i for i, f in enumerate(first)}
    doc_of, rows, cols, plain, at = [], [], [], np.zeros(n), 0
    for d, text in enumerate(texts):
        for sentence in SENTENCE.findall(text or ""):
            if hits := [index[f] for f in sentence_features(sentence) if f in index]:
                doc_of.append(d)
                rows += [at] * len(hits)
                cols += hits
                at += 1
            else:
                plain[d] += 1
    doc_of, rows, cols = np.array(doc_of, int), np.array(rows, int), np.array(cols, int)
    w = np.array(list(first.values()))
    b, m, v = -6.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, epochs + 1):
        z = np.bincount(rows, w[cols], at) + b if at else np.zeros(0)
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + math.exp(-b))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n) + plain * math.log1p(-p0)
        doc = np.clip(1 - np.exp(none), 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - doc) / doc, 1.0)  # of the loss by a sentence's score, over its own p
        g = pull[doc_of] * p
        grad = np.append(np.bincount(cols, g[rows], len(w)) / n + 1e-5 * w, (g.sum() + (pull * plain * p0).sum()) / n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], min(b - step[-1], -3.0)
    return {"bias": float(b), "weights": {f: float(x) for f, x in zip(first, w, strict=True) if abs(x) > 1e-3}, "share": ones / n}


class Scorer:
    def __init__(self, model: dict):
        self.bias, self.weights, self.share = model["bias"], model["weights"], model["share"]
        self.memo: dict[str, bool] = {}
        self.rest = math.log1p(-1 / (1 + math.exp(-self.bias)))

    def known(self, piece: str) -> bool:
        if (out := self.memo.get(piece)) is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            out = self.memo[piece] = any(f in self.weights for part in SENTENCE.findall(piece) for f in features(part.strip(_EDGES)))
        return out

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, p) of each sentence that holds a weighted feature."""
        out = []
        for m in SENTENCE.finditer(text):
            if hits := [x for f in sentence_features(m[0]) if (x := self.weights.get(f)) is not None]:
                z = max(-30.0, min(30.0, self.bias + sum(hits)))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        if not self.weights:
            return self.share, []
        if not text:
            return 0.0, []
        spans = self.sentences(text) if any(map(self.known, text.lower().split())) else []
        plain = len(SENTENCE.findall(text)) - len(spans)  # as in fit()
        return 1 - math.exp(plain * self.rest + sum(math.log1p(-min(p, 1 - 1e-9)) for _, _, p in spans)), spans


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with toxicity: struct<score double, spans array<struct<start int, end int, score double>>>.

    Null and empty texts score 0 without spans. Spans are code points, in text order,
    of the sentences at or above the threshold.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES words
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    @F.arrow_udf("struct<score: double, spans: array<struct<start: int, end: int, score: double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(state.value)
        for texts in batches:
            out = []
            for start in range(0, len(texts), 256):
                for t in texts.slice(start, 256).to_pylist():
                    p, spans = scorer.score(t)
                    out.append({"score": p, "spans": [{"start": a, "end": b, "score": x} for a, b, x in spans if x >= threshold]})
            yield pa.array(out, kind)

    return docs.withColumn("toxicity", run(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> dict:
    """Fit on about `max_train_docs` labelled rows outside the held-out fold, picked by a hash of doc_id.

    Null labels and ids are left out; a document whose labels contradict each other counts as
    toxic, and of repeated rows with one id the first text in order is taken. Rows are fitted
    in the order of doc_id, so the model does not depend on the shuffle. What reaches the
    driver is bounded by the sample.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(~held_out())
    part = min(1.0, max_train_docs / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by("doc_id")  # bounded by the sample
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist())
