"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, are trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of the words it holds, and the document's
is ``1 - product(1 - sentence score)``: it is toxic if any sentence is. Only document labels train the model, which
then locates the offending sentences.

The model is fitted on the driver over a bounded sample of labelled rows: at most ``per_class`` toxic and
``2 * per_class`` other documents of at most ``most_bytes`` of text together, taken in the order of a hash of
doc_id. Its vocabulary is bounded, too. Every document is scored, over its whole text.

Defined cases: null and empty texts have one empty sentence and its score; labels that are null, or of rows without a
document, are not learnt from; without both classes of labels the score is the share of toxic labels (0 if none);
repeated labels of a doc_id count once, toxic if any says so; rows with equal doc_id are scored one by one.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

THRESHOLD = 0.7
#: Bounds of the training sample and of the vocabulary.
PER_CLASS = 1000
MOST_BYTES = 10_000_000
VOCABULARY = 5_000
LEAST_DOCS = 3
#: Least likelihood-ratio statistic (chi-squared, one degree) of a feature.
LEAST_G2 = 12.0

_SENTENCE = re.compile(r"[.!?\n]+")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ"
_WORD = re.compile(f"[{_LETTERS}]+|[^\\x00-\\u024f]+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text that hold anything but white space; one empty sentence if there is none."""
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()] or [""]


def sentence_features(sentence: str) -> set[str]:
    """Words, and the first four and six letters of longer ones (marked by a hyphen): insults share stems."""
    words = set(_WORD.findall(sentence.lower()))
    return words.union([w[:4] + "-" for w in words if len(w) > 4], [w[:6] + "-" for w in words if len(w) > 6])


class Model:
    """Word weights and a bias; the score of a text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def sentence_logits(self, text: str | None) -> list[float]:
        get, bias = self.weights.get, self.bias
        return [bias + sum([get(w, 0.0) for w in sentence_features(s)]) for s in sentences(text)]

    def score(self, text: str | None) -> float:
        return -math.expm1(-sum(_softplus(z) for z in self.sentence_logits(text)))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, float]]:
        """Index and score of the sentences whose own score is at least ``least``."""
        scores = [1 / (1 + math.exp(-max(-500.0, z))) for z in self.sentence_logits(text)]
        return [(k, s) for k, s in enumerate(scores) if s >= least]


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def _g2(b: int, a: int, n1: int, n0: int) -> float:
    """Likelihood-ratio statistic of a feature in b of n1 toxic and a of n0 other documents."""
    out = 0.0
    for seen, of in ((b, n1), (a, n0)):
        for count, share in ((seen, (a + b) / (n1 + n0)), (of - seen, 1 - (a + b) / (n1 + n0))):
            if count:
                out += 2 * count * math.log(count / (of * share))
    return out


def train(texts: list[str | None], labels: list[int], rounds: int = 500, rate: float = 0.05, l1: float = 3e-4) -> Model:
    """Fit non-negative weights by Adam on the mean noisy-or log loss with an L1 penalty; classes weigh alike."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, -40.0 if share == 0 else 40.0)
    # Features are numbered and kept in arrays: word objects of every sentence would take most of the driver's memory.
    numbers: dict[str, int] = {}
    seen: list[list[int]] = []
    features, sizes, doc_of = array("i"), array("i"), array("i")
    for doc, (text, label) in enumerate(zip(texts, labels, strict=True)):
        of_doc: set[int] = set()
        for s in sentences(text):
            own = [numbers.setdefault(w, len(numbers)) for w in sorted(sentence_features(s))]
            features.extend(own)
            sizes.append(len(own))
            doc_of.append(doc)
            of_doc.update(own)
        seen += [[0, 0] for _ in range(len(numbers) - len(seen))]
        for k in of_doc:
            seen[k][label] += 1
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    # Features that toxic documents hold more often than chance allows. Weights only add to toxicity.
    told = {w: _g2(b, a, n1, n0) for w, (a, b) in zip(numbers, seen, strict=True) if a + b >= LEAST_DOCS and b * n0 > a * n1}
    vocabulary = {w: k for k, w in enumerate(sorted((w for w in told if told[w] >= LEAST_G2), key=lambda w: (-told[w], w))[:VOCABULARY])}
    place = np.fromiter((vocabulary.get(w, -1) for w in numbers), dtype=np.int32, count=len(numbers))
    feature, sentence, doc = place[np.array(features, dtype=np.int32)], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.array(doc_of, dtype=np.int32)
    feature, sentence = feature[feature >= 0], sentence[feature >= 0]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -5.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, weights=theta[feature], minlength=len(doc))
        hidden = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(y))  # -log(1 - score)
        p = -np.expm1(-hidden)
        pull = np.where(y == 1, -np.exp(-hidden) / np.maximum(p, 1e-12), 1.0) * weight
        g_z = pull[doc] / (1 + np.exp(-z))
        gradient = np.append(np.bincount(feature, weights=g_z[sentence], minlength=len(vocabulary)), g_z.sum())
        gradient[:-1] += l1
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        np.maximum(theta[:-1], 0, out=theta[:-1])
    return Model({w: float(theta[k]) for w, k in vocabulary.items() if abs(theta[k]) > 1e-6}, float(theta[-1]))


def held_out(doc_id):
    """Rows that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = None
    for label, most in ((1, per_class), (0, 2 * per_class)):
        own = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        chosen = own if chosen is None else chosen.union(own)
    ids = chosen.collect()
    toxic = {r["doc_id"]: r["toxic"] for r in ids}
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 3 * per_class ids: a bounded broadcast
    ids_df = docs.sparkSession.createDataFrame([(i,) for i in toxic], "id long")
    sample = sample.join(F.broadcast(ids_df), F.col("doc_id") == F.col("id"), "left_semi")
    total = sample.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if total > most_bytes:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_000)) < int(1_000_000 * most_bytes / total))
    rows = sorted({(r["doc_id"], r["text"]) for r in sample.collect()}, key=lambda r: (r[0], r[1] or ""))
    return train([t for _, t in rows], [toxic[i] for i, _ in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted, and the indexes of offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            scores = [own.score(t) for t in texts]
            found = [[k for k, _ in own.offending(t)] if s >= THRESHOLD else [] for t, s in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "score", "sentences"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, score double, sentences array<int>")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "sentences")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
