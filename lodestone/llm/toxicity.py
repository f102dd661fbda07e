"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else that may be learned from, labelled or
not, is unlabelled text. With the class prior p the risk of a classifier is
``p * R_P(+) + max(0, R_U(-) - p * R_P(-))``: what positives contribute to the unlabelled negative risk
is subtracted, and where the difference goes below zero the step is reversed (Kiryo et al., 2017).
Linear classifiers over word presence are trained in numpy, several on different unlabelled
documents, and their margins are averaged.

Bounds, all parameters: the classifiers are fitted on at most ``positives`` and ``unlabelled`` whole
documents, taken by the hash of their ids, and on the ``vocabulary`` words and beginnings of words
that separate the two best, of those in ``LEAST_SHARE`` of the documents that can be toxic. The prior
is counted over all labelled rows, and scoring reads every whole text. Where no learnable document is
positive, or none is unlabelled, nothing can be told apart: every score is the prior (0 without any
positive label).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, hash_unit, held_out, may_learn, record_batch, segment_sums

POSITIVES = 3000
UNLABELLED = 9000
VOCABULARY = 1024
#: A word enters the vocabulary if the log-ratio of its two frequencies is this many standard errors from 0.
LEAST_Z = 4.0
#: and if it is in this share of the documents that can be expected to be toxic, at least.
LEAST_SHARE = 0.008
THRESHOLD = 0.7
BAGS = 3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings of 4 to 7 letters (with a star), which words made of one stem share."""
    return [word, *(word[:k] + "*" for k in range(4, min(8, len(word))))]


def features_of_text(text: str) -> set[str]:
    """The features of a text's words; a beginning of two different words or more has another star."""
    seen = Counter(f for w in words_of(text) for f in features_of(w))
    return seen.keys() | {f + "*" for f, n in seen.items() if n > 1 and f.endswith("*")}


class FeatureIndex(dict):
    """The numbers of the known features of a word; those met lately are kept."""

    def __init__(self, vocabulary: dict[str, int], kept: int = 300_000) -> None:
        super().__init__()
        self.vocabulary, self.kept = vocabulary, kept
        known = {f.rstrip("*") + "*" for f in vocabulary if f.endswith("*")} | {f for f in vocabulary if not f.endswith("*")}
        self.base = {f: i for i, f in enumerate(sorted(known))}
        self.names = sorted(known)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > self.kept:
            self.clear()
        found = self[word] = tuple(self.base[f] for f in features_of(word) if f in self.base)
        return found

    def of(self, text: str) -> list[int]:
        out = set()
        for i, n in Counter(chain.from_iterable(map(self.__getitem__, words_of(text)))).items():
            for f in (self.names[i], self.names[i] + "*")[: 1 + (n > 1)]:
                if f in self.vocabulary:
                    out.add(self.vocabulary[f])
        return sorted(out)


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, texts: list[str], index: FeatureIndex | None = None) -> np.ndarray:
        index = FeatureIndex(self.vocabulary) if index is None else index
        found = [index.of(t) for t in texts]
        lengths = np.array([len(f) for f in found], dtype=np.int64)
        flat = np.array([i for f in found for i in f], dtype=np.int64)
        return 1 / (1 + np.exp(-(segment_sums(self.weights[flat], lengths) + self.bias)))


def pu_risk(margin: np.ndarray, positive: np.ndarray, prior: float, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The non-negative PU risk of margins under the logistic loss, and the gradient that a step follows.

    Both classes have a member. Where the negative risk is below zero the step goes back from it.
    """
    n_pos, n_unl = positive.sum(), (~positive).sum()
    p, softplus = 1 / (1 + np.exp(-margin)), np.logaddexp(0, margin)
    negative_risk = softplus[~positive].sum() / n_unl - prior * softplus[positive].sum() / n_pos
    g = np.zeros(len(margin))  # d loss(+) = p - 1, d loss(-) = p
    if negative_risk >= 0:
        g[positive] = -prior / n_pos
        g[~positive] = p[~positive] / n_unl
    else:
        g[positive] = gamma * prior * p[positive] / n_pos
        g[~positive] = -gamma * p[~positive] / n_unl
    return float(prior * np.logaddexp(0, -margin[positive]).sum() / n_pos + max(0.0, negative_risk)), g


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, epochs: int = 800, sparsity: float = 3e-4, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative PU risk with the logistic loss; ``rows`` hold feature numbers.

    Accelerated proximal gradient steps; ``sparsity`` is the L1 weight, which leaves words without a
    say of their own at 0, so that long texts don't gather noise. Where one class is empty the
    weights are 0 and the bias is that of the prior.
    """
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    w, b = np.zeros(n_features), math.log(prior / (1 - prior))
    if not positive.any() or positive.all():
        return w, b
    rate = 1 / (0.25 * (2 * prior * (1 + lengths[positive]).mean() + (1 + lengths[~positive]).mean()) + 1e-9)
    at_w, at_b, pace = w, b, 1.0
    for _ in range(epochs):
        _, g = pu_risk(segment_sums(at_w[flat], lengths) + at_b, positive, prior, gamma)
        step = at_w - rate * np.bincount(flat, weights=g[owner], minlength=n_features)
        new_w = np.sign(step) * np.maximum(0, np.abs(step) - rate * sparsity)
        new_b = at_b - rate * g.sum()
        new_pace = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        move = (pace - 1) / new_pace
        at_w, at_b = new_w + move * (new_w - w), new_b + move * (new_b - b)
        w, b, pace = new_w, new_b, new_pace
    return w, b


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, vocabulary: int = VOCABULARY, bags: int = BAGS) -> ToxicityModel:
    """The model of the rows that may be learned from; scores everything 0 where no positive label is known."""
    bound_batches(docs.sparkSession)
    known = labels.where(may_learn()).where("toxic is not null")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    if not size["n"] or not size["p"]:
        return ToxicityModel({}, np.zeros(0), -math.inf, 0.0)
    prior = min(0.9, size["p"] / size["n"])
    unit = hash_unit("doc_id", seed=1)
    texts = docs.where(may_learn()).where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", unit.alias("u"))
    n_docs = max(1, texts.count())
    chosen = known.where("toxic = 1").where(hash_unit("doc_id", seed=1) < min(1.0, positives / size["p"])).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    toxic = [r["doc_id"] for r in chosen.limit(2 * positives).collect()]
    is_positive = F.col("doc_id").isin(toxic) if len(toxic) < 200 else None
    if is_positive is None:
        marked = texts.join(F.broadcast(chosen.withColumn("pos", F.lit(True))), "doc_id", "left")  # bounded by the positives' sample
    else:
        marked = texts.withColumn("pos", is_positive)
    sample = marked.where(F.col("pos") | (F.col("u") < min(1.0, unlabelled / n_docs))).select("doc_id", "text", F.coalesce("pos", F.lit(False)).alias("pos"))
    sample = sample.dropDuplicates(["text", "pos"])  # a group of copies says no more than one of them

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, pos in zip(batch.column("text").to_pylist(), batch.column("pos").to_pylist()):
                seen[pos].update(features_of_text(text))
        words = list(seen[0].keys() | seen[1].keys())
        yield record_batch([("word", pa.string()), ("p", pa.int64()), ("u", pa.int64())], word=words, p=[seen[1][w] for w in words], u=[seen[0][w] for w in words])

    tallied = sample.select("text", "pos").mapInArrow(count, "word string, p long, u long").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 5")
    n = sample.groupBy("pos").count().collect()
    if len(n) < 2:
        return ToxicityModel({}, np.zeros(0), math.log(prior / (1 - prior)), prior)
    n_pos, n_unl = (float(next((r["count"] for r in n if r["pos"] is x), 0) + 1) for x in (True, False))
    lift = F.log((F.col("p") + 0.5) / n_pos) - F.log((F.col("u") + 0.5) / n_unl)
    common = F.col("p") + F.col("u") >= LEAST_SHARE * (n_pos + n_unl * prior)
    z = F.abs(lift) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    best = tallied.where(common & (z >= LEAST_Z)).orderBy(F.desc(z), "word").limit(vocabulary).collect()
    index = {w: i for i, w in enumerate(sorted(r["word"] for r in best))}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = FeatureIndex(index)
        for batch in batches:
            found = [known.of(t) for t in batch.column("text").to_pylist()]
            yield record_batch([("doc_id", pa.int64()), ("pos", pa.bool_()), ("found", pa.list_(pa.int32()))], doc_id=batch.column("doc_id"), pos=batch.column("pos"), found=found)

    table = sample.mapInArrow(features, "doc_id long, pos boolean, found array<int>").toArrow().sort_by("doc_id")
    rows = [np.array(f, dtype=np.int64) for f in table.column("found").to_pylist()]
    positive = np.array(table.column("pos").to_pylist(), dtype=bool)
    fits = []
    for bag in range(bags):
        part = [i for i in range(len(rows)) if positive[i] or bags == 1 or i % bags != bag]
        fits.append(fit_bag([rows[i] for i in part], positive[part], len(index), prior))
    return ToxicityModel(index, np.mean([w for w, _ in fits], axis=0), float(np.mean([b for _, b in fits])), prior)


def best_bin_prior(score: np.ndarray, positive: np.ndarray, least: float = 0.2) -> float:
    """An upper bound of the share of positives among the unlabelled: the smallest ratio of the two
    groups' shares above any score that at least ``least`` of the positives reach."""
    cuts = np.unique(np.quantile(score[positive], np.linspace(0, 1 - least, 33)))
    return min(((score[~positive] >= c).mean() + 1 / max(1, (~positive).sum())) / (score[positive] >= c).mean() for c in cuts)


def fit_bag(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """One classifier: words are chosen under the L1 weight, then weighed without it, with the class
    prior among the unlabelled (at most that among the labelled) estimated in between."""
    w, b = fit_nnpu(rows, positive, n_features, prior)
    if not positive.any() or positive.all():
        return w, b
    chosen = np.abs(w) > 0.01
    rows = [r[chosen[r]] for r in rows]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    score = segment_sums(w[np.concatenate(rows).astype(np.int64)], lengths)
    return fit_nnpu(rows, positive, n_features, min(prior, best_bin_prior(score, positive)), sparsity=0.0)


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts have no word and get the score of the bias alone. Ids may be null or
    repeated; an empty table gives an empty one; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = FeatureIndex(shared.value.vocabulary)
        for batch in batches:
            if batch.num_rows:
                score = shared.value.score([t or "" for t in batch.column("text").to_pylist()], index)
                yield record_batch(_OUT, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=score, predicted=(score >= threshold).astype(np.int32))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return predict(docs, train(docs, labels, **options))
