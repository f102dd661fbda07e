"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of orders 1 to 3 of lower-cased text into 2**16 buckets for each language,
on a bounded sample of labelled rows (``docs_per_language`` of each, those with the smallest hashes).
The smoothed log-probability matrix (buckets x languages, float64: 512 KB for each language) is
broadcast, in blocks of at most 256 languages; documents are scored in Arrow batches: all n-grams of a batch are hashed at once, their
matrix rows are gathered and summed by document. Every n-gram of every whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, hash_unit, held_out, materialize, may_learn, record_batch, segment_sums, spans_of_chars

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
DOCS_PER_LANGUAGE = 1500
UNDETERMINED = "und"
#: Languages of one matrix (128 MB); more are scored block by block, and a process holds one block at a time.
BLOCK_LANGUAGES = 256

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)


def ngram_buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of ``codes`` (uint32 code points), as many as there are places to start."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    h = np.full(n, order, dtype=np.uint32)
    for k in range(order):
        h ^= codes[k : k + n]
        h *= _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray

    def score(self, texts: list[str], piece: int = 1 << 19) -> np.ndarray:
        """Log-likelihoods, texts x languages; a text's sum is taken in pieces at the same places in any batch."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in spans_of_chars(texts, piece):
            if b - a == 1 and len(texts[a]) > piece:
                codes = _codes(texts[a])
                for order in ORDERS:
                    for i in range(0, max(0, len(codes) - order + 1), piece):
                        out[a] += self.log_prob[ngram_buckets(codes[i : i + piece + order - 1], order)].sum(axis=0)
                continue
            each = [_codes(t) for t in texts[a:b]]
            lengths = np.array([len(c) for c in each])
            flat = np.concatenate(each) if each else np.empty(0, np.uint32)
            owner = np.repeat(np.arange(b - a, dtype=np.int32), lengths)
            for order in ORDERS:
                buckets = ngram_buckets(flat, order)
                if order > 1:  # without those that span two texts
                    buckets = buckets[owner[: len(buckets)] == owner[order - 1 :]] if len(buckets) else buckets
                counts = np.maximum(0, lengths - order + 1)
                out[a:b] += segment_sums(self.log_prob[buckets], counts)
        return out + self.log_prior


def has_letter(text: str) -> bool:
    if any(c.isalpha() for c in text[:64]):
        return True
    return any(c.isalpha() for c in text)


def train_blocks(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, smoothing: float = 0.5, block: int = BLOCK_LANGUAGES) -> Iterator[LanguageModel]:
    """Models of at most ``block`` languages each, by name, of the rows with a language that may be learned from (doc_id, text, lang)."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.where(may_learn()).where("lang is not null and text is not null").select("doc_id", "text", "lang", hash_unit("doc_id", seed=8).alias("u"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        yield LanguageModel([UNDETERMINED], np.zeros((1 << BUCKET_BITS, 1)), np.zeros(1))
        return
    shares = spark.createDataFrame([(name, min(1.0, docs_per_language / sizes[name])) for name in names], "lang string, share double")

    def emitted(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in total.items():
            full = np.flatnonzero(counts)
            yield record_batch([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())], lang=[lang] * len(full), bucket=full.astype(np.int32), n=counts[full])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if lang not in total and len(total) >= 64:  # 32 MB
                    yield from emitted(total)
                    total = {}
                counts = total.setdefault(lang, np.zeros(1 << BUCKET_BITS, dtype=np.int64))
                codes = _codes(text)
                for order in ORDERS:
                    counts += np.bincount(ngram_buckets(codes, order), minlength=1 << BUCKET_BITS)
        yield from emitted(total)

    sample = rows.join(F.broadcast(shares), "lang").where(F.col("u") < F.col("share")).select("text", "lang")
    counted = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(names) > block:
        counted = materialize(counted, "language-counts")
    all_rows = sum(sizes.values())
    for i in range(0, len(names), block):
        own = names[i : i + block]
        part = (counted if len(names) <= block else counted.where(F.col("lang").between(own[0], own[-1]))).toArrow()
        matrix = np.full((1 << BUCKET_BITS, len(own)), smoothing)
        place = {name: k for k, name in enumerate(own)}
        column = np.array([place.get(x, -1) for x in part.column("lang").to_pylist()], dtype=np.int64)
        mine = column >= 0
        matrix[part.column("bucket").to_numpy()[mine], column[mine]] += part.column("n").to_numpy()[mine]
        matrix = np.log(matrix) - np.log(matrix.sum(axis=0))
        yield LanguageModel(own, matrix, np.log(np.array([sizes[n] for n in own], dtype=float) / all_rows))


def train(docs: DataFrame, **options) -> LanguageModel:
    """One model of all languages, 512 KB for each."""
    blocks = list(train_blocks(docs, **options))
    return LanguageModel([n for b in blocks for n in b.languages], np.hstack([b.log_prob for b in blocks]), np.concatenate([b.log_prior for b in blocks]))


def broadcast_model(docs: DataFrame, **options) -> list[Broadcast]:
    """A broadcast for each block of languages; the driver holds one block at a time."""
    return [docs.sparkSession.sparkContext.broadcast(m) for m in train_blocks(docs, **options)]


def judged(blocks: list[Broadcast], texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Best language of each text, the first by name of equals, and its score."""
    size = np.sqrt(np.maximum(1, np.array([len(t) for t in texts], dtype=float)))
    names: list[str] = [UNDETERMINED] * len(texts)
    top, total = np.full(len(texts), -np.inf), np.zeros(len(texts))
    for shared in blocks:
        model = shared.value
        log = model.score(texts)
        best, high = log.argmax(axis=1), log.max(axis=1)
        summed = np.exp((log - high[:, None]) / size[:, None]).sum(axis=1)
        now = np.maximum(top, high)
        total = total * np.exp((top - now) / size) + summed * np.exp((high - now) / size)
        for i in np.flatnonzero(high > top).tolist():
            names[i] = model.languages[best[i]]
        top = now
        del model
        if len(blocks) > 1:
            vars(shared).pop("_value", None)  # it is read again from the local file
    return names, 1 / total


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]


def predict(docs: DataFrame, model: LanguageModel | list[Broadcast]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    ``und`` with score 0 where the text is null, empty or has no letter. The score is the posterior
    of the likelihood tempered by the square root of the text's length, so short texts are less sure;
    ties go to the language that is first by name. Ids may be null or repeated; an empty table gives
    an empty one; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    shared = model if isinstance(model, list) else [docs.sparkSession.sparkContext.broadcast(model)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, score = judged(shared, texts)
            known = [has_letter(t) for t in texts]
            yield record_batch(
                _OUT,
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                lang_pred=[n if k else UNDETERMINED for n, k in zip(names, known)],
                score=np.where(known, score, 0.0),
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **train_options) -> DataFrame:
    """Trains on the rows that may be learned from and predicts the language of all."""
    return predict(docs, broadcast_model(docs, **train_options))


def keep_identified(docs: DataFrame, min_score: float = 0.0, relabel: bool = False, **train_options) -> DataFrame:
    """The rows of ``docs`` that op8 does not call ``und``, with all columns; with ``min_score`` only those scored so high.

    Every row is judged by the model; where ``lang`` is null it becomes the language that op8 predicts. With ``relabel``
    it does so in every row, but for those given in a language that the model could not learn.
    """
    bound_batches(docs.sparkSession)
    shared, learned = [], set()
    for model in train_blocks(docs, **train_options):
        shared.append(docs.sparkSession.sparkContext.broadcast(model))
        learned.update(model.languages if relabel else ())
    at = docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            names, score = judged(shared, texts)
            known = pa.array([bool(s) and has_letter(t) for s, t in zip(score >= min_score, texts)], pa.bool_())
            given = batch.column("lang")
            if relabel:
                given = pa.array([None if lang in learned else lang for lang in given.to_pylist()], given.type)
            yield batch.set_column(at, batch.schema.field(at), pc.coalesce(given, pa.array(names, given.type))).filter(known)

    return docs.mapInArrow(keep, docs.schema)
