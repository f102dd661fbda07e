"""Pluggable services with deterministic offline forms (S1 to S9, L1 to L5 and their ports).

A service is a small object with DataFrame-to-DataFrame methods, so a live one may batch its calls in
``mapInArrow`` and an offline one may be plain Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.text import anchor_sequence, anchors, cache_key, label
from lodestone.operators.ranking import rank_by_terms


@runtime_checkable
class SearchProvider(Protocol):
    def search(self, queries: DataFrame, limit: int = K.RESULTS_PER_QUERY, since_year: int | None = None) -> DataFrame: ...

    def scrape(self, urls: DataFrame) -> DataFrame: ...


@runtime_checkable
class EmbeddingsProvider(Protocol):
    def embed(self, texts: DataFrame, kind: str) -> DataFrame: ...


@runtime_checkable
class VectorStore(Protocol):
    def rank(self, questions: DataFrame, passages: DataFrame, k: int) -> DataFrame: ...


@runtime_checkable
class LanguageModel(Protocol):
    def plan_searches(self, questions: DataFrame) -> DataFrame: ...

    def generate_answer(self, questions: DataFrame, passages: DataFrame) -> DataFrame: ...

    def refine_query(self, questions: DataFrame) -> DataFrame: ...

    def grade_relevance(self, questions: DataFrame, passages: DataFrame) -> DataFrame: ...

    def grade_answer(self, questions: DataFrame, claims: DataFrame) -> DataFrame: ...


@dataclass
class CorpusSearch:
    """S1 to S3 over a table of pages (url, title, markdown and, if dates matter, published_year)."""

    pages: DataFrame

    def search(self, queries: DataFrame, limit: int = K.RESULTS_PER_QUERY, since_year: int | None = None) -> DataFrame:
        """(question_id, query_idx, rank, title, url, snippet) for (question_id, query_idx, query): BM25, best first; null words count as empty."""
        pages = self.pages if since_year is None else self.pages.where(F.col("published_year") >= since_year)
        keyed = queries.select(F.struct("question_id", "query_idx").alias("question_id"), F.col("query").alias("question"))
        texts = pages.select("url", F.concat_ws("\n", "title", "markdown").alias("text"))
        ranked = rank_by_terms(keyed, texts, "url", "text", limit)
        found = ranked.join(pages.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(label("markdown", 300), F.lit("")).alias("snippet")), "url")
        return found.select("question_id.*", "rank", "title", "url", "snippet")

    def scrape(self, urls: DataFrame) -> DataFrame:
        """(url, title, markdown) of the given urls; those the table lacks come with nulls."""
        return urls.select("url").distinct().join(self.pages.select("url", "title", "markdown"), "url", "left")


@dataclass
class TableEmbeddings:
    """S5 over vectors that were computed before: (cache_key, embedding)."""

    vectors: DataFrame

    def embed(self, texts: DataFrame, kind: str = "d") -> DataFrame:
        return texts.withColumn("cache_key", cache_key(kind, "text")).join(self.vectors, "cache_key", "left")


def cache_misses(texts: DataFrame, cache: DataFrame, now, seconds: int = K.CACHE_SECONDS, kind: str = "d") -> DataFrame:
    """The distinct texts that the cache (cache_key, cached_at) has no fresh vector for."""
    fresh = cache.where(F.col("cached_at").cast("timestamp").cast("double") + seconds > F.lit(now).cast("timestamp").cast("double")).select("cache_key")
    return texts.withColumn("cache_key", cache_key(kind, "text")).dropDuplicates(["cache_key"]).join(fresh, "cache_key", "left_anti")


def evict(cache: DataFrame, now, most: int, seconds: int = K.CACHE_SECONDS, key: str = "cache_key") -> DataFrame:
    """What a cache keeps: entries younger than ``seconds``, the ``most`` used last."""
    fresh = cache.where(F.col("cached_at").cast("timestamp").cast("double") + seconds > F.lit(now).cast("timestamp").cast("double"))
    return fresh.orderBy(F.desc("used_at"), key).limit(most)


def embed_in_batches(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], size: int = K.EMBED_BATCH, attempts: int = 3, key: str = "chunk_id") -> DataFrame:
    """(key, embedding) from a live service, ``size`` texts a call; a refused call alone is sent again."""
    import pyarrow as pa

    key_type = dict(texts.dtypes)[key]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for attempt in range(attempts):
                    try:
                        vectors = embed(part.column("text").to_pylist())
                        break
                    except Exception:
                        if attempt == attempts - 1:
                            raise
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(vectors, pa.list_(pa.float64()))], names=[key, "embedding"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {key_type}, embedding array<double>")


@dataclass
class RuleModel:
    """S8, L1 to L5 by rules: the contract of a language model's calls without one."""

    def plan_searches(self, questions: DataFrame) -> DataFrame:
        """(question_id, idx, query): the question, its anchors alone, with a word for it where ``recent`` says so, and its first two."""
        subject = F.array_join(anchors("question"), " ")
        if "recent" in questions.columns:
            subject = F.when(F.col("recent"), F.concat(subject, F.lit(" recent"))).otherwise(subject)
        head = F.array_join(F.slice(anchor_sequence("question"), 1, 2), " ")
        return questions.select("question_id", F.posexplode(F.array(F.col("question"), subject, head)).alias("idx", "query"))

    def grade_relevance(self, questions: DataFrame, batched: DataFrame) -> DataFrame:
        """(question_id, batch_id, relevant_ids): passages that name one of the question's anchors."""
        joined = batched.join(questions.select("question_id", "question"), "question_id")
        hit = F.size(F.array_intersect(anchors("text"), anchors("question"))) > 0
        return joined.groupBy("question_id", "batch_id").agg(F.array_sort(F.collect_list(F.when(hit, F.col("chunk_id")))).alias("relevant_ids"))

    def generate_answer(self, questions: DataFrame, passages: DataFrame) -> DataFrame:
        """(question_id, claim_idx, text, evidence_ids, confidence, theme): a claim of each of the first passages."""
        first = passages.where(F.col("place") < 5)
        text = F.trim(F.regexp_extract("text", r"(?s)^(.{1,240}?)(?:[.!?]\s|$)", 1))
        return first.select("question_id", F.col("place").alias("claim_idx"), text.alias("text"), F.array("chunk_id").alias("evidence_ids"), F.lit("medium").alias("confidence"), F.lit("").alias("theme")).where("text <> ''")

    def grade_answer(self, questions: DataFrame, claims: DataFrame) -> DataFrame:
        """(question_id, is_satisfactory, problem, missing, reasoning): two claims or more will do."""
        n = claims.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
        joined = questions.select("question_id", "question").join(n, "question_id", "left")
        enough = F.coalesce("n", F.lit(0)) >= 2
        return joined.select("question_id", enough.alias("is_satisfactory"), F.when(enough, "none").otherwise("too_thin").alias("problem"), F.when(enough, "").otherwise(F.array_join(anchors("question"), " ")).alias("missing"), F.lit("").alias("reasoning"))

    def refine_query(self, questions: DataFrame) -> DataFrame:
        """(question_id, search_query): the question's anchors without the words about research."""
        return questions.select("question_id", F.array_join(anchors("question"), " ").alias("search_query"))


@dataclass
class Registry:
    """Providers by name; an unknown name fails when a session is set up, not when a query runs."""

    builders: dict[str, Callable[[], LanguageModel]] = field(default_factory=lambda: {"rules": RuleModel})

    def register(self, name: str, build: Callable[[], LanguageModel]) -> None:
        self.builders[name] = build

    def require(self, name: str) -> LanguageModel:
        if name not in self.builders:
            raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(self.builders))}")
        return self.builders[name]()
