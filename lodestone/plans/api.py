"""The entry points of the engine: search, documents, answers, and answers with their trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.operators.passages import lines
from lodestone.operators.ranking import top_k
from lodestone.plans.research import Research
from lodestone.plans.trail import numbered
from lodestone.sources.providers import SearchProvider
from lodestone.sources.tables import valid_requests
from lodestone.streaming.activity import frame


def search(provider: SearchProvider, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, rejects) for requests (question_id, question, limit): each at most its own limit."""
    checked = valid_requests(requests)
    good = checked.where("valid")
    found = provider.search(good.select("question_id", F.lit(0).alias("query_idx"), F.col("question").alias("query")), 20)
    limited = found.join(good.select("question_id", "limit"), "question_id").where("rank < limit").select("question_id", "rank", "title", "url", "snippet")
    return limited, checked.where("not valid").select("question_id", "reason")


def documents(provider: SearchProvider, urls: DataFrame) -> DataFrame:
    """(url, title, line_number, text) of the pages of ``urls``; a page that isn't known gives no line."""
    pages = provider.scrape(urls)
    return lines(pages, "url", "markdown").join(pages.select("url", "title"), "url").select("url", "title", "line_number", "text")


def answer(research: Research, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, rejects) for requests (question_id, question)."""
    checked = valid_requests(requests.withColumn("limit", F.lit(5)))
    answers = research.run(checked.where("valid").select("question_id", "question"))
    return answers, checked.where("not valid").select("question_id", "reason")


def answer_frames(research: Research, requests: DataFrame) -> DataFrame:
    """(question_id, seq, event, frame): the trail of each answer as events, then one result or, for a reject, one error."""
    answers, rejects = answer(research, requests)
    steps = numbered(research.trail()).select("question_id", "seq", F.lit("activity").alias("event"), F.to_json(F.struct("kind", "label", "url", "title", "detail", "attempt")).alias("data"))
    last = steps.groupBy("question_id").agg((F.max("seq") + 1).alias("seq"))
    result = answers.join(last, "question_id", "left").select("question_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.lit("result").alias("event"), F.to_json(F.struct("question", "claims", "evidence_sufficient")).alias("data"))
    error = rejects.select("question_id", F.lit(0).alias("seq"), F.lit("error").alias("event"), F.to_json(F.struct("reason")).alias("data"))
    return steps.unionByName(result).unionByName(error).select("question_id", "seq", "event", frame(F.col("event"), F.col("data")).alias("frame"))


def best_results(results: DataFrame, k: int = K.RESULTS_PER_QUERY) -> DataFrame:
    """The first ``k`` results of each question over its queries, by rank and query."""
    return top_k(results, k, [F.col("rank"), F.col("query_idx")], rank="place")
