"""Queries of the services in their offline forms: the model's five calls by rules, and vectors in batches and from a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.text import cache_key
from lodestone.plans.registry import query, sql_list
from lodestone.plans.stage import session_folder
from lodestone.session import read_table
from lodestone.sources import providers, tables
from lodestone.sources.cache import CacheTable
from lodestone.sources.quota import Quota, call_within

_FOLDED = "CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"


def _sequence_sql(column: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({column}), '{K.LETTERS}'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(K.GENERIC_WORDS)}, w))"
    return f"list_transform({kept}, lambda w: {_FOLDED})"


_ANCHORED = "list_filter(s, lambda x, i: list_position(s, x) = i)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query(f"""WITH q AS (SELECT item_id, text, {_sequence_sql('text')} AS s FROM benchmark)
  SELECT item_id AS question_id, 0 AS idx, text AS query FROM q UNION ALL SELECT item_id, 1, array_to_string({_ANCHORED}, ' ') FROM q UNION ALL SELECT item_id, 2, array_to_string(s[1:2], ' ') FROM q""")
def l1_planned_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.RuleModel().plan_searches(_questions(spark, sf_dir)).select("question_id", F.col("idx").cast("int").alias("idx"), "query")


@query(f"WITH q AS (SELECT item_id, {_sequence_sql('text')} AS s FROM benchmark) SELECT item_id AS question_id, array_to_string({_ANCHORED}, ' ') AS search_query FROM q")
def l5_refined_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.RuleModel().refine_query(_questions(spark, sf_dir))


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first turns of conversations as questions, all turns as their passages."""
    c = read_table(spark, sf_dir, "conversations")
    questions = c.where("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    passages = c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("chunk_id"), F.col("turn").alias("place"), F.floor(F.col("turn") / 3).cast("int").alias("batch_id"), "text")
    return questions, passages


@query(f"""WITH f AS (SELECT conv_id, {_sequence_sql('text')} AS q FROM conversations WHERE turn = 0),
  t AS (SELECT conv_id, turn, (turn // 3)::INT AS batch_id, list_has_any({_sequence_sql('text')}, q) AS hit FROM conversations JOIN f USING (conv_id))
  SELECT conv_id AS question_id, batch_id, coalesce(string_agg(CASE WHEN hit THEN turn::VARCHAR END, ',' ORDER BY turn), '') AS relevant FROM t GROUP BY ALL""")
def l3_graded_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = providers.RuleModel().grade_relevance(*_turns(spark, sf_dir))
    return graded.select("question_id", "batch_id", F.array_join(F.col("relevant_ids").cast("array<string>"), ",").alias("relevant"))


_CLAIMS_SQL = r"claims AS (SELECT conv_id AS question_id, turn AS claim_idx, trim(regexp_extract(text, '(?s)^(.{1,240}?)(?:[.!?]\s|$)', 1)) AS text FROM conversations WHERE turn < 5)"


@query(f"WITH {_CLAIMS_SQL} SELECT question_id, claim_idx, text, claim_idx::VARCHAR AS evidence FROM claims WHERE text <> ''")
def l2_generated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = providers.RuleModel().generate_answer(*_turns(spark, sf_dir))
    return claims.select("question_id", "claim_idx", "text", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("evidence"))


@query(f"""WITH {_CLAIMS_SQL}, n AS (SELECT question_id, count(*) AS n FROM claims WHERE text <> '' GROUP BY question_id), q AS (SELECT conv_id, {_sequence_sql('text')} AS s FROM conversations WHERE turn = 0)
  SELECT conv_id AS question_id, coalesce(n, 0) >= 2 AS is_satisfactory, CASE WHEN coalesce(n, 0) >= 2 THEN 'none' ELSE 'too_thin' END AS problem, CASE WHEN coalesce(n, 0) >= 2 THEN '' ELSE array_to_string({_ANCHORED}, ' ') END AS missing FROM q LEFT JOIN n ON question_id = conv_id""")
def l4_graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, (questions, passages) = providers.RuleModel(), _turns(spark, sf_dir)
    return model.grade_answer(questions, model.generate_answer(questions, passages)).select("question_id", "is_satisfactory", "problem", "missing")


def _measured(texts: list[str]) -> list[list[float]]:
    """A stand-in for a service: it refuses more texts than a call may have."""
    if len(texts) > K.EMBED_BATCH:
        raise ValueError("too many texts in one call")
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query("SELECT doc_id AS chunk_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS b, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS c FROM documents")
def s7_embedded_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a service that takes a hundred texts a call."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = providers.embed_in_batches(docs, _measured)
    return found.select("chunk_id", *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate("abc")])


def _moody(texts: list[str]) -> list[list[float]]:
    """A stand-in for a service that is refused or fails by what it is sent."""
    for t in texts:
        if len(t) % 11 == 0:
            raise ValueError("this text can't be read")
        if len(t) % 7 == 0:
            raise ValueError("Error 429: rate limit")
        if len(t) % 5 == 0:
            raise ValueError("503 unavailable")
    return [[float(len(t))] for t in texts]


@query("""SELECT doc_id AS chunk_id, CASE WHEN length(text) % 11 = 0 THEN 'other' WHEN length(text) % 7 = 0 THEN 'rate_limit' WHEN length(text) % 5 = 0 THEN 'transient' END AS error_kind,
  CASE WHEN length(text) % 11 <> 0 AND length(text) % 7 <> 0 AND length(text) % 5 <> 0 THEN length(text)::DOUBLE END AS size,
  CASE WHEN length(text) % 11 <> 0 AND (length(text) % 7 = 0 OR length(text) % 5 = 0) THEN 3 ELSE 1 END AS calls FROM documents""")
def s7_calls_within_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document sent by itself within a quota, again after refusals by rate and passing faults."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = call_within(docs, _moody, Quota(1_000_000, window=1.0, least=1e-6, most=1e-6), size=1)
    return found.select("chunk_id", "error_kind", F.get("embedding", F.lit(0)).alias("size"), "calls")


@query("""WITH v AS (SELECT DISTINCT 'd:' || sha256(text) AS cache_key, length(text)::DOUBLE AS size FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
  SELECT doc_id, size FROM (SELECT doc_id, 'd:' || sha256(text) AS cache_key FROM documents) LEFT JOIN v USING (cache_key)""")
def s5_table_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors from a table, which has those of good documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = docs.join(read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    vectors = good.select(cache_key("d", "text").alias("cache_key"), F.array(F.length("text").cast("double")).alias("embedding")).distinct()
    return providers.TableEmbeddings(vectors).embed(docs).select("doc_id", F.get("embedding", F.lit(0)).alias("size"))


_FIRST_RUN, _SECOND_RUN = "2026-01-01 10:00:00", "2026-01-01 10:30:00"
_CACHED_SQL = """k AS (SELECT doc_id, text, 'd:' || sha256(text) AS cache_key FROM documents),
  good AS (SELECT DISTINCT cache_key FROM k JOIN labels USING (doc_id) WHERE quality = 1)"""


def _filled_cache(spark: SparkSession, sf_dir: str, second: str) -> tuple[CacheTable, DataFrame]:
    """A cache after two runs, over good documents and half an hour later over those that ``second`` says; and the latter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", cache_key("d", "text").alias("cache_key"))
    cache = CacheTable(spark, f"vectors-{uuid.uuid4().hex}")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    cache.through(docs.join(good, "doc_id", "left_semi"), _measured, _FIRST_RUN)
    return cache, cache.through(docs.where(second), _measured, _SECOND_RUN)


@query(f"""WITH {_CACHED_SQL}
  SELECT doc_id, length(text)::DOUBLE AS size, cache_key NOT IN (SELECT cache_key FROM good) AS called_again FROM k""")
def s6_write_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a cache that has those of good ones; only the others are sent to the service again."""
    cache, found = _filled_cache(spark, sf_dir, "true")
    kept = cache.read(_SECOND_RUN).select("cache_key", (F.col("cached_at") == F.lit(_SECOND_RUN).cast("timestamp")).alias("called_again"))
    return found.join(kept, "cache_key").select("doc_id", F.get("value", F.lit(0)).alias("size"), "called_again")


@query(f"""WITH {_CACHED_SQL}, used AS (SELECT cache_key, max(doc_id % 3 = 0) AS again FROM k GROUP BY cache_key)
  SELECT cache_key FROM used WHERE again OR cache_key IN (SELECT cache_key FROM good) ORDER BY again DESC, cache_key LIMIT {K.PAGE_CACHE_ROWS}""")
def s4_evicted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache keeps of two runs: the entries that were used last."""
    cache, _ = _filled_cache(spark, sf_dir, "doc_id % 3 = 0")
    cache.evict(_SECOND_RUN, K.PAGE_CACHE_ROWS)
    return cache.read(_SECOND_RUN).select("cache_key")


_LINE_SQL = """'{"event_id":' || event_id || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || ',"event_type":"' || event_type || '"}'"""


@query(f"""WITH l AS (SELECT *, {_LINE_SQL} AS whole FROM events)
  SELECT event_id, user_id, event_type, NULL AS rejected FROM l WHERE event_id % 10 <> 3 UNION ALL SELECT NULL, NULL, NULL, left(whole, length(whole) // 2) FROM l WHERE event_id % 10 = 3""")
def s12_records_and_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, one in ten of them torn, written and read back; torn lines come as they are."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    whole = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    line = F.when(F.col("event_id") % 10 == 3, F.left(whole, F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
    path = f"{session_folder(spark)}/records-{uuid.uuid4().hex}"
    events.select(line.alias("value")).write.text(path)
    records, rejects = tables.split_records(spark, path, "event_id long, user_id long, event_type string")
    return records.withColumn("rejected", F.lit(None).cast("string")).unionByName(rejects.select(F.col("line").alias("rejected")), allowMissingColumns=True)
