"""Queries over stored indexes: the inverted one for BM25 and the one of vectors, each built first and then grown by new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.operators import inverted, ranking, vector_index
from lodestone.plans.registry import query, sql_list
from lodestone.session import read_table

_FOLDED = "CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
_TERMS_SQL = f"""q AS (
    SELECT DISTINCT item_id AS question_id, unnest(list_transform(list_filter(regexp_extract_all(lower(text), '{K.LETTERS}'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(K.GENERIC_WORDS)}, w)), lambda w: {_FOLDED})) AS term
    FROM benchmark
  ),
  tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{K.WORD}')) AS w FROM documents),
  tf AS (SELECT doc_id, {_FOLDED} AS term, count(*) AS tf FROM tok GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term)"""


def _grown(spark: SparkSession, sf_dir: str) -> inverted.InvertedIndex:
    """An index of six in seven documents to which the others are added."""
    docs = read_table(spark, sf_dir, "documents")
    return inverted.build_index(docs.where("doc_id % 7 <> 0")).add(docs.where("doc_id % 7 = 0"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query(f"""WITH {_TERMS_SQL},
  len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{K.WORD}')) AS length FROM documents),
  st AS (SELECT count(*)::DOUBLE AS n, coalesce(nullif(avg(length::DOUBLE), 0), 1) AS a FROM len),
  bm AS (
    SELECT question_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / a))), 9) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY question_id, doc_id
  )
  SELECT question_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm) WHERE rank < 10""")
def w3_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each question from a stored index that grew once."""
    return inverted.search_index(_grown(spark, sf_dir), _questions(spark, sf_dir))


@query(f"""WITH {_TERMS_SQL} SELECT question_id, sum(df)::BIGINT AS of_terms, true AS within FROM q JOIN df USING (term) GROUP BY question_id""")
def w3_index_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of each question's terms in the index; ``within`` says that the search reads no more than these."""
    read = inverted.postings_read(inverted.plan_search(_grown(spark, sf_dir), _questions(spark, sf_dir), K.RESULTS_PER_QUERY))
    return read.select("question_id", "of_terms", (F.col("read") <= F.col("of_terms")).alias("within"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame, DataFrame]:
    """An index of six in seven vectors to which the others are added, all vectors, and every hundredth as a query."""
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector_index.build_vector_index(v.where("chunk_id % 7 <> 0")).add(v.where("chunk_id % 7 = 0"))
    return index, v, v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id")


@query("""WITH qv AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
  d AS (SELECT question_id, vec_id AS chunk_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings, qv)
  SELECT question_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) - 1 AS rank FROM d) WHERE rank < 10""")
def w1_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 100, by an index that grew once."""
    index, _, queries = _vectors(spark, sf_dir)
    return vector_index.search_vectors(index, queries, 10).rows


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * least(10, count(*)) AS asked, true AS nine_in_ten FROM embeddings")
def w1_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate search held against all vectors; ``nine_in_ten`` says whether it finds so many of the neighbours."""
    index, v, queries = _vectors(spark, sf_dir)
    few = vector_index.search_vectors(index, queries, 10, exact=False).rows
    found = vector_index.recall(few, ranking.rank_by_distance(queries, v, 10))
    return found.select("asked", (F.col("found") >= 0.9 * F.col("asked")).alias("nine_in_ten"))
