"""One query for each operator, over the driver's tables, and SQL for those that SQL can express.

The tables stand for the domain's: documents for pages that were read and their passages, pages for
search results, benchmark for questions, embeddings for vectors, labels for verdicts, conversations
and events for trails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions import text
from lodestone.operators import evidence, mirrors, passages, ranking, selection
from lodestone.plans import api, index_queries, provider_queries, text_queries  # noqa: F401  they register their own
from lodestone.plans.registry import ORACLE_SQL, QUERIES, choice, query, sql_list
from lodestone.plans.research import Research
from lodestone.plans.stage import session_folder
from lodestone.session import read_table
from lodestone.sources import providers, tables
from lodestone.streaming import activity

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

TODAY = 2026
PAGES_A_QUESTION = 12


# Views of the driver's tables, the same in Spark and in SQL.


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as the search results of four queries to each question, ten for each query."""
    p = read_table(spark, sf_dir, "pages").withColumn("title", tables.page_title(F.col("html")))
    snippet = F.substring(F.regexp_replace(F.regexp_extract("html", "(?s)<p>(.*?)</p>|<p>(.*)$", 1), "<[^>]*>", " "), 1, 200)
    return p.select(F.floor(F.col("page_id") / 40).alias("question_id"), (F.col("page_id") % 4).cast("int").alias("query_idx"), F.floor(F.col("page_id") % 40 / 4).cast("int").alias("rank"), "title", "url", snippet.alias("snippet"))


_RESULTS_SQL = """
  results AS (
    SELECT page_id // 40 AS question_id, (page_id % 4)::INT AS query_idx, ((page_id % 40) // 4)::INT AS rank,
           regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, url,
           substr(regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>|<p>(.*)$', 1), '<[^>]*>', ' ', 'g'), 1, 200) AS snippet
    FROM pages
  )"""
_FOLD_SQL = "CASE WHEN length({w}) > 3 AND {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
_FOLDED = _FOLD_SQL.format(w="w")
_GENERIC_SQL = sql_list(K.GENERIC_WORDS)


def _anchors_sql(column: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({column}), '{K.LETTERS}'), lambda w: length(w) > 2 AND NOT list_contains({_GENERIC_SQL}, w))"
    return f"list_transform({kept}, lambda w: {_FOLDED})"


def _pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the pages that a question read, twelve to a question."""
    return read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / PAGES_A_QUESTION).alias("question_id"), "doc_id", "text", F.substring("text", 1, 60).alias("title"), F.col("doc_id").alias("ordinal"))


def _corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a web of pages."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id")).alias("url"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("markdown"))


# Ranking.

_BM25_SQL = f"""
  q AS (SELECT DISTINCT item_id AS question_id, unnest({_anchors_sql('text')}) AS term FROM benchmark),
  tok AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{K.WORD}')) AS w FROM documents)),
  tf AS (SELECT doc_id, {_FOLDED} AS term, count(*) AS tf FROM tok GROUP BY ALL),
  len AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{K.WORD}')) AS length FROM documents),
  st AS (SELECT count(*)::DOUBLE AS n, coalesce(nullif(avg(length::DOUBLE), 0), 1) AS a FROM len),
  df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
  bm AS (
    SELECT question_id, doc_id,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / a))), 9) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY question_id, doc_id
  )"""


@query(f"WITH {_BM25_SQL} SELECT question_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm) WHERE rank < 10")
def w3_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each question."""
    return ranking.rank_by_terms(_questions(spark, sf_dir), read_table(spark, sf_dir, "documents"))


@query(f"""SELECT doc_id, {_FOLDED} AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{K.WORD}')) AS w FROM documents) GROUP BY ALL""")
def a4_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.term_frequencies(read_table(spark, sf_dir, "documents"))


@query(f"SELECT count(*) AS n_docs, round(coalesce(nullif(avg(len(regexp_extract_all(lower(text), '{K.WORD}'))::DOUBLE), 0), 1), 6) AS avg_len FROM documents")
def a5_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.corpus_statistics(read_table(spark, sf_dir, "documents")).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


_VECTOR_SQL = """
  qv AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
  d AS (SELECT question_id, vec_id AS chunk_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings, qv),
  vr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) - 1 AS rank FROM d)"""


_WITHIN_SQL = f"""t AS (SELECT DISTINCT item_id AS question_id, unnest({_anchors_sql('text')}) AS term FROM benchmark),
  l AS (SELECT doc_id // 12 AS question_id, doc_id, len(regexp_extract_all(lower(text), '{K.WORD}')) AS length FROM documents),
  st AS (SELECT question_id, count(*) AS n, coalesce(nullif(avg(length::DOUBLE), 0), 1) AS a FROM l GROUP BY question_id),
  tok AS (SELECT doc_id // 12 AS question_id, doc_id, unnest(regexp_extract_all(lower(text), '{K.WORD}')) AS w FROM documents),
  tf AS (SELECT question_id, doc_id, term, count(*) AS tf FROM (SELECT question_id, doc_id, {_FOLDED} AS term FROM tok) JOIN t USING (question_id, term) GROUP BY ALL),
  df AS (SELECT question_id, term, count(*) AS df FROM tf GROUP BY ALL),
  own AS (SELECT question_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / a))), 9) AS score
  FROM tf JOIN df USING (question_id, term) JOIN l USING (question_id, doc_id) JOIN st USING (question_id) GROUP BY question_id, doc_id)"""


@query(f"WITH {_WITHIN_SQL} SELECT * FROM own")
def w3_bm25_within_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 as the fallback uses it: among the passages that one question read."""
    return ranking.bm25_within(_questions(spark, sf_dir), _pages_read(spark, sf_dir).select("question_id", "doc_id", "text"), "doc_id")


@query(f"WITH {_VECTOR_SQL} SELECT question_id, chunk_id, distance, rank FROM vr WHERE rank < 10")
def w1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to every vector whose id is divisible by 100."""
    v = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return ranking.rank_by_distance(v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "question_id"), v, 10)


@query(f"""WITH {_BM25_SQL}, bt AS (SELECT question_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm),
  qv AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE label % 2 = 0 AND vec_id IN (SELECT item_id FROM benchmark)),
  d AS (SELECT question_id, vec_id AS chunk_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings, qv),
  vr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) - 1 AS rank FROM d)
  SELECT question_id, chunk_id, rank, 'vector' AS method FROM vr WHERE rank < 10
  UNION ALL SELECT question_id, chunk_id, rank, 'terms' FROM bt WHERE rank < 10 AND question_id NOT IN (SELECT question_id FROM qv)""")
def w2_ranking_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose vector is missing (odd label) are ranked by terms."""
    v = read_table(spark, sf_dir, "embeddings")
    questions = _questions(spark, sf_dir)
    known = v.where("label % 2 = 0").withColumnRenamed("vec_id", "question_id").join(questions.select("question_id"), "question_id", "left_semi")
    nearest = ranking.rank_by_distance(known, v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10)
    terms = ranking.rank_by_terms(questions, read_table(spark, sf_dir, "documents")).select("question_id", F.col("doc_id").alias("chunk_id"), "rank")
    return ranking.with_fallback(nearest, terms, questions)


@query(f"""WITH {_WITHIN_SQL}, qv AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS q FROM embeddings WHERE label % 2 = 0 AND vec_id IN (SELECT item_id FROM benchmark)),
  d AS (SELECT question_id, vec_id AS chunk_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS distance FROM embeddings JOIN qv ON question_id = vec_id // 12)
  SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) - 1 AS rank, 'vector' AS method FROM d
  UNION ALL SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) - 1, 'terms' FROM own WHERE question_id NOT IN (SELECT question_id FROM d)""")
def w2_fallback_within_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2 as the plan ranks: each question's own twelve passages by distance, by terms where its vector is missing (odd label)."""
    v = read_table(spark, sf_dir, "embeddings")
    questions = _questions(spark, sf_dir)
    asked = v.where("label % 2 = 0").select(F.col("vec_id").alias("question_id"), "embedding").join(questions.select("question_id"), "question_id", "left_semi")
    own = v.select(F.floor(F.col("vec_id") / PAGES_A_QUESTION).alias("question_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    nearest = ranking.top_k(ranking.distance_within(asked, own), PAGES_A_QUESTION, [F.col("distance"), F.col("chunk_id")])
    scores = ranking.bm25_within(questions, _pages_read(spark, sf_dir).select("question_id", F.col("doc_id").alias("chunk_id"), "text"))
    terms = ranking.top_k(scores, PAGES_A_QUESTION, [F.desc("score"), F.col("chunk_id")])
    return ranking.with_fallback(nearest, terms, questions)


_SPREAD_SQL = f"""{_BM25_SQL},
  ranked AS (SELECT question_id, doc_id, source AS source_url, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm JOIN documents USING (doc_id)),
  turned AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_url ORDER BY rank) AS turn, min(rank) OVER (PARTITION BY question_id, source_url) AS lead_rank FROM ranked),
  placed AS (SELECT question_id, doc_id, source_url, rank, row_number() OVER (PARTITION BY question_id ORDER BY turn, lead_rank, rank) - 1 AS place FROM turned)"""


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = ranking.bm25(_questions(spark, sf_dir), docs).join(docs.select("doc_id", F.col("source").alias("source_url")), "doc_id")
    return ranking.spread_best(scored, K.TOP_PASSAGES)


@query(f"WITH {_SPREAD_SQL} SELECT question_id, doc_id, source_url, rank, place FROM placed WHERE place < 60")
def w4_spread_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(spark, sf_dir).select("question_id", "doc_id", "source_url", "rank", "place")


@query(f"WITH {_SPREAD_SQL} SELECT question_id, count(DISTINCT source_url) AS n_sources FROM placed WHERE place < 60 GROUP BY question_id")
def a7_source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.source_count(_spread(spark, sf_dir))


# Lines, predicates and plans.


@query(r"""SELECT doc_id, line_number, text FROM (
  SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line_number
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)) WHERE regexp_matches(text, '[^\s\p{Z}]')""")
def f1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.lines(read_table(spark, sf_dir, "documents"))


_RECENT_SQL = (
    f"list_has_any(regexp_extract_all(lower(text), '{K.LETTERS}'), {sql_list(K.RECENCY_WORDS + K.RECENCY_BEGINNINGS)})"
    + "".join(f" OR contains(lower(text), '{p}')" for p in K.RECENCY_PHRASES)
    + "".join(f" OR len(list_filter(regexp_extract_all(lower(text), '{K.LETTERS}'), lambda w: starts_with(w, '{s}'))) > 0" for s in K.RECENCY_BEGINNINGS)
    + rf" OR len(list_filter(regexp_extract_all(text, '{K.YEAR}'), lambda y: y::INT BETWEEN {TODAY - 3} AND {TODAY + 1})) > 0"
)


@query(f"SELECT doc_id, ({_RECENT_SQL}) AS recent FROM documents")
def f2_recency_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.wants_recent("text", TODAY).alias("recent"))


@query(f"SELECT item_id, array_to_string({_anchors_sql('text')}, ' ') AS anchors FROM benchmark")
def f3_anchor_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.anchor_sequence("text"), " ").alias("anchors"))


_TURNS_SQL = f"""
  first AS (SELECT conv_id, text AS question FROM conversations WHERE turn = 0),
  turns AS (SELECT conv_id, turn, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS query, question,
                   list_distinct({_anchors_sql('text')}) AS a, list_distinct({_anchors_sql('question')}) AS b
            FROM conversations JOIN first USING (conv_id)),
  judged AS (SELECT *, len(b) = 0 OR len(list_intersect(a, b)) >= greatest(1, round_even(len(b) * 0.5, 0)) AS on_topic FROM turns)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.join(c.where("turn = 0").select("conv_id", F.col("text").alias("question")), "conv_id")


@query(f"WITH {_TURNS_SQL} SELECT conv_id, turn, on_topic FROM judged")
def f4_on_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", text.on_topic("text", "question").alias("on_topic"))


@query(f"""WITH {_TURNS_SQL},
  kept AS (SELECT conv_id, turn, query FROM judged WHERE on_topic AND query <> ''),
  led AS (SELECT * FROM kept UNION ALL SELECT conv_id, -1, question FROM first f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.conv_id = f.conv_id AND k.query = f.question)),
  placed AS (SELECT conv_id AS question_id, query, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM led)
  SELECT question_id, query, place, false AS drifted FROM placed WHERE place < 4
  UNION ALL SELECT conv_id, query, NULL, true FROM judged WHERE NOT on_topic AND query <> ''""")
def f5_plan_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a conversation's turns as the planned queries for its first turn."""
    c = read_table(spark, sf_dir, "conversations")
    planned = c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("idx"), F.col("text").alias("query"))
    return evidence.clean_plan(planned, c.where("turn = 0").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question")))


# Judging and verifying: labels are verdicts on documents, forty documents to a question.

_JUDGE_SQL = """
  p AS (SELECT doc_id // 40 AS question_id, doc_id AS chunk_id, ((row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) - 1) // 8)::INT AS batch_id FROM documents),
  graded AS (SELECT question_id, batch_id, p.chunk_id, quality FROM p JOIN labels l ON l.doc_id = p.chunk_id)"""


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 40).alias("question_id"), F.col("doc_id").alias("chunk_id"))
    return evidence.judge_batches(docs, order="chunk_id")


@query(f"WITH {_JUDGE_SQL} SELECT question_id, chunk_id, batch_id FROM p")
def w8_judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir)


@query(f"""WITH {_JUDGE_SQL} SELECT question_id, chunk_id, batch_id FROM p
  WHERE chunk_id IN (SELECT chunk_id FROM graded WHERE quality = 1) OR (question_id, batch_id) NOT IN (SELECT (question_id, batch_id) FROM graded)""")
def f6_keep_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch without any label is one whose call failed."""
    batched = _batched(spark, sf_dir)
    graded = batched.join(read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "quality"), "chunk_id")
    verdicts = graded.groupBy("question_id", "batch_id").agg(F.collect_list(F.when(F.col("quality") == 1, F.col("chunk_id"))).alias("relevant_ids"))
    return evidence.keep_relevant(batched, verdicts)


_CLAIMS_SQL = """
  claims AS (SELECT conv_id AS question_id, turn AS claim_idx, text, [conv_id * 7 + turn, conv_id * 3, 10000000 + turn, conv_id * 7 + turn] AS ids FROM conversations WHERE turn % 3 <> 2
             UNION ALL SELECT conv_id, turn, text, [10000000 + turn] FROM conversations WHERE turn % 3 = 2),
  cited AS (SELECT question_id, claim_idx, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) - 1 AS cite_idx FROM claims),
  valid AS (SELECT * FROM cited WHERE chunk_id IN (SELECT doc_id FROM documents))"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    conv, turn, far = F.col("conv_id"), F.col("turn"), F.lit(10_000_000) + F.col("turn")
    ids = F.when(turn % 3 == 2, F.array(far)).otherwise(F.array(conv * 7 + turn, conv * 3, far, conv * 7 + turn))
    return c.select(conv.alias("question_id"), turn.alias("claim_idx"), "text", ids.alias("evidence_ids"), F.when(turn % 4 == 0, "").otherwise(F.col("role")).alias("theme"))


def _cited_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question may cite all documents: the passages are joined by id alone."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_url"), F.length("text").alias("n_chars"))


def _known(spark: SparkSession, sf_dir: str, claims: DataFrame) -> DataFrame:
    asked = claims.select("question_id", F.explode("evidence_ids").alias("chunk_id")).distinct()
    return asked.join(_cited_docs(spark, sf_dir), "chunk_id")


@query(f"WITH {_CLAIMS_SQL} SELECT question_id, claim_idx, string_agg(chunk_id::VARCHAR, ',' ORDER BY cite_idx) AS ids FROM valid GROUP BY ALL")
def f7_verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    kept = evidence.verify_claims(claims, _known(spark, sf_dir, claims))
    return kept.select("question_id", "claim_idx", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {_CLAIMS_SQL}, n AS (SELECT question_id, claim_idx, len(ids) AS n0, (SELECT count(*) FROM valid v WHERE v.question_id = c.question_id AND v.claim_idx = c.claim_idx) AS n1 FROM claims c)
  SELECT question_id, count(*) FILTER (n1 > 0) AS kept, count(*) FILTER (n1 > 0 AND n1 < n0) AS trimmed, count(*) FILTER (n1 = 0) AS dropped, count(*) FILTER (n1 > 0) > 0 AS sufficient FROM n GROUP BY question_id""")
def f7_verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    return evidence.verification_counts(claims, evidence.verify_claims(claims, _known(spark, sf_dir, claims)))


@query(f"WITH {_CLAIMS_SQL} SELECT question_id, claim_idx, cite_idx::INT AS cite_idx, chunk_id, source AS source_url FROM valid JOIN documents ON doc_id = chunk_id")
def j1_cited_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    cited = evidence.cited_passages(claims, _known(spark, sf_dir, claims))
    return cited.select("question_id", "claim_idx", "cite_idx", "chunk_id", "source_url")


@query(f"WITH {_CLAIMS_SQL} SELECT question_id, count(DISTINCT chunk_id) AS n_passages FROM valid GROUP BY question_id")
def j1_evidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    cited = evidence.cited_passages(claims, _known(spark, sf_dir, claims)).withColumn("text", F.lit(""))
    return evidence.evidence_map(cited).select("question_id", F.size("evidence").cast("long").alias("n_passages"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2_unjudged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership as an anti-join."""
    return read_table(spark, sf_dir, "documents").select("doc_id").join(read_table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(f"""WITH {_CLAIMS_SQL}, g AS (SELECT question_id, claim_idx, source AS source_url, min(cite_idx) AS f, string_agg(chunk_id::VARCHAR, ',' ORDER BY cite_idx) AS chunk_ids FROM valid JOIN documents ON doc_id = chunk_id GROUP BY ALL)
  SELECT question_id, claim_idx, source_url, row_number() OVER (PARTITION BY question_id, claim_idx ORDER BY f) - 1 AS page_idx, chunk_ids FROM g""")
def a13_passages_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    grouped = evidence.passages_by_page(evidence.cited_passages(claims, _known(spark, sf_dir, claims)))
    return grouped.select("question_id", "claim_idx", "source_url", "page_idx", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))


@query("""WITH c AS (SELECT conv_id AS question_id, turn AS claim_idx, CASE WHEN turn % 4 = 0 THEN '' ELSE role END AS theme FROM conversations),
  s AS (SELECT question_id, theme, row_number() OVER (PARTITION BY question_id ORDER BY min(claim_idx)) AS theme_no FROM c WHERE theme <> '' GROUP BY question_id, theme),
  l AS (SELECT *, lag(theme) OVER (PARTITION BY question_id ORDER BY claim_idx) AS before FROM c)
  SELECT question_id, claim_idx, theme, theme_no, theme_no IS NOT NULL AND theme IS DISTINCT FROM before AS new_section FROM l LEFT JOIN s USING (question_id, theme)""")
def a14_theme_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speaker's role as the theme of a turn."""
    return evidence.number_themes(_claims(spark, sf_dir).drop("text", "evidence_ids"))


@query("""WITH a AS (SELECT conv_id AS question_id, turn AS attempt, contains(text, '!') AS leak, contains(text, '  ') AS damaged, length(text) < 40 AS omitted, (length(text) % 7) AS n_plain FROM conversations),
  f AS (SELECT *, 100 * leak::INT + 10 * damaged::INT + 5 * omitted::INT + n_plain AS flaws FROM a)
  SELECT question_id, attempt, flaws FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY flaws, attempt) AS r FROM f) WHERE r = 1""")
def a11_best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("text")
    attempts = c.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("attempt"), t.contains("!").alias("leak"), t.contains("  ").alias("damaged"), (F.length(t) < 40).alias("omitted"), (F.length(t) % 7).alias("n_plain"))
    return evidence.best_attempt(attempts)


@query("""SELECT page_id, CASE WHEN page_id % 50 = 7 THEN 'limited' WHEN html IS NULL OR NOT regexp_matches(html, '[^\\s\\p{Z}]') THEN 'unreadable' ELSE 'ok' END AS status FROM pages""")
def f8_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: every fiftieth page was refused for quota."""
    pages = read_table(spark, sf_dir, "pages").withColumn("error", F.when(F.col("page_id") % 50 == 7, "rate_limit"))
    return evidence.page_status(pages, "html", F.col("error")).select("page_id", "status")


_ERRORS = [
    "Error code: 402 - This request requires more credits", "Error code: 402 - too many in-flight requests", "Payment Required", "429 Too Many Requests", "RESOURCE_EXHAUSTED: quota", "Model is overloaded",
    "Read timed out", "503 Service Unavailable", "RateLimitError: slow down", "No structured output was returned", "invalid schema",
]


def _contains_sql(signs: list[str], column: str = "m") -> str:
    return "(" + " OR ".join(f"contains({column}, '{s}')" for s in signs) + ")"


@query(f"""WITH l AS (SELECT event_id, {sql_list(_ERRORS)}[1 + event_id % {len(_ERRORS)}] AS message, lower(message) AS m FROM events WHERE event_type = 'error')
  SELECT event_id, message, CASE WHEN {_contains_sql(K.BILLING_SIGNS)} AND NOT contains(m, '{K.IN_FLIGHT}') THEN 'billing' WHEN {_contains_sql(K.RATE_SIGNS)} THEN 'rate_limit' WHEN {_contains_sql(K.TRANSIENT_SIGNS)} THEN 'transient' ELSE 'other' END AS kind FROM l""")
def f9_error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error events, each with the message that its id stands for."""
    errors = read_table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", choice(F.col("event_id"), _ERRORS).alias("message"))
    return errors.withColumn("kind", text.error_kind("message"))


@query("""SELECT doc_id AS question_id, quality = 1 AS sufficient, (doc_id % 2)::INT AS retry_count, CASE WHEN toxic = 1 THEN 'not_a_research_question' ELSE 'too_thin' END AS problem,
  CASE WHEN quality = 1 OR doc_id % 2 >= 1 OR toxic = 1 THEN 'end' ELSE 'refine' END AS next FROM labels""")
def f10_next_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("sufficient"), (F.col("doc_id") % 2).cast("int").alias("retry_count"), F.when(F.col("toxic") == 1, "not_a_research_question").otherwise("too_thin").alias("problem"))
    return evidence.next_step(graded)


# Search results: fusion, tiers, scores.

_HOST_SQL = "regexp_replace(regexp_extract(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^([^:]*)', 1), '^www\\.', '')"
_PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_KEY_SQL = rf"""CASE WHEN {_HOST_SQL} LIKE '%arxiv.org' AND regexp_extract({_PATH_SQL}, '{K.ARXIV_ID}', 1) <> '' THEN 'arxiv:' || regexp_extract({_PATH_SQL}, '{K.ARXIV_ID}', 1)
  WHEN regexp_extract({_PATH_SQL}, '{K.DOI}', 1) <> '' THEN 'doi:' || lower(regexp_extract({_PATH_SQL}, '{K.DOI}', 1))
  ELSE {_HOST_SQL} || regexp_replace({_PATH_SQL}, '/+$', '') ||
    CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '{K.TRACKING}'))) > 0
    THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '{K.TRACKING}'))), '&') ELSE '' END END"""
_MERGED_SQL = f"""{_RESULTS_SQL},
  hits AS (SELECT question_id, {_KEY_SQL} AS key, query_idx, min(rank) AS rank FROM results GROUP BY ALL),
  total AS (SELECT DISTINCT question_id, 5 AS queries FROM results),
  merged AS (SELECT question_id, key, round(sum(1 / (10.0 + rank)::DOUBLE), 12) AS fusion, count(*) AS n_queries FROM hits GROUP BY ALL)"""


def _asked_queries(results: DataFrame) -> DataFrame:
    return results.select("question_id").distinct().select("question_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("query_idx"))


@query(f"SELECT page_id, {_HOST_SQL} AS host FROM pages")
def r1_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", text.host_of("url").alias("host"))


@query(f"SELECT page_id, {_KEY_SQL} AS key FROM pages")
def r8_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", text.canonical_url("url").alias("key"))


#: Hosts of the driver's pages, so that every tier comes up.
_TEST_HOSTS = {"scholarly": ["example.org"], "reference": ["example.com"], "low": ["example.net"]}
_TIER_SQL = f"CASE WHEN {_HOST_SQL} LIKE '%.example.org' THEN 'scholarly' WHEN {_HOST_SQL} LIKE '%.example.com' THEN 'reference' WHEN {_HOST_SQL} LIKE '%.example.net' THEN 'low' ELSE 'unknown' END"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", tables.page_title(F.col("html")).alias("title"), F.lit("").alias("snippet"))
    return selection.classify(pages, selection.host_table(spark, _TEST_HOSTS))


@query(f"SELECT page_id, {_TIER_SQL} AS tier, CASE WHEN {_TIER_SQL} = 'unknown' THEN {_HOST_SQL} ELSE regexp_extract({_HOST_SQL}, 'example\\.[a-z]+$') END AS host_group FROM pages")
def r2_host_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific listed suffix of a host."""
    return _classified(spark, sf_dir).select("page_id", "tier", "host_group")


@query(f"""WITH p AS (SELECT page_id, {_TIER_SQL} AS tier, {_PATH_SQL} AS path, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || chr(10) AS t FROM pages)
  SELECT page_id, round(CASE tier WHEN 'scholarly' THEN 1.0 WHEN 'reference' THEN 0.65 WHEN 'low' THEN 0.2 ELSE 0.5 + least(0.3, 0.1 * (regexp_matches(path, '{K.PAPER_PATH}')::INT + len(regexp_extract_all(t, '{K.PAPER_TEXT}')))) END, 6) AS weight FROM p""")
def r3_scholarly_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scholarly_weight(_classified(spark, sf_dir)).select("page_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {_MERGED_SQL} SELECT question_id, key, fusion, n_queries, CASE WHEN queries < 2 THEN 0.0 ELSE (n_queries - 1) / (queries - 1)::DOUBLE END AS agreement FROM merged JOIN total USING (question_id)")
def a1_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by canonical URL; a fifth query of each question was answered with nothing."""
    found = _results(spark, sf_dir)
    return selection.merge_results(found, _asked_queries(found)).select("question_id", "key", "fusion", "n_queries", "agreement")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first title of each question's results as the question."""
    r = _results(spark, sf_dir)
    return r.groupBy("question_id").agg(F.min_by("title", F.struct("query_idx", "rank")).alias("question"))


def _stem_sql(w: str) -> str:
    cuts = "".join(f" WHEN {w} LIKE '%{suffix}' AND length({w}) >= {len(suffix) + 3} THEN left({w}, length({w}) - {len(suffix)})" for suffix in ("ing", "ed", "es", "e", "s"))
    return f"CASE{cuts} ELSE {w} END"


def _runs_sql(column: str, size: int) -> str:
    """Initials of the runs of ``size`` words of a list."""
    return f"list_transform(range(1, len({column}) - {size - 2}), lambda k: " + " || ".join(f"left({column}[k + {j}], 1)" for j in range(size)) + ")"


def _covered_sql(p: str) -> str:
    """Which places of w (anchors, with stems ws and runs w3, w4) the list ``p`` (with stems, runs {p}s, {p}3, {p}4) names."""
    pair = "len(list_filter({p}s, lambda x: starts_with(x, w[{i}] || ws[{j}]))) > 0"
    spelled = "".join(f" OR len(list_filter(range(1, len(w{n}) + 1), lambda k: k <= i AND i < k + {n} AND list_position(w{n}, w{n}[k]) = k AND list_contains({p}, w{n}[k]))) > 0" for n in (3, 4))
    return (
        f"list_filter(range(1, len(w) + 1), lambda i: list_contains({p}s, ws[i]) OR list_contains({p}3, w[i]) OR list_contains({p}4, w[i])"
        f" OR (i < len(w) AND {pair.format(p=p, i='i', j='i + 1')}) OR (i > 1 AND {pair.format(p=p, i='i - 1', j='i')}){spelled})"
    )


def _relevance_sql(table: str, columns: str) -> str:
    """CTEs that end in ``relevant``: ``columns`` of ``table`` (with question, title, snippet) and relevance."""
    lists = ", ".join(f"list_transform({p}, lambda x: {_stem_sql('x')}) AS {p}s, {_runs_sql(p, 3)} AS {p}3, {_runs_sql(p, 4)} AS {p}4" for p in ("w", "t", "s"))
    return f"""
  rel0 AS (SELECT {columns}, {_anchors_sql("coalesce(question, '')")} AS w0, {_anchors_sql("coalesce(title, '')")} AS t, {_anchors_sql("coalesce(snippet, '')")} AS s FROM {table}),
  rel1 AS (SELECT *, list_filter(w0, lambda x, i: list_position(w0, x) = i) AS w FROM rel0),
  rel2 AS (SELECT *, {lists} FROM rel1),
  rel3 AS (SELECT *, {_covered_sql('t')} AS ct, {_covered_sql('s')} AS cs FROM rel2),
  relevant AS (SELECT {columns}, CASE WHEN len(w) = 0 THEN 1.0 ELSE 0.6 * len(ct) / len(w) + 0.4 * len(list_distinct(ct || cs)) / len(w) END AS relevance FROM rel3)"""


_ASKED_SQL = "asked AS (SELECT question_id, arg_min(title, (query_idx, rank)) AS question FROM results GROUP BY question_id)"


@query(f"""WITH {_RESULTS_SQL}, {_ASKED_SQL}, shown AS (SELECT * FROM results JOIN asked USING (question_id)),
  {_relevance_sql('shown', 'question_id, query_idx, rank')} SELECT question_id, query_idx, rank, round(relevance, 9) AS relevance FROM relevant""")
def r7_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the question's subject title and snippet name."""
    r = _results(spark, sf_dir).join(_asked(spark, sf_dir), "question_id")
    return r.select("question_id", "query_idx", "rank", F.round(text.relevance("question", "title", "snippet"), 9).alias("relevance"))


def _label_sql(column: str) -> str:
    """X2's first readable segment, and its cut."""
    edge = r"[ \-–—:;,\|]+"
    flat = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '{K.LABEL_IMAGE}', ' ', 'g'), '{K.LABEL_LINK}', '\\1', 'g'), '{K.LABEL_TAG}', ' ', 'g'), '{K.LABEL_URL}', ' ', 'g'), '{K.LABEL_EMPHASIS}', '', 'g')"
    clean = f"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(s, '{K.LABEL_BULLET}', ''), '[\\s\\p{{Z}}]+', ' ', 'g')), '{K.LABEL_FIELD}', ''), '^{edge}|{edge}$', '', 'g')"
    return f"coalesce(list_filter(list_transform(string_split_regex({flat}, '{K.LABEL_BOUNDARY}'), lambda s: {clean}), lambda s: length(regexp_replace(s, '[^\\p{{L}}\\p{{Nl}}\\p{{No}}]', '', 'g')) >= 12)[1], '')"


def _cut_sql(first: str) -> str:
    head = f"substr({first}, 1, 111)"
    space = f"length({head}) - instr(reverse({head}), ' ')"
    cut = f"CASE WHEN contains({head}, ' ') AND {space} > 55 THEN {space} ELSE 110 END"
    return rf"CASE WHEN length({first}) <= 110 THEN {first} ELSE regexp_replace(substr({first}, 1, {cut}), '[ \-–—:;,\|.]+$', '') || '…' END"


def _title_key_sql(column: str) -> str:
    """CTE steps in one expression over ``column``, whose label is ``{column}_label``: R9's words in order."""
    shown = f"coalesce(nullif({_cut_sql(column + '_label')}, ''), {column})"
    bare = f"regexp_replace(regexp_replace(regexp_replace({shown}, '{K.TITLE_PREFIX}', ''), '{K.TITLE_SUFFIX}', ''), '[ .…]+$', '')"
    return f"list_sort(list_distinct(regexp_extract_all(lower({bare}), '{K.WORD}')))"


def _known_words_sql(words: str) -> str:
    return f"CASE WHEN len({words}) >= {K.LEAST_TITLE_WORDS} THEN {words} ELSE [] END"


_PAPER_SQL = f"least(0.3, 0.1 * (regexp_matches({_PATH_SQL}, '{K.PAPER_PATH}')::INT + len(regexp_extract_all(title || chr(10) || snippet, '{K.PAPER_TEXT}'))))"
_SCORED_SQL = f"""{_MERGED_SQL}, {_ASKED_SQL},
  firsts AS (SELECT question_id, {_KEY_SQL} AS key, arg_min({{'title': title, 'url': url, 'snippet': snippet}}, (query_idx, rank)) AS f, min((query_idx, rank)) AS seen, list_sort(list_distinct(list(query_idx))) AS query_set FROM results GROUP BY ALL),
  merged1 AS (SELECT m.question_id, m.key, fusion, n_queries, queries, question, f.title AS title, f.url AS url, f.snippet AS snippet, seen, query_set,
              max(fusion) OVER (PARTITION BY m.question_id) AS best FROM merged m JOIN firsts USING (question_id, key) JOIN total USING (question_id) JOIN asked USING (question_id)),
  labelled AS (SELECT *, title AS raw_title, {_label_sql('title')} AS title_label FROM merged1),
  named AS (SELECT question_id, key, question, coalesce(nullif({_cut_sql('title_label')}, ''), title) AS title, snippet FROM labelled),
  {_relevance_sql('named', 'question_id, key')},
  scored AS (SELECT l.*, relevance, {_TIER_SQL} AS tier, CASE WHEN {_TIER_SQL} = 'unknown' THEN {_HOST_SQL} ELSE regexp_extract({_HOST_SQL}, 'example[.][a-z]+$') END AS host_group,
    0.40 * CASE {_TIER_SQL} WHEN 'scholarly' THEN 1.0 WHEN 'reference' THEN 0.65 WHEN 'low' THEN 0.2 ELSE 0.5 + {_PAPER_SQL} END
    + 0.35 * greatest(relevance, CASE WHEN queries < 2 THEN 0.0 ELSE (n_queries - 1) / (queries - 1)::DOUBLE END) + 0.25 * fusion / best AS score
    FROM labelled l JOIN relevant USING (question_id, key))"""


@query(f"WITH {_SCORED_SQL} SELECT question_id, key, round(relevance, 9) AS relevance, round(score, 9) AS score FROM scored")
def r10_source_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a candidate is worth."""
    found = _results(spark, sf_dir)
    merged = selection.merge_results(found, _asked_queries(found)).join(_asked(spark, sf_dir), "question_id")
    weighed = selection.scholarly_weight(selection.classify(merged, selection.host_table(spark, _TEST_HOSTS)))
    return selection.score(weighed).select("question_id", "key", F.round("relevance", 9).alias("relevance"), F.round("score", 9).alias("score"))


@query(f"""WITH RECURSIVE {_SCORED_SQL},
  worded AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seen, key) - 1 AS idx, {_title_key_sql('title')} AS words0 FROM scored),
  cand AS (SELECT *, {_known_words_sql('words0')} AS words FROM worded),
  twins AS (SELECT a.question_id, a.idx, list(b.idx) FILTER (len(list_intersect(a.words, b.words)) > 0 AND len(list_intersect(a.words, b.words)) >= 0.85 * len(list_distinct(a.words || b.words)) - 1e-9) AS twins,
            list(b.idx) FILTER (a.host_group = b.host_group) AS crowd FROM cand a JOIN cand b USING (question_id) GROUP BY ALL),
  full_cand AS (SELECT c.*, coalesce(t.twins, []) AS twins, t.crowd FROM cand c JOIN twins t USING (question_id, idx)),
  sizes AS (SELECT question_id, count(*) AS n, list_sort(list_distinct(flatten(list(query_set)))) AS queries FROM cand GROUP BY question_id),
  pick(question_id, turn, taken) AS (
    SELECT question_id, 0, []::BIGINT[] FROM sizes
    UNION ALL
    SELECT p.question_id, p.turn + 1, CASE WHEN max(c.idx) IS NULL THEN any_value(p.taken) ELSE any_value(p.taken) || [-(max({{'w': round(c.score - 0.15 * len(list_intersect(p.taken, c.crowd)) - 0.6 * (len(list_intersect(p.taken, c.twins)) > 0)::INT, 9), 'i': -c.idx}})).i] END
    FROM pick p JOIN sizes z USING (question_id)
    LEFT JOIN full_cand c ON c.question_id = p.question_id AND NOT list_contains(p.taken, c.idx) AND len(p.taken) < 12
         AND (p.turn >= len(z.queries) OR list_contains(c.query_set, z.queries[p.turn + 1]))
    WHERE p.turn < len(z.queries) + z.n
    GROUP BY p.question_id, p.turn
  ),
  done AS (SELECT p.question_id, arg_max(taken, turn) AS taken FROM pick p GROUP BY p.question_id),
  chosen AS (SELECT f.*, d.taken, list_position(d.taken, f.idx) AS spot FROM full_cand f JOIN done d USING (question_id))
  SELECT question_id, key, raw_title AS title, url, tier, round(score, 9) AS score, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, spot) - 1)::INT AS place,
         n::INT AS considered, aside::INT AS mirrors_set_aside
  FROM chosen JOIN sizes USING (question_id) JOIN (SELECT question_id, count(*) FILTER (spot IS NULL AND len(list_intersect(taken, twins)) > 0) AS aside FROM chosen GROUP BY question_id) USING (question_id)
  WHERE spot IS NOT NULL""")
def r11_select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages to read."""
    found = _results(spark, sf_dir)
    chosen = selection.select_sources(found, _asked(spark, sf_dir), selection.host_table(spark, _TEST_HOSTS), asked=_asked_queries(found))
    return chosen.withColumn("score", F.round("score", 9))


@query(f"WITH {_MERGED_SQL}, w AS (SELECT DISTINCT question_id, {_KEY_SQL} AS key, {_TIER_SQL} AS tier FROM results) SELECT question_id, count(*) FILTER (tier = 'scholarly') AS scholarly, count(*) FILTER (tier = 'reference') AS reference, count(*) FILTER (tier NOT IN ('scholarly', 'reference')) AS other FROM w GROUP BY question_id")
def a8_mix_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over all candidates."""
    return selection.mix_tally(selection.classify(selection.merge_results(_results(spark, sf_dir)), selection.host_table(spark, _TEST_HOSTS)))


@query(f"SELECT question_id, count(*) FILTER (tier = 'scholarly') AS scholarly, count(*) FILTER (tier = 'reference') AS reference, count(*) FILTER (tier NOT IN ('scholarly', 'reference')) AS other FROM ({ORACLE_SQL['r11_select_sources']}) GROUP BY question_id")
def a8_chosen_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over the pages that were chosen."""
    return selection.mix_tally(r11_select_sources(spark, sf_dir))


@query(f"""WITH {_RESULTS_SQL}, f AS (SELECT question_id, url, min((rank, query_idx)) AS pos FROM results WHERE rank < 5 GROUP BY ALL), p AS (SELECT question_id, url, row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS place FROM f) SELECT question_id, url, place FROM p WHERE place < 12""")
def w13_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.round_robin(_results(spark, sf_dir))


@query(f"""WITH w AS (SELECT item_id, unnest({_anchors_sql('text')}) AS w FROM benchmark)
  SELECT item_id, w, CASE WHEN w LIKE '%ing' AND length(w) >= 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) >= 5 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) >= 5 THEN left(w, length(w) - 2)
    WHEN w LIKE '%e' AND length(w) >= 4 THEN left(w, length(w) - 1) WHEN w LIKE '%s' AND length(w) >= 4 THEN left(w, length(w) - 1) ELSE w END AS stem FROM w""")
def r4_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read_table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.anchor_sequence("text")).alias("w"))
    return words.select("item_id", "w", text.stem("w").alias("stem"))


@query(f"""WITH p AS (SELECT page_id, '[PDF] ' || regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || ' - Example Site' AS title FROM pages), l AS (SELECT *, {_label_sql('title')} AS title_label FROM p),
  k AS (SELECT page_id, {_title_key_sql('title')} AS words FROM l) SELECT page_id, array_to_string({_known_words_sql('words')}, ' ') AS title_key FROM k""")
def r9_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(F.array_sort(text.title_key(F.concat(F.lit("[PDF] "), tables.page_title(F.col("html")), F.lit(" - Example Site")))), " ").alias("title_key"))


@query("SELECT url, title, count(*) AS n_lines FROM (SELECT 'https://' || source || '.example.org/' || doc_id AS url, substr(text, 1, 60) AS title, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\s\\p{Z}]') GROUP BY ALL")
def s10_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of pages, by URL, as the documents entry point gives them."""
    provider = providers.CorpusSearch(_corpus_pages(spark, sf_dir))
    return api.documents(provider, provider.pages).groupBy("url", "title").agg(F.count(F.lit(1)).alias("n_lines"))


_LISTED = [(e, t) for t, entries in (("scholarly", K.SCHOLARLY_HOSTS), ("reference", K.REFERENCE_HOSTS), ("low", K.LOW_HOSTS)) for e in entries]
_ELSEWHERE = ["nowhere.example", "uni-x.de", "physics.univ.edu"]
_ENTRIES = [e for e, _ in _LISTED] + _ELSEWHERE
_BELOW = ["", "www.", "docs.mirror."]


def _listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages at the hosts that are listed, with www. and at hosts below them."""
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat(F.lit("https://"), choice(F.col("page_id"), _BELOW), choice(F.col("page_id"), _ENTRIES), F.lit("/a")).alias("url"))


_LISTED_SQL = f"""
  entries AS (SELECT unnest({sql_list(_ENTRIES)}) AS entry, unnest({sql_list([t for _, t in _LISTED])} || ['', '', '']) AS listed_tier, unnest(range({len(_ENTRIES)})) AS i),
  placed AS (SELECT page_id, 'https://' || {sql_list(_BELOW)}[1 + page_id % 3] || entry || '/a' AS url FROM pages JOIN entries ON i = page_id % {len(_ENTRIES)}),
  hosted AS (SELECT page_id, {_HOST_SQL} AS host FROM placed)"""


@query(f"""WITH {_LISTED_SQL},
  hits AS (SELECT page_id, entry, listed_tier, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) - length(replace(entry, '.', '')) DESC, i) AS nth FROM hosted JOIN entries ON listed_tier <> '' AND (host = entry OR ends_with(host, '.' || entry)))
  SELECT page_id, coalesce(listed_tier, CASE WHEN regexp_matches(host, '{K.ACADEMIC_HOST}') THEN 'scholarly' ELSE 'unknown' END) AS tier, coalesce(entry, host) AS host_group FROM hosted LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (page_id)""")
def r2_listed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, J5 over the list of hosts itself."""
    return selection.classify(_listed_pages(spark, sf_dir), selection.host_table(spark)).select("page_id", "tier", "host_group")


@query(f"""WITH {_LISTED_SQL}, names AS (SELECT unnest({sql_list(list(K.SITE_NAMES))}) AS name_of, unnest({sql_list(list(K.SITE_NAMES.values()))}) AS site),
  hits AS (SELECT page_id, site, row_number() OVER (PARTITION BY page_id ORDER BY length(name_of) DESC) AS nth FROM hosted JOIN names ON host = name_of OR ends_with(host, '.' || name_of))
  SELECT page_id, coalesce(site, host) AS site FROM hosted LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (page_id)""")
def r12_listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R12 over hosts that have a name of their own."""
    return selection.site_names(_listed_pages(spark, sf_dir)).select("page_id", "site")


@query(f"SELECT page_id, {_HOST_SQL} AS site FROM pages")
def r12_site_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.site_names(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "site")


@query("SELECT tier, count(*) AS n, count(DISTINCT host) AS hosts FROM (SELECT " + _TIER_SQL + " AS tier, " + _HOST_SQL + " AS host FROM pages) GROUP BY tier")
def a15_tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"))


@query(f"""WITH p AS (SELECT page_id // 12 AS question_id, page_id % 12 AS place, {_HOST_SQL} AS host, {_TIER_SQL} AS tier, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
  l AS (SELECT *, {_label_sql('title')} AS title_label FROM p), k AS (SELECT *, {_title_key_sql('title')} AS words0 FROM l), w AS (SELECT *, {_known_words_sql('words0')} AS words FROM k),
  c AS (SELECT b.question_id, count(DISTINCT b.place) AS copies FROM w a JOIN w b ON a.question_id = b.question_id AND a.place < b.place AND len(list_intersect(a.words, b.words)) > 0 AND len(list_intersect(a.words, b.words)) >= 0.85 * len(list_distinct(a.words || b.words)) - 1e-9 GROUP BY ALL)
  SELECT question_id, count(*) AS pages, count(DISTINCT host) AS hosts, {", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in K.TIER_WEIGHTS)}, coalesce(any_value(copies), 0) AS copies FROM w LEFT JOIN c USING (question_id) GROUP BY question_id""")
def a15_choice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve pages as a question's choice: copies, hosts, tiers."""
    pages = _classified(spark, sf_dir).withColumns({"question_id": F.floor(F.col("page_id") / 12), "place": F.col("page_id") % 12})
    return selection.choice_summary(pages)


@query("SELECT user_id AS run_id, max(value) AS slowest, round(sum(value), 6) AS total FROM events GROUP BY user_id")
def a15_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps that took some seconds."""
    return selection.timing_summary(read_table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id"), "run_id", "value")


@query("SELECT user_id AS run_id, event_id AS ordinal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events")
def t4_completion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: events as steps, by the time at which they ended."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), F.col("ts").alias("finished_at"))
    return activity.completion_order(e).select("run_id", "ordinal", "seq")


# Duplicates.


@query(r"""WITH k AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS key FROM documents) SELECT min(doc_id) AS doc_id FROM k GROUP BY key""")
def d1_exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.first_of_equal(read_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id")


_SHINGLES_SQL = f"""
  w AS (SELECT doc_id, regexp_extract_all(lower(text), '{K.WORD}') AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
      ELSE list_transform(range(1, len(l) - 3), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] || ' ' || l[i + 3] || ' ' || l[i + 4]) END) AS shingle FROM w))"""


@query(f"WITH {_SHINGLES_SQL} SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id")
def d2_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrors.shingles(read_table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shingles"))


@query(f"""WITH {_SHINGLES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id // 12 AS question_id, a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND a.doc_id // 12 = b.doc_id // 12 GROUP BY ALL)
  SELECT question_id, a, b, round(shared / least(x.n, y.n)::DOUBLE, 9) AS containment FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / least(x.n, y.n)::DOUBLE >= 0.55""")
def d3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the twelve pages of a question."""
    return mirrors.containment_pairs(_pages_read(spark, sf_dir))


@query(f"""WITH {_SHINGLES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL)
  SELECT a, b, round(shared / least(x.n, y.n)::DOUBLE, 9) AS containment FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / least(x.n, y.n)::DOUBLE >= 0.55""")
def d3_containment_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, J7 over all documents."""
    return mirrors.corpus_containment(read_table(spark, sf_dir, "documents"))


@query(f"""WITH t AS (SELECT page_id // 12 AS question_id, page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '{K.WORD}')) AS w FROM pages)
  SELECT question_id, a, b, round(j, 9) AS jaccard FROM (SELECT x.question_id, x.page_id AS a, y.page_id AS b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE AS j
  FROM t x JOIN t y ON x.question_id = y.question_id AND x.page_id < y.page_id WHERE len(x.w) >= 4 AND len(y.w) >= 4) WHERE j >= 0.85""")
def d4_title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the twelve pages of a question."""
    pages = read_table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES_A_QUESTION).alias("question_id"), "page_id", tables.page_title(F.col("html")).alias("title"))
    return mirrors.title_pairs(pages)


@query(f"""WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '{K.WORD}')) AS w FROM pages)
  SELECT a, b, round(j, 9) AS jaccard FROM (SELECT x.page_id AS a, y.page_id AS b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE AS j
  FROM t x JOIN t y ON x.page_id < y.page_id WHERE len(x.w) >= 4 AND len(y.w) >= 4) WHERE j >= 0.85""")
def d4_title_identity_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, J6 over all pages."""
    return mirrors.corpus_titles(read_table(spark, sf_dir, "pages").select("page_id", tables.page_title(F.col("html")).alias("title")))


@query(f"""WITH RECURSIVE {_SHINGLES_SQL}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
  t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, 60)), '{K.WORD}')) AS w FROM documents),
  met AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / least(x.n, y.n)::DOUBLE >= 0.55
    UNION SELECT x.doc_id, y.doc_id FROM t x JOIN t y ON x.doc_id < y.doc_id WHERE len(x.w) >= 4 AND len(y.w) >= 4 AND len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE >= 0.85),
  turn AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents),
  edge AS (SELECT greatest(x.place, y.place) AS later, least(x.place, y.place) AS earlier FROM met JOIN turn x ON x.doc_id = a JOIN turn y ON y.doc_id = b),
  waits AS (SELECT later, list(earlier) AS before, row_number() OVER (ORDER BY later) AS step FROM edge GROUP BY later),
  go(step, dropped) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT go.step + 1, CASE WHEN len(list_filter(before, lambda e: NOT list_contains(dropped, e))) > 0 THEN list_append(dropped, later) ELSE dropped END FROM go JOIN waits ON waits.step = go.step + 1
  ),
  gone AS (SELECT unnest(dropped) AS place FROM (SELECT dropped FROM go ORDER BY step DESC LIMIT 1)),
  firsts AS (SELECT later, min(earlier) AS keeper FROM edge WHERE later IN (SELECT place FROM gone) AND earlier NOT IN (SELECT place FROM gone) GROUP BY later)
  SELECT turn.doc_id, k.doc_id AS mirror_of FROM turn LEFT JOIN firsts ON firsts.later = turn.place LEFT JOIN turn k ON k.place = firsts.keeper""")
def d5_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 over all documents."""
    return mirrors.corpus_mirrors(_pages_read(spark, sf_dir))


@query("SELECT conv_id AS run_id, turn AS seq, role AS event FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'result' END FROM conversations GROUP BY conv_id")
def t1_trail_with_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail and exactly one result or error after it."""
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("event"), F.col("text").alias("data"))
    outcome = c.select("run_id").distinct().where("run_id % 5 <> 0").select("run_id", F.lit(True).alias("ok"), F.lit("{}").alias("data"))
    return activity.with_terminal(c, outcome).select("run_id", "seq", "event")


# Passages.


@query(r"""WITH l AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1)::INT AS line_number FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)),
  k AS (SELECT doc_id, line_number, text FROM l WHERE regexp_matches(text, '[^\s\p{Z}]') AND length(text) % 5 <> 0),
  g AS (SELECT *, CASE WHEN line_number - lag(line_number) OVER (PARTITION BY doc_id ORDER BY line_number) > 1 THEN 1 ELSE 0 END AS leap FROM k)
  SELECT doc_id, line_number, sum(leap) OVER (PARTITION BY doc_id ORDER BY line_number)::BIGINT AS paragraph FROM g""")
def w9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a length that 5 divides stand for blank ones."""
    kept = passages.lines(read_table(spark, sf_dir, "documents")).where(F.length("text") % 5 != 0)
    return passages.paragraphs(kept).select("doc_id", "line_number", "paragraph")


# Text functions.


@query(f"SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), '{K.WORD}'), lambda w: {_FOLDED}), ' ') AS folded FROM benchmark")
def x1_fold_plural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(text.words("text"), text.fold_plural), " ").alias("folded"))


@query(f"""WITH f AS (SELECT page_id, {_label_sql("regexp_extract(html, '(?s)<body>(.*)$', 1)")} AS first FROM pages) SELECT page_id, {_cut_sql('first')} AS label FROM f""")
def x2_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", text.label(F.regexp_extract("html", "(?s)<body>(.*)$", 1)).alias("label"))


@query(rf"""WITH t AS (SELECT item_id, regexp_replace(regexp_replace(trim('## 2. ' || text || ' :'), '{K.THEME_PREFIX}', ''), '{K.THEME_TAIL}', '') AS b FROM benchmark),
  f AS (SELECT *, regexp_extract(b, '^(\S+)', 1) AS w FROM t) SELECT item_id, CASE WHEN lower(w) = w AND upper(w) <> w THEN upper(substr(b, 1, 1)) || substr(b, 2) ELSE b END AS theme FROM f""")
def x3_tidy_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat(F.lit("## 2. "), F.col("text"), F.lit(" :"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", text.tidy_theme(written).alias("theme"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'evidence_id' END AS leak FROM conversations")
def x7_id_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    leaked = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" evidence_id"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.id_leak(leaked).alias("leak"))


@query("SELECT page_id, array_to_string(string_split(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), chr(10))[1:5], chr(10)) AS quote FROM pages")
def x17_readable_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", text.readable_quote("html").alias("quote"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^www\\.', '') AS host, page_id || CASE WHEN page_id = 1 THEN ' search' ELSE ' searches' END AS searches FROM pages")
def x18_activity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", text.short_host("url").alias("host"), text.counted("page_id", "search").alias("searches"))


_SHORTFALL_SQL = "CASE " + " ".join(f"WHEN problem = '{k}' THEN '{v}'" for k, v in K.SHORTFALLS.items()) + f" ELSE '{K.SHORTFALL_OTHERWISE}' END"


@query(f"""WITH p AS (SELECT item_id, {sql_list([*K.SHORTFALLS, 'none'])}[1 + item_id % 6] AS problem, CASE WHEN item_id % 3 = 0 THEN ' ' ELSE text END AS missing FROM benchmark)
  SELECT item_id, 'The answer was ' || {_SHORTFALL_SQL} || '.' || CASE WHEN trim(missing) <> '' THEN ' It needed: ' || trim(missing) ELSE '' END AS said FROM p""")
def x19_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in [*K.SHORTFALLS, "none"]])
    b = read_table(spark, sf_dir, "benchmark").withColumn("problem", F.get(codes, (F.col("item_id") % 6).cast("int"))).withColumn("missing", F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.col("text")))
    return b.select("item_id", text.shortfall("problem", "missing", F.lit("")).alias("said"))


@query("SELECT conv_id AS question_id, string_agg('[evidence_id: ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id")
def x21_evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), F.col("turn").alias("chunk_id"), "text")
    return evidence.evidence_block(c)


@query("SELECT doc_id, 'd:' || sha256(text) AS cache_key FROM documents")
def x22_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22, S6."""
    return read_table(spark, sf_dir, "documents").select("doc_id", text.cache_key("d", "text").alias("cache_key"))


# Sources and streams.


@query("WITH k AS (SELECT doc_id, 'd:' || sha256(text) AS cache_key FROM documents) SELECT DISTINCT cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k JOIN labels USING (doc_id) WHERE quality = 1)")
def s6_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of good documents are fresh, those of the others are too old."""
    d = read_table(spark, sf_dir, "documents")
    age = F.when(F.col("quality") == 1, F.lit("2026-01-01 00:00:00")).otherwise(F.lit("2025-12-31 22:00:00")).cast("timestamp")
    cache = d.join(read_table(spark, sf_dir, "labels"), "doc_id").select(text.cache_key("d", "text").alias("cache_key"), age.alias("cached_at"))
    return providers.cache_misses(d.select("text"), cache, "2026-01-01 00:30:00").select("cache_key")


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE epoch_us(ts) + 3600000000 > (SELECT max(epoch_us(ts)) FROM events) ORDER BY ts DESC, event_id LIMIT 256)")
def s4_page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cache entries: those of the last hour, 256 at most, used last first."""
    e = read_table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("t")).first()["t"]
    cache = e.select("event_id", F.col("ts").alias("cached_at"), F.col("ts").alias("used_at"))
    return providers.evict(cache, newest, K.PAGE_CACHE_ROWS, key="event_id").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) >= 1997")
def s2_since_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem")
    return tables.since(rows.select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("published_year")), 1997).select("l_orderkey", "l_linenumber")


@query(r"""WITH t AS (SELECT page_id, url, html, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS b FROM pages),
  p AS (SELECT *, regexp_replace(regexp_replace(b, '(?i)<(?:br|p|/p|div|/div|li|h[1-6]|/h[1-6])\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS v FROM t),
  e AS (SELECT *, replace(replace(replace(replace(replace(replace(v, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS w FROM p)
  SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(w, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS markdown FROM e""")
def s3_scraped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scraped_pages(read_table(spark, sf_dir, "pages"))


@query("SELECT doc_id, CASE WHEN length(text) < 3 THEN 'too short' WHEN length(text) > 500 THEN 'too long' WHEN doc_id % 25 NOT BETWEEN 1 AND 20 THEN 'limit' END AS reason FROM documents")
def s10_valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), (F.col("doc_id") % 25).cast("int").alias("limit"))
    return tables.valid_requests(requests).select("doc_id", "reason")


@query("""SELECT conv_id, turn, 'event: ' || role || chr(10) || 'data: {"conv_id":' || conv_id || ',"turn":' || turn || '}' || chr(10) || chr(10) AS frame FROM conversations""")
def s11_event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("event"))
    return activity.frames(c).select("conv_id", "turn", "frame")


@query("SELECT conv_id, turn, role AS event FROM conversations")
def t6_parsed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are parsed back, and their JSON with them."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("event"))
    parsed = activity.parse_frames(activity.frames(c).select(F.concat(F.lit(":\n\n"), "frame").alias("body")))
    return parsed.select(F.from_json("data", "conv_id long, turn long").alias("d"), "event").select("d.conv_id", "d.turn", "event")


@query("""WITH g AS (SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events)
  SELECT user_id, event_id, gap_us, (gap_us - 1) // 15000000 AS heartbeats FROM g WHERE gap_us > 15000000""")
def t2_heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.heartbeat_gaps(read_table(spark, sf_dir, "events"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as files that arrive in a folder."""
    rows = spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 15000000 THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g),
  w AS (SELECT user_id, min(epoch_us(ts)) AS began_us, max(epoch_us(ts)) + 15000000 AS silent_from_us, count(*) AS n_events FROM s GROUP BY user_id, n)
  SELECT * FROM w WHERE silent_from_us <= (SELECT max(epoch_us(ts)) - 60000000 FROM events)""")
def t2_stream_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, T3 over a stream: the sessions of events that a silence ended, as far as the watermark has come."""
    found = activity.drained(activity.silences(_event_stream(spark, sf_dir)), "silences")
    return found.select("user_id", F.unix_micros("began").alias("began_us"), F.unix_micros("silent_from").alias("silent_from_us"), "n_events")


@query("SELECT user_id, event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def t3_streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, S11 over a stream: every event as a frame, in micro-batches, to the end of what there is."""
    rows = _event_stream(spark, sf_dir).select("user_id", "event_id", activity.frame(F.col("event_type"), F.col("props")).alias("frame"))
    return activity.drained(rows, "frames")


@query("""SELECT user_id AS run_id, event_id AS seq, event_type AS event FROM events
  UNION ALL SELECT user_id, max(event_id) + 1, CASE WHEN user_id % 5 <> 0 AND user_id % 3 <> 0 THEN 'result' ELSE 'error' END FROM events GROUP BY user_id""")
def t5_redelivered_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that breaks twice after it has written gets every event once; a user's events are a run, with one end each."""
    folder, tries = f"{session_folder(spark)}/trail-{uuid.uuid4().hex}", []
    table = activity.batch_table(f"{folder}/rows")

    def sink(batch: DataFrame, number: int) -> None:
        table(batch, number)
        tries.append(number)
        if tries.count(number) < 3:
            raise ConnectionError("the client has gone")

    rows = _event_stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.col("props").alias("data"))
    activity.feed_kept(rows, sink, f"{folder}/checkpoint", f"{folder}/letters").awaitTermination()
    while activity.redeliver(spark, sink, f"{folder}/letters"):
        pass
    trail = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    runs = trail.select("run_id").distinct().where("run_id % 5 <> 0")
    outcome = runs.select("run_id", (F.col("run_id") % 3 != 0).alias("ok"), F.lit("done").alias("data"))
    return activity.with_terminal(trail, outcome).select("run_id", "seq", "event")


@query("""WITH t AS (SELECT user_id AS question_id, event_type, props, event_id, event_id % 2 AS attempt FROM events)
  SELECT question_id, count(DISTINCT CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN props END) AS sources, count(*) FILTER (event_type = (SELECT max(event_type) FROM events)) AS read, count(DISTINCT attempt) AS passes FROM t GROUP BY question_id""")
def a12_trail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first kind of event stands for a source found, the last for a page read."""
    e = read_table(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    kind = F.when(F.col("event_type") == kinds["a"], "source_found").when(F.col("event_type") == kinds["b"], "scrape_ok").otherwise("other")
    return evidence.trail_counts(e.select(F.col("user_id").alias("question_id"), kind.alias("kind"), F.col("props").alias("url"), (F.col("event_id") % 2).alias("attempt")))


@query()
def l0_research_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline (L1 to L5 by rules): every question against the documents as pages."""
    return Research(providers.CorpusSearch(_corpus_pages(spark, sf_dir)), year=TODAY).run(_questions(spark, sf_dir))


@query()
def t1_answer_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their trails as server-sent events."""
    return api.answer_frames(Research(providers.CorpusSearch(_corpus_pages(spark, sf_dir)), year=TODAY), _questions(spark, sf_dir))


FLAGSHIP = "w3_bm25_search"
