"""Ranking passages: BM25 (A4 to A6, W3), vector distance (W1), the fallback from one to the other (W2), spreading over sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.functions.text import anchors, fold_plural, words
from lodestone.plans.stage import staged

#: Query vectors that are broadcast at a time; more are ranked block by block.
VECTORS_AT_A_TIME = 4096
#: Of these, as many go into one matrix product (20 MB for a batch of 10,000 vectors).
QUERIES_AT_A_TIME = 256
#: Terms of all questions up to this many are broadcast to the scan of the texts.
BROADCAST_TERMS = 200_000


def tokens_of(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, length, term) of every word. explode_outer, because Spark infers a filter for explode
    that splits each text once more; texts without words give a null term."""
    split = docs.select(*keys, words(text).alias("__words"))
    return split.select(*keys, F.size("__words").alias("length"), F.explode_outer("__words").alias("__word")).select(*keys, "length", fold_plural("__word").alias("term"))


def term_frequencies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A4: (key, term, tf)."""
    return tokens_of(docs, [key], text).where("term is not null").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """A5: one row: number of texts and their average length in terms (1 where that is 0)."""
    size = F.size(words(F.coalesce(F.col(text), F.lit(""))))
    average = F.avg(size.cast("double"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.nullif(average, F.lit(0.0)), F.lit(1.0)).alias("avg_len"))


def question_terms(questions: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    return questions.select(key, F.explode(anchors(text)).alias("term"))


def bm25(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """(question_id, key, score) of the pairs that share a term; scores have nine places.

    Texts are split once: the terms of questions (broadcast up to a checked number) and one row of
    each text leave the scan, and frequencies, lengths and weights are counted from that table.
    Frequent terms make long postings, never pairs of texts.
    """
    wanted = staged(question_terms(questions), "terms")
    terms = wanted.select("term").distinct()
    few = F.broadcast if terms.count() <= BROADCAST_TERMS else (lambda df: df)
    split = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("__words"))
    each = split.select(key, F.size("__words").alias("length"), F.posexplode_outer("__words").alias("__pos", "__word")).withColumn("term", fold_plural("__word"))
    found = each.join(few(terms.withColumn("__asked", F.lit(True))), "term", "left").where("__asked or coalesce(__pos, 0) = 0")
    counted = found.groupBy(key, F.when(F.col("__asked"), F.col("term")).alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"), F.max((F.coalesce("__pos", F.lit(0)) == 0).cast("int")).alias("first"))
    table = staged(counted, "postings")
    # each text has one row with its first word, whatever its term
    size = table.where("first = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).first()
    n, average = F.lit(float(size["n"])), F.lit(float(size["words"] or 0) / size["n"] if size["n"] and size["words"] else 1.0)
    matched = table.where("term is not null")
    frequency = matched.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / average)
    weighed = matched.join(few(frequency), "term").select(key, "term", (idf * F.col("tf") * (k1 + 1) / norm).alias("__w"))
    return weighed.join(few(wanted) if wanted.count() <= BROADCAST_TERMS else wanted, "term").groupBy("question_id", key).agg(F.round(F.sum("__w"), 9).alias("score"))


def bm25_within(questions: DataFrame, passages: DataFrame, key: str = "chunk_id", text: str = "text", k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """W3 over each question's own passages: frequencies, lengths and their average are those of one question.

    passages: question_id, key, text; the result (question_id, key, score) has those that share a term.
    Passages of different questions never meet.
    """
    wanted = question_terms(questions)
    lengths = passages.select("question_id", key, F.size(words(text)).alias("length"))
    statistics = lengths.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nullif(F.avg(F.col("length").cast("double")), F.lit(0.0)), F.lit(1.0)).alias("average"))
    tf = tokens_of(passages, ["question_id", key], text).join(wanted, ["question_id", "term"]).groupBy("question_id", key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average"))
    weighed = tf.join(df, ["question_id", "term"]).join(statistics, "question_id").withColumn("__w", idf * F.col("tf") * (k1 + 1) / norm)
    return weighed.groupBy("question_id", key).agg(F.round(F.sum("__w"), 9).alias("score"))


def top_k(scored: DataFrame, k: int, by: list, within: str | list[str] = "question_id", rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 0; Spark cuts each task's groups before the shuffle."""
    w = Window.partitionBy(within).orderBy(*by)
    return scored.withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < k)


def rank_by_terms(questions: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K.RESULTS_PER_QUERY) -> DataFrame:
    """The best ``k`` texts of each question; ties go to the smaller key. Texts without a term in common don't come."""
    return top_k(bm25(questions, docs, key, text), k, [F.desc("score"), F.col(key)])


def rank_by_distance(queries: DataFrame, vectors: DataFrame, k: int, block: int = VECTORS_AT_A_TIME) -> DataFrame:
    """(question_id, chunk_id, distance, rank) of the ``k`` nearest by squared L2 distance, exactly.

    ``queries`` (question_id, embedding) are broadcast ``block`` at a time; each scan task keeps the
    best ``k`` of its rows for each query, so the shuffle has no more than tasks x queries x k rows.
    Distances have nine places; ties go to the smaller chunk_id. Null or empty vectors have no distance.
    """
    fields = [("question_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())]
    rows = queries.where("size(embedding) > 0").select(F.col("question_id").cast("long"), F.col("embedding").cast("array<double>")).orderBy("question_id")
    parts = []
    total = rows.count()
    for begin in range(0, max(total, 1), block):
        some = rows.offset(begin).limit(block).toArrow() if total > block else rows.toArrow()
        ids = np.array(some.column(0).to_pylist(), dtype=np.int64)
        matrix = np.array(some.column(1).to_pylist(), dtype=np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best: list[list[tuple[float, int]]] = [[] for _ in ids]
            for batch in batches if k > 0 else ():
                keys, each = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                kept = [(c, v) for c, v in zip(keys, each) if v and len(ids) and len(v) == matrix.shape[1]]
                if not kept:
                    continue
                x = np.array([v for _, v in kept], dtype=np.float64)
                chunk = np.array([c for c, _ in kept], dtype=np.int64)
                norm = (x**2).sum(axis=1)
                for lo in range(0, len(ids), QUERIES_AT_A_TIME):
                    part = matrix[lo : lo + QUERIES_AT_A_TIME]
                    near = norm[:, None] - 2 * x @ part.T + (part**2).sum(axis=1)
                    # whatever could be among the first k for all that rounding does to a product
                    slack = 1e-8 + 1e-12 * (norm.max() + (part**2).sum(axis=1))
                    edge = np.partition(near, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1] + 2 * slack
                    edge = np.minimum(edge, [best[lo + q][-1][0] + slack[q] if len(best[lo + q]) == k else np.inf for q in range(len(part))])
                    for q in np.flatnonzero((near <= edge).any(axis=0)).tolist():
                        rows = np.flatnonzero(near[:, q] <= edge[q])
                        d = np.round(((x[rows] - part[q]) ** 2).sum(axis=1), 9)
                        best[lo + q] = sorted(best[lo + q] + list(zip(d.tolist(), chunk[rows].tolist())))[:k]
            out = [(int(q), c, d) for q, found in zip(ids, best) for d, c in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))

        table = vectors.select(F.col("chunk_id").cast("long"), F.col("embedding").cast("array<double>"))
        parts.append(table.mapInArrow(nearest, "question_id long, chunk_id long, distance double"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return top_k(merged, k, [F.col("distance"), F.col("chunk_id")])


def distance_within(questions: DataFrame, passages: DataFrame, key: str = "chunk_id") -> DataFrame:
    """W1 over each question's own passages: (question_id, key, distance), squared L2 with nine places.

    questions (question_id, embedding), passages (question_id, key, embedding). A question comes only if
    its own vector and those of all its passages are there and of one length: a service that fails for
    some of them has failed for the question.
    """
    asked = questions.where("size(embedding) > 0").select("question_id", F.col("embedding").cast("array<double>").alias("__q"))
    met = passages.select("question_id", key, F.col("embedding").cast("array<double>").alias("__p")).join(asked, "question_id")
    fits = F.coalesce(F.size("__p") == F.size("__q"), F.lit(False))
    lacking = met.where(~fits).select("question_id").distinct()
    distance = F.aggregate(F.zip_with("__p", "__q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return met.where(fits).select("question_id", key, F.round(distance, 9).alias("distance")).join(lacking, "question_id", "left_anti")


def with_fallback(by_vector: DataFrame, by_terms: DataFrame, questions: DataFrame) -> DataFrame:
    """The vector ranking of the questions that have one, the term ranking of all others; (question_id, chunk_id, rank, method)."""
    ranked = by_vector.select("question_id", "chunk_id", "rank", F.lit("vector").alias("method"))
    without = questions.select("question_id").join(by_vector.select("question_id").distinct(), "question_id", "left_anti")
    rest = by_terms.join(without, "question_id", "left_semi").select("question_id", "chunk_id", "rank", F.lit("terms").alias("method"))
    return ranked.unionByName(rest)


def spread(ranked: DataFrame, limit: int = K.TOP_PASSAGES, source: str = "source_url", within: str = "question_id") -> DataFrame:
    """One passage of each source in turn, sources by their best rank; the first ``limit`` with their ``place``."""
    own = Window.partitionBy(within, source)
    turned = ranked.withColumn("__turn", F.row_number().over(own.orderBy("rank"))).withColumn("__lead", F.min("rank").over(own))
    return top_k(turned, max(0, limit), [F.col("__turn"), F.col("__lead"), F.col("rank")], within, "place").drop("__turn", "__lead")


def spread_best(scored: DataFrame, limit: int = K.TOP_PASSAGES, key: str = "doc_id", source: str = "source_url", within: str = "question_id") -> DataFrame:
    """W4 from scores (within, key, source, score): ``spread`` of the ranking by score and key, without ranking all.

    No more than ``limit`` of each source can be among the first; they are cut before the shuffle.
    Their ranks come from the numbers of rows in bands of scores, and from the rows of their own bands.
    """
    rows = staged(scored.withColumn("__band", F.floor(F.col("score") * 100)), "scored")
    best = [F.desc("score"), F.col(key)]
    kept = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(within, source).orderBy(*best))).where(F.col("__nth") <= max(0, limit)).drop("__nth")
    bands = rows.groupBy(within, "__band").agg(F.count(F.lit(1)).alias("__n"))
    above = bands.withColumn("__above", F.sum("__n").over(Window.partitionBy(within).orderBy(F.desc("__band"))) - F.col("__n")).drop("__n")
    near = rows.select(within, key, "score", "__band").join(kept.select(within, "__band").distinct(), [within, "__band"], "left_semi")
    placed = near.withColumn("__at", F.row_number().over(Window.partitionBy(within, "__band").orderBy(*best)) - 1).join(above, [within, "__band"])
    ranks = placed.select(within, key, (F.col("__above") + F.col("__at")).cast("int").alias("rank"))
    return spread(kept.drop("__band").join(ranks, [within, key]), limit, source, within)


def source_count(rows: DataFrame, source: str = "source_url", within: str = "question_id") -> DataFrame:
    """Different sources of each question."""
    return rows.groupBy(within).agg(F.count_distinct(source).alias("n_sources"))
