"""The queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import divergence, exact_dedup, importance, kneser_ney, language_id, minhash, mixing, ngram_join, packing, pii, quality_rules, toxicity, warc
from lodestone.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), keep_ids=False)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op11_source_divergence": op11_source_divergence,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_minhash_dedup": op13_minhash_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "op1_toxicity": op1_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op5_mixing_sources": op5_mixing_sources,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _groups_sql(words: int, percent: int, columns: str) -> str:
    """Groups of documents whose sets of n-grams are linked: overlaps of all pairs that share one, then reachability."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: hash(w[i:i + {words - 1}])) WHEN len(w) > 0 THEN [hash(w)] ELSE [] END) AS gram FROM d
        ),
        sizes AS (SELECT doc_id, count(gram) AS n FROM d LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc, other) AS (SELECT a, b FROM both_ways UNION SELECT reach.doc, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
        least AS (SELECT doc, min(other) AS other FROM reach GROUP BY doc),
        found AS (SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM sizes LEFT JOIN least ON doc = doc_id)
        SELECT {columns} FROM found
    """


def _crc_step(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


#: What four bits do to a CRC-32.
_CRC_STEPS = "[" + ", ".join(f"{_crc_step(n)}::BIGINT" for n in range(16)) + "]"

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": _groups_sql(3, 90, "*"),
    "op13_minhash_dedup": _groups_sql(4, 80, "*, doc_id = component_id AS kept"),
    "op11_source_divergence": rf"""
        WITH d AS (
          SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                 regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
        ),
        words AS (SELECT row, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        sizes AS (
          SELECT lang, source, coalesce(s, 0) + coalesce(v, 0) AS size FROM groups
          LEFT JOIN (SELECT lang, source, sum(n) AS s FROM counts GROUP BY ALL) USING (lang, source)
          LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) USING (lang)
        ),
        shares AS (
          SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // size::HUGEINT AS p
          FROM sizes JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
        ),
        all_shares AS (
          SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q
          FROM counts GROUP BY lang, term
        ),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        found AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares JOIN all_shares USING (lang, term) WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found)
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op12_importance_resampling": rf"""
        WITH texts AS (SELECT 'd' AS side, doc_id, {_LOWERED} AS text FROM documents UNION ALL SELECT 't', NULL, {_LOWERED} FROM benchmark),
        w AS (SELECT row_number() OVER () AS row, side, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        runs AS (SELECT row, side, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS run FROM w),
        coded AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM runs)),
        nibbles AS (SELECT run, list_transform(range(length(h)), lambda i: strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1) AS nibbles FROM coded),
        hashed AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, nibbles), lambda c, x: xor(c >> 4, {_CRC_STEPS}[1 + xor(c & 15, x)])), 4294967295::BIGINT) % 10000 AS bucket FROM nibbles),
        placed AS (SELECT row, side, bucket FROM runs JOIN hashed USING (run)),
        totals AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 't') AS t_all FROM placed),
        gains AS (
          SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
          FROM (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM placed GROUP BY bucket), totals
        ),
        weights AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
        scored AS (
          SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM w LEFT JOIN weights USING (row) WHERE side = 'd'
        ),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranks
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM g
    """,
    "op5_mixing_sources": """
        WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        weighted AS (SELECT source, n, pow(n::DOUBLE, 0.5) AS weight FROM sizes),
        rates AS (
          SELECT source, (SELECT sum(n) FROM weighted)::DOUBLE * (weight / (SELECT sum(weight) FROM weighted)) / n AS rate FROM weighted
        ),
        poisson(source, rate, k, term, total) AS (
          SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
          UNION ALL
          SELECT source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1)
          FROM poisson WHERE k < CAST(ceil(rate + 12.0 * sqrt(rate) + 25.0) AS INT)
        ),
        drawn AS (
          SELECT d.*, ('0x' || substr(md5('5:' || d.doc_id || ':0'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d
        ),
        counts AS (
          SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
          FROM drawn d JOIN poisson p ON p.source = d.source AND p.total <= d.u GROUP BY ALL
        )
        SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INT AS copy FROM counts
    """,
    "op7_exact_dedup": """
        WITH d AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
}
