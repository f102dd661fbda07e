import random

import pytest

from pyspark.sql import functions as F

from lodestone.operators import inverted, ranking


def texts(n, seed=1):
    """Words of falling frequency, and in every text the word everywhere."""
    rng = random.Random(seed)
    return [(k, " ".join([f"term{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 40))] + ["everywhere"] * rng.randint(1, 4))) for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(1500) + [(9001, None), (9002, ""), (9003, "?! --")], "doc_id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(1, "term1 everywhere"), (2, "everywhere"), (3, "terms3 term17 term40 everywhere"), (4, "nowhere"), (5, None), (6, ""), (7, "termtwo term1")]
    return spark.createDataFrame(rows, "question_id long, question string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("question_id", "doc_id", "score", "rank").collect())


def letters(df, column):
    """Anchors have letters only, so numbers are spelt."""
    return df.withColumn(column, F.translate(column, "0123456789", "abcdefghij"))


@pytest.mark.parametrize("named, broadcast", [(2000, 200_000), (0, 0)])
def test_equals_the_search_of_all_texts(docs, questions, monkeypatch, named, broadcast):
    monkeypatch.setattr(inverted, "NAMED_TERMS", named)
    monkeypatch.setattr(inverted, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(inverted, "BUCKET_POSTINGS", 5000)
    docs, questions = letters(docs, "text"), letters(questions, "question")
    index = inverted.build_index(docs.where("doc_id % 3 <> 0"))
    grown = index.add(docs.where("doc_id % 3 = 0"))
    for k in (1, 10, 5000):
        assert rows_of(inverted.search_index(grown, questions, k)) == rows_of(ranking.rank_by_terms(questions, docs, k=k))
    assert rows_of(inverted.search_index(index, questions, 10)) == rows_of(ranking.rank_by_terms(questions, docs.where("doc_id % 3 <> 0"), k=10))


def test_few_terms_read_a_small_share(docs, questions, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 32)
    monkeypatch.setattr(inverted, "FIRST", 64)
    docs, questions = letters(docs, "text"), letters(questions, "question")
    index = inverted.build_index(docs)
    plan = inverted.plan_search(index, questions, 10)
    read = {r.question_id: r.read / r.of_terms for r in inverted.postings_read(plan).collect()}
    assert read[2] < 0.05 and read[1] < 0.8 and set(read) == {1, 2, 3, 7}
    assert rows_of(inverted.search_index(index, questions, 10, plan)) == rows_of(ranking.rank_by_terms(questions, docs, k=10))


def test_bounds_hold_for_every_posting(docs):
    index = inverted.build_index(letters(docs, "text"))
    found = index.segments[0][0].select("most", "shortest", "n", F.explode("postings").alias("p"))
    assert found.where("p.tf > most or p.length < shortest").isEmpty()
    assert index.segments[0][0].where("n <> size(postings)").isEmpty() and index.n == 1503


def test_empty_tables(docs, questions):
    index = inverted.build_index(docs.where("false"))
    assert inverted.search_index(index, questions).collect() == []
    assert inverted.search_index(inverted.build_index(docs), questions.where("false")).collect() == []


def test_blocks_of_a_term_are_full_and_runs_agree(spark, monkeypatch):
    texts = [(i, " ".join(["light"] * (1 + i % 7) + [f"w{k}" for k in range(i % 90)])) for i in range(1000)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame([(1, "light"), (2, "light w89"), (3, "w3 w88")], "question_id long, question string")
    expected = sorted(map(tuple, ranking.rank_by_terms(questions, docs).collect()))
    for run, most in ((inverted.RUN, 8), (100, 20)):  # 1000 postings are eight blocks, or one or two for each of ten runs
        monkeypatch.setattr(inverted, "RUN", run, raising=False)
        index = inverted.build_index(docs)
        (segment, _), = index.segments
        blocks = segment.where("term = 'light'").select("n", "block").collect()
        assert sum(b.n for b in blocks) == 1000 and len({b.block for b in blocks}) == len(blocks) <= most
        assert (index.n, index.words) == (1002, sum(len(t.split()) for _, t in texts))
        assert sorted(map(tuple, inverted.search_index(index, questions).collect())) == expected
