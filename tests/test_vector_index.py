import numpy as np
import pytest

from lodestone.operators import vector_index as V
from lodestone.operators.ranking import rank_by_distance


@pytest.fixture(scope="module")
def clouds(spark):
    """Clouds of vectors with repeated ones, and rows that have no vector or another length."""
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 10, (25, 8))
    x = middles[rng.integers(0, 25, 2500)] + rng.normal(0, 1, (2500, 8))
    x[1000:1020] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [1.0, 2.0])]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5).cache()


def asked(clouds):
    return clouds.where("chunk_id % 50 = 0 or chunk_id > 9000").withColumnRenamed("chunk_id", "question_id")


def rows_of(df):
    return sorted((r.question_id, r.rank, r.chunk_id, r.distance) for r in df.collect())


def test_exact_search_equals_all_distances_and_skips_lists(clouds):
    index = V.build_vector_index(clouds)
    found = V.search_vectors(index, asked(clouds), 10)
    assert rows_of(found.rows) == [r for r in rows_of(rank_by_distance(asked(clouds).where("size(embedding) = 8"), clouds.where("size(embedding) = 8"), 10))]
    assert found.read < 0.6 * found.pairs


@pytest.mark.parametrize("k, probes, block", [(1, 1, 7), (60, 2, 4096), (3000, 1, 4096)])
def test_any_number_of_neighbours_probes_and_blocks(clouds, k, probes, block):
    some = asked(clouds).where("size(embedding) = 8 and question_id % 250 = 0")
    index = V.build_vector_index(clouds.where("chunk_id % 3 <> 1"), lists=20).add(clouds.where("chunk_id % 3 = 1"))
    assert rows_of(V.search_vectors(index, some, k, probes, block=block).rows) == rows_of(rank_by_distance(some, clouds.where("size(embedding) = 8"), k))


def test_approximate_search_finds_nine_in_ten(clouds):
    index = V.build_vector_index(clouds)
    few = V.search_vectors(index, asked(clouds), 10, exact=False)
    told = V.recall(few.rows, rank_by_distance(asked(clouds).where("size(embedding) = 8"), clouds.where("size(embedding) = 8"), 10)).first()
    assert told["found"] >= 0.9 * told["asked"] and few.read < 0.4 * few.pairs


def test_approximate_search_finds_nine_in_ten_without_clusters(spark):
    x = np.random.default_rng(5).normal(0, 1, (6000, 24))
    plain = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_id long, embedding array<double>").cache()
    queries = plain.where("chunk_id % 60 = 0").withColumnRenamed("chunk_id", "question_id")
    index = V.build_vector_index(plain.where("chunk_id % 7 <> 0")).add(plain.where("chunk_id % 7 = 0"))
    few = V.search_vectors(index, queries, 10, exact=False)
    told = V.recall(few.rows, rank_by_distance(queries, plain, 10)).first()
    assert told["found"] >= 0.9 * told["asked"] and few.read < few.pairs


def test_large_lists_are_several_files(clouds, monkeypatch):
    monkeypatch.setattr(V, "FILE_ROWS", 100)
    index = V.build_vector_index(clouds, lists=2)
    assert len(index.vectors.inputFiles()) > 6 and index.vectors.count() == 2500
    assert rows_of(V.search_vectors(index, asked(clouds), 3).rows) == rows_of(rank_by_distance(asked(clouds).where("size(embedding) = 8"), clouds.where("size(embedding) = 8"), 3))


def test_empty_tables(clouds):
    index = V.build_vector_index(clouds)
    assert V.search_vectors(index, asked(clouds).where("false"), 5).rows.collect() == []
    none = V.build_vector_index(clouds.where("false"))
    assert V.search_vectors(none, asked(clouds), 5).rows.collect() == [] and none.vectors.collect() == []
