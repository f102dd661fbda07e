import os
import uuid

import pytest

from pyspark.sql import functions as F

from lodestone.sources.cache import CacheTable, Conflict

NOW, LATER, NEXT_DAY = "2026-01-01 10:00:00", "2026-01-01 10:30:00", "2026-01-02 10:00:00"


@pytest.fixture
def cache(spark):
    return CacheTable(spark, uuid.uuid4().hex)


@pytest.fixture
def texts(spark):
    return spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 30).alias("cache_key"), F.concat(F.lit("text "), F.col("id") % 30).alias("text"), "id")


def counted(folder, refused=()):
    """A service that notes what it was asked; tasks append to a file each."""
    os.makedirs(folder, exist_ok=True)

    def call(batch):
        assert len(batch) <= 4
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(batch))
        if any(t in refused for t in batch):
            raise ValueError("refused")
        return [[float(len(t))] for t in batch]

    return call


def asked(folder):
    return sorted(line for f in os.listdir(folder) for line in open(f"{folder}/{f}").read().split("\n"))


def test_second_run_calls_for_misses_only(cache, texts, tmp_path):
    some = texts.where("id < 10")
    first = cache.through(some, counted(tmp_path / "a"), NOW, size=4, wave=2)
    assert {(r.cache_key, r.value[0]) for r in first.collect()} == {(f"k{k}", 6.0) for k in range(10)}
    again = cache.through(texts, counted(tmp_path / "b"), LATER, size=4, wave=2)
    assert again.count() == 50 and again.where("value is null").isEmpty()
    assert asked(tmp_path / "a") == sorted(f"text {k}" for k in range(10))
    assert asked(tmp_path / "b") == sorted(f"text {k}" for k in range(10, 30))
    entries = {r.cache_key: (str(r.cached_at), str(r.used_at)) for r in cache.read(LATER).collect()}
    assert len(entries) == 30 and entries["k3"] == (NOW, LATER) and entries["k20"] == (LATER, LATER)
    old = cache.through(some, counted(tmp_path / "c"), NEXT_DAY, size=4)
    assert old.where("value is null").isEmpty() and len(asked(tmp_path / "c")) == 10


def test_a_failing_wave_keeps_those_before_it(cache, texts, tmp_path):
    def refuses(batch):
        raise ValueError("refused")

    cache.through(texts.where("id < 8"), counted(tmp_path / "a"), NOW, size=4, wave=1)
    with pytest.raises(Exception, match="refused"):
        cache.through(texts, refuses, NOW, size=4, wave=1)
    assert cache.read(NOW).count() == 8
    cache.through(texts, counted(tmp_path / "b"), NOW, size=4, wave=3)
    rows = cache.spark.read.schema(cache.schema).parquet(*[f"{cache.folder}/parts/{p}" for p in cache.version()[1]])
    assert len(asked(tmp_path / "b")) == 22 and rows.where("value is not null").groupBy("cache_key").count().where("count > 1").isEmpty()


def test_one_writer_wins_a_version(cache, texts):
    rows = texts.select("cache_key", F.array(F.lit(1.0)).alias("value"))
    assert cache.add(rows, NOW) == 30
    number, parts = cache.version()
    with pytest.raises(Conflict):
        cache.commit(number, parts)
    cache._write(rows.select("cache_key", F.lit(NOW).alias("cached_at"), F.lit(NOW).alias("used_at"), "value"))  # as a killed attempt leaves it
    assert cache.version() == (number, parts) and cache.read(NOW).count() == 30
    assert cache.add(rows, NOW) == 0 and cache.version()[0] == number


def test_parts_are_merged(cache, spark, monkeypatch):
    monkeypatch.setattr("lodestone.sources.cache.MOST_PARTS", 3)
    for k in range(6):
        cache.add(spark.createDataFrame([(f"k{k}", [float(k)])], "cache_key string, value array<double>"), NOW)
    assert len(cache.version()[1]) <= 4 and {r.cache_key: r.value for r in cache.read(NOW).collect()} == {f"k{k}": [float(k)] for k in range(6)}


def test_eviction_keeps_what_was_used_last(cache, texts):
    cache.add(texts.select("cache_key", F.array(F.lit(1.0)).alias("value")), NOW)
    cache.use(texts.where("id in (4, 7, 21)"), LATER)
    cache.evict(LATER, 5)
    assert {r.cache_key for r in cache.read(LATER).collect()} == {"k4", "k7", "k21", "k0", "k1"}
    cache.evict(NEXT_DAY, 5)
    assert cache.read(NOW).count() == 0


def test_empty_and_null(cache, texts, spark):
    assert cache.read(NOW).collect() == [] and cache.version() == (0, [])
    odd = spark.createDataFrame([(None, "x", 1), ("k", None, 2)], "cache_key string, text string, id long")
    found = cache.through(odd, lambda batch: [[0.0]] * len(batch), NOW)
    assert sorted((r.id, r.value) for r in found.collect()) == [(1, None), (2, None)]
    assert cache.through(texts.where("false"), lambda batch: [], NOW).collect() == []


def test_waves_read_no_part_of_their_own_run(cache, texts, tmp_path, monkeypatch):
    read = []
    plain = cache._entries
    monkeypatch.setattr(type(cache), "_entries", lambda self, parts: (read.append(len(parts)), plain(parts))[1])
    found = cache.through(texts, counted(tmp_path / "a"), NOW, size=2, wave=1)
    assert len(cache.version()[1]) > 8 and len(read) <= 3  # before the first wave, and for the result
    assert found.where("value is null").isEmpty() and asked(tmp_path / "a") == sorted(f"text {k}" for k in range(30))
