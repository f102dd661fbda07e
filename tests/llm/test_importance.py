import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestone.llm import importance as I

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(rows, targets, percent=5, least=20):
    each = [(doc, *features(text)) for doc, text in rows]
    s, t = Counter(b for _, f, _ in each for b in f), Counter(b for x in targets for b in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for doc, f, n in each:
        h = int(hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = Counter((*r[:4], i + 1 if i < len(order) * percent // 100 else None) for i, r in enumerate(order))
    return ranks + Counter((*r[:4], None) for r in out if r[4] < least)


def check(df, target, **options):
    got = Counter(tuple(r) for r in I.resample(df, target, **options).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], [r.text for r in target.collect()], *options.values())


@pytest.fixture(scope="module")
def target(spark, corpus):
    return spark.createDataFrame([(r[1],) for r in corpus[::9]] + [(None,), ("",)], "text string")


@given(st.text(alphabet="aB c1\n-_éÉ\x7f☃", max_size=60))
@settings(max_examples=100, deadline=None)
def test_buckets(text):
    found, n = I.buckets_of(text)
    assert (found.tolist(), n) == features(text)


def test_runs():
    values = np.array([3, 1, 3, 3, 9999, 0], dtype=np.uint16)
    assert [a.tolist() for a in I.run_lengths(values)] == [[0, 1, 3, 9999], [1, 1, 3, 1]]
    assert [a.tolist() for a in I.run_lengths(values[:0])] == [[], []]


def test_against_brute_force(docs, odd, target):
    check(docs, target)
    check(odd, target, percent=40, least_words=1)


def test_streams_of_any_length(docs, target, monkeypatch):
    monkeypatch.setattr(I, "CHARS_OF_A_STREAM", 500)
    assert I.write_streams(docs, "small").count() > 50
    check(docs, target, percent=100)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 300).alias("score")).repartition(7)
    got = {r.doc_id: r.rank for r in I.ranked(rows, 450).collect()}
    order = sorted(range(1000), key=lambda d: (-(d // 300), d))
    assert got == {d: i + 1 if i < 450 else None for i, d in enumerate(order)}


def test_empty_tables(spark, docs, empty, target):
    assert I.resample(empty, target).collect() == []
    check(docs, target.where("false"))


def test_other_columns_stay_out(docs, target):
    assert I.resample(docs.withColumn("stream", F.lit(1)).withColumn("__at", F.lit("k")), target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
