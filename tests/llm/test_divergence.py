import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodestone.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    texts = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        df = Counter(t for g, _, ws in texts if g == lang for t in set(ws))
        kept = sorted(t for t, n in df.items() if n >= 3)
        sources = sorted({s for g, s, _ in texts if g == lang})
        count = {s: Counter(t for g, x, ws in texts if g == lang and x == s for t in ws) for s in sources}
        count[None] = sum(count.values(), Counter())

        def share(s):
            size = sum(count[s][t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[s][t] + 1) // size for t in kept}

        p = {s: share(s) for s in count}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())))]
            terms = [((p[s][t] - p[None][t]) ** 2 // p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return Counter(out)


def check(df, top=200):
    got = Counter(tuple(r) for r in D.audit_sources(df, top).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute([(r.text, r.lang, r.source) for r in df.select("text", "lang", "source").collect()], top)


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 10**15, 300)
    for size in (counts.max() + 7, 8 * 10**15):
        assert D.shares(counts, size).tolist() == [1 + 10**9 * (c + 1) // int(size) for c in counts.tolist()]
    assert D.shares(np.array([0]), 1).tolist() == [10**9 + 1]


def test_against_brute_force(docs, odd):
    check(docs)
    check(odd)
    check(docs, top=5)


@pytest.mark.parametrize("terms, counts, size", [(7, 10**6, 1 << 21), (4096, 9, 1 << 21), (50, 40, 30)])
def test_chunks_of_any_size(docs, monkeypatch, terms, counts, size):
    for name, value in (("CHUNK_TERMS", terms), ("CHUNK_COUNTS", counts), ("SLICE", size), ("HELD_SUMS", 1), ("COUNTERS", 100)):
        monkeypatch.setattr(D, name, value)
    check(docs)


def test_ties_and_groups_without_terms(spark):
    rows = [("b a É z", "en", "s")] * 3 + [("a b é z", "en", "t")] * 3 + [("", "en", "u"), (None, None, None), ("x", None, "v"), ("1 2", "xx", "w"), ("only", "yy", "w")]
    check(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3))


def test_empty_and_other_columns(empty, docs):
    assert D.audit_sources(empty).collect() == []
    assert D.audit_sources(docs.withColumn("term", F.lit(1)).withColumn("n", F.lit("k"))).columns == ["lang", "source", "part", "item", "value", "rank"]
