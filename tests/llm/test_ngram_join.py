import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lodestone.llm import ngram_join as J
from lodestone.llm.base import materialize
from lodestone.llm.components import connected_components
from lodestone.plans import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=J.PERCENT):
    sets = [(doc, shingle_set(text)) for doc, text in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            smallest[find(i)].append(doc)
    return Counter((doc, len(s), min(smallest[find(i)]) if smallest[find(i)] else None) for i, (doc, s) in enumerate(sets))


def check(df, percent=J.PERCENT):
    got = Counter(tuple(r) for r in J.near_duplicate_groups(df, percent).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], percent)


@given(st.lists(st.text(alphabet="aB c\n\x0bé\x1cÉ", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_sets_have_the_right_sizes(texts):
    assert [len(g) for g in J.shingle_sets(texts)] == [len(shingle_set(t)) for t in texts]


def test_hashes_do_not_depend_on_the_batch():
    texts = ["one two three four", "", "x", "ONE two three four", "a" * 5000 + " b c"]
    alone = [next(J.shingle_sets([t])).tolist() for t in texts]
    assert [g.tolist() for g in J.shingle_sets(texts)] == alone and alone[0] == alone[3]


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 2)), dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = J.parity_bitmap(a), J.parity_bitmap(b)
        bits = J.differing_bits(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y))
        assert bits <= len(np.setxor1d(a, b))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 90 * (len(a) + len(b) - inter):
            assert J.may_link(len(a), len(b), bits)


def test_order_is_one_for_one():
    rng = np.random.default_rng(1)
    rank = rng.permutation(1 << J.SKETCH_BITS).astype(np.uint64)
    order = J.GlobalOrder(rank, np.array([1 << 17, 1 << 19], dtype=np.uint64))
    grams = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    out = order.ordered(grams)
    assert len(np.unique(out)) == len(np.unique(grams)) and np.array_equal(np.concatenate(order.segments(out)), out)


def test_corpus_against_brute_force(docs, odd, empty):
    for df in (docs, odd, empty):
        check(df)


def chains_and_stars(spark, percent):
    """Documents that are linked only through others, many with few edits of one text, and long groups without links."""
    rng = random.Random(percent)
    base = [f"w{i}" for i in range(60)]
    rows, chain = [], list(base)
    for i in range(25):  # each differs from the one before by a word
        rows.append((" ".join(chain),))
        chain[rng.randrange(60)] = f"c{i}"
    for _ in range(40):  # some edits of one text
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"e{rng.randrange(12)}"
        rows.append((" ".join(t),))
    rows += [("a common passage of some words " + f"x{i} y{i} z{i}",) for i in range(20)] + [("same",), ("same",), ("",), (None,)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return spark.createDataFrame([(d, t) for d, (t,) in zip(order, rows)], "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("percent", [50, 90, 100])
def test_chains_and_stars(spark, percent):
    check(chains_and_stars(spark, percent), percent)


def test_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(J.crossing_pairs, "__defaults__", (J.PERCENT, 5))
    check(chains_and_stars(spark, 80), 80)


def test_bitmaps_of_arrays_agree():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64)) for _ in range(60)]
    maps = [J.parity_bitmap(x) for x in sets]
    i, j = (rng.integers(0, 60, 500) for _ in range(2))
    got = J._Bitmaps(maps).differing(i, j)
    want = [J.differing_bits(int.from_bytes(maps[a], "little"), 8 * len(maps[a]), int.from_bytes(maps[b], "little"), 8 * len(maps[b])) for a, b in zip(i, j)]
    assert got.tolist() == want
    n, m = (np.array([len(sets[k]) for k in x]) for x in (i, j))
    assert J.may_link_all(n, m, got, 90).tolist() == [J.may_link(a, b, d, 90) for a, b, d in zip(n.tolist(), m.tolist(), want)]


def test_unlike_nodes_of_one_token_hardly_meet(spark):
    """Nodes that share one token of their prefixes and nothing else: work grows with their number, not its square."""
    met = []
    for n in (1000, 4000, 16000):
        ids = spark.range(n)
        own = ids.select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"), F.col("id").alias("node"))
        token = F.when(F.col("pos") == 1, F.lit(7).cast("long")).otherwise(F.col("node") * 10 + F.col("pos") + 100)
        postings = own.withColumn("token", token).select("token", "node", "pos", (F.shiftleft(F.col("pos").cast("long"), 32) + 30).alias("place"))
        order = J.GlobalOrder(np.zeros(1, np.uint64), np.zeros(0, np.uint64), 0 if n == 4000 else 1 << J.SKETCH_BITS)  # hot or not
        shared = J.shared_postings(postings.drop("pos"), order)
        assert shared.select("token").distinct().count() == 1
        nodes = ids.select(F.col("id").alias("node"), F.lit(30).alias("n"), F.lit(b"\x00" * 8).alias("bitmap"), F.lit(b"\x00" * 8).alias("small"), F.col("id").alias("doc_id"))
        none = spark.createDataFrame([], "node long, component long")
        assert J.crossing_pairs(shared, nodes, none, order).count() == 0  # nothing after the shared token is shared
        # with a second shared token in a tenth of them, only these meet
        second = F.when((F.col("pos") == 2) & (F.col("node") % 10 == 0), F.floor(F.col("node") / 100) + 10**7).otherwise(F.col("token"))
        paired = J.shared_postings(postings.withColumn("token", second.cast("long")).drop("pos"), order)
        met.append(J.crossing_pairs(paired, nodes, none, order).count())
    assert met == [450, 1800, 7200]  # 10 of each hundred


@pytest.mark.parametrize("constants", [{"BLOCK": 3, "PAIRS_PER_SALT": 2, "BROADCAST_IDS": 0}])
def test_small_bounds_give_the_same(spark, monkeypatch, docs, constants):
    for name, value in constants.items():
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J.crossing_pairs, "__defaults__", (J.PERCENT, 3))
    monkeypatch.setattr(stage, "LEAST_HOT", 2)
    monkeypatch.setattr(stage, "HOT_KEYS", 10)
    monkeypatch.setattr(J, "HOT_KEYS", 10)
    monkeypatch.setattr(J, "HOT_COUNT", 2)
    monkeypatch.setattr(J, "HOT_SHARE", 0)
    monkeypatch.setattr(J, "PLAIN", 3)
    check(chains_and_stars(spark, 60), 60)
    check(docs)
    assert J.keep_one_of_each_group(docs).count() == len({r.component_id for r in J.near_duplicate_groups(docs).collect()})


def test_one_set_and_empty_texts_in_most_rows(spark):
    rows = [(i, "a b c d e" if i % 10 < 5 else "" if i % 10 < 9 else f"t{i} u v w x") for i in range(3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(100, 160)]
    links = path + [(5, 900), (900, 7), (7, -3)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(50)]
    links = [(a, b) for a, b in links if a != b]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: find(n) for e in links for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(docs, odd, empty):
    for df in (docs, odd, empty):
        out = J.keep_one_of_each_group(df)
        assert out.columns == df.columns
        kept = out.collect()
        groups = {r.doc_id: r.component_id for r in J.near_duplicate_groups(df).collect() if r.doc_id is not None}
        ids = [r.doc_id for r in kept if r.doc_id is not None]
        assert sorted(ids) == sorted({g for g in groups.values()})


def test_five_words_and_four_fifths(spark):
    base = [f"w{i}" for i in range(200)]
    block = base[:100] + [f"n{i}" for i in range(20)] + base[100:]  # 0.98 * 200 / 220: a link at five words and 0.8 alone
    changed = [w if i not in (20, 60, 100, 140) else f"x{i}" for i, w in enumerate(base)]  # 176 of 216
    far = [w if i % 25 else f"y{i}" for i, w in enumerate(base)]
    df = spark.createDataFrame([(7, " ".join(base)), (2, " ".join(block)), (5, " ".join(changed)), (1, " ".join(far)), (9, "one two three four"), (8, "one two three")], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in J.near_duplicate_groups(df, 80, 5).collect()}
    assert groups == {7: 2, 2: 2, 5: 2, 1: 1, 9: 9, 8: 8}
    assert {r.doc_id for r in J.keep_one_of_each_group(df, 80, 5).collect()} == {1, 2, 8, 9}
    assert {r.component_id for r in J.near_duplicate_groups(df).collect()} == {7, 2, 5, 1, 9, 8}


def compared(spark, monkeypatch, df, percent, words):
    """Rows that the comparison of groups makes over ``df``, and the groups found."""
    kind, made = type(df), []
    plain = kind.mapInArrow

    def counted(self, function, *args, **kwargs):
        out = plain(self, function, *args, **kwargs)
        if function.__name__ == "compare":
            out = materialize(out, "compared")
            made.append(out.count())
        return out

    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", counted)
        groups = {r.doc_id: r.component_id for r in J.near_duplicate_groups(df, percent, words).collect()}
    return sum(made), groups


def test_sets_that_share_tokens_by_chance_are_not_paired(spark, monkeypatch):
    rng, rows = random.Random(11), []
    passages = [[f"p{i}x{k}" for k in range(8)] for i in range(30)]
    for i in range(150):  # a quarter is common passages, two sets share one now and then
        parts = [[f"u{i}y{k}" for k in range(60)], *rng.sample(passages, 3)]
        rng.shuffle(parts)
        rows.append((i, " ".join(w for part in parts for w in part)))
    made, groups = compared(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), 80, 3)
    assert made == 0 and groups == {i: i for i in range(150)}


def test_near_copies_that_stay_apart_meet_once(spark, monkeypatch):
    """Copies of one text with too many edits for a link: a pair is made by the first token it shares, not by each."""
    rows = []
    for i in range(12):
        text = [f"w{k}" for k in range(200)]
        for k in range(16):
            text[(k * 12 + i) % 200] = f"e{i}z{k}"
        rows.append((i, " ".join(text)))
    made, groups = compared(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), 70, 1)
    assert len(set(groups.values())) == 1
    again, groups = compared(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), 86, 1)
    assert groups == {i: i for i in range(12)}
    assert max(made, again) <= 3 * 66
