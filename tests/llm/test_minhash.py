import random
import re
from collections import Counter, defaultdict

import numpy as np

from pyspark.sql import functions as F

from lodestone.llm import minhash as M
from lodestone.llm.ngram_join import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(size)))) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
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
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            ids[find(i)].append(doc)
    smallest = [min(ids[find(i)]) if ids[find(i)] else None for i in range(len(sets))]
    return Counter((doc, len(s), low, doc == low) for (doc, s), low in zip(sets, smallest))


def check(df):
    got = Counter(tuple(r) for r in M.near_duplicates(df).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_values_are_those_of_each_set_alone():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 40_000, 2, 17_000, 3)]
    together = M.min_max(sets)
    for own, values in zip(sets, together):
        assert np.array_equal(M.min_max([own])[0], values)
        h = (own >> np.uint64(32)).astype(np.uint32)
        h = (h ^ M._MASKS[3]) * M._FACTORS[3]
        h ^= h >> np.uint32(15)
        assert values[0, 3] == h.min() and values[1, 3] == h.max()


def test_signatures_estimate_without_bias_and_bands_find_links():
    rng, errors, missed, below = np.random.default_rng(2), [], 0, 0
    for _ in range(400):
        n = int(rng.integers(20, 300))
        grams = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        common = grams[: int(np.ceil(8 * n / 9))]
        rest = grams[len(common) :]
        a, b = np.sort(np.concatenate([common, rest[: n - len(common)]])), np.sort(np.concatenate([common, rest[-(n - len(common)) :]])) if n > len(common) else np.sort(common)
        values = M.min_max([a, b])
        errors.append((values[0] == values[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        marks, bands = M.signature(values), M.bands_of(values)
        below += (marks[0] == marks[1]).sum() < M.least_equal(80)
        missed += not (bands[0] == bands[1]).any()
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.03 and not missed and not below


def test_bands_of_other_numbers_never_meet():
    values = np.full((1, 2, M.PERMUTATIONS), 7, dtype=np.uint32)
    assert len(set(M.bands_of(values)[0].tolist())) == M.BANDS


def test_against_brute_force(docs, odd, empty):
    check(docs)
    check(odd)
    assert M.near_duplicates(empty).collect() == []


def test_chains_families_and_thresholds(spark):
    rng, rows = random.Random(3), []
    for family in range(12):
        words = [f"v{rng.randrange(400)}" for _ in range(rng.randint(1, 120))]
        for _ in range(12):
            rows.append((rng.randrange(10**6), " ".join(words)))
            words = edited(rng, words, rng.randint(0, 2))  # each copy is made from the last one
    rows += [(10**6 + n, " ".join(f"x{k}" for k in range(n))) for n in range(12)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_one_passage_in_all_texts(spark, monkeypatch):
    """Half of each text is the same passage: buckets are large and open, so they are split, and compared block by block."""
    monkeypatch.setattr(M.crossing_pairs, "__defaults__", (M.PERCENT, None, None, 12, 1))
    rng, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(60)]
    for k in range(150):
        own = [f"q{rng.randrange(5000)}" for _ in range(rng.randint(20, 60))]
        rows.append((3 * k, " ".join(passage + own)))
        if k % 5 == 0:
            rows.append((3 * k + 1, " ".join(passage + edited(rng, own, 1))))
        if k % 7 == 0:
            rows.append((3 * k + 2, " ".join(passage + own).upper()))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_splits_give_no_other_pairs(spark):
    met = spark.createDataFrame([(k, b, n) for n in range(60) for b, k in ((0, 1), (1, 2 + n % 2), (2, 10 + n % 3))], "key long, band int, node long")
    nodes = spark.createDataFrame([(n, 100, bytes(2 * M.PERMUTATIONS)) for n in range(60)], "node long, n long, signature binary")
    components = spark.createDataFrame([(n, n % 4) for n in range(60)], "node long, component long")

    def pairs(**options):
        return {(r.a, r.b) for r in M.crossing_pairs(met, nodes, components, **options).collect()}

    whole = pairs(block=100)
    assert whole == {(a, b) for b in range(60) for a in range(b) if a % 4 != b % 4}
    assert pairs(block=7, depth=0) == whole
    # the bucket of all nodes is split, those of every second and third node are not
    assert pairs(block=38, depth=1) == {p for p in whole if (p[0] - p[1]) % 2 == 0 or (p[0] - p[1]) % 3 == 0}
    probed = pairs(block=100, probes=4)
    assert probed < whole and {n for p in probed for n in p} == set(range(60)) and len(probed) <= 4 * 60


def test_probes_prefer_similar_nodes(spark):
    rng = np.random.default_rng(4)
    marks = [bytes(rng.integers(0, 2, 2 * M.PERMUTATIONS, dtype=np.uint8)) for _ in range(20)]
    near = [bytes(m[:-9]) + bytes(9) for m in marks]
    nodes = spark.createDataFrame([(n, 50, m) for n, m in enumerate(marks + near)], "node long, n long, signature binary")
    met = spark.createDataFrame([(1, 0, n) for n in range(40)], "key long, band int, node long")
    components = spark.createDataFrame([], "node long, component long")
    assert {(n, n + 20) for n in range(20)} <= {(r.a, r.b) for r in M.crossing_pairs(met, nodes, components, probes=1).collect()}


def test_shortened_sets_exclude_no_link():
    rng = np.random.default_rng(6)
    sets = [rng.choice(300, int(rng.integers(1, 200)), replace=False).astype(np.int32) for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    n = np.array([len(s) for s in sets])
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)])
    assert np.array_equal(M._within_reach(x, y, n, sets, 40), 100 * shared >= 40 * (n[x] + n[y] - shared))
    assert M._within_reach(x, y, n, [None] * 40, 40).all()


def test_sets_are_those_of_the_contract():
    texts = ["A b c d e", "a B", "", " \n", "É é x y z", None]
    assert [len(g) for g in shingle_sets([t or "" for t in texts], 4)] == [len(shingle_set(t)) for t in texts]


def test_other_columns_stay_out(docs):
    assert M.near_duplicates(docs.withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))).columns == ["doc_id", "n_shingles", "component_id", "kept"]
