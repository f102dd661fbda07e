import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as E

LOWER = str.maketrans(E.UPPER, E.UPPER.lower())


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(1)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(6000)]
    index, live = E.CuckooIndex(8), {}
    for i, k in enumerate(keys):
        index.insert(k, i)
        live[k] = i
        if i % 3 == 0:
            gone = rng.choice(list(live)) if i < 300 else keys[i // 2]
            assert index.delete(gone) is (gone in live)
            live.pop(gone, None)
    assert index.resizes > 3 and len(index) == len(live) and dict(index.items()) == live
    assert all(index.get(k) == live.get(k) for k in keys) and b"\0" * 32 not in index
    index.insert(keys[5], "new")
    assert index.get(keys[5]) == "new"


def test_cuckoo_index_verifies_equal_fingerprints():
    index = E.CuckooIndex(8)
    a, b = b"\1" * 8 + b"a", b"\1" * 8 + b"b"
    index.insert(a, 1)
    assert b not in index and a in index and not index.delete(b)
    for i in range(7):  # two buckets of four slots are what keys with one fingerprint have
        index.insert(b"\1" * 8 + bytes([i]), i)
    assert len(index) == 8
    with pytest.raises(ValueError, match="not digests"):
        index.insert(b"\1" * 8 + b"z")


def test_cuckoo_index_grows_until_all_are_placed():
    # no kicks: buckets that are full at once overflow again and again while they grow
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index = E.CuckooIndex(8, max_kicks=0)
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert dict(index.items()) == {k: i for i, k in enumerate(keys)} and len(index) == 3000


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen = seen or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def test_against_brute_force(docs, odd, empty):
    for df in (docs, odd, empty):
        got = Counter(tuple(r) for r in E.exact_duplicates(df).collect())
        assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_many_small_shards_agree(docs):
    digests = docs.select("doc_id", F.unhex(E.text_digest()).alias("digest"))
    a = sorted(map(tuple, E.digest_groups(digests).collect()))
    assert a == sorted(map(tuple, E.digest_groups(digests, 3).collect()))


def test_deduplicate_keeps_one_row_with_all_columns(docs, odd, empty):
    for df in (docs, odd, empty):
        out = E.deduplicate(df)
        assert out.columns == df.columns
        got = out.collect()
        want = sum(1 for (_, _, _, kept, _), n in brute([(r.doc_id, r.text) for r in df.collect()]).items() for _ in range(n) if kept)
        assert len(got) == want == len({(r.text or "").translate(LOWER) for r in got})


def test_index_of_a_task_is_bounded(spark):
    """Emptied at a number of keys, the index gives a digest more than once, and the shards merge these."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(hashlib.sha256(str(rng.randrange(300)).encode()).digest(), i, 1, 1) for i in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100]), E._GROUP.types)], schema=E._GROUP) for i in range(0, 2000, 100)]
    once = pa.Table.from_batches(E.merge(iter(batches))).to_pylist()
    parts = list(E.merge(iter(batches), 50))
    assert len(once) == 300 < sum(b.num_rows for b in parts)
    again = pa.Table.from_batches(E.merge(iter(parts))).to_pylist()
    assert sorted(map(str, again)) == sorted(map(str, once))


def test_retracted_digests_are_gone(docs):
    groups = E.digest_groups(docs.select("doc_id", F.unhex(E.text_digest()).alias("digest")))
    gone = groups.where("keep_id % 3 = 0").select("digest")
    left = E.retract(groups, gone.unionByName(gone).unionByName(groups.select(F.lit(None).cast("binary").alias("digest")).limit(1)))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, groups.where("keep_id is null or keep_id % 3 <> 0").collect()))


def test_one_text_in_most_rows(spark):
    """Without adaptive execution: the copies of a text are in no task alone."""
    rows = [(i, "Hot text" if i % 10 else f"text {i}", "x", "y") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, id string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = E.exact_duplicates(df)
        assert Counter(tuple(r) for r in out.collect()) == brute([r[:2] for r in rows])
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500
        kept = E.deduplicate(df)
        assert kept.count() == 501 and kept.schema == df.schema and kept.where("text = 'Hot text'").first()["doc_id"] == 4999
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_rows_beyond_one_array(spark):
    df = spark.range(25_001).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    out = E.exact_duplicates(df).groupBy("kept", "group_size").count().collect()
    assert sorted((r["kept"], r["group_size"], r["count"]) for r in out) == [(False, 25_001, 25_000), (True, 25_001, 1)]
    assert E.deduplicate(df).count() == 1


def test_losers_joined_by_shuffle(docs, odd, monkeypatch):
    for df in (docs, odd):
        few = sorted(map(str, E.deduplicate(df).select("doc_id", "text").collect()))
        monkeypatch.setattr(E, "BROADCAST_LOSERS", -1)
        assert sorted(map(str, E.deduplicate(df).select("doc_id", "text").collect())) == few
        monkeypatch.undo()
