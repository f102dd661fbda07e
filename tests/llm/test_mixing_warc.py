import gzip
import hashlib
import math
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing as M
from lodestone.llm import warc as W

PAGES = "page_id long, url string, html string, refers_to string"


def poisson_count(mean, u):
    term = total = math.exp(-mean)
    k = 0
    while total <= u and k < 10_000:
        k += 1
        term *= mean / k
        total += term
    return k


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def test_counts_invert_the_distribution(docs, odd, empty):
    for df in (docs, odd, empty):
        rates = {r.source: r.rate for r in M.source_rates(df).collect()}
        want = Counter()
        for r in df.collect():
            doc = "null" if r.doc_id is None else r.doc_id
            for k in range(poisson_count(rates[r.source], uniform(5, doc, 0))):
                want[(r.doc_id, r.text, k)] += 1
        out = M.mix_sources(df)
        assert Counter((r.doc_id, r.text, r.copy) for r in out.collect()) == want
        assert sorted(out.columns) == sorted(df.columns)


def test_shares_approach_the_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = M.mix_sources(df, {"a": 3.0, "b": 1.0}, total_rows=30_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(22_500, rel=0.03) and n["b"] == pytest.approx(7_500, rel=0.05)
    assert M.mix_sources(df, {"a": 1.0}).where("source = 'b'").isEmpty()


def test_large_means_are_sums(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    out = M.mix_sources(df, total_rows=300 * 1200.0)
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    assert len(counts) == 300 and sum(counts) / 300 == pytest.approx(1200, rel=0.01)


def test_sources_joined_by_shuffle(docs, monkeypatch):
    few = sorted((r.doc_id, r.copy) for r in M.mix_sources(docs).select("doc_id", "copy").collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", -1)
    assert sorted((r.doc_id, r.copy) for r in M.mix_sources(docs).select("doc_id", "copy").collect()) == few


def test_partitions_change_nothing(docs):
    a = sorted((r.doc_id, r.copy) for r in M.mix(docs, M.source_rates(docs), partitions=2).select("doc_id", "copy").collect())
    b = sorted((r.doc_id, r.copy) for r in M.mix(docs.repartition(7), M.source_rates(docs), partitions=9).select("doc_id", "copy").collect())
    assert a == b


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "x" * 1200 + "é</p>"
    rows = [(i, f"http://a.org/{i}", f"<html>{i}</html>" * (i % 40), "z") for i in range(300)]
    rows += [(300 + i, "http://b.org/ü \n", long, "z") for i in range(5)] + [(400, None, None, None), (401, "u", "", None), (402, "u", "short", None), (403, "u", "short", None), (404, "u", long, None), (404, "u", long, None), (None, "u", long, None), (7, "again", "other", None)]
    return spark.createDataFrame(rows, PAGES).repartition(4)


def brute(rows):
    groups = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            groups[data] = max(groups.get(data, page), page)
    out = Counter()
    for page, _, html, _ in rows:
        data = (html or "").encode()
        target = groups.get(data)
        again = target is not None and page != target
        out[(page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", target if again else None)] += 1
    return out


def test_round_trip(spark, pages):
    got = W.round_trip(spark, pages, file_bytes=4000, range_bytes=40_000)
    assert Counter(map(tuple, got.collect())) == brute(list(map(tuple, pages.collect())))
    assert W.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_files_are_the_same_every_time(spark, pages, tmp_path):
    sums = []
    for run, n in (("a", 4), ("b", 9)):
        uri = f"file://{tmp_path}/{run}"
        manifest = W.write_archives(pages.repartition(n), uri, file_bytes=3000, range_bytes=40_000)
        sums.append({r.file: (r.sha256, r.bytes, r.records) for r in manifest.collect()})
        on_disk = {p.name: p for p in Path(tmp_path, run).glob("*.warc.gz")}
        assert set(on_disk) == set(sums[-1]) and not Path(tmp_path, run, W.TEMPORARY).exists()
        for name, p in on_disk.items():
            assert hashlib.sha256(p.read_bytes()).hexdigest() == sums[-1][name][0]
            assert gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert sums[0] == sums[1] and len(sums[0]) > 3
    payloads = W.read_archives(spark.read.parquet(f"{tmp_path}/a/manifest"), f"file://{tmp_path}/a", payloads=True).where("record_type = 'response'")
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in payloads.collect())


def test_records_have_names_of_their_own(spark, pages, tmp_path):
    manifest = W.write_archives(pages, f"file://{tmp_path}/n", file_bytes=3000, range_bytes=40_000)
    names = []
    for r in manifest.collect():
        with open(f"{tmp_path}/n/{r.file}", "rb") as stream:
            names += [h["WARC-Record-ID"] for h, _ in W.records_of(stream)]
    assert len(names) == len(set(names)) == pages.count() + manifest.count()


def test_an_attempt_that_dies_between_write_and_move(spark, pages, tmp_path):
    uri, store = f"file://{tmp_path}/k", W.pafs.LocalFileSystem()
    first = W.write_archives(pages, uri, file_bytes=3000, range_bytes=40_000)
    want = {p.name: p.read_bytes() for p in Path(tmp_path, "k").glob("*.warc.gz")}
    one = first.first()
    Path(tmp_path, "k", W.TEMPORARY).mkdir()
    dead, late = (W._File(store, f"{tmp_path}/k", one.range, one.part) for _ in range(2))
    dead.out.close()  # written, never moved
    late.commit()  # a second attempt after the manifest: the file that it names stays as it is
    assert {p.name: p.read_bytes() for p in Path(tmp_path, "k").glob("*.warc.gz")} == want
    assert Counter(map(tuple, W.read_archives(first, uri).collect())) == brute(list(map(tuple, pages.collect())))
    Path(tmp_path, "l", W.TEMPORARY).mkdir(parents=True)  # the same before the manifest
    lost = W._File(store, f"{tmp_path}/l", 0, 0)
    lost.out.close()
    W.write_archives(pages, f"file://{tmp_path}/l", file_bytes=3000, range_bytes=40_000)
    assert {p.name: p.read_bytes() for p in Path(tmp_path, "l").glob("*.warc.gz")} == want and not Path(tmp_path, "l", W.TEMPORARY).exists()


def test_ranges_are_bounded_in_number(spark):
    sizes = spark.range(5000).select(F.col("id").alias("page_id"), F.lit(1000).cast("long").alias("payload_bytes"))
    assert len(W.range_bounds(sizes, 1000, most=40)) == 39
    assert W.range_bounds(sizes, 10**9) == []


def test_names_of_the_caller_stay(spark):
    rows = [(i, "s", f"c{i}", "p", 7, 8) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy string, place string, row int, `key` int")
    out = M.mix_sources(df, copy=None)
    assert out.schema == df.schema and {r.copy for r in out.collect()} <= {r[2] for r in rows}
    assert dict(M.mix_sources(df).dtypes)["copy"] == "int"


def test_equal_rows_spread(spark):
    df = spark.range(4000, numPartitions=8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"))
    out = M.mix(df, M.source_rates(df), partitions=8)
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert out.count() == 0 or most <= out.count() / 2


def test_damage_is_seen(spark, pages, tmp_path):
    uri = f"file://{tmp_path}/x"
    manifest = W.write_archives(pages, uri)
    victim = next(Path(tmp_path, "x").glob("*.warc.gz"))
    victim.write_bytes(victim.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends within a record|incorrect|Error"):
        W.read_archives(manifest, uri).collect()
