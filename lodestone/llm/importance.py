"""Importance resampling towards a target distribution, by external sort and count.

Features are runs of 1 to 3 consecutive words, hashed into 10,000 buckets. One pass over the texts writes
their buckets as packed uint16 streams, with the offsets at which documents begin: six bytes for a
word, and no text is split again. Streams are sorted piece by piece and run-length encoded; the runs,
at most one for each bucket and piece, are summed by bucket. A bucket's gain is what the logarithm of
its share in the target exceeds that in the corpus by; with 10,000 gains at hand a second pass over the
streams gathers each document's gains and adds them up between offsets (``np.add.reduceat``).

A document's score is its weight plus Gumbel noise from a hash of its id, so the highest scores are a sample
without replacement with probabilities in proportion to exp(weight / 1000). They are ranked by a range sort
and the row counts of its partitions; no task sees more than its range.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, materialize, record_batch, segment_sums, spans_of_chars, texts_of

#: Runs of words that aren't ASCII marks; upper-case letters are lowered before.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONGEST_RUN = 3
BUCKETS = 10_000
#: Gains and scores are in thousandths.
SCALE = 1000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: Values of a packed stream; a longer document has one of its own.
CHARS_OF_A_STREAM = 1 << 20


def buckets_of(text: str) -> tuple[np.ndarray, int]:
    """The buckets of a text's features (repeats included) and its number of words."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    spaced = [b" " + w for w in words]
    hashes = runs = list(map(crc32, words))
    for k in range(1, LONGEST_RUN):
        runs = list(map(crc32, spaced[k:], runs))  # a run goes on from the one that is a word shorter
        hashes = hashes + runs
    return (np.array(hashes, dtype=np.uint32) % np.uint32(BUCKETS)).astype(np.uint16), len(words)


_STREAMS = [("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stream", pa.binary())]


def write_streams(docs: DataFrame, name: str) -> DataFrame:
    """The table of packed streams: doc_ids, offsets (of each document's first value), words (of each document), stream."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), texts_of(batch)
            for a, b in spans_of_chars(texts, CHARS_OF_A_STREAM):
                found = [buckets_of(t) for t in texts[a:b]]
                lengths = np.array([len(f) for f, _ in found])
                stream = np.concatenate([f for f, _ in found]).astype("<u2")
                yield record_batch(_STREAMS, doc_ids=[ids.slice(a, b - a).to_pylist()], offsets=[np.cumsum(lengths) - lengths], words=[[n for _, n in found]], stream=[stream.tobytes()])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(plain.mapInArrow(pack, "doc_ids array<long>, offsets array<long>, words array<long>, stream binary"), name)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stream and how often it has each: sorted, then run-length encoded."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.concatenate([starts, [len(ordered)]]))


def count_buckets(streams: DataFrame) -> np.ndarray:
    """How often all streams have each bucket: runs of each piece, summed by bucket."""
    fields = [("bucket", pa.int32()), ("n", pa.int64())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                values, n = run_lengths(np.frombuffer(packed.as_py(), dtype="<u2"))
                yield record_batch(fields, bucket=values.astype(np.int32), n=n)

    runs = streams.select("stream").mapInArrow(count, "bucket int, n long")
    table = runs.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each bucket
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return counts


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a bucket's share in the target over that in the corpus), both with one added to each bucket."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


_WEIGHED = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())]


def weigh(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document of the streams."""
    shared = streams.sparkSession.sparkContext.broadcast(gains)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, offsets, words, packed in zip(*(batch.column(k) for k in range(4))):
                stream = np.frombuffer(packed.as_py(), dtype="<u2")
                lengths = np.diff(np.concatenate([offsets.values.to_numpy(), [len(stream)]]))
                yield record_batch(_WEIGHED, doc_id=ids.values, n_words=words.values, n_features=lengths, weight=segment_sums(shared.value[stream], lengths))

    return streams.select("doc_ids", "offsets", "words", "stream").mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with score: weight and Gumbel noise, a function of seed and doc_id (null counts as the text 'null')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (doc_id, score, ...) with rank from 1 by score, then by smaller doc_id (null last); null beyond ``most``.

    Rows are dealt to ranges and sorted there; a row's rank is its place in its range and the rows before the range.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    table = materialize(dealt, "ranges")
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each range
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "__part long, __before long")
    placed = table.withColumn("__part", part).join(F.broadcast(starts), "__part")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of ``docs``; ``target`` is a table with a text column.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) highest scores are
    drawn and ranked; rank is null for all others. Null and empty texts have no features and weight 0.
    Repeated rows score alike and are counted and drawn one by one. An empty table gives an empty one, an empty
    target one in which no bucket occurs. Columns but doc_id and text are not looked at.
    """
    bound_batches(docs.sparkSession)
    streams = write_streams(docs, "streams")
    aims = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-streams")
    scored = materialize(with_scores(weigh(streams, gains_of(count_buckets(streams), count_buckets(aims))), seed), "scored")
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(enough.select("doc_id", "n_features", "weight", "score"), enough.count() * percent // 100)
    short = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(short)
