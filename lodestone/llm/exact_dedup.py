"""Exact deduplication with a cuckoo-filter index of live digests.

The digest of a text is the SHA-256 of its UTF-8 bytes after lower-casing A-Z only; null counts as
empty. A ``CuckooIndex`` answers "seen before?" from 16-bit fingerprints in two candidate buckets,
verifies every hit against the whole digest that is kept in the same bucket, supports deletion, and
doubles itself from the stored keys when an insertion finds no place.

Distribution: each scan task runs its rows through an index of its own, which it empties at a bounded
number of keys, so a group of copies leaves a task as a few rows however large it is; the rest is
dealt by digest to shards of a bounded number of keys, each with its index. What a group decides goes
back to its rows by ``join_counted``: large groups are broadcast, so no task gathers one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import join_counted, materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLOTS = 4
#: Digests that one shard's index holds; the number of shards follows from it.
KEYS_PER_SHARD = 400_000
#: Rows that lose against an equal one, up to this many, are broadcast to the documents (16 MB); more are joined by id.
BROADCAST_LOSERS = 1_000_000
#: Repeated rows (same id, same text) that are counted out at a time.
REPEATS = 10_000


class CuckooIndex:
    """Cuckoo filter over byte digests (8 bytes at least) with the keys stored beside the fingerprints."""

    def __init__(self, capacity: int = 1024, max_kicks: int = 200) -> None:
        self.max_kicks = max_kicks
        self.resizes = 0
        self.size = 0
        self._clear(max(2, 1 << max(1, (int(capacity / SLOTS / 0.8)).bit_length())))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.fingerprints: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple[bytes, object]]] = [[] for _ in range(buckets)]

    @staticmethod
    def _fingerprint(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") | 0x10000

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[2:8], "little") & self.mask

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995 >> 7)) & self.mask

    def _find(self, key: bytes) -> tuple[int, int] | None:
        fingerprint, bucket = self._fingerprint(key), self._first(key)
        for b in (bucket, self._other(bucket, fingerprint)):
            prints = self.fingerprints[b]
            if fingerprint in prints:  # the filter says yes: verify against the content of the bucket
                for slot, (stored, _) in enumerate(self.content[b]):
                    if stored == key:
                        return b, slot
        return None

    def get(self, key: bytes):
        at = self._find(key)
        return self.content[at[0]][at[1]][1] if at else None

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) is not None

    def __len__(self) -> int:
        return self.size

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content:
            yield from bucket

    def delete(self, key: bytes) -> bool:
        at = self._find(key)
        if at is None:
            return False
        del self.fingerprints[at[0]][at[1]], self.content[at[0]][at[1]]
        self.size -= 1
        return True

    def insert(self, key: bytes, value: object = None) -> None:
        """Adds a key that isn't there, or gives a key that is there a new value (delete, then insert)."""
        at = self._find(key)
        if at is not None:
            self.content[at[0]][at[1]] = (key, value)
            return
        self.size += 1
        homeless, rest = self._place(key, value), []
        while homeless is not None:  # grow, with what is placed, what fell out, and the rest, until all have a place
            stored = [*self.items(), homeless, *rest]
            if sum(k[:8] == homeless[0][:8] for k, _ in stored) > 2 * SLOTS:
                raise ValueError("more keys begin with the same 8 bytes than two buckets hold: not digests")
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            for i, (k, v) in enumerate(stored):
                homeless = self._place(k, v)
                if homeless is not None:
                    rest = stored[i + 1 :]
                    break

    def _place(self, key: bytes, value: object) -> tuple[bytes, object] | None:
        """Puts a pair into a bucket; the pair that is left without one after ``max_kicks``, or None."""
        fingerprint, bucket = self._fingerprint(key), self._first(key)
        for b in (bucket, self._other(bucket, fingerprint)):
            if len(self.content[b]) < SLOTS:
                self.fingerprints[b].append(fingerprint)
                self.content[b].append((key, value))
                return None
        pair = (key, value)
        b = bucket
        for kick in range(self.max_kicks):
            slot = (kick * 7 + fingerprint) % SLOTS
            fingerprint, self.fingerprints[b][slot] = self.fingerprints[b][slot], fingerprint
            pair, self.content[b][slot] = self.content[b][slot], pair
            b = self._other(b, fingerprint)
            if len(self.content[b]) < SLOTS:
                self.fingerprints[b].append(fingerprint)
                self.content[b].append(pair)
                return None
        return pair


def text_digest(text: str = "text") -> Column:
    """SHA-256 in lower-case hex of the text with A-Z lower-cased."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), 256)


_GROUP = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_times", pa.int64())])
_GROUP_DDL = "digest binary, keep_id long, group_size long, keep_times long"


def _flushed(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        columns = [pa.array([k for k, _ in part], pa.binary())] + [pa.array([v[j] for _, v in part], pa.int64()) for j in range(3)]
        yield pa.RecordBatch.from_arrays(columns, schema=_GROUP)


def merge(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (digest, keep_id, group_size, keep_times) of one task through one index: one row for each digest.

    With ``most`` the index is emptied whenever it holds so many, and a digest may come again.
    """
    index = CuckooIndex(4096)
    for batch in batches:
        for key, doc, n, times in zip(*(batch.column(i).to_pylist() for i in range(4))):
            live = index.get(key)
            if live is None:
                index.insert(key, (doc, n, times))
            elif doc == live[0]:
                index.insert(key, (doc, live[1] + n, live[2] + times))
            elif live[0] is None or (doc is not None and doc > live[0]):
                index.insert(key, (doc, live[1] + n, times))
            else:
                index.insert(key, (live[0], live[1] + n, live[2]))
        if most and len(index) >= most:
            yield from _flushed(index)
            index = CuckooIndex(4096)
    yield from _flushed(index)


def digest_groups(digests: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """(digest binary, doc_id) to (digest, keep_id, group_size, keep_times), one row for each digest."""
    one = F.lit(1).cast("long")
    rows = digests.select("digest", F.col("doc_id").cast("long").alias("keep_id"), one.alias("group_size"), one.alias("keep_times"))
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // keys_per_shard))
    return rows.mapInArrow(lambda batches: merge(batches, keys_per_shard), _GROUP_DDL).repartition(shards, "digest").mapInArrow(merge, _GROUP_DDL)


def retract(groups: DataFrame, gone: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """``groups`` without the digests of ``gone`` (digest): each shard's index is filled with the live ones, and those of the other table are deleted from it.

    Null digests of ``gone`` and those that aren't live change nothing.
    """
    shards = max(1, -(-groups.count() // keys_per_shard))
    none = F.lit(None).cast("long")
    dead = gone.where("digest is not null").select("digest", none.alias("keep_id"), none.alias("group_size"), none.alias("keep_times")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, waiting = CuckooIndex(4096), []
        for batch in batches:
            for key, *value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if value[1] is None:
                    waiting.append(key)
                else:
                    index.insert(key, tuple(value))
        for key in waiting:
            index.delete(key)
        yield from _flushed(index)

    return groups.select("digest", "keep_id", "group_size", "keep_times").unionByName(dead).repartition(shards, "digest").mapInArrow(run, _GROUP_DDL)


def _digests(docs: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_digest()).alias("digest")), "digests")


def _nth(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (digest, doc_id) with what their group decides; ``stays`` for the row that is kept. Of repeated
    ones that would be kept, which agree in both columns, they are counted and one stays."""
    times = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    joined = join_counted(times, groups, "digest", "group_size", rows.count(), "left")
    # in two steps, so that no array holds a number for each of a third of all rows
    chunks = joined.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    last = F.least(F.col("times"), (F.col("__chunk") + 1) * REPEATS)
    again = chunks.withColumn("nth", F.explode(F.sequence(F.col("__chunk") * REPEATS + 1, last)))
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    return again.select("doc_id", "digest", keep.alias("keep_id"), size.alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null text is empty text. A null doc_id
    counts as the smallest. Of repeated rows (same id, same text) exactly one is kept. An empty
    table gives an empty table; other columns are not looked at.
    """
    digests = _digests(docs)
    groups = materialize(digest_groups(digests).where("group_size > 1"), "copies")
    return _nth(digests, groups).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one. Cases as in ``exact_duplicates``.

    The rows that go are found by id and digest, so the copies of a hot text spread over all tasks.
    """
    digests = _digests(docs)
    groups = materialize(digest_groups(digests).where("group_size > 1"), "copies")
    copied = join_counted(digests, groups, "digest", "group_size", digests.count())
    lost = copied.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"))
    gone = materialize(lost.distinct(), "losers")
    few = gone.count() <= BROADCAST_LOSERS
    # the caller's columns travel in a struct, so no name of theirs clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(text_digest()).alias("digest"))
    stays = rows.join(F.broadcast(gone) if few else gone, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("digest") == F.col("lost_digest")), "left_anti")
    again = groups.where("keep_times > 1").select("digest")
    if again.isEmpty():
        return stays.select("row.*")
    # Rows that agree in id and text: all their other columns go through one aggregation, which keeps one of each.
    once = stays.join(again, "digest", "left_semi").dropDuplicates(["digest"])
    return stays.join(again, "digest", "left_anti").select("row.*").unionByName(once.select("row.*"))
