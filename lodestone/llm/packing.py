"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

For each bin a bitset subset-sum over the lengths still available finds the fullest feasible
combination around the longest of them, which is then removed. Lengths are all that the search
needs, so it runs on their histogram (as many numbers as a sequence has tokens, whatever the size of
the corpus), and a combination is removed as often as the histogram holds it: the number of searches
depends on the sequence length alone. Pieces then find their bins by their rank within their length,
which is counted in salted groups, never by gathering a length's pieces in one task.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, materialize, spans_of_chars, texts_of

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END_OF_DOCUMENT = 2
#: Groups that the pieces of one length are counted in, at least; more as the corpus grows.
SALTS = 16
ROWS_PER_SALT = 100_000
#: Words of a worker whose ids are kept, in each of two generations (some 50 MB in all).
CACHED_WORDS = 100_000

# The vocabulary's split of text before its merges, for characters whose class no Unicode version disputes.
_SPACE = "\\t-\\r\\x20\\xa0"
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa0-\\xac\\xae-\\u024f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]|<\\|endoftext\\|>")


def _same_merges(path: str):
    """Encodes one word by the rank file of the same vocabulary, where there is one beside it: the same
    ids with less ado for each call."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not (path.endswith(".json") and os.path.exists(ranks)):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


class WordCachedTokenizer:
    """Token ids as ``tokenizers`` gives them, with the ids of each word kept.

    Byte-pair merges never cross the split into words, so a text's ids are those of its words in
    turn. Texts with unusual characters or a special token's string go to the library whole.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS) -> None:
        self.path = path
        self.merges = _same_merges(path)
        self.cached_words = cached_words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """Loaded when a text first needs it: it takes some 40 MB of each worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Sees to it that the ids of ``words`` are at hand; words not met for long are forgotten."""
        if len(self.words) > self.cached_words:
            self.words, self.older = {}, self.words
        words -= self.words.keys()
        again = words & self.older.keys()
        self.words.update((w, self.older[w]) for w in again)
        new = list(words - again)
        if self.merges is None:
            self.words.update(zip(new, self._whole(new)))
        else:
            self.words.update((w, array("I", self.merges(w)).tobytes()) for w in new)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [None if _UNUSUAL.search(t) else _SPLIT.findall(t) for t in texts]
        self._learn(set().union(*(w for w in split if w)))
        ids = self.words.__getitem__
        return [self._whole([t])[0] if w is None else b"".join(map(ids, w)) for t, w in zip(texts, split)]


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(name: str) -> WordCachedTokenizer:
    """One of each worker process, kept from task to task; ``name`` is a public vocabulary's or a path."""
    if name not in _TOKENIZERS:
        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[name] = WordCachedTokenizer(name if os.path.sep in name else public_tokenizers.path(name))
    return _TOKENIZERS[name]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = TOKENIZER, end: int = END_OF_DOCUMENT, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (``keep_ids``) ids of each piece of each document.

    ``ids`` is binary, little-endian 32-bit. A document is its text's ids and then ``end``; null text
    is empty. Only a document longer than ``capacity`` is cut, into pieces of ``capacity`` of which the
    first may be shorter.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields[: 5 + keep_ids])
    last = array("I", [end]).tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_all
        for batch in batches:
            texts, docs_of = texts_of(batch), batch.column("doc_id").to_pylist()
            for i, j in spans_of_chars(texts, 1 << 22):
                rows = []
                for doc, ids in zip(docs_of[i:j], encode(texts[i:j])):
                    ids += last
                    n = len(ids) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = ids[4 * a : 4 * b]
                        rows.append((doc, k, a, b - a, zlib.crc32(part), part)[: 5 + keep_ids])
                yield batch_of(rows)

    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


@dataclass
class PackingPlan:
    """Where the n-th piece of a length goes: intervals of n, in order, one after another for each length."""

    first: np.ndarray  # by length: the place of its rank 0 among all places
    begin: np.ndarray  # of each interval among all places
    bins: np.ndarray  # how many bins an interval runs through
    base: np.ndarray  # its first bin
    offset: np.ndarray  # the place in each bin
    n_bins: int


def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """The combination of available lengths, the longest among them, that fills most of ``capacity``."""
    lengths = np.flatnonzero(counts)
    seed = int(lengths[-1])
    gap = capacity - seed
    mask = (1 << (gap + 1)) - 1
    reach, steps = 1, []
    for length in map(int, lengths[lengths <= gap][::-1]):
        left = min(int(counts[length]) - (length == seed), gap // length)
        take = 1
        while left > 0:  # the multiples of a length by binary splitting
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> gap & 1:
            break
    total, chosen = reach.bit_length() - 1, [seed]
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen += [length] * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> PackingPlan:
    """The plan for pieces of length 1 to ``capacity``; ``histogram`` has how many there are of each."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    first = np.cumsum(counts) - counts
    used = np.zeros_like(counts)
    intervals, n_bins = [], 0
    while counts.any():
        chosen = fullest(counts, capacity)
        lengths, each = np.unique(chosen, return_counts=True)
        times = int((counts[lengths] // each).min())
        place = 0
        for length in sorted(chosen, reverse=True):
            intervals.append((int(first[length] + used[length]), times, n_bins, place))
            used[length] += times
            counts[length] -= times
            place += length
        n_bins += times
    table = np.array(sorted(intervals), dtype=np.int64).reshape(-1, 4)
    return PackingPlan(first, table[:, 0], table[:, 1], table[:, 2], table[:, 3], n_bins)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``; any others stay) plus sequence_id and offset.

    Columns of these names are replaced. Rows are numbered in a table, once, so that all that follows
    agrees about them. Equal rows are different pieces. An empty table gives an empty one.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "__row")]
    pieces = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity)
    part = pieces.where(F.col("length") < capacity)
    histogram = {int(r["length"]): int(r["n"]) for r in part.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(histogram.values())
    plan = plan_bins(histogram, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    salts = max(SALTS, -(-rows // ROWS_PER_SALT))
    salted = part.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.select("length", "__salt", (F.sum("n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    ranked = salted.withColumn("__nth", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__row")) - 1).join(before, ["length", "__salt"])

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        p = shared.value
        at = p.first[length.to_numpy(zero_copy_only=False)] + rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(p.begin, at, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(2 * (p.base[i] + at - p.begin[i]), pa.int64()), pa.array(p.offset[i], pa.int64())], ["sequence_id", "offset"])

    placed = ranked.withColumn("__at", place("length", F.col("__before") + F.col("__nth"))).select(*names, "__at.sequence_id", "__at.offset")
    alone = whole.select(*names, (F.col("__row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = TOKENIZER, end: int = END_OF_DOCUMENT, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and (``keep_ids``) ids of each piece.

    Null text counts as empty, so every row of ``docs`` is in some sequence; repeated rows are packed
    as often as they are there; null ids stay null; an empty table gives an empty one; other columns
    are not looked at.
    """
    return pack(token_pieces(docs, capacity, vocabulary, end, keep_ids), capacity)
