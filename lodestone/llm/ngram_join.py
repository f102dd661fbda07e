"""N-gram Jaccard join with vertical partitioning.

Every document is the set of its distinct word n-grams (64-bit hashes; of three words if not told
otherwise). A global order of n-grams,
rare ones first, comes from a frequency sketch of fixed size (2**20 counters over all documents);
any order gives the same result, a good one gives few candidates. The order is cut into fragments of
equal mass, each set thereby into segments. Two sets are compared by counting the overlap of their
segments fragment by fragment, each on its own, and summing the counts for each pair.

Which pairs are compared, without losing a link and without emitting all pairs of a group:

1. Equal sets are one node (their documents are linked with each other by definition).
2. Two sets with Jaccard of at least t share an n-gram among the first |x| - ceil(t|x|) + 1 of each in
   the global order. Nodes that share such a token are a posting group. If the first token that two
   sets share stands at places p and q, the overlap is at most 1 + min(|x| - p - 1, |y| - q - 1): what
   is too far back in its set for the sizes of a group takes no part in it. Tokens that only one set
   has count as standing first, so sets that share few tokens by chance are too far back.
3. Stars: every node is compared with two leaders of its groups: the one with the fewest rare n-grams of its
   own before the shared one, as the original of edited copies has it, and any other; so with no more
   than two pairs for each node. Verified links give components.
4. Groups whose nodes are by now in one component need nothing more. In the others, only pairs from
   different components are looked at. A group of more than ``block`` nodes is split by the next token
   that its nodes share (for t above one half two linked sets share two of their first
   |x| - ceil(t|x|) + 2 tokens), so nodes that have nothing else in common never meet; what is still
   larger is compared in blocks of bounded size. A pair leaves its task only if sizes, places and the
   parity bitmaps of its sets allow the threshold (the number of differing bits never exceeds the
   symmetric difference, so no link is lost), and if no token is known that both sets have before the
   one they meet by: they meet at the first token that they share too. These are verified like the
   first ones. Where a group has more than ``block`` nodes there is a round before, in which each node
   is paired with the nearest one of other components alone; its links join most of what a large group
   of near copies still has apart, so few pairs cross components when all of them are looked at.

Components of all verified links then give each document the smallest doc_id it reaches. Joins whose
keys can be hot (tokens, nodes with many copies, leaders) deal the rows of these to salts, so no task
gathers a key's rows. The sketch says which tokens can be hot; the others take one shuffle and a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, discard, join_counted, materialize, record_batch, spans_of_chars, texts_of
from lodestone.llm.components import connected_components
from lodestone.plans.stage import HOT_KEYS

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
WORDS = 3
FRAGMENTS = 8
SKETCH_BITS = 20
#: Counters that travel together, packed; most are zero in a small task.
SKETCH_CHUNK = 1 << 14
#: Rows of a posting group that one task compares with each other at a time.
BLOCK = 400
#: Rows of posting groups that a task compares, on average, at most.
ROWS_PER_TASK = 50_000
#: In larger groups pairs are held against the bitmaps of their sets before they leave the task.
PLAIN = 16
#: Tokens that a row of a group knows of its set before the group's own, at most.
BEFORE = 4
#: Pairs of one leader whose segments travel together.
PAIRS_PER_SALT = 500
#: A token is hot if its counter in the sketch holds so many n-grams, or so many times the mean counter.
HOT_COUNT, HOT_SHARE = 5000, 4
#: Bits of the filter that says which documents to read again (1 MB; more for more documents, to 16 MB).
FILTER_BITS = (1 << 23, 1 << 27)
#: Dropped ids up to this many are broadcast (16 MB).
BROADCAST_IDS = 1_000_000

_LOW = np.uint64((1 << (64 - SKETCH_BITS)) - 1)
_SHIFT = np.uint64(64 - SKETCH_BITS)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers or more of an odd multiplier, modulo 2**64."""
    global _POWERS
    if n > len(_POWERS):
        factors = np.full(max(64, 2 * n), 0x9E3779B97F4A7C15, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (runs of anything but ASCII white space, A-Z lower-cased), and words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buffer = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    solid = ~_SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]))
    if not len(starts):
        return np.empty(0, np.uint64), per_text
    first = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        values = (buffer[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()) + 1)[within]
        sums = np.add.reduceat(values, first)
    return _mix(sums), per_text


def shingle_sets(texts: list[str], size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``size`` words; with fewer words the whole sequence is one n-gram."""
    for a, b in spans_of_chars(texts, 1 << 19):
        words, per_text = word_hashes(texts[a:b])
        with np.errstate(over="ignore"):
            n = max(0, len(words) - size + 1)
            grams = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                grams = grams * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
        grams = _mix(grams)
        start = 0
        for count in per_text.tolist():
            if count >= size:
                yield np.unique(grams[start : start + count - size + 1])
            elif count:
                with np.errstate(over="ignore"):
                    h = np.uint64(count)
                    for w in words[start : start + count]:
                        h = h * np.uint64(0xA24BAED4963EE407) + w
                yield _mix(np.array([h], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)
            start += count


def fingerprint(grams: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(grams).sum() + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def may_link(n: int, m: int, differ: int = 0, percent: int = PERCENT) -> bool:
    """Whether sets of sizes n and m with a symmetric difference of at least ``differ`` can reach the threshold."""
    differ = max(differ, abs(n - m))
    # union = (n + m + d) / 2, intersection = (n + m - d) / 2
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def bitmap_bits(n: int) -> int:
    return 1 << min(13, max(6, (2 * n).bit_length()))


def parity_bitmap(grams: np.ndarray) -> bytes:
    bits = bitmap_bits(len(grams))
    counts = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded_bitmap(bitmap: bytes, width: int) -> bytes:
    """A bitmap folded to at most ``width`` bytes."""
    m = np.frombuffer(bitmap, dtype=np.uint8)
    while len(m) > width:
        m = m[: len(m) // 2] ^ m[len(m) // 2 :]
    return m.tobytes()


def differing_bits(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """A lower bound of the symmetric difference: the larger bitmap is folded onto the smaller one."""
    while a_bits > b_bits:
        a_bits >>= 1
        a = (a ^ (a >> a_bits)) & ((1 << a_bits) - 1)
    while b_bits > a_bits:
        b_bits >>= 1
        b = (b ^ (b >> b_bits)) & ((1 << b_bits) - 1)
    return (a ^ b).bit_count()


@dataclass
class GlobalOrder:
    """Place of each counter in the order of frequencies (uint64), the places that fragments begin at, and the
    place from which tokens can be hot."""

    rank: np.ndarray
    cuts: np.ndarray
    hot_from: int = 1 << SKETCH_BITS

    def hot(self) -> Column:
        """Whether many sets can have a token."""
        return F.shiftrightunsigned("token", 64 - SKETCH_BITS) >= self.hot_from

    def ordered(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams as numbers that sort by the global order; one for one with their hashes."""
        return np.sort((self.rank[(grams >> _SHIFT).astype(np.int64)] << _SHIFT) | (grams & _LOW))

    def segments(self, ordered: np.ndarray) -> list[np.ndarray]:
        return np.split(ordered, np.searchsorted(ordered, self.cuts << _SHIFT))


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype="<i8")


_FIRST = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("chunk", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())]


def read_sets(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, GlobalOrder]:
    """(doc_id, n, node) of each row, node null for empty sets; and the global order of all n-grams."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            texts = texts_of(batch)
            n, node = [], []
            for grams in shingle_sets(texts, words):
                n.append(len(grams))
                node.append(fingerprint(grams) if len(grams) else None)
                np.add.at(sketch, (grams >> _SHIFT).astype(np.int64), 1)
            none = [None] * len(n)
            yield record_batch(_FIRST, doc_id=batch.column("doc_id"), n=n, node=node, chunk=none, task=none, counts=none)
        task = TaskContext.get().partitionId()
        parts = [(i, sketch[i : i + SKETCH_CHUNK]) for i in range(0, len(sketch), SKETCH_CHUNK)]
        parts = [(i // SKETCH_CHUNK, _packed(c)) for i, c in parts if c.any()]
        none = [None] * len(parts)
        yield record_batch(_FIRST, doc_id=none, n=none, node=none, chunk=[i for i, _ in parts], task=[task] * len(parts), counts=[c for _, c in parts])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(plain.mapInArrow(read, "doc_id long, n long, node long, chunk int, task int, counts binary"), "sets")
    counted = table.where("chunk is not null").select("chunk", "task", "counts")
    tasks = counted.agg(F.max("task").alias("t")).first()["t"]

    def add(rows: pa.Table) -> pa.Table:
        total = sum(_unpacked(c) for c in rows.column("counts").to_pylist())
        first = rows.slice(0, 1).to_pylist()[0]
        return pa.table({"chunk": pa.array([first["chunk"]], pa.int32()), "task": pa.array([first["task"] // 64], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})

    left = (tasks or 0) + 1
    while True:  # a tree: no group has more than 64 rows of 128 KB at most
        counted = counted.withColumn("upper", F.floor(F.col("task") / 64)).groupBy("chunk", "upper").applyInArrow(add, "chunk int, task int, counts binary")
        if left <= 64:
            break
        left = -(-left // 64)
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for row in counted.toArrow().to_pylist():  # at most 64 rows of 128 KB
        sketch[row["chunk"] * SKETCH_CHUNK : (row["chunk"] + 1) * SKETCH_CHUNK] = _unpacked(row["counts"])
    by_frequency = np.argsort(sketch, kind="stable")
    rank = np.empty(len(sketch), dtype=np.uint64)
    rank[by_frequency] = np.arange(len(sketch), dtype=np.uint64)
    mass = np.cumsum(sketch[by_frequency])
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS).astype(np.uint64)
    hot_from = int(np.searchsorted(sketch[by_frequency], max(HOT_COUNT, HOT_SHARE * int(mass[-1]) // len(sketch))))
    return table.where("chunk is null").select("doc_id", "n", "node"), GlobalOrder(rank, cuts, hot_from)


_TOKENS = [("token", pa.int64()), ("node", pa.int64()), ("place", pa.int64()), ("bitmap", pa.binary())]


def in_first_prefix(percent: int) -> Column:
    """Whether a token of the longer prefix is in the shorter one too."""
    return F.col("pos") < F.col("n") - F.expr(f"({percent}L * n + 99) div 100") + 1


def prefix_tokens(docs: DataFrame, order: GlobalOrder, percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(token, node, place) of the prefixes, one token longer than what a pair must share one of; and (node, n, bitmap).

    ``place`` is the token's place in the set and, in its low 32 bits, the set's size. A node may come more than once. Sets of one n-gram are left out where they can't be linked with any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    least = 2 if percent > 50 else 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, maps, tokens = [], [], [], []
            for grams in shingle_sets(texts_of(batch), words):
                if len(grams) < least:
                    continue
                node = fingerprint(grams)
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                nodes.append(node)
                sizes.append(len(grams))
                maps.append(parity_bitmap(grams))
                tokens.append(shared.value.ordered(grams)[: prefix_length(len(grams), percent) + 1].view(np.int64))
            if not nodes:
                continue
            lengths = np.array([len(t) for t in tokens])
            token, owner, size = np.concatenate(tokens), np.repeat(np.array(nodes), lengths), np.repeat(np.array(sizes), lengths)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield record_batch(_TOKENS, token=[None] * len(nodes), node=nodes, place=sizes, bitmap=maps)
            for i in range(0, len(token), 200_000):
                part = slice(i, i + 200_000)
                none = pa.nulls(len(token[part]), pa.binary())
                yield record_batch(_TOKENS, token=token[part], node=owner[part], place=(pos[part] << 32) | size[part], bitmap=none)

    table = materialize(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, "token long, node long, place long, bitmap binary"), "tokens")
    tokens = table.where("token is not null").select("token", "node", "place")
    tokens.staged_at = table.staged_at
    return tokens, table.where("token is null").select("node", F.col("place").cast("int").alias("n"), "bitmap")


def by_token(rows: DataFrame, hot: Column, total: int, then: Callable[[DataFrame], DataFrame], **aggregates: Column) -> DataFrame:
    """``then`` of ``rows`` with aggregates over the rows of their token: by a window, and for hot tokens by a salted join."""
    w = Window.partitionBy("token")
    cold = rows.where(~hot).withColumns({name: a.over(w) for name, a in aggregates.items()})
    warm = rows.where(hot)
    groups = materialize(warm.groupBy("token").agg(*[a.alias(name) for name, a in aggregates.items()], F.count(F.lit(1)).alias("__rows")), "hot-groups")
    met = join_counted(warm, groups, "token", "__rows", total).select(*rows.columns, *aggregates)
    return then(cold).unionByName(then(met))


def shared_postings(tokens: DataFrame, order: GlobalOrder) -> DataFrame:
    """(token, node, pos, n) of the ``tokens`` that two different nodes have, each row once; with two leaders of the
    group (node, pos, n): foremost, whose token comes first in its set, and other, the largest node."""

    def shared(rows: DataFrame) -> DataFrame:
        return rows.where("smallest <> other.node").dropDuplicates(["token", "node"])

    def unpacked(place: str) -> list[Column]:
        return [F.shiftright(place, 32).cast("int").alias("pos"), F.col(place).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n")]

    found = by_token(tokens, order.hot(), tokens.count(), shared, smallest=F.min("node"), other=F.max(F.struct("node", "place")), foremost=F.min(F.struct("place", "node")))
    ends = [F.struct(F.col(f"{x}.node").alias("node"), *unpacked(f"{x}.place")).alias(x) for x in ("foremost", "other")]
    return materialize(found.select("token", "node", *unpacked("place"), *ends), "postings")


def shared_places(postings: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, node, pos, n) of ``postings`` with the places that tokens have when those of a prefix that no other set has stand first.

    What only one set has is in no overlap, wherever it stands, so the bound by places holds for these
    too. For t above one half a linked pair has two shared tokens in its prefixes and one more, so the
    first of them stays in the prefix proper. Others keep their places.
    """
    rows = postings.select("token", "node", "pos", "n")
    if percent <= 50:
        return rows
    after = F.count(F.lit(1)).over(Window.partitionBy("node").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))
    last = F.col("n") - F.expr(f"({percent}L * n + 99) div 100") + 1
    return materialize(rows.withColumn("pos", (last - after).cast("int")), "places")


def segments_of(docs: DataFrame, readers: DataFrame, order: GlobalOrder, words: int = WORDS) -> DataFrame:
    """(node, fragment, items) of the sets whose (node, doc_id) is in ``readers``; the others aren't read again."""
    spark = docs.sparkSession
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * readers.count()).bit_length()))
    bit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(bits)).cast("int")
    masks = readers.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, bit & 31))").alias("mask")).toArrow()
    table = np.zeros(bits // 32, dtype=np.int64)
    table[masks.column(0).to_numpy()] = masks.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((order, table.astype(np.uint32)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, wanted = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            hit = (wanted[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
            chosen = batch.filter(pa.array(hit))
            ids, texts = chosen.column("doc_id").to_pylist(), texts_of(chosen)
            for a, b in spans_of_chars(texts, 1 << 21):
                rows: list[tuple] = []
                for doc, grams in zip(ids[a:b], shingle_sets(texts[a:b], words)):
                    if len(grams):
                        node = fingerprint(grams)
                        rows += [(doc, node, k, part.view(np.int64)) for k, part in enumerate(order.segments(order.ordered(grams))) if len(part)]
                if rows:
                    lengths = np.array([len(r[3]) for r in rows])
                    items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate([r[3] for r in rows])))
                    fields = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("fragment", pa.int32()), ("items", pa.list_(pa.int64()))])
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), items], schema=fields)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.withColumn("bit", bit).mapInArrow(read, "doc_id long, node long, fragment int, items array<long>")
    wanted = readers.select(F.col("node").alias("__node"), F.col("doc_id").alias("__doc"))
    exact = found.join(wanted, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    return materialize(exact.select("node", "fragment", "items"), "segments")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, order: GlobalOrder, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that are links: overlaps counted fragment by fragment, summed for each pair.

    A node in many pairs, as leaders are, has its segments copied for each ``PAIRS_PER_SALT`` of them.
    """
    ends = pairs.select(F.col("a").alias("node"), F.lit("a").alias("side")).unionByName(pairs.select(F.col("b").alias("node"), F.lit("b").alias("side")))
    asked = materialize(ends.groupBy("node").agg(F.count_if(F.col("side") == "a").alias("as_a"), F.count_if(F.col("side") == "b").alias("as_b")), "asked")
    readers = materialize(nodes.join(asked.select("node"), "node", "left_semi").select("node", "doc_id"), "readers")
    segments = segments_of(docs, readers, order, words)
    least = max(PAIRS_PER_SALT, -(-pairs.count() // HOT_KEYS))
    table = pairs
    for side, other in (("a", "b"), ("b", "a")):
        hot = asked.where(F.col(f"as_{side}") > least).select(F.col("node").alias(side), F.ceil(F.col(f"as_{side}") / F.lit(least)).cast("int").alias("salts"))
        table = table.join(F.broadcast(hot), side, "left").withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")

    def copies(side: str) -> DataFrame:
        salts = asked.where(F.col(f"as_{side}") > 0).select(F.col("node").alias(side), F.ceil(F.col(f"as_{side}") / F.lit(least)).cast("int").alias("salts"))
        each = segments.withColumnRenamed("node", side).join(salts, side)
        return each.select(side, "fragment", F.col("items").alias(f"items_{side}"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias(f"salt_{side}"))

    table = table.join(copies("a"), ["a", "salt_a"]).join(copies("b"), ["b", "salt_b", "fragment"])
    partial = table.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("items_a", "items_b")).alias("shared"))
    # a repeated row gives its segments twice, hence the maximum before the sum
    once = partial.groupBy("a", "b", "n_a", "n_b", "fragment").agg(F.max("shared").alias("shared"))
    summed = once.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    links = summed.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    found = materialize(links.select("a", "b"), "verified")
    discard(asked, readers, segments)
    return found


class _Bitmaps:
    """Parity bitmaps of some nodes, folded to smaller sizes as they are asked for."""

    def __init__(self, maps: list[bytes]) -> None:
        self.width = np.array([len(m) for m in maps], dtype=np.int64)
        self.row = np.zeros(len(maps), dtype=np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.of[w] = np.frombuffer(b"".join(maps[i] for i in own), dtype=np.uint8).reshape(-1, w)

    def folded(self, rows: np.ndarray, own: int, to: int) -> np.ndarray:
        m = self.of[own][self.row[rows]]
        while own > to:
            own //= 2
            m = m[:, :own] ^ m[:, own:]
        return np.ascontiguousarray(m).view(np.uint64)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric differences of pairs."""
        out = np.zeros(len(i), dtype=np.int64)
        both = np.stack([self.width[i], self.width[j]], axis=1)
        for wi, wj in np.unique(both, axis=0).tolist():
            for at in np.array_split(here := np.flatnonzero((both[:, 0] == wi) & (both[:, 1] == wj)), max(1, len(here) // 20_000)):
                to = min(wi, wj)
                out[at] = np.bitwise_count(self.folded(i[at], wi, to) ^ self.folded(j[at], wj, to)).sum(axis=1)
        return out


def may_link_all(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` for arrays."""
    differ = np.maximum(differ, np.abs(n - m))
    return 100 * (n + m - differ) >= percent * (n + m + differ)


def _bitmaps_allow(percent: int):
    @F.arrow_udf("boolean")
    def allow(n_a: pa.Array, map_a: pa.Array, n_b: pa.Array, map_b: pa.Array) -> pa.Array:
        n, m = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (n_a, n_b))
        maps = _Bitmaps(map_a.to_pylist() + map_b.to_pylist())
        at = np.arange(len(n))
        return pa.array(may_link_all(n, m, maps.differing(at, at + len(n)), percent) if len(n) else np.zeros(0, bool), pa.bool_())

    return allow


def _places_allow(n: str, pos: str, m: str, other_pos: str, percent: int) -> Column:
    """Whether sizes and the places of the first token that two sets share allow the threshold."""
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(other_pos))
    sizes = F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    return sizes & (rest * F.lit(100 + percent) >= F.lit(percent) * (F.col(n) + F.col(m)))


def star_pairs(postings: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each node with two leaders of its posting groups that sizes, places and bitmaps allow a link with.

    Of foremost nodes it takes the one that stands foremost; near copies of one text so have the same
    leader, whichever tokens they share with it.
    """

    def leader(kind: str) -> Column:
        fits = (F.col("node") != F.col(f"{kind}.node")) & _places_allow("n", "pos", f"{kind}.n", f"{kind}.pos", percent)
        return F.min(F.when(fits, F.struct(f"{kind}.pos", f"{kind}.n", f"{kind}.node")))["node"].alias(kind)

    kinds = ["foremost", "other"]
    chosen = postings.where(in_first_prefix(percent)).groupBy("node").agg(*map(leader, kinds))
    pairs = chosen.select("node", F.explode(F.array_distinct(F.array(*kinds))).alias("leader")).where("leader is not null")
    return allowed_pairs(pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), nodes, percent)


def allowed_pairs(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that bitmaps allow, with sizes; a leader of many pairs is broadcast if it is in more than 1 in HOT_KEYS of them."""
    pairs = materialize(pairs, "candidates")
    total, table = pairs.count(), pairs
    for side in ("a", "b"):
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size"))
        own = counts.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bitmap").alias(f"map_{side}")), side)
        table = join_counted(table, own, side, "size", total).drop("size")
    return table.where(_bitmaps_allow(percent)("n_a", "map_a", "n_b", "map_b")).select("a", "b", "n_a", "n_b")


def _opened(rows: DataFrame, hot: Column, percent: int, tag: str) -> DataFrame:
    """Of ``rows`` (token, node, component, pos, n) those of groups with several components whose place allows a link
    with the smallest set of the group; with ``size``, at least the number of a group's rows that this leaves."""

    def several(rows: DataFrame) -> DataFrame:
        fits = (F.col("n") - F.col("pos")) * F.lit(100 + percent) >= F.lit(percent) * (F.col("n") + F.col("least"))
        return rows.where("low <> high").where(fits).drop("low", "high", "least")

    component = {"low": F.min("component"), "high": F.max("component")}
    return materialize(by_token(rows, hot, rows.count(), several, **component, least=F.min("n"), size=F.count(F.lit(1))), tag)


def _with_before(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``before``: the last tokens of the set that rows of the same ``keys`` have before their own."""
    w = Window.partitionBy("node", *keys).orderBy("pos", "token").rowsBetween(-BEFORE, -1)
    return rows.withColumn("before", F.collect_list("token" if not keys else "next").over(w))


def crossing_pairs(postings: DataFrame, nodes: DataFrame, components: DataFrame, order: GlobalOrder, percent: int = PERCENT, block: int = BLOCK, *, nearest: bool = False) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of a posting group from different components that sizes, places and bitmaps allow to be links.

    With ``nearest``, where a group has more than ``block`` rows, only the nearest of these by bitmaps for each row of
    the groups of more than PLAIN rows; ``complete`` of the result says whether it has all.
    """
    few = F.broadcast(components) if components.count() <= BROADCAST_IDS else components
    placed = postings.select("token", "node", "pos", "n").join(few, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    opened = _opened(placed.where(in_first_prefix(percent)), order.hot(), percent, "open")
    used = [placed, opened]
    rows = _with_before(opened)
    hot = rows.where(F.col("size") > block).select("token", "node", F.col("pos").alias("at"), F.col("before").alias("first"))
    some = not opened.where(F.col("size") > block).isEmpty()
    nearest = nearest and some
    if percent > 50 and some:
        # by the next token that the sets share: what stands after it is one place further back for the bound
        after = placed.select("node", "component", "n", "pos", F.col("token").alias("next")).join(hot, "node").where("pos > at")
        split = after.select(F.xxhash64("token", "next").alias("token"), "node", "component", (F.col("pos") - 1).alias("pos"), "n", F.col("token").alias("by"), "next", "first")
        split = materialize(split, "split")
        split_opened = _opened(split, F.lit(True), percent, "split-open")
        used += [split, split_opened]
        again = _with_before(split_opened, "by").withColumn("before", F.concat("first", "before"))
        rows = rows.where(F.col("size") <= block).unionByName(again.select(*rows.columns))
    if nearest:
        rows = rows.where(F.col("size") > PLAIN)
    # A group of more than ``block`` rows is compared block by block: each row meets each block once.
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = ["token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "pos", "before"]
    plain = dealt.where(F.col("size") <= PLAIN).select(*kept, F.lit(None).cast("binary").alias("bitmap"))
    mapped = dealt.where(F.col("size") > PLAIN).join(nodes.select("node", "bitmap"), "node").select(*kept, "bitmap")
    # comparing is dear for the bytes it reads, so the number of tasks is not left to their sizes
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-opened.count() // ROWS_PER_TASK))
    sorted_rows = plain.unionByName(mapped).repartition(tasks, "token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node")
    fields = [("a", pa.int64()), ("b", pa.int64())]

    def few(group: list[tuple], out: list[tuple[int, int]]) -> None:
        """Pairs of a group of a few rows, which is of one block."""
        for at, (*_, node, component, n, pos, before, _) in enumerate(group):
            for *_, other, other_component, m, other_pos, other_before, _ in group[:at]:  # sizes ascend
                if component != other_component and 100 * m >= percent * n and min(n - pos, m - other_pos) * (100 + percent) >= percent * (n + m):
                    if not set(before).intersection(other_before):
                        out.append((min(node, other), max(node, other)))

    def met_before(before: list[list[int]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows know a token that both have before this one."""
        width = max(map(len, before))
        if not width:
            return np.zeros(len(x), dtype=bool)
        lengths = np.array([len(b) for b in before])
        tokens = np.zeros((len(before), width), dtype=np.int64)
        there = np.arange(width) < lengths[:, None]
        tokens[there] = np.concatenate([np.array(b, np.int64) for b in before])
        met = np.zeros(len(x), dtype=bool)
        for k in range(width):
            for m in range(width):
                met |= (tokens[x, k] == tokens[y, m]) & there[x, k] & there[y, m]
        return met

    def nearest_of(x: np.ndarray, y: np.ndarray, far: np.ndarray, rows: int) -> np.ndarray:
        """Which of the pairs is the nearest of one of its rows."""
        place, best = np.empty(len(x), dtype=np.int64), np.full(rows, len(x))
        place[np.argsort(far, kind="stable")] = np.arange(len(x))
        np.minimum.at(best, x, place)
        np.minimum.at(best, y, place)
        return (best[x] == place) | (best[y] == place)

    def close(group: list[tuple]) -> pa.RecordBatch | None:
        token, i, j, own, node, component, n, pos, before, bitmap = zip(*group)
        n, rest, component, own = np.array(n, np.int64), np.array(n, np.int64) - np.array(pos), np.array(component), np.array(own)
        ok = np.triu(component[:, None] != component, 1)  # sizes ascend
        ok &= 100 * n[:, None] >= percent * n
        ok &= np.minimum(rest[:, None], rest) * (100 + percent) >= percent * (n[:, None] + n)
        if i[0] != j[0]:
            ok &= own[:, None] != own
        x, y = np.nonzero(ok)
        if len(x):
            new = ~met_before(before, x, y)
            x, y = x[new], y[new]
        if not len(x):
            return None
        if bitmap[0] is not None:
            differ = _Bitmaps(list(bitmap)).differing(x, y)
            fits = may_link_all(n[x], n[y], differ, percent)
            x, y, differ = x[fits], y[fits], differ[fits]
            if nearest and len(x):
                chosen = nearest_of(x, y, differ / (n[x] + n[y]), len(n))
                x, y = x[chosen], y[chosen]
        if not len(x):
            return None
        ids = np.array(node)
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return record_batch(fields, a=ids[x], b=ids[y])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int]] = []

        def end() -> Iterator[pa.RecordBatch]:
            if 1 < len(group) <= PLAIN and group[0][-1] is None:
                few(group, out)
            elif len(group) > 1 and (found := close(group)):
                yield found

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    yield from end()
                    group = []
                group.append(row)
            if out:
                yield record_batch(fields, a=[p[0] for p in out], b=[p[1] for p in out])
                out.clear()
        yield from end()
        if out:
            yield record_batch(fields, a=[p[0] for p in out], b=[p[1] for p in out])

    allowed = allowed_pairs(sorted_rows.mapInArrow(compare, "a long, b long").select("a", "b").distinct(), nodes, percent)
    discard(*used)  # the candidates are a table of their own
    allowed.complete = not nearest
    return allowed


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    ``component_id`` is the smallest doc_id that links reach, its own included. Empty and null texts
    have no n-grams and no links. Rows with equal sets are linked; null ids stay null, and count only
    where a group has no other. An empty table gives an empty one; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    rows, order = read_sets(docs, words)
    tokens, described = prefix_tokens(docs, order, percent, words)
    by_node = materialize(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "by-node")
    nodes = materialize(described.dropDuplicates(["node"]).join(by_node, "node").select("node", "n", "bitmap", "doc_id"), "nodes")
    postings = shared_postings(tokens, order)
    discard(tokens)  # with what ``described`` reads
    stars = materialize(star_pairs(postings, nodes, percent), "stars")
    links = verified(stars, docs, nodes, order, percent, words)
    components = connected_components(links)
    places = shared_places(postings, percent)
    if hasattr(places, "staged_at"):
        discard(postings)
    for nearest in (True, False):
        pairs = crossing_pairs(places, nodes, components, order, percent, nearest=nearest)
        crossing = materialize(pairs, "crossing")
        if not crossing.isEmpty():
            links = links.unionByName(verified(crossing, docs, nodes, order, percent, words))
            components = connected_components(links)
        if pairs.complete:
            break
    linked = by_node.join(components, "node").select("node", "component", "doc_id", "copies")
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    reached = join_counted(linked, smallest, "component", "size", linked.count()).select("node", "component_id", "copies")
    copied = by_node.where("copies > 1").join(reached, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"), "copies")
    groups = materialize(reached.unionByName(copied), "reached")
    found = join_counted(rows, groups, "node", "copies", rows.count(), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the smallest of their group; of repeated rows one."""
    groups = materialize(near_duplicate_groups(docs, percent, words), "groups")
    dead = materialize(groups.where("doc_id <> component_id or doc_id is null and component_id is not null").select(F.col("doc_id").alias("dead")).distinct(), "dead")
    few = dead.count() <= BROADCAST_IDS
    # the caller's columns travel in a struct, so no name of theirs clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    kept = rows.join(F.broadcast(dead) if few else dead, F.col("id").eqNullSafe(F.col("dead")), "left_anti")
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.isEmpty():
        return kept.select("row.*")
    repeated = F.col("id") == F.col("again")
    once = kept.join(again, repeated, "left_semi").dropDuplicates(["id", "text"])
    return kept.join(again, repeated, "left_anti").select("row.*").unionByName(once.select("row.*"))
