"""Near duplicates by min-max hashing: banded signatures for candidates, full sets for links.

Every document is the set of its distinct word n-grams (of four words if not told otherwise). Each
permutation of a set gives two values, its minimum and its maximum, so a signature of 2 * PERMUTATIONS
values costs PERMUTATIONS passes over the n-grams. Two sets agree in a value with the probability of
their Jaccard similarity; minimum and maximum err in opposite directions, which makes the share of
equal values vary less than that of as many independent minima. A band hashes ROWS values of different
permutations, half of the bands minima and half maxima. Sets that share a band are candidates: sets
of similarity 0.8 share none of the 40 bands with a probability of (1 - 0.8**5)**40 = 1.3e-7.

1. One pass over the texts gives sizes, a fingerprint for each set (equal sets are one node), bands and
   the signature with 8 bits a value. Texts that a task has met before give no second signature.
2. Buckets (nodes that share a band) are counted; only those with two nodes or more go on.
3. Every node is held against two leaders of its buckets, the smallest nodes, with which it shares most
   bands. Sizes and signatures drop pairs that can't be links (a pair of similarity 0.8 has fewer than
   LEAST_EQUAL of its expected equal values with a probability of about 1e-6); the rest is counted on the full sets,
   which one more pass writes for nodes of buckets. Links give components.
4. Buckets whose nodes are by then in one component need nothing more. In the others only pairs of
   different components are looked at: first each node with its most similar partners by signature, PROBES of
   them, which joins most of what is left of large groups with a few pairs for each node; then all pairs that are still of different components and that signatures allow, so no candidate stays uncounted. For
   these, tasks hold the sets with 32 bits an n-gram, which bound an overlap from above, so that pairs
   just below the threshold, of which a large group has many, are not written; what passes is counted on the full sets.
   Buckets are compared block by block, block pairs dealt over tasks. A bucket in which a row has on average more
   than BLOCK / 2 rows of other components is split by every later band that its nodes share before, so nodes that
   share a passage and little else part. A linked pair shares 13 of 40 bands on average; it shares a single
   one, and would be lost if that one's bucket is split, with a probability below 3e-6. Each further
   split would lose more (two bands: 3e-5), so buckets are split DEPTH times.

No bucket is gathered in one task: buckets are aggregated before they are shuffled, joins of hot keys are
salted (``join_counted``), comparisons run on blocks. Nothing is capped. Work grows with the square
of a group whose nodes share bands after all splits and are in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, discard, join_counted, materialize, record_batch, spans_of_chars, texts_of
from lodestone.llm.components import connected_components
from lodestone.llm.ngram_join import SKETCH_BITS, GlobalOrder, fingerprint, segments_of, shingle_sets

#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
WORDS = 4
#: Values of a band, bands, and permutations, each of which gives a minimum and a maximum.
ROWS, BANDS = 5, 40
PERMUTATIONS = ROWS * BANDS // 2
#: Signatures with a smaller share of equal values than this times the threshold can't be those of a link.
LEAST_EQUAL = 0.825
#: Nodes of a bucket that one task compares with each other at a time.
BLOCK = 1500
#: Partners of a node, each the most similar of its share of the nodes, that are counted before all others are.
PROBES = 2
#: Times that a large bucket is split.
DEPTH = 1
#: n-grams of the sets that travel to the blocks, at most; pairs of larger sets are counted on the full sets.
SMALL_SET = 8192
#: n-grams whose permutations are held at a time.
GRAMS_AT_A_TIME = 1 << 14

_rng = np.random.default_rng(13)
_FACTORS = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_WEIGHTS = _rng.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2, PERMUTATIONS) of uint32: minima and maxima of each set's hashes; no set may be empty."""
    lengths = np.array([len(s) for s in sets])
    out = np.empty((len(sets), 2, PERMUTATIONS), dtype=np.uint32)
    out[:, 0], out[:, 1] = 0xFFFFFFFF, 0
    grams = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(lengths)
    for lo in range(0, len(grams), GRAMS_AT_A_TIME):
        part = grams[lo : lo + GRAMS_AT_A_TIME]
        first, last = np.searchsorted(ends, [lo, lo + len(part) - 1], side="right")
        starts = np.maximum(ends[first : last + 1] - lengths[first : last + 1] - lo, 0)
        for k in range(PERMUTATIONS):
            with np.errstate(over="ignore"):
                h = (part ^ _MASKS[k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)  # one for one, as all of it
            out[first : last + 1, 0, k] = np.minimum(out[first : last + 1, 0, k], np.minimum.reduceat(h, starts))
            out[first : last + 1, 1, k] = np.maximum(out[first : last + 1, 1, k], np.maximum.reduceat(h, starts))
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def bands_of(values: np.ndarray) -> np.ndarray:
    """(sets, BANDS) of int64: a band's hash tells its number too."""
    rows = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = (_mixed(rows + np.uint64(1)) * _WEIGHTS).sum(axis=2, dtype=np.uint64)
        return _mixed(sums + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def signature(values: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) of uint8: eight bits of each value."""
    with np.errstate(over="ignore"):
        return ((values.reshape(len(values), -1) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def least_equal(percent: int) -> int:
    """Equal values that signatures of a link have at least."""
    return int(LEAST_EQUAL * percent / 100 * 2 * PERMUTATIONS)


_READ = [("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())]


def read_signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, node, bands, signature) of each row: node is null for empty sets, bands and signature are null where the task has given them before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column("doc_id"), texts_of(batch)
            for a, b in spans_of_chars(texts):
                sizes, nodes, new, at = [], [], [], []
                for i, grams in enumerate(shingle_sets(texts[a:b], words)):
                    node = fingerprint(grams) if len(grams) else None
                    sizes.append(len(grams))
                    nodes.append(node)
                    if node is not None and node not in seen:
                        if len(seen) < 200_000:
                            seen.add(node)
                        new.append(grams)
                        at.append(i)
                bands: list = [None] * (b - a)
                marks: list = [None] * (b - a)
                if new:
                    values = min_max(new)
                    for i, own, mark in zip(at, bands_of(values), signature(values)):
                        bands[i], marks[i] = own, mark.tobytes()
                yield record_batch(_READ, doc_id=ids.slice(a, b - a), n=sizes, node=nodes, bands=bands, signature=marks)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(plain.mapInArrow(read, "doc_id long, n long, node long, bands array<long>, signature binary"), "signatures")


def _open(rows: DataFrame, low: str, tag: str) -> DataFrame:
    """Of ``rows`` (key, node, ...) those whose key has different values of ``low``; with ``least``, its smallest, ``size``,
    the key's rows, and ``apart``, the pairs of them with different values."""
    each = rows.groupBy("key", low).agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("key").agg(F.min(low).alias("least"), F.count(F.lit(1)).alias("values"), F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    several = materialize(groups.where("values > 1").select("key", "least", "size", ((F.col("size") * F.col("size") - F.col("squares")) / 2).alias("apart")), f"{tag}-keys")
    found = materialize(join_counted(rows, several, "key", "size", max(1, several.agg(F.sum("size").alias("n")).first()["n"] or 0)), tag)
    discard(several)
    return found


def _equal_enough(percent: int):
    least = least_equal(percent)

    @F.arrow_udf("boolean")
    def equal(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), dtype=np.uint8).reshape(len(a), -1) for s in (a, b))
        return pa.array((x == y).sum(axis=1) >= least)

    return equal


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, n_a, n_b) of the ``pairs`` (a, b) that sizes and signatures allow to be links."""
    pairs = materialize(pairs, "candidates")
    total, table = pairs.count(), pairs
    for side in ("a", "b"):
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size"))
        own = counts.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}")), side)
        table = join_counted(table, own, side, "size", total).drop("size")
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    return table.where(fits).where(_equal_enough(percent)("s_a", "s_b")).select("a", "b", "n_a", "n_b")


def leader_pairs(met: DataFrame) -> DataFrame:
    """(a, b): each node with the two leaders that it shares most bands with."""
    shared = met.where("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("node").agg(F.max(F.struct("shared", "least")).alias("first"), F.max("least").alias("second"))
    pairs = best.select("node", F.explode(F.array_distinct(F.array("first.least", "second"))).alias("leader"))
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _within_reach(x: np.ndarray, y: np.ndarray, n: np.ndarray, sets: list[np.ndarray | None], percent: int) -> np.ndarray:
    """Which pairs (x ascends) shortened sets allow to be links: what of y's set occurs in x's is the overlap or more."""
    ok = np.ones(len(x), dtype=bool)
    ends = np.flatnonzero(np.concatenate([x[1:] != x[:-1], [True]])) + 1
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        at = [k for k in range(lo, hi) if sets[y[k]] is not None]
        if (own := sets[x[lo]]) is None or not at:
            continue
        others = [sets[y[k]] for k in at]
        values, own = np.concatenate(others), np.sort(own)
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        lengths = np.array([len(o) for o in others])
        shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
        ok[at] = 100 * shared >= percent * (n[x[lo]] + n[y[at]] - shared)
    return ok


def crossing_pairs(met: DataFrame, nodes: DataFrame, components: DataFrame, percent: int = PERCENT, probes: int | None = None, sets: DataFrame | None = None, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """(a, b, n_a, n_b): pairs of nodes of different components that share a band and that sizes and signatures, and
    shortened ``sets`` if given, allow to be links; with ``probes``, of each node only those with its most similar partners, so many at most."""
    mapped = met.select("key", "band", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = _open(mapped, "component", "open")
    scratch = [placed]
    many = F.col("apart") > F.col("size") * (block / 2)
    bands = placed.select("node", F.col("key").alias("next"), F.col("band").alias("later"))
    columns = ["key", "band", "node", "component", "size"]
    ready, large = placed.where(~many).select(*columns), placed.where(many).select(*columns)
    for _ in range(depth):
        if large.isEmpty():
            break
        split = large.drop("size").join(bands, "node").where("later > band").select(F.xxhash64("key", "next").alias("key"), F.col("later").alias("band"), "node", "component")
        scratch.append(parts := _open(split, "component", "split"))
        ready, large = ready.unionByName(parts.where(~many).select(*columns)), parts.where(many).select(*columns)
    rows = ready.unionByName(large)
    # a bucket of more than ``block`` rows is compared block by block: each row meets each block once
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    described = nodes.select("node", "n", "signature")
    if sets is None:
        described = described.withColumn("small", F.lit(None).cast("array<int>"))
    else:
        # the number of n-grams is in both tables, but a large set's need not be shuffled
        small = sets.where(F.size("items") <= SMALL_SET).select("node", F.transform("items", lambda x: F.shiftright(x, 32).cast("int")).alias("small"))
        described = described.join(small, "node", "left")
    with_sets = dealt.join(described, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "n", "signature", "small")
    least, by_sets = least_equal(percent), sets is not None
    fields = [("node", pa.int64()), ("probe", pa.int32()), ("equal", pa.int32())] + [(c, pa.int64()) for c in ("a", "b", "n_a", "n_b")]

    def close(group: list[tuple]) -> pa.RecordBatch | None:
        _, i, j, own, node, component, n, marks, small = zip(*group)
        own, node, component, n = (np.array(c) for c in (own, node, component, n))
        m = np.frombuffer(b"".join(marks), dtype=np.uint8).reshape(len(group), -1)
        found = []
        step = max(1, 200_000 // len(group))
        for lo in range(0, len(group), step):
            ok = component[lo : lo + step, None] != component
            ok &= np.arange(lo, lo + len(ok))[:, None] < np.arange(len(group))
            ok &= 100 * np.minimum(n[lo : lo + step, None], n) >= percent * np.maximum(n[lo : lo + step, None], n)
            if i[0] != j[0]:
                ok &= own[lo : lo + step, None] != own
            x, y = np.nonzero(ok)
            for at in range(0, len(x), 20_000):
                p, q = x[at : at + 20_000] + lo, y[at : at + 20_000]
                equal = (m[p] == m[q]).sum(axis=1)
                p, q, equal = np.stack([p, q, equal])[:, equal >= least]
                if len(p) and by_sets:
                    p, q, equal = np.stack([p, q, equal])[:, _within_reach(p, q, n, small, percent)]
                found.append(np.stack([p, q, equal]))
        if not found or not len((all_found := np.concatenate(found, axis=1))[0]):
            return None
        x, y, equal = all_found
        if probes is None:
            of = probe = np.full(len(x), -1)
        else:
            of, to, equal = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([equal, equal])
            probe = node[to] % probes
            order = np.lexsort((node[to], -equal, probe, of))
            of, to, probe, equal = of[order], to[order], probe[order], equal[order]
            first = np.concatenate([[True], (of[1:] != of[:-1]) | (probe[1:] != probe[:-1])])
            x, y, of, probe, equal = of[first], to[first], of[first], probe[first], equal[first]
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return record_batch(fields, node=node[of], probe=probe.astype(np.int32), equal=equal.astype(np.int32), a=node[x], b=node[y], n_a=n[x], n_b=n[y])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            column = batch.column(8)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            small = [values[lo:hi] if valid else None for lo, hi, valid in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]
            for row in zip(*(c.to_pylist() for c in batch.columns[:8]), small):
                if group and row[:3] != group[0][:3]:
                    if len(group) > 1 and (out := close(group)):
                        yield out
                    group = []
                group.append(row)
        if len(group) > 1 and (out := close(group)):
            yield out

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = with_sets.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    found = sorted_rows.mapInArrow(compare, "node long, probe int, equal int, a long, b long, n_a long, n_b long")
    if probes is not None:
        found = found.groupBy("node", "probe").agg(F.max(F.struct("equal", "a", "b", "n_a", "n_b")).alias("best")).select("best.*")
    pairs = materialize(found.select("a", "b", "n_a", "n_b").distinct(), "crossing")
    discard(*scratch)
    return pairs


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, b, n_a, n_b) that are links, by the full ``sets`` (node, items) of both; a node of many pairs is salted."""
    total, table = pairs.count(), pairs
    for side in ("a", "b"):
        counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("size"))
        own = counts.join(sets.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}")), side)
        table = join_counted(table, own, side, "size", total).drop("size")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    links = table.where(F.lit(100) * shared >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - shared))
    return materialize(links.select("a", "b").distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    ``component_id`` is the smallest doc_id that links reach, its own included; ``kept`` says that it is
    the row's own. Empty and null texts have no n-grams and no links. Rows with equal sets are linked;
    repeated rows are all kept or all dropped. Null ids stay null and count only where a group has no
    other; such a group is kept. Words are whole however long, texts too. An empty table gives an empty one;
    columns but doc_id and text are not looked at.
    """
    bound_batches(docs.sparkSession)
    read = read_signatures(docs, words)
    rows = read.select("doc_id", "n", "node")
    given = read.where("signature is not null").select("node", "n", "bands", "signature")
    by_node = materialize(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "by-node")
    postings = given.select("node", F.posexplode("bands").alias("band", "key"))
    shared = _open(postings, "node", "met")
    met = materialize(shared.select("key", "band", "node", "least").dropDuplicates(["key", "node"]), "buckets")
    discard(shared)
    candidates = met.select("node").distinct()
    nodes = materialize(given.select("node", "n", "signature").join(candidates, "node", "left_semi").dropDuplicates(["node"]).join(by_node.select("node", "doc_id"), "node"), "nodes")
    whole = GlobalOrder(np.arange(1 << SKETCH_BITS, dtype=np.uint64), np.empty(0, np.uint64))  # sets in one piece
    sets = segments_of(docs, nodes.select("node", "doc_id"), whole, words).select("node", "items")
    links = linked(materialize(plausible_pairs(leader_pairs(met), nodes, percent), "stars"), sets, percent)
    components = connected_components(links)
    for probes in (PROBES, None):
        crossing = crossing_pairs(met, nodes, components, percent, probes, None if probes else sets)
        more = None if crossing.isEmpty() else linked(crossing, sets, percent)
        discard(crossing)
        if more is not None and not more.isEmpty():
            links = links.unionByName(more)
            components = connected_components(links)
    in_groups = by_node.join(components, "node").select("node", "component", "doc_id", "copies")
    smallest = in_groups.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    reached = join_counted(in_groups, smallest, "component", "size", in_groups.count()).select("node", "component_id", "copies")
    copied = by_node.where("copies > 1").join(reached, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"), "copies")
    groups = materialize(reached.unionByName(copied), "reached")
    found = join_counted(rows, groups, "node", "copies", rows.count(), "left")
    named = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
