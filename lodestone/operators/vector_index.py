"""An inverted-file index of vectors (W1): lists around centroids, searched exactly by the triangle inequality or by a few lists.

Centroids come from a sample of at most SAMPLE vectors; every vector is in the list of its nearest centroid, with its
distance from it. A list is a partition of a Parquet table, sorted by that distance, so a search reads the lists it
needs and, by the bounds of row groups, no whole list. For a query at distance d from a centroid all vectors of
the list whose distance from it is r are at least |d - r| away. The nearest PROBES lists of a query give a bound of its k-th
distance; exact search then reads only lists, and of these vectors, that |d - r| lets be as near. Approximate
search reads the nearest lists only, as many as neighbours within the sample need (``enough_probes``): vectors without
clusters need half of the lists or more.

A list that has many vectors is many files and tasks; what tasks share are the queries (a block of them at a time), the centroids
(LISTS of them at most) and the bounds of each query with each list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import VECTORS_AT_A_TIME, top_k
from lodestone.plans.stage import session_folder, staged

#: Vectors that centroids are fitted to, at most; 1 in so many of a smaller table gives the number of lists.
SAMPLE, VECTORS_A_LIST = 20_000, 64
LISTS = 1024
ROUNDS = 8
#: Lists that give the first bound; approximate search reads so many at least.
PROBES = 8
#: Share of the sample's neighbours that the lists of an approximate search hold, the neighbours of each, and sample vectors that ask.
WANTED, NEIGHBOURS, ASKING = 0.95, 10, 512
#: Distances have nine places; bounds must miss by more than rounding does.
SLACK = 1e-7
#: Vectors of one list in one file, about.
FILE_ROWS = 1_000_000


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from seeded rows; a centroid that nothing is nearest to stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of rows, without the cancellation that a product would bring to near ones."""
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the distance from it."""
    squares = (x**2).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(axis=1)
    near = squares.argmin(axis=1)
    return near, np.sqrt(((x - centroids[near]) ** 2).sum(axis=1))


def enough_probes(sample: np.ndarray, centroids: np.ndarray, wanted: float = WANTED) -> int:
    """How many of the nearest lists hold that share of the NEIGHBOURS of sample vectors; itself is none of a vector's neighbours.

    The neighbours of a whole table are nearer than those of a sample of it, so there the share is larger.
    """
    k = min(NEIGHBOURS, len(sample) - 1)
    if k < 1:
        return PROBES
    own, squares = nearest(sample, centroids)[0], (sample**2).sum(axis=1)
    places = []
    for at in np.array_split(np.arange(min(ASKING, len(sample))), 8):
        apart = squares - 2 * sample[at] @ sample.T
        apart[np.arange(len(at)), at] = np.inf
        near = np.argpartition(apart, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(distances(sample[at], centroids), axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(place, own[near], axis=1).ravel())
    every = np.sort(np.concatenate(places))
    return max(PROBES, int(every[int(np.ceil(wanted * len(every))) - 1]) + 1)


@dataclass
class VectorIndex:
    """``vectors`` (list, chunk_id, radius, embedding), of each list its least and largest radius (not a number if empty),
    and how many lists an approximate search reads."""

    vectors: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    probes: int = PROBES

    def add(self, rows: DataFrame) -> VectorIndex:
        """The index with further rows (chunk_id, embedding) in its lists; centroids stay, the old index too."""
        placed, radii = _placed(rows, self.centroids)
        both = np.stack([np.fmin(self.radii[:, 0], radii[:, 0]), np.fmax(self.radii[:, 1], radii[:, 1])], axis=1)
        return VectorIndex(self.vectors.unionByName(placed), self.centroids, both, self.probes)


def _placed(rows: DataFrame, centroids: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centroids)
    fields = pa.schema([("list", pa.int32()), ("chunk_id", pa.int64()), ("radius", pa.float64()), ("embedding", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            if len(x):
                near, radius = nearest(x, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), pa.array(radius), batch.column(1)], schema=fields)

    known = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    known = known.where(F.size("embedding") == (centroids.shape[1] if centroids.size else -1))
    table = staged(known.mapInArrow(place, "list int, chunk_id long, radius double, embedding array<double>"), "placed")
    bounds = table.groupBy("list").agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n")).collect()  # a row for each list
    radii = np.full((len(centroids), 2), np.nan)
    for row in bounds:
        radii[row["list"]] = row["least"], row["most"]
    many = {row["list"]: -(-row["n"] // FILE_ROWS) for row in bounds if row["n"] > FILE_ROWS}
    salts = F.lit(1) if not many else F.coalesce(F.create_map(*[F.lit(v) for pair in many.items() for v in pair])[F.col("list")], F.lit(1))
    path = f"{session_folder(spark)}/lists-{table.staged_at.rsplit('-', 1)[-1]}"
    files = len(bounds) + sum(n - 1 for n in many.values())
    dealt = table.repartition(max(1, files), "list", F.pmod(F.xxhash64("chunk_id"), salts)).sortWithinPartitions("list", "radius")
    dealt.write.partitionBy("list").parquet(path)
    return spark.read.schema("chunk_id long, radius double, embedding array<double>, list int").parquet(path).select("list", "chunk_id", "radius", "embedding"), radii


def build_vector_index(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """An index of ``rows`` (chunk_id, embedding). Null and empty vectors are in no list; nor are those of another
    length than most of the sample has. The sample is that of the smallest hashes of ids, whatever the partitions."""
    some = rows.where("size(embedding) > 0").select(F.xxhash64("chunk_id").alias("h"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy("h").limit(sample)
    known = [r["embedding"] for r in some.collect()]  # SAMPLE rows at most
    sizes = [len(v) for v in known]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    usual = [v for v in known if len(v) == size]
    matrix = np.array(usual, dtype=np.float64).reshape(len(usual), size)
    centroids = fit_centroids(matrix, lists or max(1, min(LISTS, len(matrix) // VECTORS_A_LIST))) if len(matrix) else matrix
    placed, radii = _placed(rows, centroids)
    return VectorIndex(placed, centroids, radii, enough_probes(matrix, centroids))


_FOUND = "question_id long, chunk_id long, distance double"


def _scan(index: VectorIndex, ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, reach: np.ndarray, k: int) -> DataFrame:
    """The best ``k`` of each task for each query, from the lists that are ``wanted`` (query, list) of vectors that are within ``reach``."""
    away = distances(queries, index.centroids)
    shared = index.vectors.sparkSession.sparkContext.broadcast((ids, queries, wanted, away, reach))
    asked = np.flatnonzero(wanted.any(axis=0))
    # the radii that any query wants of a list: the scan drops row groups by them
    near, far = np.where(wanted, away - reach[:, None], np.inf).min(axis=0), np.where(wanted, away + reach[:, None], -np.inf).max(axis=0)
    if not len(asked):
        return index.vectors.sparkSession.createDataFrame([], _FOUND)
    rows = index.vectors.where(F.col("list").isin(asked.tolist()) & F.col("radius").between(float(near[asked].min()) - SLACK, float(far[asked].max()) + SLACK))
    fields = [("question_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, wanted, away, reach = shared.value
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            of, chunk, radius = (batch.column(c).to_numpy() for c in range(3))
            for number in np.unique(of):
                at = np.flatnonzero(of == number)
                who = np.flatnonzero(wanted[:, number])
                x = np.array(batch.column(3).take(pa.array(at)).to_pylist(), dtype=np.float64)
                for q in who.tolist():
                    limit = min(reach[q], np.sqrt(best[q][-1][0]) + SLACK if len(best.get(q, ())) == k else np.inf)
                    close = np.flatnonzero(np.abs(away[q, number] - radius[at]) <= limit + SLACK)
                    if len(close):
                        d = np.round(((x[close] - queries[q]) ** 2).sum(axis=1), 9)
                        best[q] = sorted(best.get(q, []) + list(zip(d.tolist(), chunk[at[close]].tolist())))[:k]
        out = [(int(ids[q]), c, d) for q, found in best.items() for d, c in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))

    return rows.select("list", "chunk_id", "radius", "embedding").mapInArrow(search, _FOUND)


@dataclass
class Found:
    """``rows`` (question_id, chunk_id, distance, rank), and how many (query, list) pairs were read of all."""

    rows: DataFrame
    read: int = 0
    pairs: int = 0


def search_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, exact: bool = True, block: int = VECTORS_AT_A_TIME) -> Found:
    """The ``k`` nearest of all vectors to each of ``queries`` (question_id, embedding), as ``rank_by_distance`` gives them.

    With ``exact`` false the nearest among those in the ``probes`` nearest lists, by default as many as the index says. Queries that are null, empty or
    of another length have no rows. Repeated ids of the index are rows of their own; ids of queries must differ.
    """
    probes = probes or (PROBES if exact else index.probes)
    size = index.centroids.shape[1] if index.centroids.size else -1
    rows = queries.where(F.size("embedding") == size).select(F.col("question_id").cast("long"), F.col("embedding").cast("array<double>")).orderBy("question_id")
    total = rows.count()
    full = np.flatnonzero(~np.isnan(index.radii[:, 0])) if len(index.radii) else np.empty(0, int)
    out = Found(index.vectors.sparkSession.createDataFrame([], _FOUND + ", rank int"))
    if not total or not len(full) or k <= 0:
        return out
    parts = []
    for begin in range(0, total, block):
        some = (rows.offset(begin).limit(block) if total > block else rows).toArrow()
        ids, matrix = np.array(some.column(0).to_pylist(), dtype=np.int64), np.array(some.column(1).to_pylist(), dtype=np.float64)
        away = distances(matrix, index.centroids)
        first = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(first, full[np.argsort(away[:, full], axis=1, kind="stable")[:, :probes]], True, axis=1)
        no_bound = np.full(len(ids), np.inf)
        near = staged(top_k(_scan(index, ids, matrix, first, no_bound, k), k, [F.col("distance"), F.col("chunk_id")]), "near")
        parts.append(near.select("question_id", "chunk_id", "distance"))
        out.read += int(first.sum())
        out.pairs += len(ids) * len(full)
        if exact:
            kth = {r["question_id"]: r["distance"] for r in near.where(F.col("rank") == k - 1).collect()}  # one row for each query of the block
            reach = np.array([np.sqrt(kth.get(i, np.inf)) + SLACK for i in ids.tolist()])
            low = np.maximum(0, np.maximum(away - index.radii[:, 1], index.radii[:, 0] - away))
            rest = ~first & ~np.isnan(low) & (low <= reach[:, None] + SLACK)
            parts.append(_scan(index, ids, matrix, rest, reach, k))
            out.read += int(rest.sum())
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    out.rows = top_k(merged, k, [F.col("distance"), F.col("chunk_id")])
    return out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(asked, found): neighbours by exact search, and those of them that ``found`` has too."""
    both = exact.select("question_id", "chunk_id").join(found.select("question_id", "chunk_id", F.lit(1).alias("hit")), ["question_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("found"))
