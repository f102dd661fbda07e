"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture; a document's mean number of repetitions is the number
of rows that the source is to have over those it has. Its count is the inverse of the Poisson
distribution function at a uniform number that is hashed from the seed and the document, so it
depends on no partitioning and no retry. Documents are then exploded by their counts and dealt out
by a hash of seed, document and copy: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import hash_unit, materialize

SEED = 5
#: Target weight of a source with n documents: n to this power.
TEMPERATURE = 0.5
#: A larger mean is the sum of several independent smaller ones, so exp(-mean) never vanishes.
LARGEST_MEAN = 500.0
#: Sources up to this many are broadcast with their distribution functions; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total_rows: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, n, rate: mean repetitions for each source (null is a source of its own).

    ``weights`` are relative target shares; sources that it leaves out get none. Without it a source
    weighs its size to the power ``temperature``. ``total_rows`` is the size of the mixture (as many rows as now).
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = sizes.withColumn("weight", weight)
    sums = weighted.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    if not sums["w"]:
        return weighted.select("source", "n", F.lit(0.0).alias("rate"))
    target = float(sums["n"] if total_rows is None else total_rows)
    return weighted.select("source", "n", (F.lit(target) * (F.col("weight") / F.lit(sums["w"])) / F.col("n")).alias("rate"))


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0, 1, 2 ... far enough that what is left is below 2**-60."""
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(25.0)).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + term)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["sums"]


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, partitions: int | None = None, copy: str | None = "copy") -> DataFrame:
    """The rows of ``docs`` repeated by Poisson counts and shuffled globally; plus column ``copy``, from 0 for each row.

    Counts depend on seed and doc_id alone: repeated rows get the same count each; null ids share one.
    Places depend on seed, doc_id, copy and the task that reads a row, so rows that agree in all
    columns spread as well. A source that ``rates`` lacks, or with rate 0, gives no rows. A column of
    the input named as ``copy`` is replaced; with None for it nothing is added or replaced. An empty
    table gives an empty one.
    """
    names = [c for c in docs.columns if c != copy]
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(LARGEST_MEAN)).cast("int"))
    table = materialize(rates.where("rate > 0").select(key.alias("key"), parts.alias("parts"), poisson_steps(F.col("rate") / parts).alias("sums")), "rates")
    table = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table

    def count_of(part: Column) -> Column:
        u = hash_unit(F.col("doc"), part, seed=seed)
        return F.size(F.filter(F.col("sums"), lambda s: s <= u))

    counts = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda acc, part: acc + count_of(part))
    # the caller's columns travel in a struct, so no name of theirs clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("key"), doc.alias("doc"))
    counted = rows.join(table, "key").select("row", "doc", counts.alias("n")).where("n > 0")
    copies = counted.select("row", "doc", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    spread = copies.select("row", "copy", F.xxhash64(F.lit(seed), "doc", "copy", F.spark_partition_id()).alias("place"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread.repartition(n, "place").sortWithinPartitions("place")
    return dealt.select("row.*") if copy is None else dealt.select("row.*", F.col("copy").alias(copy))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, copy: str | None = "copy", **options) -> DataFrame:
    return mix(docs, source_rates(docs, weights, **options), seed, copy=copy)
