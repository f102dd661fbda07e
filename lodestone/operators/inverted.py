"""A stored inverted index for BM25 (S1, W3, A4 to A6): postings in blocks with bounds, and a search that skips blocks.

An index is a list of segments; a segment is a Parquet table of blocks, partitioned by a hash of the term and
sorted by term, so a search reads the partitions and row groups of its terms. A block has postings of one
term with similar frequencies and lengths, their largest frequency and their smallest length. These bound the weight of each
posting whatever the average length has become, so new documents are a new segment and no old block changes.

A search reads the bounds of its terms' blocks (narrow columns), then a first part of the best blocks of each
term, whose sums are lower bounds of scores: the k-th of them is a score that the result reaches. A document of
a block can reach it only if the block's bound and the best of the question's other terms do together;
all other blocks are skipped. What the result needs stands in blocks that are read, so it is exact.

Postings of a frequent term are dealt to runs, so no task holds a term of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lodestone.functions import constants as K
from lodestone.functions.text import fold_plural, words
from lodestone.operators.ranking import question_terms, top_k
from lodestone.plans.stage import bound_batches, session_folder, staged

#: Postings of a segment's partition, about, and partitions of a segment at most.
BUCKET_POSTINGS, MOST_BUCKETS = 4_000_000, 4096
#: Postings of a block, about.
BLOCK = 128
#: Postings of a term that one task orders; more are dealt to runs. A bucket is written by so many tasks at most.
RUN, PARTS = 65_536, 8
#: A run is cut to blocks in the order of frequencies (above EXACT_TF of their doublings), then of lengths in so many
#: steps for each doubling; so the bound of a block is close to its postings.
LENGTH_STEPS, EXACT_TF = 8, 16
#: Postings of each term that are read for a first bound of the k-th score, at least.
FIRST = 512
#: Scores have nine places; a bound must miss the k-th by more than rounding does.
SLACK = 1e-8
#: Terms up to this many are named to the scan; more are joined.
NAMED_TERMS = 2000
#: Question terms and bounds up to this many are broadcast.
BROADCAST_ROWS = 200_000


def frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, length, term, tf) of the terms of each text, counted where it is read; keys are those of whole texts."""
    split = docs.select(key, F.transform(words(F.coalesce(F.col(text), F.lit(""))), fold_plural).alias("terms"))
    fields = pa.schema([to_arrow_schema(split.select(key).schema).field(0), pa.field("length", pa.int32()), pa.field("term", pa.string()), pa.field("tf", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column(1)
            flat = terms.flatten().dictionary_encode()
            known = max(1, len(flat.dictionary))
            place = pc.list_parent_indices(terms).to_numpy().astype(np.int64) * known + flat.indices.to_numpy()
            found, tf = np.unique(place, return_counts=True)
            row, term = pa.array(found // known), pa.array(found % known)
            columns = [batch.column(0).take(row), pc.list_value_length(terms).take(row), flat.dictionary.take(term), pa.array(tf)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    bound_batches(docs.sparkSession)
    schema = StructType([*split.select(key).schema.fields, StructField("length", IntegerType()), StructField("term", StringType()), StructField("tf", LongType())])
    return split.mapInArrow(count, schema)


@dataclass
class InvertedIndex:
    """Segments, each with its number of partitions; ``n`` and ``words`` count all texts and their words."""

    key: str = "doc_id"
    segments: list[tuple[DataFrame, int]] = field(default_factory=list)
    n: int = 0
    words: int = 0

    @property
    def average(self) -> float:
        return self.words / self.n if self.n and self.words else 1.0

    def add(self, docs: DataFrame, text: str = "text") -> InvertedIndex:
        """The index with a segment more; keys that it has already are further texts, not newer versions.

        Null texts count as empty: they have no postings but count as texts. This index stays as it was.
        """
        table = staged(frequencies(docs, self.key, text), "frequencies")
        # a text's length from its words, so that texts without any count too
        size = docs.select(F.size(words(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")).first()
        buckets = max(1, min(MOST_BUCKETS, table.count() // BUCKET_POSTINGS))
        # postings cross once, to where their block is written; there can't be more than one such term for each RUN postings
        hot = table.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > RUN).select("term", F.ceil(F.col("df") / F.lit(RUN)).alias("runs"))
        run = F.pmod(F.xxhash64(self.key), F.coalesce("runs", F.lit(1))).cast("int").alias("run")
        rows = table.join(F.broadcast(hot), "term", "left").select("term", run, F.col(self.key).alias("key"), "tf", "length")
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
        sent = rows.select(bucket, F.pmod(F.xxhash64("term", "run"), F.lit(PARTS)).cast("int").alias("part"), "*").repartition("bucket", "part")
        alike = F.when(F.col("tf") <= EXACT_TF, F.col("tf")).otherwise(EXACT_TF + F.floor(F.log2("tf"))) * 1000 + F.floor(F.log2(F.col("length") + 1) * LENGTH_STEPS)
        at = ["bucket", "part", "term", "run"]
        nth = F.row_number().over(Window.partitionBy(*at).orderBy(alike, "length", "key"))
        grouped = sent.withColumn("block", F.floor((nth - 1) / BLOCK).cast("int")).groupBy(*at, "block").agg(
            F.collect_list(F.struct("key", "tf", "length")).alias("postings"),
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("shortest"),
        )
        named = F.concat(F.lit(f"{len(self.segments)}:"), F.concat_ws(":", "run", "block")).alias("block")
        ordered = grouped.select("bucket", "term", "n", "most", "shortest", "postings", named)
        path = f"{session_folder(docs.sparkSession)}/segment-{len(self.segments)}-{table.staged_at.rsplit('-', 1)[-1]}"
        ordered.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
        segment = docs.sparkSession.read.schema(ordered.schema).parquet(path)
        return InvertedIndex(self.key, [*self.segments, (segment, buckets)], self.n + size["n"], self.words + (size["words"] or 0))


def _weight(tf: Column, length: Column, average: Column, k1: float = K.BM25_K1, b: float = K.BM25_B) -> Column:
    """What BM25 multiplies a term's rarity by."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> InvertedIndex:
    return InvertedIndex(key).add(docs, text)


def _of_terms(index: InvertedIndex, terms: DataFrame, n_terms: int) -> DataFrame:
    """The blocks of ``terms``; few terms are named, so that other partitions and row groups are not read."""
    names = sorted(r["term"] for r in terms.collect()) if n_terms <= NAMED_TERMS else None
    parts = []
    for segment, buckets in index.segments:
        of_term = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        if names is None:
            parts.append(segment.join(terms.withColumn("bucket", of_term), ["bucket", "term"], "left_semi"))
        else:
            own = sorted(r["bucket"] for r in terms.select(of_term.alias("bucket")).distinct().collect())
            parts.append(segment.where(F.col("bucket").isin(own) & F.col("term").isin(names)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@dataclass
class Plan:
    """What a search has found out before it reads the rest: terms asked, blocks to read, and blocks there are."""

    asked: DataFrame
    chosen: DataFrame
    bounds: DataFrame


def plan_search(index: InvertedIndex, questions: DataFrame, k: int) -> Plan:
    """Which blocks a search has to read: (term, block, bound, n) for each question's terms, chosen by bounds.

    bounds: (question_id, term, block, n, bound, at) with ``at`` the postings of better blocks of the term.
    """
    asked = staged(question_terms(questions), "asked")
    few = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda df: df)
    terms = asked.select("term").distinct()
    heads = staged(_of_terms(index, terms, terms.count()).select("term", "block", "n", "most", "shortest"), "heads")
    frequency = heads.groupBy("term").agg(F.sum("n").alias("df"))
    rarity = F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = staged(frequency.select("term", rarity.alias("rarity")), "rarity")
    bound = F.col("rarity") * _weight(F.col("most"), F.col("shortest"), F.lit(index.average))
    better = Window.partitionBy("term").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    each = staged(heads.join(few(rare), "term").select("term", "block", "n", bound.alias("bound")).withColumn("at", F.coalesce(F.sum("n").over(better), F.lit(0))), "bounds")
    first = _scores(index, asked, rare, each.where(F.col("at") < max(FIRST, k)).select("term", "block"), few)
    kth = top_k(first, k, [F.desc("score")]).where(F.col("rank") == k - 1).select("question_id", F.col("score").alias("least"))
    best = asked.join(few(each.groupBy("term").agg(F.max("bound").alias("best"))), "term")
    others = best.withColumn("others", F.sum("best").over(Window.partitionBy("question_id")) - F.col("best")).join(few(kth), "question_id", "left")
    bounds = others.join(each, "term").withColumn("needed", F.col("bound") + F.col("others") >= F.coalesce(F.col("least") - SLACK, F.lit(0.0)))
    bounds = staged(bounds.select("question_id", "term", "block", "n", "bound", "at", "needed"), "needed")
    return Plan(asked, bounds.where("needed").select("question_id", "term", "block"), bounds)


def _scores(index: InvertedIndex, asked: DataFrame, rare: DataFrame, chosen: DataFrame, few) -> DataFrame:
    """(question_id, key, score) summed over the chosen blocks; scores of other blocks' postings are missing."""
    names = [c for c in ("question_id", "term", "block") if c in chosen.columns]
    chosen = chosen.select(*names)
    blocks = chosen.select("term", "block").distinct()
    terms = blocks.select("term").distinct()
    read = _of_terms(index, terms, terms.count()).select("term", "block", "postings")
    pairs = chosen if "question_id" in names else chosen.join(few(asked), "term")
    wanted = read.join(few(blocks) if few is F.broadcast and blocks.count() <= BROADCAST_ROWS else blocks, ["term", "block"])
    opened = wanted.join(few(rare), "term").select("term", "block", "rarity", F.explode("postings").alias("p"))
    weighed = opened.select("term", "block", F.col("p.key").alias(index.key), (F.col("rarity") * _weight(F.col("p.tf"), F.col("p.length"), F.lit(index.average))).alias("__w"))
    return weighed.join(pairs, ["term", "block"]).groupBy("question_id", index.key).agg(F.round(F.sum("__w"), 9).alias("score"))


def search_index(index: InvertedIndex, questions: DataFrame, k: int = K.RESULTS_PER_QUERY, plan: Plan | None = None) -> DataFrame:
    """(question_id, key, score, rank) as ``rank_by_terms`` over all texts of the index gives them.

    Questions without a term of the index don't come; an index without segments can't be searched.
    """
    plan = plan or plan_search(index, questions, k)
    few = F.broadcast if plan.asked.count() <= BROADCAST_ROWS else (lambda df: df)
    frequency = plan.bounds.select("term", "block", "n").distinct().groupBy("term").agg(F.sum("n").alias("df"))
    rare = frequency.select("term", F.log(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("rarity"))
    return top_k(_scores(index, plan.asked, rare, plan.chosen, few), k, [F.desc("score"), F.col(index.key)])


def postings_read(plan: Plan) -> DataFrame:
    """(question_id, of_terms, read): postings of the question's terms, and those in blocks that its search reads."""
    return plan.bounds.groupBy("question_id").agg(F.sum("n").alias("of_terms"), F.coalesce(F.sum(F.when(F.col("needed"), F.col("n"))), F.lit(0)).alias("read"))
