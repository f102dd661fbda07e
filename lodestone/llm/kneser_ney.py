"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted text (rows labelled with quality 1 that may be learned from): all of
it, its 5-grams counted in each scan task and summed by key in as many shards as there are shuffle
partitions. Continuation counts of the lower orders, the three discounts of each order and the
interpolation weights of all contexts come from joins and aggregations of those sharded count tables.
A document's perplexity is taken over every character of its whole text. Thresholds are quantiles for
each language, of trusted text that the model has not seen.

A character is 12 bits of an n-gram's key, so a 5-gram fits a long: the 4094 characters that trusted
text has most of have a number each, all others share one. Perplexities come from count joins at any
size: documents are taken in shards of some megabytes of text, as their scan tasks meet them; each shard
asks the sharded tables for its own distinct n-grams, backing off order by order, and what they answer
is written by shard, whose documents are then scored with it. No table goes through the driver or to
every task. Texts are written once with the number of their shard, which both passes read, so neither
depends on how Spark deals that table to tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyarrow.dataset import dataset
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestone.llm.base import bound_batches, discard, held_out, materialize, may_learn, record_batch, segment_sums, session_folder, spans_of_chars, texts_of

ORDER = 5
BITS = 12
#: Characters of a shard of documents, at least, but for the last of a task; its tables are some dozens of MB.
SHARD_CHARS = 24 << 20
#: A shard's number is that of its task, then so many bits for its place there.
TASK_BITS = 24
#: Shards whose answers lie in one folder, at most, unless there are fewer folders than shuffle partitions; bytes of their row groups.
BUCKET_SHARDS = 64
ROW_GROUP = 8 << 20
ANSWERS = pa.schema([("shard", pa.int64()), ("order", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("value", pa.float64())])
#: Keys of a shard that were met lately, by a hash (8 MB).
RECENT = 1 << 20
#: Labelled ids up to this many are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
QUANTILE = 0.995
#: A text's mean is taken as if so many more characters of the language's mean stood in it, else short texts scatter.
PRIOR_CHARS = 150
#: Added to the quantile of the log-perplexity.
MARGIN = 0.05
#: Languages up to this many are broadcast with their thresholds; more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000


class Alphabet:
    """The number of each character: 1 to 4094 for those that are known, 4095 for all others; 0 is none."""

    def __init__(self, known: list[int]) -> None:
        self.codes = np.full(0x110000, (1 << BITS) - 1, dtype=np.uint16)
        self.codes[np.array(known, dtype=np.int64)] = np.arange(1, len(known) + 1)

    @classmethod
    def of(cls, texts: DataFrame) -> Alphabet:
        """The characters that the texts have most of."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(0x110000, dtype=np.int64)
            for batch in batches:
                texts = texts_of(batch)
                for i, j in spans_of_chars(texts, 1 << 20):
                    n = np.bincount(_points("".join(texts[i:j])))
                    total[: len(n)] += n
            full = np.flatnonzero(total)
            yield record_batch([("c", pa.int64()), ("n", pa.int64())], c=full, n=total[full])

        counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
        return cls([r["c"] for r in counted.orderBy(F.desc("n"), "c").limit((1 << BITS) - 2).collect()])

    def numbers(self, text: str) -> np.ndarray:
        return self.codes[_points(text)].astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def ngram_keys(texts: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 5-gram that ends at each character of each text (zeros before its start), and the texts' lengths."""
    each = [alphabet.numbers(t) for t in texts]
    lengths = np.array([len(c) for c in each], dtype=np.int64)
    pad = np.zeros(ORDER - 1, dtype=np.int64)
    flat = np.concatenate([x for c in each for x in (pad, c)]) if each else np.empty(0, np.int64)
    keys = np.zeros(max(0, len(flat) - ORDER + 1), dtype=np.int64)
    for k in range(ORDER):
        keys = (keys << BITS) | flat[k : k + len(keys)]
    # a text of n characters gives n keys; those in between span two texts
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    keep = np.repeat(starts, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    return keys[keep], lengths


@dataclass
class HashTable:
    """Open addressing over int64 keys, probed for whole arrays at once."""

    keys: np.ndarray
    values: np.ndarray
    mask: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> HashTable:
        """Of different keys, none negative."""
        size = 1 << max(4, int(len(keys) * 2.2).bit_length())
        owner, left, slots = np.full(size, -1, dtype=np.int64), np.arange(len(keys)), cls._slots(keys, size - 1)
        while len(left):
            free = np.flatnonzero(owner[slots] < 0)
            owner[slots[free]] = left[free]  # of several that want a slot one gets it
            rest = owner[slots] != left
            left, slots = left[rest], (slots[rest] + 1) & (size - 1)
        table, out = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.float64)
        full = np.flatnonzero(owner >= 0)
        table[full], out[full] = keys[owner[full]], values[owner[full]]
        return cls(table, out, size - 1)

    @staticmethod
    def _slots(keys: np.ndarray, mask: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(keys), missing)
        slots = self._slots(keys, self.mask)
        found = self.keys[slots]
        hit = found == keys
        out[hit] = self.values[slots[hit]]
        left = np.flatnonzero(~hit & (found >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def _context(key: Column | str) -> Column:
    return F.shiftright(F.col(key) if isinstance(key, str) else key, BITS)


def _suffix(key: str, order: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))


@dataclass
class KneserNey:
    """``grams``: order, key, p (interpolated); ``weights``: order, context, share left to the lower order; 1 / characters."""

    grams: DataFrame
    weights: DataFrame
    floor: float
    alphabet: Alphabet


@dataclass
class Tables:
    """What a shard of documents was told, by order."""

    grams: dict[int, HashTable]
    weights: dict[int, HashTable]
    floor: float

    @classmethod
    def of(cls, answers: pa.Table, floor: float) -> Tables:
        order, kind, key, value = (answers.column(c).to_numpy() for c in ("order", "kind", "key", "value"))
        both = [{o: HashTable.of(key[at], value[at]) for o in range(1, ORDER + 1) for at in [(order == o) & (kind == k)]} for k in (GRAM, SHARE)]
        return cls(*both, floor)

    def probability(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each n-gram's last character after the others; unseen n-grams back off through their contexts' shares."""
        if order == 0:
            return np.full(len(keys), self.floor)
        p = self.grams[order].get(keys, -1.0)
        unseen = np.flatnonzero(p < 0)
        if len(unseen):
            rest = keys[unseen]
            lower = self.probability(rest & ((1 << (BITS * (order - 1))) - 1), order - 1)
            p[unseen] = lower * self.weights[order].get(rest >> BITS, 1.0)
        return p


def train(trusted: DataFrame) -> KneserNey:
    """The model of the texts of ``trusted``: counts of all of it."""
    alphabet = Alphabet.of(trusted)
    shared = trusted.sparkSession.sparkContext.broadcast(alphabet)  # 2 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        waiting = 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in spans_of_chars(texts, 1 << 21):
                keys, n = np.unique(ngram_keys(texts[a:b], shared.value)[0], return_counts=True)
                held.append((keys, n))
                waiting += len(keys)
                if waiting > 4_000_000:
                    held, waiting = [_summed(held)], 0
        keys, n = _summed(held)
        for i in range(0, len(keys), 200_000):
            yield record_batch([("key", pa.int64()), ("n", pa.int64())], key=keys[i : i + 200_000], n=n[i : i + 200_000])

    counts = trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    tables = {ORDER: materialize(counts, "counts5")}
    for order in range(ORDER - 1, 0, -1):  # how many different characters stand before each n-gram
        shorter = tables[order + 1].groupBy(_suffix("key", order + 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        tables[order] = materialize(shorter, f"counts{order}")
    vocabulary = max(1, tables[1].count())
    floor = 1.0 / (vocabulary + 1)
    grams = weights = lower = None
    for order in range(1, ORDER + 1):
        t = tables[order]
        n1, n2, n3, n4 = (t.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
        d1, d2, d3 = (min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = t.groupBy(_context("key").alias("context")).agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("share"))
        joined = t.withColumn("context", _context("key")).join(contexts, "context")
        own = (F.col("n") - discount) / F.col("total")
        if lower is None:
            now = joined.select("key", (own + F.col("share") * F.lit(floor)).alias("p"))
        else:
            below = lower.select(F.col("key").alias("suffix"), F.col("p").alias("lower"))
            now = joined.withColumn("suffix", _suffix("key", order)).join(below, "suffix").select("key", (own + F.col("share") * F.col("lower")).alias("p"))
        lower = materialize(now, f"model{order}")
        part = lower.select(F.lit(order).alias("order"), "key", "p")
        share = contexts.select(F.lit(order).alias("order"), "context", "share")
        grams = part if grams is None else grams.unionByName(part)
        weights = share if weights is None else weights.unionByName(share)
    shares = materialize(weights, "shares")
    discard(*tables.values())
    return KneserNey(grams, shares, floor, alphabet)


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)


GRAM, SHARE = 0, 1


def _cut(docs: DataFrame, chars: int) -> DataFrame:
    """(shard, row, text): ``docs`` dealt to shards of ``chars`` characters or a little more, as each task meets them."""
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*names).alias("row") if names else F.lit(None).cast("struct<none:int>").alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([StructField("shard", LongType()), *rows.schema.fields])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << TASK_BITS, 0
        for batch in batches:
            # a row's shard is the one that is open before it, which it may fill
            shards = np.empty(batch.num_rows, dtype=np.int64)
            for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                shards[i], size = number, size + n
                if size >= chars:
                    number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(shards), *[batch.column(k).cast(arrow.field(k + 1).type) for k in range(2)]], schema=arrow)

    return rows.mapInArrow(cut, schema)


def _runs(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the rows of a batch that lie together."""
    edges = np.flatnonzero(np.diff(shards)) + 1
    for i, j in zip([0, *edges], [*edges, len(shards)]):
        if i < j:
            yield int(shards[i]), int(i), int(j)


def _asked(cut: DataFrame, alphabet: Broadcast) -> DataFrame:
    """(shard, key) of the distinct 5-grams of each shard. A shard that two tasks read may ask twice for a key."""
    fields = [("shard", pa.int64()), ("key", pa.int64())]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0
        recent = np.full(RECENT, -1, dtype=np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            keys = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            for i in range(0, len(keys), 200_000):
                part = keys[i : i + 200_000]
                yield record_batch(fields, shard=np.full(len(part), now), key=part)

        for batch in batches:
            texts = texts_of(batch)
            for shard, i, j in _runs(batch.column("shard").to_numpy()):
                if shard != now:
                    yield from close()
                    now, held, waiting = shard, [], 0
                    recent.fill(-1)
                for a, b in spans_of_chars(texts[i:j], 1 << 19):
                    keys = ngram_keys(texts[i + a : i + b], alphabet.value)[0]
                    slots = HashTable._slots(keys, RECENT - 1)
                    new = recent[slots] != keys
                    recent[slots[new]] = keys[new]
                    held.append(np.unique(keys[new]))
                    waiting += len(held[-1])
                    if waiting > 8_000_000:
                        held = [np.unique(np.concatenate(held))]
                        waiting = 0
        yield from close()

    return cut.select("shard", "text").mapInArrow(ask, "shard long, key long")


def _bucket(shard, buckets: int):
    """Where the answers of a shard lie; of a column or of a number."""
    low = (1 << TASK_BITS) - 1
    if isinstance(shard, Column):
        return (F.shiftright(shard, TASK_BITS) * 31 + shard.bitwiseAND(low)) % buckets
    return ((shard >> TASK_BITS) * 31 + (shard & low)) % buckets


def _answer(asked: DataFrame, model: KneserNey, path: str, buckets: int) -> None:
    """Writes (shard, order, kind, key, value), all that the shards' n-grams need of the model, by joins of each order."""
    need, before = asked, asked
    for order in range(ORDER, 0, -1):
        known = model.grams.where(F.col("order") == order).select("key", "p")
        met = materialize(need.join(known, "key", "left"), f"asked{order}", compression="zstd")
        discard(before)
        missing = met.where("p is null")
        shares = model.weights.where(F.col("order") == order).select("context", "share")
        contexts = missing.select("shard", _context("key").alias("context")).distinct().join(shares, "context")
        grams = met.where("p is not null").select("shard", F.lit(GRAM).alias("kind"), "key", F.col("p").alias("value"))
        answers = grams.unionByName(contexts.select("shard", F.lit(SHARE).alias("kind"), F.col("context").alias("key"), F.col("share").alias("value")))
        placed = answers.select(_bucket(F.col("shard"), buckets).alias("bucket"), "shard", F.lit(order).alias("order"), "kind", "key", "value")
        # a file has a bucket's shards one after the other, in small row groups: a shard's reader skips the others
        sorted_ = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
        sorted_.write.mode("append").option("parquet.block.size", str(ROW_GROUP)).option("compression", "zstd").partitionBy("bucket").parquet(path)
        need, before = missing.select("shard", _suffix("key", order).alias("key")).distinct(), met
    discard(before)


def log_likelihoods(docs: DataFrame, model: KneserNey, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``docs`` (any columns, with text) with scored_chars and log_p, the sum over all characters, in place of text."""
    spark = docs.sparkSession
    kept = docs.drop("scored_chars", "log_p")
    cut = materialize(_cut(kept, shard_chars), "shards", compression="zstd")
    alphabet = spark.sparkContext.broadcast(model.alphabet)
    shards = cut.select("shard").distinct().count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // BUCKET_SHARDS))
    path = f"{session_folder(spark)}/answers-{uuid.uuid4().hex}"
    _answer(materialize(_asked(cut, alphabet), "asked", compression="zstd"), model, path, buckets)
    floor = model.floor
    schema = StructType([cut.schema["row"], StructField("scored_chars", LongType()), StructField("log_p", DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        now = tables = None
        for batch in batches:
            texts = texts_of(batch)
            chars, log_p = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for shard, i, j in _runs(batch.column("shard").to_numpy()):
                if shard != now:
                    now, tables = shard, None
                    tables = Tables.of(_read_answers(store, root, shard, buckets), floor)
                for a, b in spans_of_chars(texts[i:j], 1 << 19):
                    keys, lengths = ngram_keys(texts[i + a : i + b], alphabet.value)
                    chars[i + a : i + b] = lengths
                    log_p[i + a : i + b] = segment_sums(np.log(tables.probability(keys)), lengths)
            yield pa.RecordBatch.from_arrays([batch.column("row").cast(arrow.field("row").type), pa.array(chars), pa.array(log_p)], schema=arrow)

    scored = cut.mapInArrow(score, schema)
    names = [c for c in kept.columns if c != "text"]
    return scored.select(*[F.col("row").getField(c).alias(c) for c in names], "scored_chars", "log_p")


def _read_answers(store: pafs.FileSystem, root: str, shard: int, buckets: int) -> pa.Table:
    """A shard's answers; none if all its texts are empty."""
    folder = f"{root}/bucket={_bucket(shard, buckets)}"
    if store.get_file_info(folder).type == pafs.FileType.NotFound:
        return ANSWERS.empty_table()
    return dataset(folder, filesystem=store, format="parquet", schema=ANSWERS).to_table(filter=pc.field("shard") == shard)


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_chars: int = PRIOR_CHARS, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, scored_chars, perplexity, threshold, kept for each row.

    Perplexity is for each character, drawn to the language's mean as ``prior_chars`` more characters
    would. A document is kept if it is not above its language's threshold. Empty and null texts have
    nothing to score: perplexity is null and they are not kept. A null language is ``und``. A language
    has a threshold of its own however few its trusted texts are; without any that the model has not
    seen nothing is known, and all its texts are kept, with null thresholds. Ids may be null or repeated.
    """
    bound_batches(docs.sparkSession)
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = ids.withColumn("__trusted", F.lit(True))
    known = F.broadcast(known) if ids.count() <= BROADCAST_IDS else known
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    model = train(plain.join(known, "doc_id", "left_semi").where(may_learn()))
    unseen = F.coalesce("__trusted", F.lit(False)) & held_out()
    scored = materialize(log_likelihoods(plain, model).join(known, "doc_id", "left").withColumn("__unseen", unseen).drop("__trusted"), "likelihoods")
    trusted = scored.where("__unseen and scored_chars > 0")
    means = materialize(trusted.groupBy("lang").agg((F.sum("log_p") / F.sum("scored_chars")).alias("mean")), "means")
    few = F.broadcast if means.count() <= BROADCAST_LANGUAGES else (lambda df: df)
    everywhere = trusted.agg((F.sum("log_p") / F.sum("scored_chars")).alias("mean")).first()["mean"]
    drawn = (-(F.col("log_p") + F.lit(prior_chars) * F.coalesce("mean", F.lit(everywhere).cast("double"))) / (F.col("scored_chars") + prior_chars)).alias("__log")
    base = scored.join(few(means), "lang", "left").select("doc_id", "lang", "scored_chars", "__unseen", F.when(F.col("scored_chars") > 0, drawn).alias("__log"))
    judged = base.where("__unseen and scored_chars > 0")
    cut = judged.groupBy("lang").agg(F.percentile_approx("__log", quantile, 20_000).alias("__cut"))
    threshold = F.col("__cut") + margin
    kept = (F.col("scored_chars") > 0) & F.coalesce(F.col("__log") <= threshold, F.lit(True))
    return base.join(few(cut), "lang", "left").select("doc_id", "lang", "scored_chars", F.exp("__log").alias("perplexity"), F.exp(threshold).alias("threshold"), kept.alias("kept"))
