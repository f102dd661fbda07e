"""A write-through cache of service answers as a keyed table with atomic versions.

A cache is a folder: Parquet parts, and for each version a manifest that names the parts it has. A version
becomes visible by one rename that fails where the version is there already, so of two writers one wins and the other
looks again at what is missing; parts that no manifest names, as killed attempts leave them, are never
read. An entry is (cache_key, cached_at, used_at, value). Later entries of a key override earlier ones, and
a use is an entry without value, so reads write narrow rows and nothing is updated in place.

Answers of a service land wave by wave: a wave is a bounded number of keys, called in batches by tasks, written as
one part and committed before the next begins. What fails costs its wave; a new run calls for what is still missing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import constants as K
from lodestone.plans.stage import discard, shared_folder, staged

#: Batches of a wave; a wave is what a failure costs at most.
WAVE_BATCHES = 256
#: Parts of a version; beyond that a commit merges them.
MOST_PARTS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass
class CacheTable:
    """The cache ``name`` in the shared folder; ``value`` is the type of what is kept for a key."""

    spark: SparkSession
    name: str
    value: str = "array<double>"
    seconds: int = K.CACHE_SECONDS

    @property
    def folder(self) -> str:
        return f"{shared_folder(self.spark)}/cache/{self.name}"

    @property
    def schema(self) -> str:
        return f"cache_key string, cached_at timestamp, used_at timestamp, value {self.value}"

    def _files(self):
        """Hadoop's file context of the folder: its rename never replaces."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)

    def version(self) -> tuple[int, list[str]]:
        """The last version's number and parts; (0, []) for a cache without any."""
        jvm, fs, _ = self._files()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        if not fs.exists(path):
            return 0, []
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()]
        if not numbers:
            return 0, []
        text = self.spark.read.text(f"{self.folder}/versions/{max(numbers):012d}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)["parts"]

    def commit(self, number: int, parts: list[str]) -> None:
        """Makes ``parts`` the version ``number``; Conflict if there is one."""
        jvm, fs, context = self._files()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions"))
        hidden = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/_{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/{number:012d}"), options)
        except Exception as error:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {number} of {self.name} is there") from None
            raise

    def _write(self, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.select("cache_key", F.col("cached_at").cast("timestamp").alias("cached_at"), F.col("used_at").cast("timestamp").alias("used_at"), "value").write.parquet(f"{self.folder}/parts/{part}")
        return part

    def _entries(self, parts: list[str]) -> DataFrame:
        """One row for each key of the parts: its last value, when that was kept, and when it was last used."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/parts/{p}" for p in parts])
        kept = F.max(F.when(F.col("value").isNotNull(), F.struct("cached_at", "value"))).alias("kept")
        each = rows.groupBy("cache_key").agg(kept, F.max("used_at").alias("used_at")).where("kept is not null")
        return each.select("cache_key", F.col("kept.cached_at").alias("cached_at"), "used_at", F.col("kept.value").alias("value"))

    def read(self, now) -> DataFrame:
        """The entries (cache_key, cached_at, used_at, value) that are fresh at ``now``."""
        return self._fresh(self._entries(self.version()[1]), now)

    def _fresh(self, entries: DataFrame, now) -> DataFrame:
        return entries.where(F.col("cached_at").cast("double") + self.seconds > F.lit(now).cast("timestamp").cast("double"))

    def add(self, rows: DataFrame, now, seen: list[str] | None = None) -> int:
        """Commits the ``rows`` (cache_key, value) that have no fresh entry, one for each key; how many these were.

        Of the parts in ``seen`` the caller knows that they have no fresh entry of these keys: they aren't read again. Parts that this call commits join them.
        """
        seen = [] if seen is None else seen
        stamped = rows.where("cache_key is not null and value is not null").groupBy("cache_key").agg(F.min("value").alias("value"))
        stamped = stamped.select("cache_key", F.lit(now).cast("timestamp").alias("cached_at"), F.lit(now).cast("timestamp").alias("used_at"), "value")
        own = self._write(stamped)
        while True:
            number, parts = self.version()
            mine = self.spark.read.schema(self.schema).parquet(f"{self.folder}/parts/{own}")
            others = [p for p in parts if p not in seen]
            new = mine.join(self._fresh(self._entries(others), now).select("cache_key"), "cache_key", "left_anti") if others else mine
            n = new.count()
            if n == 0:
                return 0
            part = own if not others or n == mine.count() else self._write(new)
            if len(parts) >= MOST_PARTS:
                parts = [self._write(self._entries(parts))]
            try:
                self.commit(number + 1, [*parts, part])
                seen += [p for p in (*(parts if not others else []), part) if p not in seen]
                return n
            except Conflict:
                continue

    def use(self, keys: DataFrame, now) -> str:
        """Notes that the ``keys`` (cache_key) were read at ``now``; the part that says so."""
        none = F.lit(None)
        part = self._write(keys.select("cache_key").distinct().select("cache_key", none.alias("cached_at"), F.lit(now).cast("timestamp").alias("used_at"), none.cast(self.value).alias("value")))
        while True:
            number, parts = self.version()
            try:
                self.commit(number + 1, [*parts, part])
                return part
            except Conflict:
                continue

    def evict(self, now, most: int) -> None:
        """Keeps the ``most`` entries that were used last, of those that are fresh; ties go to the smaller key.

        Tasks cut their rows to ``most`` before these are merged, so it bounds what one task sees.
        """
        while True:
            number, parts = self.version()
            fresh = self._fresh(self._entries(parts), now)
            kept = fresh.orderBy(F.desc("used_at"), "cache_key").limit(most)
            part = self._write(kept)
            try:
                return self.commit(number + 1, [part])
            except Conflict:
                continue

    def through(self, texts: DataFrame, call: Callable[[list[str]], list], now, size: int = K.EMBED_BATCH, wave: int = WAVE_BATCHES) -> DataFrame:
        """``texts`` (cache_key, text, ...) with the column value, from the cache or else from ``call``.

        ``call`` takes ``size`` texts at most. What is missing is found once; a wave looks again only at parts that another writer has
        committed since, so work grows with the texts. Each missing key is asked for once, in waves that are committed as they
        land; a failing call fails its wave, and the waves before it stay.
        """
        seen = self.version()[1]
        keys = texts.where("cache_key is not null and text is not null").select("cache_key", "text").dropDuplicates(["cache_key"])
        known = self._fresh(self._entries(seen), now).select("cache_key", F.lit(True).alias("known"))
        asked = staged(keys.join(known, "cache_key", "left").select("cache_key", F.when(F.col("known").isNull(), F.col("text")).alias("text")), "asked")
        seen = [*seen, self.use(asked.where("text is null"), now)]
        missing = asked.where("text is not null")
        waves = -(-missing.count() // (size * wave))
        each = missing.withColumn("wave", F.pmod(F.xxhash64("cache_key"), F.lit(max(1, waves))).cast("int"))
        if waves > 1:  # a wave reads its own texts only
            path = f"{asked.staged_at}-waves"
            each.repartition(waves, "wave").write.partitionBy("wave").parquet(path)
            each = self.spark.read.schema(each.schema).parquet(path)
            each.staged_at = path
        arrow = to_arrow_type(self.spark.createDataFrame([], self.schema).schema["value"].dataType)
        for number in range(waves):
            some = each.where(F.col("wave") == number).select("cache_key", "text")
            if others := [p for p in self.version()[1] if p not in seen]:
                some = some.join(self._fresh(self._entries(others), now).select("cache_key"), "cache_key", "left_anti")
            found = some.repartition(max(1, min(wave, self.spark.sparkContext.defaultParallelism))).mapInArrow(_calls(call, size, arrow), f"cache_key string, value {self.value}")
            self.add(found, now, seen)
        discard(asked, *([each] if waves > 1 else []))
        return texts.join(self.read(now).select("cache_key", "value"), "cache_key", "left")


def _calls(call: Callable[[list[str]], list], size: int, arrow: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(call(part.column(1).to_pylist()), arrow)], names=["cache_key", "value"])

    return run
