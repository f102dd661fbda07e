"""Tables between the stages of a plan, in the folder that driver and executors share, and joins that no hot key gathers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that a join broadcasts because many rows have them: no more, since each has more than that share of the rows.
HOT_KEYS = 100_000
#: A key with fewer rows than this is not hot, however small the table.
LEAST_HOT = 64
#: Of an Arrow batch that goes to a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where none is set on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local") and not master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where this application's tables are; nothing else is in it."""
    return f"{shared_folder(spark)}/lodestone/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written (with the writer's ``options``) and read again: later stages plan from a table, and a lost executor costs no earlier stage."""
    path = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``staged`` returned; nothing that is still to run may read them."""
    for table in tables:
        _delete(table.sparkSession, table.staged_at)


def discard_all(spark: SparkSession) -> None:
    """Deletes all tables of this application, once no result is to be read any more."""
    _delete(spark, session_folder(spark))


def join_counted(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``groups``, which has one row for each key and in ``size`` how many rows have it.

    A key of more than ``total / HOT_KEYS`` rows is hot; there can't be more than HOT_KEYS of them, so
    these are broadcast with the number of their salts. Rows of a hot key are dealt to its salts by a
    hash of all their columns, and its group is copied to each. One shuffle join follows, in which no
    task gets more rows of a key than that. Null keys match nothing and are spread.
    """
    least = max(LEAST_HOT, -(-total // HOT_KEYS))
    salts = F.ceil(F.col(size) / F.lit(least)).cast("int")
    hot = groups.where(F.col(size) > least).select(key, salts.alias("__salts"))
    spread = F.coalesce(F.col("__salts"), F.when(F.col(key).isNull(), HOT_KEYS).otherwise(1))
    others = [c for c in rows.columns if c != key] or [key]
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), spread).cast("int")).drop("__salts")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts to some megabytes, on both sides of the pipe; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            given = spark.conf.get(key)
        except Exception:  # noqa: BLE001  a version of Spark without this setting
            continue
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)(?:i?b)?", given.strip().lower()).groups()
        now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
