"""The trail of a run as a stream (T1 to T6, S11): events, frames, heartbeats."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import constants as K
from lodestone.plans.stage import _delete, session_folder

log = logging.getLogger(__name__)


def frame(event: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def frames(events: DataFrame) -> DataFrame:
    """Adds frame to rows with an event column; its data are all other columns as JSON."""
    rest = [c for c in events.columns if c != "event"]
    return events.withColumn("frame", frame(F.col("event"), F.to_json(F.struct(*rest))))


def parse_frames(body: DataFrame, column: str = "body") -> DataFrame:
    """(event, data) of each whole frame of a body; comments, such as heartbeats, are skipped."""
    split = body.select(F.posexplode(F.split(F.col(column), "\n\n")).alias("seq", "f")).where(~F.col("f").startswith(":") & (F.col("f") != ""))
    return split.select("seq", F.regexp_extract("f", r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract("f", r"(?m)^data: ?(.*)$", 1).alias("data"))


def heartbeat_gaps(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = K.HEARTBEAT_SECONDS) -> DataFrame:
    """T2 over a table: silences of more than ``seconds`` between a key's events, and the heartbeats that they take."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    silent = events.withColumn("gap_us", gap).where(F.col("gap_us") > seconds * 1_000_000)
    return silent.select(key, "event_id", "gap_us", F.floor((F.col("gap_us") - 1) / F.lit(seconds * 1_000_000)).alias("heartbeats"))


def silences(stream: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = K.HEARTBEAT_SECONDS, late: str = "1 minute") -> DataFrame:
    """T2 over a stream: sessions that end with ``seconds`` of silence; rows later than the watermark are left out."""
    session = F.session_window(F.col(ts), f"{seconds} seconds")
    return stream.withWatermark(ts, late).groupBy(session.alias("session"), key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("session.start").alias("began"), F.col("session.end").alias("silent_from"), "n_events")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, as a table in the shared folder: micro-batches take the place of a producer's
    queue, and the end of what is available that of its sentinel."""
    folder = f"{session_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def completion_order(steps: DataFrame, run: str = "run_id", ordinal: str = "ordinal", finished: str = "finished_at") -> DataFrame:
    """T4: adds ``seq``, the place of a step in the order in which a run's steps ended, which its trail shows; what
    is computed from the steps takes them by ``ordinal``, as they were planned."""
    return steps.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(finished, ordinal)) - 1)


def with_terminal(trail: DataFrame, outcome: DataFrame) -> DataFrame:
    """A run's progress and activity in order, then exactly one result or error.

    trail: run_id, seq, event, data; outcome: run_id, ok, data. A run without an outcome ends in error.
    """
    last = trail.groupBy("run_id").agg((F.max("seq") + 1).alias("seq"))
    runs = last.join(outcome, "run_id", "full_outer")
    ok = F.coalesce("ok", F.lit(False))
    end = runs.select("run_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.when(ok, "result").otherwise("error").alias("event"), F.coalesce("data", F.lit("the run ended without a result")).alias("data"))
    return trail.select("run_id", "seq", "event", "data").unionByName(end)


def feed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, on_error: Callable[[Exception, int], None] | None = None):
    """The stream into a sink, micro-batch by micro-batch; a broken sink never ends the run."""

    def deliver(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as error:  # the trail is a by-product of the run
            if on_error is None:
                log.warning("batch %s of the trail was not delivered", number, exc_info=error)
            else:
                on_error(error, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver).trigger(availableNow=True).start()


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``feed`` and ``feed_kept``: batch ``n`` is the folder ``batch=n`` of a table, so one that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        # the mark of a whole folder, by which ``kept_batches`` knows one
        batch.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/batch={number}")

    return write


def feed_kept(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, letters: str):
    """``feed`` that loses nothing: a batch that the sink refuses is kept in ``letters`` under its number.

    The run goes on; ``redeliver`` offers the batch again. If it can't be kept either, the run fails, and its
    restart begins with that batch. The sink has to take a number again without doubling its rows (``batch_table``).
    """

    def deliver(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as error:  # the trail is a by-product of the run
            log.warning("batch %s of the trail is kept for later", number, exc_info=error)
            batch_table(letters)(batch, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver).trigger(availableNow=True).start()


def kept_batches(spark: SparkSession, letters: str) -> list[int]:
    """The numbers of the batches that wait in ``letters``; one whose write broke off is not among them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(letters)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    whole = [f.getPath() for f in store.listStatus(folder) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("batch=")) for p in whole)


def redeliver(spark: SparkSession, sink: Callable[[DataFrame, int], None], letters: str) -> list[int]:
    """T5: offers the batches in ``letters`` to the sink in order, each with its own number; returns those that it refused again.

    A batch leaves ``letters`` after the sink has taken it; if the run breaks off in between, it is offered once more.
    """
    refused = []
    for number in kept_batches(spark, letters):
        path = f"{letters}/batch={number}"
        try:
            sink(spark.read.parquet(path), number)
        except Exception as error:
            log.warning("batch %s of the trail was refused again", number, exc_info=error)
            refused.append(number)
        else:
            _delete(spark, path)
    return refused
