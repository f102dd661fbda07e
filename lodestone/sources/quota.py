"""Calls to a service that allows so many in a window of time.

The window's calls are dealt to lanes, and a lane is a partition: however many executors there are and
however Spark places the lanes, a window can't see more calls than all lanes have together. A lane keeps
the times of its last calls and waits until the oldest has left the window. A task can't know what an
attempt before it called, be it lost with its executor or its stage, so each begins with a wait of one
window. Speculative execution would run a lane twice at once: turn it off for such a stage.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lodestone.functions import constants as K

BILLING, RATE_LIMIT, TRANSIENT, OTHER = "billing", "rate_limit", "transient", "other"


def kind_of(message: str) -> str:
    """F9 for the message of one exception; ``functions.text.error_kind`` is the same for a column."""
    said = message.lower()
    for kind, signs in ((BILLING, K.BILLING_SIGNS), (RATE_LIMIT, K.RATE_SIGNS), (TRANSIENT, K.TRANSIENT_SIGNS)):
        if any(s in said for s in signs) and not (kind == BILLING and K.IN_FLIGHT in said):
            return kind
    return OTHER


@dataclass(frozen=True)
class Quota:
    """``calls`` in any ``window`` seconds; a refused call is sent again ``attempts`` - 1 times, after waits that double from ``least`` to ``most`` seconds."""

    calls: int
    window: float = 60.0
    attempts: int = 3
    least: float = 2.0
    most: float = 15.0

    def __post_init__(self) -> None:
        if self.calls < 1 or self.attempts < 1 or self.window < 0:
            raise ValueError("a quota needs a call a window, an attempt, and a window that isn't negative")

    def wait(self, refusals: int) -> float:
        return min(self.most, self.least * 2 ** (refusals - 1))


@dataclass
class Lane:
    """The calls of one task: paced, sent again or given up by their errors."""

    quota: Quota
    calls: int
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    made: deque = field(default_factory=deque)
    stopped: str | None = None

    def pace(self) -> None:
        """Returns once another call keeps within the lane's share of the window."""
        if len(self.made) == self.calls:
            while (rest := self.made[0] + self.quota.window - self.clock()) > 0:
                self.sleep(rest)
            self.made.popleft()

    def ask(self, call: Callable[[list[str]], list[list[float]]], texts: list[str]) -> tuple[list, str | None, str | None, int]:
        """(answers, error kind, message, calls made); without answers if the call failed for good."""
        if self.stopped is not None:
            return [None] * len(texts), BILLING, self.stopped, 0
        for attempt in range(1, self.quota.attempts + 1):
            self.pace()
            try:
                answers = call(texts)
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
                return answers, None, None, attempt
            except Exception as e:  # noqa: BLE001  what a service raises is its own
                message = str(e)
            finally:
                self.made.append(self.clock())  # the service may have counted it as late as this
            kind = kind_of(message)
            if kind == BILLING:
                self.stopped = message
            if kind in (BILLING, OTHER) or attempt == self.quota.attempts:
                return [None] * len(texts), kind, message, attempt
            self.sleep(self.quota.wait(attempt))
        raise AssertionError("unreachable")


def call_within(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], quota: Quota, size: int = K.EMBED_BATCH, lanes: int = 8, key: str = "chunk_id") -> DataFrame:
    """(key, embedding, error_kind, message, calls), one row for each row of ``texts`` (key, text; more columns are left out).

    ``size`` texts go in a call. Refusals by rate and passing faults are tried again, others cost their
    own batch its answer, and a refusal to spend ends the lane's calls; what has no answer says why and
    can be sent again later (``unanswered``). ``calls`` is how often the row's batch was sent, 0 after the
    end of a lane. Null texts are sent as empty, null and repeated keys are rows like others; a table
    without rows gives none. Rows are dealt to lanes by hashes of both columns: rows that are all equal
    share a lane, so ask for distinct texts (``cache_misses``). No more lanes are used than calls.
    """
    lanes = max(1, min(lanes, quota.calls))
    share, more = divmod(quota.calls, lanes)
    schema = StructType([texts.schema[key], StructField("embedding", ArrayType(DoubleType())), StructField("error_kind", StringType()), StructField("message", StringType()), StructField("calls", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        lane = Lane(quota, share + (TaskContext.get().partitionId() < more))
        lane.sleep(quota.window)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                answers, kind, message, calls = lane.ask(call, [t or "" for t in part.column("text").to_pylist()])
                n = part.num_rows
                columns = [part.column(0).cast(arrow.field(0).type), answers, [kind] * n, [message] * n, [calls] * n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    rows = texts.select(F.col(key), F.col("text").cast("string").alias("text"))
    # dealt by a number of partitions that was asked for, which adaptive execution leaves as it is
    return rows.repartition(lanes, F.xxhash64(key, "text")).mapInArrow(run, schema)


def unanswered(texts: DataFrame, answers: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of ``texts`` whose key has no answer yet."""
    return texts.join(answers.where("error_kind is null").select(key).distinct(), key, "left_anti")
