import glob
import time
import uuid

import pytest

from pyspark.sql import functions as F

from lodestone.functions.text import error_kind
from lodestone.sources.quota import Lane, Quota, call_within, kind_of, unanswered

MESSAGES = ["Error code: 402", "429 Too Many Requests", "RateLimitError", "insufficient credits for in-flight requests", "503 UNAVAILABLE", "timed out", "no structured output", "bad key", ""]


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        assert seconds > 0
        self.waits.append(seconds)
        self.now += seconds


def most_in_window(times, window):
    return max(sum(t <= u < t + window for u in times) for t in times)


def failing(*messages):
    left = list(messages)

    def call(texts):
        if left:
            raise RuntimeError(left.pop(0))
        return [[float(len(t))] for t in texts]

    return call


def test_kinds_are_those_of_the_column(spark):
    rows = spark.createDataFrame([(m,) for m in MESSAGES], "m string").select("m", error_kind("m").alias("kind")).collect()
    assert all(kind_of(r.m) == r.kind for r in rows) and len({r.kind for r in rows}) == 4


def test_a_lane_keeps_its_share():
    clock = Clock()
    lane, times = Lane(Quota(3, 10.0), 3, clock, clock.sleep), []

    def call(texts):
        times.append(clock.now)
        clock.now += 0.5
        return [[0.0] for _ in texts]

    for _ in range(20):
        lane.ask(call, ["t"])
    assert len(times) == 20 and most_in_window(times, 10.0) == 3 and times[-1] < 10.0 * 8


def test_refusals_wait_twice_as_long_each_time():
    clock = Clock()
    lane = Lane(Quota(100, 1.0, attempts=6), 100, clock, clock.sleep)
    assert lane.ask(failing("429", "503", "timeout", "overloaded", "429"), ["abc"]) == ([[3.0]], None, None, 6)
    assert clock.waits == [2.0, 4.0, 8.0, 15.0, 15.0]
    assert lane.ask(failing(*["429"] * 9), ["abc"]) == ([None], "rate_limit", "429", 6)


def test_some_errors_are_not_tried_again():
    clock = Clock()
    lane = Lane(Quota(100), 100, clock, clock.sleep)
    assert lane.ask(failing("bad key"), ["a", "b"]) == ([None, None], "other", "bad key", 1)
    assert lane.ask(lambda texts: [], ["a"])[1:] == ("other", "0 answers to 1 texts", 1)
    assert lane.ask(failing(), ["ab"])[0] == [[2.0]]
    assert lane.ask(failing("payment required"), ["a"]) == ([None], "billing", "payment required", 1)
    assert lane.ask(failing(), ["ab"]) == ([None], "billing", "payment required", 0)  # nothing is called any more
    assert clock.waits == []


def test_no_window_sees_more_calls_than_allowed(spark, tmp_path):
    folder = str(tmp_path)

    def call(texts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(time.time()))
        return [[float(len(t))] for t in texts]

    df = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("text"))
    out = call_within(df, call, Quota(10, 0.6), size=2, lanes=4, key="id").collect()
    times = [float(open(f).read()) for f in glob.glob(f"{folder}/*")]
    assert len(out) == 60 and all(r.error_kind is None and r.embedding == [float(len(f"t{r.id}"))] for r in out)
    assert 30 <= len(times) <= 34 and most_in_window(times, 0.6) <= 10


def test_rows_without_answer_are_kept_and_sent_again(spark):
    def call(texts):
        if any(t.startswith("x") for t in texts):
            raise ValueError("bad text")
        return [[1.0] for _ in texts]

    df = spark.createDataFrame([(1, "a", 5), (2, "x", 5), (None, None, 5), (4, "b", 5), (4, "b", 5)], "chunk_id int, text string, calls int")
    out = call_within(df, call, Quota(100, 0.0), size=1)
    got = sorted(((r.chunk_id, r.error_kind, r.calls) for r in out.collect()), key=str)
    assert got == sorted([(1, None, 1), (2, "other", 1), (None, None, 1), (4, None, 1), (4, None, 1)], key=str)
    assert {r.chunk_id for r in unanswered(df, out).collect()} == {2, None}
    assert call_within(df.limit(0), call, Quota(1)).count() == 0


def test_a_quota_without_calls_is_refused():
    with pytest.raises(ValueError):
        Quota(0)
