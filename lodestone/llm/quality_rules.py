"""Quality rules: hard base rules, then gradient-boosted trees over document statistics.

The trees are fitted on the rows of ``labels`` that may be learned from (at most ``rows`` of them, by
the hash of their ids), with the probability of low quality constrained never to fall as the shares
of symbols, repeated words, repeated lines or capitals rise. They are flattened into node arrays and
score whole batches at once. Statistics are taken of every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, hash_unit, may_learn, record_batch
from lodestone.llm.boosting import FlatTrees, fit

TRAINING_ROWS = 16_000
THRESHOLD = 0.6
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "digits", "marks", "distinct", "line_words", "top_word")
INCREASING = tuple(FEATURES.index(f) for f in ("symbols", "dup_lines", "repeat_words", "capitals"))

#: So many different words that three of their numbers fit a long.
THREE_FIT = 1 << 21

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[list(b"0123456789")] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(b"!?;:.,")] = True


def statistics(text: str) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, and the features of the trees."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits bytes on \x20 and \x09-\x0D alone
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    word_chars = len(text) - spaces
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    symbols = int(by_byte[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    repeat_words = 0
    if n > 3:
        pairs = codes[:-1] * len(ids) + codes[1:]
        if len(ids) < THREE_FIT:
            windows = pairs[:-1] * len(ids) + codes[2:]
        else:  # three numbers don't fit; those of the pairs that occur do
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * len(ids) + codes[2:]
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(windows), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside = np.zeros(n, dtype=bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeat_words = int(inside.sum())
    lower = text.lower()
    if len(lower) == len(text):
        capitals = int((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())
    else:
        capitals = sum(map(str.isupper, text))
    features = [
        float(np.log1p(n)), word_chars / n, symbols / word_chars, dup_lines / max(1, len(lines)), repeat_words / n, capitals / word_chars,
        int(by_byte[_DIGITS].sum()) / word_chars, int(by_byte[_MARKS].sum()) / word_chars, len(ids) / n, min(n / max(1, len(lines)), 500.0), int(np.bincount(codes).max()) / n,
    ]
    return [n, word_chars, symbols, dup_lines, repeat_words], features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> FlatTrees | None:
    """Trees for the probability of quality 0; None where there are no labels of both kinds."""
    bound_batches(docs.sparkSession)
    known = labels.where(may_learn()).where("quality in (0, 1)")
    share = min(1.0, rows / max(1, known.count()))
    sample = known.where(hash_unit("doc_id", seed=6) < share).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropDuplicates(["doc_id"])
    # the sample is bounded by ``rows``, so its ids may be broadcast
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [statistics(t or "")[1] for t in batch.column("text").to_pylist()]
            yield record_batch([("doc_id", pa.int64()), ("bad", pa.int32()), ("x", pa.list_(pa.float64()))], doc_id=batch.column("doc_id"), bad=[1 - int(q) for q in batch.column("quality").to_pylist()], x=each)

    table = marked.mapInArrow(features, "doc_id long, bad int, x array<double>").toArrow().sort_by("doc_id")
    y = np.array(table.column("bad").to_pylist(), dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array(table.column("x").to_pylist()), y, INCREASING)


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("p_low", pa.float64())]


def judge(docs: DataFrame, trees: FlatTrees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and p_low for each row.

    Null text has no words and fails the base rules. Without trees the base rules decide alone. Ids
    may be null or repeated; an empty table gives an empty one; other columns are not looked at.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            each = [statistics(t or "") for t in batch.column("text").to_pylist()]
            counts, x = np.array([c for c, _ in each], dtype=np.int64), np.array([f for _, f in each])
            failed = base_failed(counts)
            low = shared.value.probability(x) if shared.value is not None else np.zeros(len(x))
            columns = {name: counts[:, i] for i, (name, _) in enumerate(_OUT[1:6])}
            yield record_batch(_OUT, doc_id=batch.column("doc_id"), base_failed=failed, kept=~failed & (low < threshold), p_low=low, **columns)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_low double")


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judge(docs, train(docs, labels, **options))
