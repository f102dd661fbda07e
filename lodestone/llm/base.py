"""What the operators of this package share: hashing, batches of text, and tables between stages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.stage import bound_batches, discard, join_counted, session_folder
from lodestone.plans.stage import staged as materialize

__all__ = ["bound_batches", "discard", "join_counted", "materialize", "session_folder"]

#: Rows whose crc32(doc_id as text) leaves this remainder by 3 are held out of all training.
HELD_OUT_REMAINDER = 1


def remainder3(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True for held-out rows; a null id is never held out (nor learned from)."""
    return F.coalesce(remainder3(doc_id) == HELD_OUT_REMAINDER, F.lit(False))


def may_learn(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder3(doc_id) != HELD_OUT_REMAINDER, F.lit(False))


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from 52 bits of md5 over the seed and the columns; SQL engines agree on it."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def record_batch(schema: pa.Schema | list[tuple[str, pa.DataType]], **columns) -> pa.RecordBatch:
    fields = pa.schema(schema) if isinstance(schema, list) else schema
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in fields], schema=fields)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def spans_of_chars(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, a longer text alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def segment_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of ``values`` (first axis); an empty segment gives 0."""
    out = np.zeros((len(lengths), *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out
