"""A Bloom filter of ids: which rows need a look at all, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.words import mix

HASHES = 4
BITS_PER_ID = 16
#: Bits at least and at most. Beyond, more rows pass than need be; the exact step behind decides all the same.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
ONE, TWO = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6E8FEB86659FD93)


def places(one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
    """The bit numbers of every id, from two hashes of it."""
    one, two = one.astype(np.int64).view(np.uint64), two.astype(np.int64).view(np.uint64) | np.uint64(1)
    return np.stack([(one + np.uint64(i) * two) >> np.uint64(64 - bits.bit_length() + 1) for i in range(HASHES)])


def hashes(column: str) -> list[Column]:
    return [F.xxhash64(column, F.lit(salt)) for salt in ("one", "two")]


def numbers_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a batch's first column of whole numbers, taken within the task; a null counts as 0."""
    ids = pc.fill_null(batch.column(0), 0).to_numpy().view(np.uint64)
    return mix(ids ^ ONE), mix(ids ^ TWO)


def filled(ids: DataFrame, number: int, hashed: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[Broadcast, int]:
    """The filter of ``number`` rows, sent to all tasks, and its size, which follows their number up to ``MOST_BITS``."""
    bits = LEAST_BITS
    while bits < min(BITS_PER_ID * number, MOST_BITS):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = places(*hashed(batch), bits).ravel()
            np.bitwise_or.at(field, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(field)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(field[used].view(np.int64))], ["word", "bits"])

    words = ids.mapInArrow(fill, "word long, bits long")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    field = np.zeros(bits // 64, np.uint64)
    field[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(field), bits


def found_in(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    hit = field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
    return hit.all(axis=0)


def maybe_in(ids: DataFrame, column: str) -> Column:
    """A boolean column: false for rows whose ``column`` is surely not in the one column of ``ids``.

    A null is looked up like any value.
    """
    hashed = ids.select(*[h.alias(f"h{i}") for i, h in enumerate(hashes(ids.columns[0]))])
    sent, bits = filled(hashed, ids.count(), lambda batch: (batch.column(0).to_numpy(), batch.column(1).to_numpy()))

    @F.pandas_udf("boolean")
    def member(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(found_in(sent.value, places(one.to_numpy(), two.to_numpy(), bits)))

    return member(*hashes(column))


def lookup(ids: DataFrame) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """For use within tasks: a batch without the rows whose first column is surely not in the one column of ``ids``.

    For whole numbers. A task that runs Python anyway needs no second Python process for a column of ``maybe_in``.
    """
    sent, bits = filled(ids, ids.count(), numbers_hashes)

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(found_in(sent.value, places(*numbers_hashes(batch), bits))))

    return some
