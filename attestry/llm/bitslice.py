"""Exact top-k by inner product from a bit-sliced index.

A block of rows stores each dimension's quantised value as bit slices: slice
b is a bitmap of the rows whose value has bit b. A query's weights are integers too, so
the coarse scores of all rows of a block are sums of slices shifted by the weights' bits,
added with bitmap arithmetic. The rows to look at are selected from the most significant slice of
the sum downward. The quantisation error of a query is bounded, so every row that can
belong to the answer lies within that bound of the k-th coarse score; those boundary
rows are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.storage import stored

#: Rows of an index block, and queries of a query block; both bound one task's memory.
BLOCK_ROWS = 16_384
QUERY_ROWS = 256
#: Pairs of an index and a query block in a cell of their grid.
CELL_PAIRS = 1024
#: Slices per dimension, and bits of a query's weight; what is left out is made up for by the exact scoring.
VALUE_BITS = 7
WEIGHT_BITS = 12


class Slices:
    """A column of non-negative numbers as bitmaps, least significant first."""

    def __init__(self, rows: int):
        self.words = (rows + 63) // 64
        self.columns: list[list[np.ndarray]] = []

    def add(self, weight: int, bitmap: np.ndarray) -> None:
        while len(self.columns) <= weight:
            self.columns.append([])
        self.columns[weight].append(bitmap)

    def total(self) -> list[np.ndarray]:
        """One bitmap per binary place: three bitmaps of a place become a sum and a carry."""
        out, place = [], 0
        while place < len(self.columns):
            pile = self.columns[place]
            while len(pile) > 1:
                a, b = pile.pop(), pile.pop()
                half = a ^ b
                if pile:
                    c = pile.pop()
                    pile.insert(0, half ^ c)
                    carry = (a & b) | (half & c)
                else:
                    pile.append(half)
                    carry = a & b
                self.add(place + 1, carry)
            out.append(pile[0] if pile else np.zeros(self.words, np.uint64))
            place += 1
        return out


def at_least(total: list[np.ndarray], value: int, rows: np.ndarray) -> np.ndarray:
    """Bitmap of the rows whose number is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(total):
        return np.zeros_like(rows)
    more, equal = np.zeros_like(rows), rows
    for place in range(len(total) - 1, -1, -1):
        if value >> place & 1:
            equal = equal & total[place]
        else:
            more = more | (equal & total[place])
            equal = equal & ~total[place]
    return more | equal


def kth_value(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest number among ``rows``, found from the most significant slice downward."""
    value, tied, need = 0, rows, k
    for place in range(len(total) - 1, -1, -1):
        high = tied & total[place]
        count = int(np.bitwise_count(high).sum())
        if count >= need:
            value |= 1 << place
            tied = high
        else:
            need -= count
            tied = tied & ~total[place]
    return value


def pack(bits: np.ndarray) -> np.ndarray:
    """A boolean row per bitmap, as 64-bit words."""
    padded = np.zeros((len(bits), (bits.shape[1] + 63) // 64 * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Index:
    """Bit slices of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low = vectors.min(axis=0)
        reach = int((vectors - self.low).max()) if vectors.size else 0
        self.dropped = max(0, reach.bit_length() - VALUE_BITS)
        coarse = (vectors - self.low) >> self.dropped
        self.bits = int(coarse.max()).bit_length() if coarse.size else 0
        self.slices = [pack((coarse.T >> b & 1).astype(bool)) for b in range(self.bits)]
        self.all = pack(np.ones((1, len(ids)), dtype=bool))[0]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but the query's own, ties to the smaller id."""
        allowed = self.all & ~pack((self.ids == own)[None, :])[0]
        count = int(np.bitwise_count(allowed).sum())
        if count > k and self.bits:
            total, slack = self.coarse(query)
            floor = kth_value(total, allowed, k) - slack
            allowed = allowed & at_least(total, floor, allowed)
        rows = np.flatnonzero(np.unpackbits(allowed.view(np.uint8), bitorder="little"))
        score = self.vectors[rows] @ query
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]

    def coarse(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the sums, and by how much two coarse sums may differ from their exact order.

        Weights are rounded to multiples of a power of two, and negative ones are applied to the complement,
        so that only additions are left.
        """
        size = int(np.abs(query).max()) if len(query) else 0
        step = max(0, size.bit_length() - WEIGHT_BITS)
        sums = Slices(len(self.ids))
        top = (1 << self.bits) - 1
        weights = np.abs(query) + (1 << step >> 1) >> step
        for dimension in np.flatnonzero(weights):
            weight, flip = int(weights[dimension]), query[dimension] < 0
            for bit in range(weight.bit_length()):
                if weight >> bit & 1:
                    for b in range(self.bits):
                        bitmap = self.slices[b][dimension]
                        sums.add(bit + b, ~bitmap if flip else bitmap)
        # exact = sum(q * v), coarse = sum(w * c), v = low + (c << dropped) + rest, q = (w << step) + error.
        error = np.abs(np.abs(query) - (weights << step))
        spread = (weights << step) * ((1 << self.dropped) - 1) + error * (((top + 1) << self.dropped) - 1)
        unit = 1 << (step + self.dropped)
        return sums.total(), int(-(-int(spread.sum()) // unit)) + 1


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def grid(blocks: int, chunks: int) -> tuple[int, int]:
    """Rows and columns of the grid on which index and query blocks meet.

    A cell holds about ``CELL_PAIRS`` pairs of blocks, fewer while there are few cells. The sides are copied alike:
    index blocks times columns is about query blocks times rows, by their size.
    """
    pairs = blocks * chunks
    cells = max(1, pairs // CELL_PAIRS, min(pairs // 16, 1000))
    down = min(blocks, max(1, round((cells * blocks * BLOCK_ROWS / (chunks * QUERY_ROWS)) ** 0.5)))
    return down, min(chunks, -(-cells // down))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product per query.

    Components become floor(``scale`` * x). Rows of the query's own id are no candidates. Vectors that are null, or
    hold null or non-finite components, take no part, on either side; nor do rows without an id.
    Vectors of another length than the query's are no candidates of it. Equal scores are
    ranked by id. Repeated rows are candidates, and queries, each on their own. Other columns are not read.
    """

    def clean(df: DataFrame) -> DataFrame:
        vector = F.col(vector_column)
        return df.where(usable(vector) & F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"), quantised(vector, scale).alias("vector")
        )

    rows, asked = clean(vectors), clean(queries)
    blocks = 1 + rows.count() // BLOCK_ROWS
    chunks = 1 + asked.count() // QUERY_ROWS
    # Rows are dealt by their place in the scan, so no id or vector, however common, fills a block.
    place = F.monotonically_increasing_id()

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        block = F.pmod(F.xxhash64(place), F.lit(parts)).cast("int").alias("block")
        return df.withColumn("dim", F.size("vector")).select(block, "dim", "id", "vector")

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        order = part.sort_values("id", kind="stable")
        flat = np.stack(order["vector"].to_list()).astype("<i8")
        return pd.DataFrame(
            {
                "block": part["block"].iloc[:1].to_numpy(),
                "dim": part["dim"].iloc[:1].to_numpy(),
                "ids": [order["id"].to_numpy().astype("<i8").tobytes()],
                "vectors": [flat.tobytes()],
            }
        )

    packed = "block int, dim int, ids binary, vectors binary"
    index = stored(dealt(rows, blocks).groupBy("block", "dim").applyInPandas(gather, packed), "slice-index")
    sent = stored(dealt(asked, chunks).groupBy("block", "dim").applyInPandas(gather, packed), "slice-queries")
    # All index blocks meet all query blocks, on a grid: an index block goes to each column, a query block to each row.
    down, across = grid(blocks, chunks)

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = index.select("*", (F.col("block") % down).alias("_row"), each(across).alias("_column"))
    right = sent.select(
        "dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
        (F.col("block") % across).alias("_column"), each(down).alias("_row"),
    )
    answer = pa.schema([("query_id", pa.int64()), ("dim", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None)
        for batch in batches:
            for line in range(batch.num_rows):
                block, dim, ids, flat, query_ids, query_flat, query_block = (c[line].as_py() for c in batch.columns)
                if held[0] != (block, dim):
                    held = ((block, dim), Index(np.frombuffer(ids, "<i8"), np.frombuffer(flat, "<i8").reshape(len(ids) // 8, dim)))
                asked_ids = np.frombuffer(query_ids, "<i8")
                found = [
                    (own, (query_block << 32) + i, *held[1].top(query, own, k))
                    for i, (own, query) in enumerate(zip(asked_ids.tolist(), np.frombuffer(query_flat, "<i8").reshape(len(asked_ids), dim), strict=True))
                ]
                lengths = [len(f[2]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([f[0] for f in found], lengths).astype(np.int64)),
                        pa.array(np.full(sum(lengths), dim, np.int64)),
                        pa.array(np.repeat([f[1] for f in found], lengths).astype(np.int64)),
                        pa.array(np.concatenate([f[2] for f in found])),
                        pa.array(np.concatenate([f[3] for f in found])),
                    ],
                    schema=answer,
                )

    pairs = left.join(right, ["dim", "_row", "_column"]).select(
        "block", "dim", "ids", "vectors", "query_ids", "query_vectors", "query_block"
    )
    best = pairs.mapInArrow(search, "query_id long, dim long, query_row long, vec_id long, score long")
    # A query row is told by its block and its place there: equal rows, and rows of one id, are ranked each on their own.
    order = Window.partitionBy("query_id", "dim", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
