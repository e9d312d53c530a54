"""Benchmark passages in documents: Wu-Manber multi-pattern search over words.

Every run of ``window`` item words is a pattern (an item with fewer words is
one pattern). Patterns of one length share a shift table: a block is two
neighbouring words, and its entry says how far the search may jump because no
pattern holds that block nearer to its end. Where the jump is zero, the block
ends some pattern: the bucket of its suffix and prefix hashes names the
patterns to test, their word hashes are compared, and last the words themselves.

All texts of an Arrow batch advance together, in short lanes, so the search is
a few array operations per jump, and whole texts are read. Items go to the tasks in parts
of bounded size; each part is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.storage import stored
from attestry.llm.words import ALNUM, Words, mix, pieces, text_bytes

#: Bytes of item text searched for in one pass; bounds what is sent to a task.
PART_BYTES = 2_000_000
LANE = 256
FOUND = "doc_id long, n_words long, hits array<struct<first: long, last: long>>, items array<long>"
BLOCK = np.uint64(0xD6E8FEB86659FD93)


def block_hash(words: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` (1 or 2) words that end at ``last``."""
    return mix(words[last - 1] * BLOCK + words[last]) if width == 2 else mix(words[last])


class Patterns:
    """Search tables of all patterns of one length."""

    def __init__(self, length: int, texts: list[bytes], items: list[list[int | None]], hashes: np.ndarray):
        self.length, self.texts, self.items = length, texts, items
        self.width = min(2, length)
        stream = hashes.reshape(-1)
        starts = np.arange(len(texts)) * length
        self.bits = max(16, int(4 * len(stream)).bit_length())
        self.shift = np.full(1 << self.bits, length - self.width + 1, dtype=np.uint8 if length < 250 else np.int64)
        for end in range(self.width - 1, length):
            np.minimum.at(self.shift, self.slot(block_hash(stream, starts + end, self.width)), length - 1 - end)
        key = self.bucket(stream, starts + length - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.order, self.hashes = key[order], order, hashes

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - self.bits)).astype(np.int64)

    def bucket(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Suffix and prefix hash in one key."""
        prefix = block_hash(words, last - self.length + self.width, self.width)
        return mix(prefix * BLOCK + block_hash(words, last, self.width))

    def search(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of every place where all word hashes agree."""
        first = offsets[:-1] + self.length - 1
        lanes = np.maximum(0, -((first - offsets[1:]) // LANE))
        row = np.repeat(np.arange(len(first)), lanes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[row] + number * LANE
        stop = np.minimum(at + LANE, offsets[1:][row])
        ends = []
        while len(at):
            jump = self.shift[self.slot(block_hash(words, at, self.width))].astype(np.int64)
            ends.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        last = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        key = self.bucket(words, last)
        low, high = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        count = high - low
        last = np.repeat(last, count)
        within = np.arange(len(last)) - np.repeat(np.cumsum(count) - count, count)
        pattern = self.order[np.repeat(low, count) + within]
        same = np.ones(len(last), dtype=bool)
        for back in range(self.length):
            same &= words[last - back] == self.hashes[pattern, self.length - 1 - back]
        return last[same], pattern[same]


def compile_patterns(items: Iterable[tuple[int | None, str | None]], window: int) -> list[Patterns]:
    """Search tables by pattern length. Equal patterns of several items are one pattern."""
    found: dict[int, dict[bytes, tuple[set, np.ndarray]]] = {}
    for item, text in items:
        data, offsets = text_bytes(pa.array([text], pa.string()))
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes()
        own = [words.word(i) for i in range(len(hashes))]
        length = min(window, len(own))
        for first in range(len(own) - length + 1 if length else 0):
            key = b" ".join(own[first : first + length])
            found.setdefault(length, {}).setdefault(key, (set(), hashes[first : first + length]))[0].add(item)
    return [
        Patterns(length, list(rows), [list(v[0]) for v in rows.values()], np.stack([v[1] for v in rows.values()]))
        for length, rows in found.items()
    ]


def scan_texts(column: pa.Array, tables: list[Patterns]) -> Iterator[tuple[int, int, np.ndarray, list]]:
    """Per text: position, words, hit ranges (first, last word), items."""
    data, offsets = text_bytes(column)
    for low, high in pieces(offsets):
        words = Words(data, offsets[low : high + 1], ALNUM)
        hashes = words.hashes()
        cover = np.zeros(len(hashes) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for table in tables:
            for last, pattern in zip(*map(np.ndarray.tolist, table.search(hashes, words.offsets)), strict=True):
                first = last - table.length + 1
                if b" ".join(words.word(i) for i in range(first, last + 1)) != table.texts[pattern]:
                    continue
                cover[first] += 1
                cover[last + 1] -= 1
                items.setdefault(int(words.rows[last]), set()).update(table.items[pattern])
        hit = np.cumsum(cover[:-1]) > 0
        for row in range(high - low):
            begin, end = int(words.offsets[row]), int(words.offsets[row + 1])
            ranges = np.zeros((0, 2), dtype=np.int64)
            if row in items:
                edge = np.diff(np.concatenate(([0], hit[begin:end].astype(np.int8), [0])))
                ranges = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1)
            yield low + row, end - begin, ranges, sorted(items.get(row, ()), key=lambda x: (x is not None, x))


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """Per document: its words, the word ranges inside benchmark windows, and the items found.

    With ``carry`` the whole document row follows as ``row``.

    A null or empty text has no words and no hits; an item without words is
    never found; an item id found through several rows or windows is listed
    once; a null item id counts as an item. Other columns are not read.
    An empty benchmark gives no hits. Each document row gives one row.
    """
    spark = documents.sparkSession
    bench = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("words"))
    total = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = 1 + total // PART_BYTES
    sends_rows = carry and parts == 1
    # With the whole row, the text is read from there, so that it is sent once.
    docs = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.struct("*").alias("row") if carry else F.col(text_column).alias("text")
    )
    schema = T.StructType.fromDDL(FOUND)
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])
    passes = []
    for part in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()
        sent = spark.sparkContext.broadcast(compile_patterns(((r[0], r[1]) for r in rows), window))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                count, ranges, items = [], [], []
                texts = pc.struct_field(batch.column(1), text_column) if batch.schema.names[1] == "row" else batch.column(1)
                for _, n, hits, found_items in scan_texts(texts, sent.value):
                    count.append(n)
                    ranges.append([{"first": a, "last": b} for a, b in hits.tolist()])
                    items.append(found_items)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(count, pa.int64()),
                        pa.array(ranges, pa.list_(span)),
                        pa.array(items, pa.list_(pa.int64())),
                        *batch.columns[1:] * sends_rows,
                    ],
                    ["doc_id", "n_words", "hits", "items", *["row"] * sends_rows],
                )

        passes.append(scan)
    if parts == 1:
        return docs.mapInArrow(passes[0], T.StructType([*schema.fields, *docs.schema.fields[1 : 1 + carry]]))
    # Several passes: rows are numbered and written once, so that every pass sees the same numbers.
    placed = stored(docs.withColumn("_place", F.monotonically_increasing_id()), "benchmark-scan")
    merged = None
    for scan in passes:
        one = placed.select("_place", F.col(f"row.{text_column}").alias("text") if carry else "text").mapInArrow(scan, schema).withColumnRenamed("doc_id", "_place")
        merged = one if merged is None else merged.unionByName(one)
    merged = merged.groupBy("_place").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hits")).alias("_hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    return merged.join(placed.select("_place", "doc_id", *["row"] * carry), "_place").select(
        "doc_id", "n_words", _union("_hits").alias("hits"), "items", *["row"] * carry
    )


def _union(name: str) -> F.Column:
    """Overlapping or touching ranges as one."""
    kind = "array<struct<first: long, last: long>>"

    def add(done: F.Column, span: F.Column) -> F.Column:
        tail = F.try_element_at(done, F.lit(-1))
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], span["last"]).alias("last"))
        return F.when(
            tail["last"] >= span["first"] - 1,
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(name), F.array().cast(kind), add)


def hit_words() -> F.Column:
    """Words inside any hit range."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
