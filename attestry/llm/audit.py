"""What each quality filter removes, alone and behind the others.

Documents become a sparse document-term matrix. Every task counts the words of a block of texts against
the block's own word list; the lists together give a global dictionary of numbered words, and the blocks,
renumbered, are the matrix in CSR shards. Row sums (words) and nonzero counts (distinct words) decide filters A and B;
C and D look at single characters, E at equal texts of smaller ids. The failed filters of a document are five
bits, and all orders of the filters are worked out from counts of equal bits.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.storage import stored
from attestry.llm.words import NOT_SPACE, Words, counted, gathered, pieces, text_bytes

#: Filters by letter; a document that fails one has the bit of its place.
FILTERS = "ABCDE"
ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 3 << 20
#: Words of all blocks in a part of the dictionary, about.
PART = 200_000
SPECIAL = np.isin(np.arange(256), list(b"#$%&*|"))

ROWS = "doc_ids array<long>, sources array<string>, upper array<long>, points array<long>, special array<boolean>, digests array<binary>"
BLOCK = f"block long, {ROWS}, starts array<int>, columns array<int>, counts array<int>, words array<string>"
SHARD = f"block long, {ROWS}, starts array<int>, columns array<long>, counts array<int>"
DOCUMENT = "doc_id long, source string, words long, distinct_words long, upper long, points long, special boolean, digest binary"


def _one(values: np.ndarray | pa.Array) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def counted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, source, text`` to blocks of counted words, a row each."""
    number = TaskContext.get().partitionId() << 32
    for batch in gathered(batches, "text", BLOCK_BYTES):
        data, offsets = text_bytes(batch.column("text"), lower=False)
        for first, last in pieces(offsets, BLOCK_BYTES):
            bounds = offsets[first : last + 1]
            part, rows = data[bounds[0] : bounds[-1]], bounds - bounds[0]
            words = Words(data, bounds, NOT_SPACE)
            encoded = words.encoded()
            known = encoded.dictionary
            order = np.argsort(word_hashes(known))
            place = np.empty(len(known), dtype=np.int64)
            place[order] = np.arange(len(known))
            width = max(len(known), 1)
            cells, counts = np.unique(words.rows * width + place[encoded.indices.to_numpy()], return_counts=True)
            raw = part.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in itertools.pairwise(rows.tolist())]
            columns = {
                "block": pa.array([number]),
                "doc_ids": _one(batch.column("doc_id").slice(first, last - first)),
                "sources": _one(batch.column("source").slice(first, last - first)),
                "upper": _one(counted((part >= 65) & (part <= 90), rows)),
                "points": _one(counted((part & 0xC0) != 0x80, rows)),
                "special": _one(counted(SPECIAL[part], rows) > 0),
                "digests": _one(pa.array(digests, pa.binary())),
                "starts": _one(np.searchsorted(cells, np.arange(last - first + 1) * width).astype(np.int32)),
                "columns": _one((cells % width).astype(np.int32)),
                "counts": _one(counts.astype(np.int32)),
                "words": _one(known.take(pa.array(order))),
            }
            yield pa.RecordBatch.from_pydict(columns)
            number += 1


def _rows(batch: pa.RecordBatch, at: int, name: str) -> pa.Array:
    return batch.column(name)[at].values


def word_hashes(words: pa.Array) -> np.ndarray:
    """Unsigned 64-bit hashes of words without blanks."""
    data, offsets = text_bytes(words, lower=False)
    return Words(data, offsets, NOT_SPACE).hashes()


def dealt_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``block, words`` to ``block, part, first, words``: a block's words by ranges of their hash, in which they are ordered."""
    for batch in batches:
        for block, words in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            part = ((word_hashes(words.values) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array(np.full(len(first), block)),
                    "part": pa.array(part[first]),
                    "first": pa.array(first.astype(np.int32)),
                    "words": pa.ListArray.from_arrays(pa.array(np.append(first, len(part)).astype(np.int32)), words.values),
                }
            )


def numbered_words(part: pa.Table) -> pa.Table:
    """One part of the dictionary: the lists of all blocks with the numbers of their words."""
    lists = part.column("words").combine_chunks()
    codes = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    base = part.column("part")[0].as_py() << 32
    bounds = pa.array(np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))).astype(np.int32))
    return pa.table(
        {"block": part.column("block"), "first": part.column("first"), "numbers": pa.ListArray.from_arrays(bounds, pa.array(base + codes))}
    )


def part_dictionary(part: pa.Table) -> pa.Table:
    """One part of the dictionary: its words with their numbers."""
    words = part.column("words").combine_chunks().flatten().dictionary_encode().dictionary
    base = part.column("part")[0].as_py() << 32
    return pa.table({"word": words, "number": pa.array(base + np.arange(len(words)))})


def renumbered(block: pa.Table, numbers: pa.Table) -> pa.Table:
    """A block and the numbers of its words to a shard: columns ascend within a row."""
    block = block.combine_chunks().to_batches()[0]
    shard = {name: block.column(name) for name in (f.split()[0] for f in SHARD.split(", "))}
    numbers = numbers.sort_by("first")
    starts = _rows(block, 0, "starts").to_numpy()
    ids = numbers.column("numbers").combine_chunks().flatten().to_numpy()
    columns, counts = ids[_rows(block, 0, "columns").to_numpy()], _rows(block, 0, "counts").to_numpy()
    order = np.lexsort((columns, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
    return pa.table(shard | {"columns": _one(columns[order]), "counts": _one(counts[order])})


def matrix_rows(shard: pa.Table) -> pa.Table:
    """A shard to a row per document with its sum and its number of nonzero entries."""
    shard = shard.combine_chunks().to_batches()[0]
    starts = _rows(shard, 0, "starts").to_numpy().astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(_rows(shard, 0, "counts").to_numpy(), dtype=np.int64)])
    return pa.table(
        {
            "doc_id": _rows(shard, 0, "doc_ids"),
            "source": _rows(shard, 0, "sources"),
            "words": pa.array(np.diff(sums[starts])),
            "distinct_words": pa.array(np.diff(starts)),
            **{n: _rows(shard, 0, n) for n in ("upper", "points", "special")},
            "digest": _rows(shard, 0, "digests"),
        }
    )


def _blocks_and_words(documents: DataFrame, id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, DataFrame]:
    """The stored blocks, and their words dealt to the parts of the dictionary."""
    read = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text")
    )
    blocks = stored(read.mapInArrow(counted_blocks, BLOCK), "counted-blocks", group_rows=1)
    parts = 1 + (blocks.agg(F.sum(F.size("words"))).first()[0] or 0) // PART
    return blocks, blocks.select("block", "words").mapInArrow(
        lambda batches: dealt_words(batches, parts), "block long, part long, first int, words array<string>"
    )


def _of_shards(blocks: DataFrame, listed: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``function`` gives for every shard, in the task that makes it: shards do not pass from process to process."""
    numbers = listed.groupBy("part").applyInArrow(numbered_words, "block long, first int, numbers array<long>")
    return blocks.drop("words").groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(
        lambda block, ids: function(renumbered(block, ids)), schema
    )


def term_matrix(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix: its CSR shards and its dictionary ``word, number``.

    A shard is a row: arrays of its documents' ids, sources and character counts, and ``starts, columns, counts``
    of its part of the matrix; a column is a word's number. A null text is empty: a row without entries. A block holds about
    3 MB of text, or one longer text. The dictionary has a part for each ``PART`` words of all blocks, so
    a task numbers about so many, and a word counts once per block, however frequent it is. An empty table gives no
    shards and no words.
    """
    blocks, listed = _blocks_and_words(documents, id_column, text_column, source_column)
    shards = _of_shards(blocks, listed, lambda shard: shard, SHARD)
    return shards, listed.groupBy("part").applyInArrow(part_dictionary, "word string, number long")


def failed_filters(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> DataFrame:
    """``doc_id, source, flags`` per row of ``documents``; bit i of flags is set where filter i of ``FILTERS`` fails.

    A null or empty text has no words: it fails A alone, and E where a smaller id has no text either. Rows without an id
    are neither larger nor smaller than others, so they never fail E and fail no other; rows of one id and text do not
    fail E for each other. Very long texts are counted whole. Columns other than the three named are not read.
    """
    blocks, listed = _blocks_and_words(documents, id_column, text_column, source_column)
    rows = stored(_of_shards(blocks, listed, matrix_rows, DOCUMENT), "matrix-rows")
    # Copies share a digest; a table of digests that several rows have is joined, and skewed ones may be split.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(firsts.drop("_n"), "digest", "left")
    failed = [
        F.col("words") < MIN_WORDS,
        100 * F.col("distinct_words") < MIN_DISTINCT * F.col("words"),
        100 * F.col("upper") > MAX_UPPER * F.col("points"),
        F.col("special"),
        F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)),
    ]
    flags = F.lit(0)
    for place, fails in enumerate(failed):
        flags = flags + F.when(fails, 1 << place).otherwise(0)
    return rows.select("doc_id", "source", flags.cast("int").alias("flags"))


def filter_orders(flagged: DataFrame) -> DataFrame:
    """Every order of the filters, step by step, for each part of ``part, flags, good, toxic``.

    See ``filter_audit`` for the columns. Rows are first counted by equal values, so at most 128 rows of a part go on.
    """
    counts = flagged.groupBy("part", "flags", "good", "toxic").agg(F.count("*").alias("n"))
    steps = counts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    )

    def bits(letters: Column) -> Column:
        found = F.lit(0)
        for place, letter in enumerate(FILTERS):
            found = found + F.when(F.contains(letters, F.lit(letter)), 1 << place).otherwise(0)
        return found

    flags = F.col("flags")
    own = bits(F.substr(F.col("filter_order"), F.col("step"), F.lit(1)))
    before = flags.bitwiseAND(bits(F.substr(F.col("filter_order"), F.lit(1), F.col("step") - 1))) != 0
    fails = flags.bitwiseAND(own) != 0
    removed = fails & ~before

    def total(where: Column, value: str = "n") -> Column:
        return F.coalesce(F.sum(F.when(where, F.expr(value))), F.lit(0)).cast("long")

    # Of the orders, a document that fails k filters is removed by each of them in one of k.
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before).alias("kept"),
        total(removed).alias("removed"),
        total(fails & before).alias("redundant"),
        total(flags == own).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        total(fails, f"n * {len(ORDERS)} div bit_count(flags)").alias("shapley"),
    )


def filter_audit(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """A row per source, order of the five filters and step (from 1), with counts of documents.

    ``kept`` pass this and all earlier filters, ``removed`` fail this one first, ``redundant`` fail it and an earlier one,
    ``unique_fails`` fail it alone, ``good_lost`` and ``toxic_lost`` are the removed with a label of that kind, ``shapley``
    is what this filter removes, summed over all orders. ``part`` is the source; null counts as empty text. Several
    labels of one id: any that is 1 counts; labels without an id count for nothing. Repeated rows are separate documents. An
    empty table gives no rows; a table without labels loses none.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    flagged = failed_filters(documents, id_column, text_column, source_column).join(known.where("good or toxic"), "doc_id", "left")
    return filter_orders(
        flagged.select(
            F.coalesce("source", F.lit("")).alias("part"),
            "flags",
            F.coalesce("good", F.lit(False)).alias("good"),
            F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )
