"""Documents packed into as few sequences of bounded length as can be found.

Only the histogram of piece lengths matters for which lengths go together, and it has at most as many rows as a
sequence has tokens. The configuration linear program over it (how many sequences of each configuration, a multiset of
lengths that fits) is solved by multiplicative weights: a length's weight falls as it gets covered, and the
configuration of greatest weight is found by dynamic programming over a knapsack. The fractional solution is
rounded to whole sequences at several scales; what that leaves is packed best fit, longest first, for all pieces of a
length at once, and the scale with fewest sequences is taken. Pieces then look up their place by their rank among
those of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.ordering import position
from attestry.llm.storage import stored
from attestry.llm.words import NOT_SPACE, Words, pieces, text_bytes

CAPACITY = 2048
#: Rounds of the linear program, each a knapsack over ``CELLS`` cells; without cells there are ``FINER`` times fewer.
ROUNDS, CELLS, FINER = 1500, 1024, 50
#: How fast weights fall, and the least part of a length's pieces that a round covers at most: rounds must do for all lengths.
STEP, SHARE = 2.0, 0.05
#: Parts of the fractional solution that are tried as whole sequences; 0 is best fit alone.
SCALES = (1.0, 0.9, 0.75, 0.5, 0.0)
#: Words that a worker remembers the ids of, words tokenized in one call, and the mark between them.
REMEMBERED, AT_ONCE, MARK = 1_500_000, 4096, "\x01"
#: Blocks that the pieces of one length are ranked in.
BLOCKS = 256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, at long"


class WordTokens:
    """Ids of single words, remembered. The tokenizer must treat words between blanks apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._single([MARK])[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _single(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[np.ndarray]:
        """Ids of many words from one text that holds a mark between them."""
        found = self._single([f" {MARK} ".join(words)])[0]
        if len(self.mark) == 1 and not any(MARK in word for word in words):
            ends = np.flatnonzero(found == self.mark[0])
            if len(ends) == len(words) - 1:
                bounds = zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(found)], strict=True)
                return [found[a:b] for a, b in bounds]
        return self._single(words)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``ids, begins, sizes``: the ids of word i are ``sizes[i]`` from ``begins[i]`` on."""
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh = [word for word in words if word not in self.known]
        if fresh:
            found = []
            for first in range(0, len(fresh), AT_ONCE):
                found += self._together(fresh[first : first + AT_ONCE])
            self.known.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh)), strict=True))
            self.sizes = np.append(self.sizes, [len(x) for x in found])
            self.ids = np.concatenate([self.ids, *found])
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        begins = np.cumsum(self.sizes) - self.sizes
        return self.ids, begins[at], self.sizes[at]


@cache
def word_tokens(path: str) -> WordTokens:
    """One memory of words for all tasks of a worker."""
    return WordTokens(path)


def document_ids(words: Words, tokens: WordTokens, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, an id 0 behind each row's, and row bounds."""
    encoded = words.encoded()
    flat, begins, sizes = tokens.of(encoded.dictionary.to_pylist())
    codes = encoded.indices.to_numpy()
    width = sizes[codes]
    before = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(width, out=before[1:])
    found = flat[np.arange(before[-1]) + np.repeat(begins[codes] - before[:-1], width)]
    bounds = before[words.offsets] + np.arange(rows + 1)
    out = np.zeros(bounds[-1], dtype=np.uint32)
    out[np.arange(before[-1]) + np.repeat(words.rows, width)] = found
    return out, bounds


def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to pieces of at most ``capacity`` ids."""
    tokens = word_tokens(path)
    at = TaskContext.get().partitionId() << 36
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"), lower=False)
        for first, last in pieces(offsets):
            ids, bounds = document_ids(Words(data, offsets[first : last + 1], NOT_SPACE), tokens, last - first)
            parts = -(-np.diff(bounds) // capacity)
            rows = np.repeat(np.arange(last - first), parts)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            begin = bounds[rows] + start
            length = np.minimum(capacity, bounds[rows + 1] - begin)
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = {
                "doc_id": batch.column("doc_id").slice(first, last - first).take(pa.array(rows)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "at": pa.array(np.arange(at, at + len(rows))),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, bounds[-1]).astype(np.int32)), pa.array(ids.view(np.int32)))
            at += len(rows)
            yield pa.RecordBatch.from_pydict(columns)


def token_pieces(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, at`` and if asked ``ids``: every text's ids and an id 0, cut into pieces.

    ``tokenizer`` is the path of its file, the same on every machine. A null text is empty and has the id 0 alone. ``at`` is
    a number of the piece; the table is written, so it stays. Only texts of more than ``capacity`` ids have several pieces.
    """
    read = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return stored(read.mapInArrow(lambda batches: cut_pieces(batches, tokenizer, capacity, with_ids), schema), "token-pieces")


def best_configuration(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Which lengths, and how often each, fit into ``capacity`` with greatest total weight; lengths ascend."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(int(lengths[0]), capacity + 1):
        fits = fitting[room]
        worth = best[room - lengths[:fits]] + weights[:fits]
        top = int(worth.argmax())
        if worth[top] > best[room - 1]:
            best[room], last[room] = worth[top], top
        else:
            best[room] = best[room - 1]
    chosen: dict[int, int] = {}
    room = capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        chosen[int(last[room])] = chosen.get(int(last[room]), 0) + 1
        room -= int(lengths[last[room]])
    return chosen, float(best[capacity])


def fractional_solution(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with amounts that together cover no length more than once, and a lower bound of sequences.

    A length's weight is its room times a factor that falls with each part of its pieces that is covered. Any weights bound the
    number of sequences from below: all pieces' weight by the weight that fits into one sequence; the best bound is returned.
    """
    share = min(1.0, max(SHARE, 2 * len(lengths) / rounds))
    covered = np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    bound = 0.0
    for _ in range(rounds):
        open_ = covered < counts
        if not open_.any():
            break
        weights = lengths / capacity * np.exp(-STEP * covered / counts) * open_
        chosen, worth = best_configuration(lengths, weights, capacity)
        bound = max(bound, float((weights * counts).sum() / worth))
        room = min((counts[i] - covered[i]) / n for i, n in chosen.items())
        amount = min(room, min(max(share * counts[i], 1.0) / n for i, n in chosen.items()))
        for i, n in chosen.items():
            covered[i] += n * amount
            if counts[i] - covered[i] < 1e-9 * counts[i]:
                covered[i] = counts[i]
        key = tuple(sorted(chosen.items()))
        amounts[key] = amounts.get(key, 0.0) + amount
    return [(dict(key), amount) for key, amount in amounts.items()], bound


def whole_sequences(
    solution: list[tuple[dict[int, int], float]], classes: np.ndarray, left: np.ndarray, scale: float
) -> list[tuple[dict[int, int], int]]:
    """The solution's amounts times ``scale`` as whole numbers; each class gives its longest lengths first.

    ``classes`` names the class of every length; ``left``, the pieces of every length, is reduced by those that are used.
    """
    members = {int(c): list(np.flatnonzero(classes == c)) for c in np.unique(classes)}
    found = []
    for chosen, amount in solution:
        todo = int(amount * scale + 0.5)
        while todo:
            taken = {}
            for c, each in chosen.items():
                able = [i for i in members[c] if left[i] >= each]
                if able:
                    taken[able[-1]] = each
            if len(taken) < len(chosen):
                break
            number = min(todo, *(int(left[i]) // each for i, each in taken.items()))
            for i, each in taken.items():
                left[i] -= each * number
            found.append((taken, number))
            todo -= number
    return found


def best_fit(lengths: np.ndarray, counts: np.ndarray, open_bins: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, into open and new sequences; sequences of equal content are one entry with their number."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(held: dict[int, int], number: int, left: int) -> None:
        if number:
            room.setdefault(left, []).append((held, number))

    for held, number in open_bins:
        put(held, number, capacity - sum(int(lengths[i]) * n for i, n in held.items()))
    for i in range(len(lengths) - 1, -1, -1):
        length, todo = int(lengths[i]), int(counts[i])
        for left in sorted(r for r in room if r >= length):
            fit = left // length
            while todo and room[left]:
                held, number = room[left].pop()
                full = min(number, todo // fit)
                put({**held, i: held.get(i, 0) + fit}, full, left - fit * length)
                todo, number = todo - full * fit, number - full
                if number and todo:
                    put({**held, i: held.get(i, 0) + todo}, 1, left - todo * length)
                    todo, number = 0, number - 1
                if number:
                    put(held, number, left)
            if not room[left]:
                del room[left]
            if not todo:
                break
        fit = capacity // length
        put({i: fit}, todo // fit, capacity - fit * length)
        if todo % fit:
            put({i: todo % fit}, 1, capacity - todo % fit * length)
    return [entry for entries in room.values() for entry in entries]


def plan_sequences(
    lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS
) -> tuple[list[tuple[dict[int, int], int]], float]:
    """``(pieces by length, number of such sequences)`` for all pieces, and a lower bound of the number of sequences.

    ``lengths`` ascend and are 1 to ``capacity``. The linear program is solved twice: by lengths for the bound and first
    configurations, and with lengths in classes, rounded up, for many more of them. Work and result are bounded by
    ``capacity`` and ``rounds``, whatever the counts.
    """
    if not len(lengths):
        return [], 0.0
    grid = -(-capacity // CELLS)
    steps = -(-lengths // grid)
    kinds, classes = np.unique(steps, return_inverse=True)
    sums = np.bincount(classes, weights=counts).astype(np.int64)
    coarse, _ = fractional_solution(kinds, sums, capacity // grid, rounds)
    fine, bound = fractional_solution(lengths, counts, capacity, rounds // FINER)
    bound = max(bound, float((lengths * counts).sum() / capacity))
    exact = np.arange(len(lengths))
    best, fewest = [], None
    for solution, of in ((coarse, classes), (fine, exact)):
        solution.sort(key=lambda entry: -entry[1])
        for scale in SCALES:
            left = counts.copy()
            whole = whole_sequences(solution, of, left, scale)
            found = best_fit(lengths, left, whole, capacity)
            total = sum(number for _, number in found)
            if fewest is None or total < fewest:
                best, fewest = found, total
        if fewest <= np.ceil(bound - 1e-9):
            break
    by_length = [({int(lengths[i]): n for i, n in held.items()}, number) for held, number in best]
    return by_length, bound


def slots(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """``length, first, each, sequence, offset``: pieces of a length from rank ``first`` on go ``each`` to a sequence."""
    rows, used, begun = [], {}, 0
    for held, number in plan:
        offset = 0
        for length, each in sorted(held.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, each, begun, offset))
            used[length] = first + each * number
            offset += each * length
        begun += number
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(token_rows: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``at, length``.

    Sequences are numbered from 0. Pieces lie in a sequence without gaps. The driver holds the histogram of lengths (at most
    ``capacity`` rows) and the plan (a few entries per length and round). No pieces give no rows.
    """
    spark = token_rows.sparkSession
    histogram = sorted((r[0], r[1]) for r in token_rows.groupBy("length").count().collect())
    lengths = np.array([h[0] for h in histogram], dtype=np.int64)
    plan, _ = plan_sequences(lengths, np.array([h[1] for h in histogram], dtype=np.int64), capacity, rounds)
    table = slots(plan)
    sent = spark.sparkContext.broadcast({name: table[name].to_numpy(dtype=np.int64) for name in table})

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slot = sent.value
        # Slots are in order of length and first rank, as one number.
        wide = np.int64(1) << 48
        at = np.searchsorted(slot["length"] * wide + slot["first"], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        step, inside = np.divmod(rank.to_numpy() - slot["first"][at], slot["each"][at])
        return pd.DataFrame({"sequence_id": slot["sequence"][at] + step, "offset": slot["offset"][at] + inside * slot["length"][at]})

    ranked = position(token_rows, ["length"], ["at"], F.pmod(F.xxhash64("at"), F.lit(BLOCKS)), "_rank")
    return ranked.withColumn("_placed", placed("length", "_rank")).select(*token_rows.columns, "_placed.*")


def pack_documents(
    documents: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    rounds: int = ROUNDS,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and if asked ``ids``, a row per piece.

    Repeated rows are separate documents, null ids stay null, other columns are not read. An empty table gives no rows.
    Texts of any length are tokenized whole.
    """
    found = token_pieces(documents, tokenizer, capacity, with_ids, id_column, text_column)
    return pack(found, capacity, rounds).drop("at")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence, from pieces with ``ids``; at most a sequence's room in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
