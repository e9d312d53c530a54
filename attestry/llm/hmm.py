"""A hidden Markov language model, trained and scored over the whole corpus.

Texts are encoded once into blocks: a block's distinct words and, per token, a word number. Baum-Welch
counts (starts, transitions, emissions) are taken block by block and summed across partitions. The first
rounds tie all words but the most frequent ones, so only a bounded table travels to the tasks. All rounds take all
texts to learn from. The last one counts emissions of every word, which stay distributed: a block sends the counts of its words
packed by ranges of their hashes, each range is summed by itself, and the sums go back to the blocks in the order in which they came.

Texts are cut into short segments that advance together. A segment's product of scaled transition and
emission matrices carries the recursion across it, so the forward and backward values, and
the likelihood, are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.storage import stored
from attestry.llm.words import NOT_SPACE, Words, gathered, mix, pieces, text_bytes

STATES = 4
#: Words with an emission of their own in the tied rounds; bounds what is sent to the tasks.
HEAD = 20_000
ROUNDS = 3
SEGMENT = 128
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Tokens whose forward and backward values are held at once.
HELD_TOKENS = 300_000
#: Part of a state's emissions left to the background.
BACKGROUND = 0.4
END_WORD = np.uint64(0x0123456789ABCDEF)
#: Words that a range of hashes holds, counted once per block.
RANGE_WORDS = 1 << 19
#: Numbers in place of a range's: of the row that carries starts, moves and sums, and of that which tells a block's ranges.
CHAIN, PLACES = -1, -2
PARTS = "block long, part int, words binary, c binary, cells binary"
REPLIES = "block long, part int, c binary, cells binary"
BLOCKS = "block long, ids binary, no_id binary, held binary, offsets binary, words binary, low binary, high binary"


def encode(documents: DataFrame, held: str) -> DataFrame:
    """Blocks of encoded texts: ids, token bounds, distinct word hashes by frequency, and token numbers."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2, BLOCK_BYTES):
            _, offsets = text_bytes(batch.column(2), lower=False)
            for low, high in pieces(offsets, BLOCK_BYTES):
                hashes, counts = [], []
                for a, b in pieces(offsets[low : high + 1], 1 << 20):
                    words = Words(*text_bytes(batch.column(2).slice(low + a, b - a)), NOT_SPACE)
                    # Every text ends with the end token.
                    bounds = words.offsets[1:]
                    hashes.append(np.insert(words.hashes(), bounds, END_WORD))
                    counts.append(np.diff(words.offsets) + 1)
                hashes, counts = np.concatenate(hashes), np.concatenate(counts)
                distinct, number, often = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                number = rank[number]
                ids = batch.column(0).slice(low, high - low)
                texts = [
                    ids.fill_null(0).to_numpy().astype("<i8"),
                    ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                    batch.column(1).slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.uint8),
                    np.concatenate(([0], np.cumsum(counts))).astype("<i8"),
                    distinct[order],
                    (number & 0xFFFF).astype("<u2"),
                    (number >> 16).astype("<u2"),
                ]
                key = int(mix(np.array([hashes.sum(dtype=np.uint64) ^ np.uint64(len(hashes))]))[0] >> np.uint64(1))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip((f.split()[0] for f in BLOCKS.split(", ")), [key, *(t.tobytes() for t in texts)], strict=True))],
                    pa.schema([("block", pa.int64()), *((f.split()[0], pa.binary()) for f in BLOCKS.split(", ")[1:])]),
                )

    rows = documents.select("doc_id", held, "text").mapInArrow(blocks, BLOCKS)
    # The place in the scan tells blocks of equal content apart.
    return rows.withColumn("block", F.monotonically_increasing_id())


@dataclass
class Block:
    """An encoded block, unpacked."""

    ids: np.ndarray
    no_id: np.ndarray
    held: np.ndarray
    offsets: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def read(rows: pa.RecordBatch | pa.Table, at: int) -> Block:
        """The block in one row; its bytes are read where Arrow holds them. Without a column of words it has none."""

        def of(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(rows.column(name)[at].as_buffer(), kind)

        tokens = of("high", "<u2").astype(np.int32)
        tokens <<= 16
        tokens |= of("low", "<u2")
        flags = (of(name, "u1").astype(bool) for name in ("no_id", "held"))
        words = of("words", "<u8") if "words" in rows.schema.names else np.zeros(0, np.uint64)
        return Block(of("ids", "<i8"), *flags, of("offsets", "<i8"), words, tokens)

    def texts(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Token numbers and bounds of the chosen texts, in runs of about ``HELD_TOKENS`` tokens."""
        at = np.flatnonzero(chosen)
        length = np.diff(self.offsets)[at]
        run = (np.cumsum(length) - length) // HELD_TOKENS
        for part in np.split(at, np.flatnonzero(np.diff(run)) + 1) if len(at) else ():
            tokens = np.concatenate([self.tokens[self.offsets[i] : self.offsets[i + 1]] for i in part])
            yield tokens, np.concatenate(([0], np.cumsum(np.diff(self.offsets)[part])))


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column("block")[at].as_py(), Block.read(batch, at)


class Segments:
    """Texts cut into segments of at most ``SEGMENT`` tokens, longest first."""

    def __init__(self, offsets: np.ndarray):
        length = np.diff(offsets)
        self.count = -(-length // SEGMENT)
        text = np.repeat(np.arange(len(length)), self.count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        start = offsets[:-1][text] + number * SEGMENT
        size = np.minimum(SEGMENT, offsets[1:][text] - start)
        order = np.argsort(-size, kind="stable")
        self.start, self.size = start[order], size[order]
        self.live = np.searchsorted(-self.size, -np.arange(SEGMENT), side="left")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.first = np.cumsum(self.count) - self.count
        self.rank = rank
        self.texts = np.argsort(-self.count, kind="stable")
        most = int(self.count.max()) if len(self.count) else 0
        self.going = np.searchsorted(-self.count[self.texts], -np.arange(most), side="left")

    def steps(self) -> Iterator[tuple[int, int]]:
        """Step and number of segments that still have a token there."""
        return ((t, int(n)) for t, n in enumerate(self.live) if n)

    def chain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts that have a k-th segment, and those segments, for k from 0."""
        for k, n in enumerate(self.going):
            text = self.texts[:n]
            yield text, self.rank[self.first[text] + k]

    def products(self, emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per segment, the scaled product of its matrices, and the log of the scale."""
        states = emission.shape[1]
        out = np.zeros((len(self.start), states, states), emission.dtype)
        out[:, np.arange(states), np.arange(states)] = emission[self.start]
        scale = np.zeros(len(self.start))
        for t, n in self.steps():
            if t:
                step = (out[:n].reshape(-1, states) @ transition).reshape(n, states, states)
                out[:n] = step * emission[self.start[:n] + t][:, None, :]
            if t % 4 == 3 or t == len(self.live) - 1:
                scale[:n] += rescale(out[:n])
        short = self.size % 4 != 0
        if short.any():
            part = out[short]
            scale[short] += rescale(part)
            out[short] = part
        return out, scale

    def forward(self, products: np.ndarray, scale: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood per text, and the state distribution before each segment's first token."""
        before = np.zeros((len(products), len(start)), products.dtype)
        state = np.zeros((len(self.count), len(start)), products.dtype)
        total = np.zeros(len(self.count))
        for k, (text, segment) in enumerate(self.chain()):
            before[segment] = start if k == 0 else state[text] @ transition
            after = np.einsum("ns,nst->nt", before[segment], products[segment])
            norm = after.sum(axis=1)
            state[text] = after / norm[:, None]
            total[text] += np.log(norm) + scale[segment]
        return total, before

    def backward(self, products: np.ndarray, transition: np.ndarray) -> np.ndarray:
        """Scaled backward values behind each segment's last token."""
        behind = np.zeros(products.shape[:2], products.dtype)
        value = np.ones((len(self.count), products.shape[1]), products.dtype)
        for text, segment in reversed(list(self.chain())):
            behind[segment] = value[text]
            earlier = np.einsum("nst,nt->ns", products[segment], value[text]) @ transition.T
            value[text] = earlier / earlier.sum(axis=1, keepdims=True)
        return behind


def rescale(values: np.ndarray) -> np.ndarray:
    """Divide each matrix by its largest entry, in place; logs of the divisors."""
    most = values.max(axis=(1, 2))
    values /= most[:, None, None]
    return np.log(most.astype(np.float64))


@dataclass
class Chain:
    """Start and transition probabilities."""

    start: np.ndarray
    transition: np.ndarray


def expected(emission: np.ndarray, offsets: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior state probabilities per token, and expected starts and transitions."""
    cut = Segments(offsets)
    start, transition = chain.start.astype(np.float32), chain.transition.astype(np.float32)
    products, scale = cut.products(emission, transition)
    _, before = cut.forward(products, scale, start, transition)
    behind = cut.backward(products, transition)
    alpha = np.zeros_like(emission)
    state = before
    for t, n in cut.steps():
        state = (before[:n] if t == 0 else state[:n] @ transition) * emission[cut.start[:n] + t]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[cut.start[:n] + t] = state
    gamma, moves = np.zeros_like(emission), np.zeros_like(chain.transition)
    beta = behind.copy()
    for t, n in reversed(list(cut.steps())):
        at = cut.start[:n] + t
        post = alpha[at] * beta[:n]
        gamma[at] = post / post.sum(axis=1, keepdims=True)
        ahead = emission[at] * beta[:n]
        if t:
            prior = alpha[at - 1]
            flow = (prior @ transition * ahead).sum(axis=1, keepdims=True)
            moves += prior.T @ (ahead / flow) * transition
        earlier = ahead @ transition.T
        beta[:n] = earlier / earlier.sum(axis=1, keepdims=True)
    # Moves into the first token of a later segment.
    first = np.ones(len(cut.start), dtype=bool)
    first[cut.rank[cut.first]] = False
    at = cut.start[first]
    if len(at):
        prior, ahead = alpha[at - 1], gamma[at] / np.maximum(alpha[at - 1] @ transition, 1e-30)
        moves += prior.T @ ahead * transition
    return gamma, gamma[offsets[:-1]].sum(axis=0), moves


def smoothed(counts: np.ndarray, sums: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Emission probabilities from expected counts, filled up from the background."""
    mass = sums * BACKGROUND / (1 - BACKGROUND) + 1
    return (counts + mass * background[:, None]) / (sums + mass)


@dataclass
class TiedModel:
    """Chain, and emissions of the head words; the last row stands for all others. Of the training: its tokens and distinct words."""

    head: np.ndarray
    background: np.ndarray
    chain: Chain
    emission: np.ndarray
    total: int
    distinct: int

    def cells(self, words: np.ndarray) -> np.ndarray:
        if not len(self.head):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
        return np.where(self.head[at] == words, at, len(self.head))

    def block_emission(self, block: Block) -> np.ndarray:
        """Per word of the block. A factor common to the states does not matter to the posteriors."""
        return (self.emission / self.background[:, None])[self.cells(block.words)].astype(np.float32)


def first_model(head: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> TiedModel:
    """States that keep to themselves and lean to different words, by the words' hashes."""
    background = np.append(counts, max(total - counts.sum(), 1)).astype(float)
    background /= background.sum()
    lean = np.stack([mix(head + np.uint64(s + 1)) for s in range(STATES)], axis=1) / 2.0**64
    lean = np.concatenate((np.exp(3 * (lean - 0.5)), np.ones((1, STATES))))
    emission = background[:, None] * lean
    stay = np.full((STATES, STATES), 0.04 / max(STATES - 1, 1))
    np.fill_diagonal(stay, 0.96)
    return TiedModel(head, background, Chain(np.full(STATES, 1 / STATES), stay), emission / emission.sum(axis=0), total, distinct)


def next_chain(starts: np.ndarray, moves: np.ndarray) -> Chain:
    starts, moves = starts + 0.1, moves + 0.1
    return Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True))


def tied_rounds(blocks: DataFrame) -> TiedModel:
    """Baum-Welch with tied rare words. Tables that reach the driver are bounded by ``HEAD``."""
    spark = blocks.sparkSession

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in block_rows(batches):
            learned = np.repeat(~block.held, np.diff(block.offsets))
            count = np.bincount(block.tokens[learned], minlength=len(block.words))
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(block.words[some].view(np.int64)), pa.array(count[some])], ["word", "n"])

    sums = stored(blocks.mapInArrow(often, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "hmm-words")
    total, distinct = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = sums.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "n").toPandas()
    head = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(head)
    model = first_model(head[order], top["n"].to_numpy()[order], total, distinct)

    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            width = len(own.background)
            starts, moves = np.zeros(STATES), np.zeros((STATES, STATES))
            cells = np.zeros((width, STATES))
            for _, block in block_rows(batches):
                table, place = own.block_emission(block), own.cells(block.words)
                for tokens, offsets in block.texts(~block.held):
                    gamma, begin, move = expected(table[tokens], offsets, own.chain)
                    starts += begin
                    moves += move
                    for s in range(STATES):
                        cells[:, s] += np.bincount(place[tokens], gamma[:, s], minlength=width)
            every = np.concatenate((cells, starts[None], moves))
            used = np.flatnonzero(every.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), *(pa.array(every[used, s]) for s in range(STATES))], ["cell", *(f"n{s}" for s in range(STATES))]
            )

        columns = ", ".join(f"n{s} double" for s in range(STATES))
        found = blocks.mapInArrow(count, f"cell long, {columns}").groupBy("cell").agg(*[F.sum(f"n{s}").alias(f"n{s}") for s in range(STATES)]).toPandas()
        every = np.zeros((len(model.background) + 1 + STATES, STATES))
        every[found["cell"].to_numpy()] = found[[f"n{s}" for s in range(STATES)]].to_numpy()
        counts = every[: len(model.background)]
        model = TiedModel(
            model.head,
            model.background,
            next_chain(every[len(counts)], every[len(counts) + 1 :]),
            smoothed(counts, counts.sum(axis=0), model.background),
            total,
            distinct,
        )
        sent.unpersist()
    return model


def ranges(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's range of hashes; the words in order of their ranges, and where each range begins there."""
    part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype("<u4")
    return part, *in_order(part, parts)


def in_order(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def emission_counts(blocks: DataFrame, model: TiedModel, parts: int) -> DataFrame:
    """``block, part, words, c, cells``: a block's words in a range, their training counts and expected counts per state.

    The row of part ``CHAIN`` holds starts, moves, and sums of the expected counts.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for number, block in block_rows(batches):
            table = own.block_emission(block)
            cells = np.zeros((STATES, len(block.words)))
            plain = np.zeros(len(block.words), np.int64)
            chain = np.zeros((2 + STATES, STATES))
            for tokens, offsets in block.texts(~block.held):
                gamma, begin, move = expected(table[tokens], offsets, own.chain)
                chain[0] += begin
                chain[1:-1] += move
                plain += np.bincount(tokens, minlength=len(plain))
                for s in range(STATES):
                    cells[s] += np.bincount(tokens, gamma[:, s], minlength=len(plain))
            chain[-1] = cells.sum(axis=1)
            _, order, bounds = ranges(block.words, parts)
            filled = np.flatnonzero(np.diff(bounds))
            places = [order[bounds[i] : bounds[i + 1]] for i in filled]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(filled) + 1, number)),
                    pa.array(np.append(filled, CHAIN).astype(np.int32)),
                    pa.array([*(block.words[at].tobytes() for at in places), b""], pa.binary()),
                    pa.array([*(plain[at].astype("<u4").tobytes() for at in places), b""], pa.binary()),
                    pa.array([*(cells[:, at].astype("<f4").tobytes() for at in places), chain.tobytes()], pa.binary()),
                ],
                ["block", "part", "words", "c", "cells"],
            )

    return blocks.mapInArrow(count, PARTS)


def summed(counts: DataFrame) -> DataFrame:
    """``block, part, c, cells``: the words of every row with their counts in all blocks."""

    def add(group: pa.Table) -> pa.Table:
        def of(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]

        if group.column("part")[0].as_py() == CHAIN:
            c, cells = [b""] * group.num_rows, [np.sum(of("cells", "<f8"), axis=0).tobytes()] * group.num_rows
        else:
            words = of("words", "<u8")
            ends = np.cumsum([len(x) for x in words])[:-1]
            distinct, number = np.unique(np.concatenate(words), return_inverse=True)
            often = np.bincount(number, np.concatenate(of("c", "<u4"))).astype("<i8")
            each = np.concatenate([x.reshape(STATES, -1) for x in of("cells", "<f4")], axis=1)
            sums = np.stack([np.bincount(number, state) for state in each]).astype("<f4")
            rows = np.split(number, ends)
            c, cells = [often[at].tobytes() for at in rows], [sums[:, at].tobytes() for at in rows]
        columns = [*group.select(["block", "part"]).columns, pa.array(c, pa.binary()), pa.array(cells, pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "part", "c", "cells"])

    # A group is a range of hashes with about RANGE_WORDS words, or a few numbers per block.
    return counts.groupBy("part").applyInArrow(add, REPLIES)


def range_places(blocks: DataFrame, parts: int) -> DataFrame:
    """Per block, the range of every word, as a row of part ``PLACES``."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [ranges(np.frombuffer(x.as_buffer(), "<u8"), parts)[0].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(part), PLACES, np.int32)),
                    pa.array([b""] * len(part), pa.binary()),
                    pa.array(part, pa.binary()),
                ],
                ["block", "part", "c", "cells"],
            )

    return blocks.select("block", "words").mapInArrow(tell, REPLIES)


def score_documents(
    documents: DataFrame, held: str = "held_out", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The model learns from the rows whose boolean column ``held`` is false; a null there counts as held out. Tokens are words and one end per
    text; null and empty texts are the end alone. ``base_score`` and ``score`` are log10 probabilities under
    the add-one unigram model and under the hidden Markov model. Repeated rows are scored alike, and
    learned from each. With no row to learn from, both scores are 0. Other columns are not read.
    """
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(held), F.lit(True)).alias("held"), F.col(text_column).alias("text")
    )
    blocks = encode(rows, "held")
    path_blocks = stored(blocks, "hmm-blocks")
    model = tied_rounds(path_blocks)
    total, distinct = model.total, model.distinct
    words = path_blocks.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    parts = int(words // RANGE_WORDS) + 1
    replies = summed(emission_counts(path_blocks, model, parts)).unionByName(range_places(path_blocks, parts))

    def score(group: pa.Table, counts: pa.Table) -> pa.Table:
        scored = []
        for row in range(group.num_rows):
            block = Block.read(group, row)
            told = dict(zip(counts.column("part").to_pylist(), zip(counts.column("c"), counts.column("cells")), strict=True))
            place = np.frombuffer(told.pop(PLACES)[1].as_buffer(), "<u4")
            every = np.frombuffer(told.pop(CHAIN)[1].as_buffer(), "<f8").reshape(-1, STATES)
            chain, sums = next_chain(every[0], every[1:-1]), every[-1]
            order, bounds = in_order(place, parts)
            c = np.zeros(len(place))
            own = np.zeros((len(place), STATES))
            for part, (often, cells) in told.items():
                at = order[bounds[part] : bounds[part + 1]]
                c[at] = np.frombuffer(often.as_buffer(), "<i8")
                own[at] = np.frombuffer(cells.as_buffer(), "<f4").reshape(STATES, -1).T
            background = (c + 1) / (total + distinct + 1)
            emission = smoothed(own, sums, background)
            known, base = c > 0, np.log10(background)
            at = 0
            for tokens, offsets in block.texts(np.ones(len(block.ids), dtype=bool)):
                cut = Segments(offsets)
                products, scale = cut.products(emission[tokens], chain.transition)
                log, _ = cut.forward(products, scale, chain.start, chain.transition)
                some = slice(at, at + len(log))
                at += len(log)
                columns = [
                    pa.array(block.ids[some], mask=block.no_id[some]),
                    pa.array(block.held[some]),
                    pa.array(np.diff(offsets)),
                    pa.array(np.add.reduceat(known[tokens].astype(np.int64), offsets[:-1])),
                    pa.array(np.full(len(log), total, np.int64)),
                    pa.array(np.add.reduceat(base[tokens], offsets[:-1])),
                    pa.array(log / np.log(10)),
                ]
                scored.append(pa.Table.from_arrays(columns, schema=SCORED))
        return pa.concat_tables(scored) if scored else SCORED.empty_table()

    # A group is one block and its words' counts, bounded by the block's size.
    return path_blocks.drop("words").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
