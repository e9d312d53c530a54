"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Words are the letter runs of whole texts with their numbers of occurrences. The nodes of the words' trie and of
the trie of the reversed words are numbered. A word left of a place is a node of the one, right of it a node of the other:
the pair with one letter skipped between them is what two words that differ there have in common, and the
pair without a skip is what a word shares with those that have one letter more at that place. Equal pairs give exactly
the near words, without a look at any pair of words. A word's form is its most frequent near word, if clearly more
frequent; forms are followed to their roots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.numbering import numbered
from attestry.llm.storage import stored
from attestry.llm.words import LOWER, Words, pieces, text_bytes

MIN_LETTERS, MIN_COUNT = 5, 3
#: One run in so many, by its checksum, loses a letter; None: none does.
DAMAGED = 97
#: A form is at least so many times as frequent.
FACTOR = 2
#: UTF-8 lead byte of U+00C0 to U+00FF, and what its second byte lacks to the code point.
LEAD, SHIFT = 0xC3, 0x40
#: Letters as one byte each: a-z and U+00C0 to U+00FF. Other bytes part runs.
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[0xC0:] = True

CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC_TABLE = (CRC_TABLE >> 1) ^ np.where(CRC_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0))


def crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return CRC_TABLE[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 as one byte a letter: A-Z lower-cased, U+00C0 to U+00FF their code points, all else blank."""
    lead = data == LEAD
    second = np.zeros(len(data), dtype=bool)
    second[1:] = lead[:-1]
    single = np.where(second, data + SHIFT, LOWER[data])
    single[(data >= 0x80) & ~second] = 32
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~lead, out=before[1:])
    return single[~lead], before[offsets]


def checksums(words: Words, ids: list[str]) -> np.ndarray:
    """CRC-32 of ``<id>:<run>`` in UTF-8 for every run; ids by row."""
    state = np.full(len(ids), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(max(map(len, ids), default=0) + 1):
        live = [i for i, x in enumerate(ids) if len(x) >= at]
        byte = np.array([ord((ids[i] + ":")[at]) for i in live], dtype=np.uint32)
        state[live] = crc_step(state[live], byte)
    state = state[words.rows]
    lengths = words.ends - words.starts
    order = np.argsort(-lengths, kind="stable")
    longest = np.sort(lengths)
    for at in range(int(longest[-1]) if len(longest) else 0):
        live = order[: len(longest) - np.searchsorted(longest, at, side="right")]
        byte = words.data[words.starts[live] + at].astype(np.uint32)
        now = state[live]
        wide = byte >= LEAD - 3
        now = np.where(wide, crc_step(now, np.uint32(LEAD)), now)
        state[live] = crc_step(now, np.where(wide, byte - SHIFT, byte))
    return ~state


def counted_runs(batches: Iterator[pa.RecordBatch], damaged: int | None) -> Iterator[pa.RecordBatch]:
    """``doc_id, text`` to words of enough letters with their number in a piece of text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"), lower=False)
        ids = ["" if x is None else str(x) for x in batch.column("doc_id").to_pylist()]
        for first, last in pieces(offsets):
            single, bounds = letters(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            words = Words(single, bounds, LETTER)
            if not len(words.starts):
                continue
            lengths = words.ends - words.starts
            kept = words.inside
            if damaged:
                sums = checksums(words, ids[first:last])
                hit = np.flatnonzero(sums % np.uint32(damaged) == 0)
                kept = kept.copy()
                kept[words.starts[hit] + sums[hit] % lengths[hit]] = False
                lengths[hit] -= 1
            ends = np.zeros(len(lengths) + 1, dtype=np.int32)
            np.cumsum(lengths, out=ends[1:])
            runs = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(single[kept])])
            runs = runs.filter(pa.array(lengths >= MIN_LETTERS)).dictionary_encode()
            found = [x.decode("latin-1") for x in runs.dictionary.to_pylist()]
            counts = np.bincount(runs.indices.to_numpy(), minlength=len(found))
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "n": pa.array(counts, pa.int64())})


def letter_runs(
    documents: DataFrame, damaged: int | None = DAMAGED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``word, n``: letter runs of at least ``MIN_LETTERS`` letters that occur at least ``MIN_COUNT`` times in all texts."""
    read = documents.select(F.col(id_column).cast("string").alias("doc_id"), F.col(text_column).alias("text"))
    found = read.mapInArrow(lambda batches: counted_runs(batches, damaged), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _joined(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the words, by sorting: neither is collected for a broadcast.

    Spark would size a written table by its compressed files, and exploded words as the words themselves.
    """
    return left.join(right.hint("merge"), on, how)


def node_pairs(words: DataFrame) -> DataFrame:
    """``word, n, left, right, skipped, first`` for every place of every word.

    ``left`` is the trie node before the place, ``right`` the reversed trie's node behind it. ``skipped``: a letter lies between
    them; ``first`` is false if the letter before is the same, as skipping either leaves the same letters.
    """
    places = F.sequence(F.lit(0), F.length("word"))
    spelled = words.select("word", "n", F.posexplode(F.transform(places, lambda i: i)).alias("place", "_i"))
    nodes = spelled.select(
        "word",
        "place",
        F.explode(
            F.array(
                F.concat(F.lit("<"), F.expr("left(word, place)")), F.concat(F.lit(">"), F.expr("reverse(substr(word, place + 1))"))
            )
        ).alias("spelling"),
    )
    numbers = numbered(nodes.select("spelling"), "spelling", "trie-nodes")
    both = _joined(nodes, numbers, "spelling").select("word", "place", "number", F.col("spelling").startswith("<").alias("forward"))

    def line(forward: bool) -> Column:
        here = F.col("forward") if forward else ~F.col("forward")
        found = F.array_sort(F.collect_list(F.when(here, F.struct("place", "number"))))
        return found["number"]

    lines = both.groupBy("word").agg(line(True).alias("lefts"), line(False).alias("rights"))
    pair = """
        transform(sequence(0, length(word)), i -> named_struct('left', lefts[i], 'right', rights[i], 'skipped', false, 'first', true))"""
    skips = """
        transform(sequence(0, length(word) - 1), i -> named_struct('left', lefts[i], 'right', rights[i + 1], 'skipped', true,
            'first', i = 0 or substr(word, i, 1) <> substr(word, i + 1, 1)))"""
    return _joined(words, lines, "word").select("word", "n", F.explode(F.concat(F.expr(pair), F.expr(skips))).alias("_p")).select(
        "word", "n", "_p.*"
    )


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near`` for words that have near words; ``near`` (``_order, word``) is the most frequent, ties to the smallest.

    Words that share a pair differ in one letter only, so a pair has at most as many words as there are letters, and
    one word more.
    """
    entry = F.struct((-F.col("n")).alias("_order"), "word", "first")
    pairs = node_pairs(words).groupBy("left", "right").agg(
        F.array_sort(F.collect_list(F.when(F.col("skipped"), entry))).alias("longer"),
        F.max(F.when(~F.col("skipped"), F.struct((-F.col("n")).alias("_order"), "word"))).alias("shorter"),
    )
    pairs = pairs.where("size(longer) > 1 or (size(longer) > 0 and shorter is not null)")
    plain = "named_struct('_order', x._order, 'word', x.word)"
    # A word's best in a pair: the first of the others, or the shorter word, whichever is more frequent.
    told = F.expr(f"""
        concat(
          transform(longer, (m, i) -> named_struct('word', m.word,
            'n_near', size(longer) - 1 + if(m.first and shorter is not null, 1, 0),
            'near', array_min(array(
              get(transform(filter(slice(longer, 1, 2), x -> x.word <> m.word), x -> {plain}), 0),
              if(m.first, shorter, null))))),
          if(shorter is null, array(), array(named_struct('word', shorter.word,
            'n_near', size(filter(longer, x -> x.first)),
            'near', array_min(transform(filter(longer, x -> x.first), x -> {plain}))))))""")
    each = pairs.select(F.explode(told).alias("_t")).select("_t.*").where("n_near > 0")
    return each.groupBy("word").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("near").alias("near"))


def roots(forms: DataFrame, name: str = "roots") -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last.

    Every round doubles the steps that all words have gone; a form is at least ``FACTOR`` times as frequent, so
    the rounds are bounded by the logarithm of the logarithm of the largest count.
    """
    going = stored(forms.select("word", F.col("form").alias("to")), f"{name}-0")
    round_ = 0
    while True:
        round_ += 1
        ahead = going.select(F.col("word").alias("_word"), F.col("to").alias("_next"))
        stepped = _joined(going, ahead, F.col("to") == F.col("_word"), "left").select(
            "word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")
        )
        stepped = stored(stepped, f"{name}-{round_}")
        going = stepped.select("word", "to")
        if stepped.where("moved").isEmpty():
            return going.withColumnRenamed("to", "root")


def spelling_variants(
    documents: DataFrame, damaged: int | None = DAMAGED, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Runs of letters (A-Z lower-cased, U+00C0 to U+00FF as they are) of at least five letters and three occurrences are words. With
    ``damaged``, runs whose checksum with the document's id it divides lose a letter first; a null id is empty text
    there. Null and empty texts have no words, repeated rows count each, texts of any length are read whole. An empty
    table gives no rows. Other columns are not read.
    """
    words = stored(letter_runs(documents, damaged, id_column, text_column), "spelled-words")
    near = _joined(words, near_words(words), "word", "left")
    formed = -F.col("near._order") >= FACTOR * F.col("n")
    near = stored(
        near.select(
            "word",
            F.when(formed, F.col("near.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, -F.col("near._order")).alias("form_n"),
        ),
        "near-words",
    )
    ends = roots(near.where("form is not null"))
    return _joined(near, ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
