"""Language of texts, by words: script ranges, word scores, and Viterbi over the words.

A word is a run of letters. Its script names the languages that can be meant; its score in a
language is the log-probability of its character trigrams and of the word itself, both
hashed, counted over all labelled documents. Viterbi with a penalty per
change of language labels the words of a text, so spans of mixed texts are told apart.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.words import mix

#: First code point of each script range, in order; "Other" closes a range. Fixed values.
SCRIPTS = (
    (0x0000, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0x20000, "Han"),
)
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS], dtype=np.uint32)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

#: Hash cells of trigrams, and as many of words.
CELLS = 1 << 16
FEATURES = 2 * CELLS
#: A language with less than this part of its letters in a script is no candidate for that script's words.
SCRIPT_SHARE = 0.001
#: The model has a row of numbers per language, so their number bounds it.
MAX_LANGUAGES = 500
PIECE = 500_000
GROUP_WORDS = 700_000
LAST_LETTER = 0x32400
UNDETERMINED = "und"


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 2 for letters, 1 for marks, else 0; and its lower case."""
    kind = np.zeros(0x110000, np.uint8)
    kinds = {"L": 2, "M": 1}
    kind[:LAST_LETTER] = [kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(LAST_LETTER)]
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(kind[:LAST_LETTER] == 2).tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return kind, lower


class TextWords:
    """Words of some texts: features per letter, and per word its row, bounds, letters and script."""

    def __init__(self, texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]):
        kind, lower = tables
        joined = "\n".join(t or "" for t in texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts])))
        inside = kind[points]
        at = np.flatnonzero(inside)
        self.rows = len(texts)
        if not len(at):
            self.row = self.start = self.end = self.letters = self.script = np.zeros(0, np.int64)
            self.trigram = self.word = self.first = np.zeros(0, np.int64)
            return
        plain = np.where(inside > 0, lower[points], 0).astype(np.uint64)
        plain = np.concatenate(([np.uint64(0)], plain))
        here = at + 1
        code = mix((plain[here - 1] << np.uint64(42)) ^ (plain[here] << np.uint64(21)) ^ plain[here + 1])
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = at[1:] != at[:-1] + 1
        self.first = np.flatnonzero(opens)
        self.trigram = (code >> np.uint64(48)).astype(np.int64)
        self.word = (mix(np.add.reduceat(code, self.first)) >> np.uint64(48)).astype(np.int64) + CELLS
        last = np.append(self.first[1:], len(at)) - 1
        row = np.searchsorted(begins, at[self.first], side="right") - 1
        self.row = row
        self.start = at[self.first] - begins[row]
        self.end = at[last] + 1 - begins[row]
        self.letters = np.add.reduceat((inside[at] == 2).astype(np.int64), self.first)
        self.script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, points[at[self.first]], side="right") - 1]


@dataclass
class LanguageModel:
    """Log-probabilities per feature and language, and the languages of each script."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    penalty: float

    def word_scores(self, words: TextWords) -> np.ndarray:
        if not len(words.first):
            return np.zeros((0, len(self.languages)), np.float32)
        score = np.add.reduceat(self.scores[words.trigram], words.first, axis=0) + self.scores[words.word]
        # What is counted per letter is not needed any more.
        words.trigram = words.word = words.first = None
        # Far below any word's own score, so that no other language is taken.
        return score - np.where(self.candidates[words.script], 0, 1e6).astype(np.float32)


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has that remainder; a null id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % modulus) == remainder


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield first, last
        first = last


def train_languages(
    documents: DataFrame, text_column: str = "text", language_column: str = "lang", penalty: float = 8.0
) -> LanguageModel:
    """Count features of all rows that have a text and a language.

    Counts are summed within tasks and then by feature; only the sums, whose number is
    bounded by the number of languages, reach the driver.
    """
    labelled = documents.select(F.col(text_column).alias("text"), F.col(language_column).alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    width = FEATURES + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = letter_tables()
        known = pa.array(languages, pa.string())
        total = np.zeros(len(languages) * width, np.int64)
        for batch in batches:
            language = pc.index_in(batch.column(1).cast(pa.string()), known).to_numpy()
            for low, high in pieces(batch.column(0)):
                words = TextWords(batch.column(0).slice(low, high - low).to_pylist(), tables)
                own = language[low:high][words.row].astype(np.int64) * width
                per_letter = np.repeat(own, np.diff(np.append(words.first, len(words.trigram))))
                for cell, weight in (
                    (per_letter + words.trigram, None),
                    (own + words.word, None),
                    (own + FEATURES + words.script, words.letters),
                ):
                    total += np.bincount(cell, weight, minlength=len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    counts = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(len(languages) * width)
    total[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    total = total.reshape(len(languages), width)
    scores = np.zeros((FEATURES, len(languages)), np.float32)
    for part in (slice(0, CELLS), slice(CELLS, FEATURES)):
        sums = total[:, part].sum(axis=1, keepdims=True)
        scores[part] = np.log((total[:, part] + 0.5) / (sums + 0.5 * CELLS)).T
    letters = total[:, FEATURES:].T
    candidates = letters > SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1)
    candidates[~candidates.any(axis=1)] = True
    return LanguageModel(languages, scores, candidates, penalty)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best language per word of texts whose words lie between ``offsets``; all texts advance together."""
    count = np.diff(offsets)
    order = np.argsort(-count, kind="stable")
    begin, count = offsets[:-1][order], count[order]
    path = np.zeros(len(scores), np.int16)
    if not len(scores):
        return path
    live = np.searchsorted(-count, -np.arange(int(count[0])), side="left")  # texts with more than t words
    best = scores[begin[: live[0]]].copy()
    jumps: list[tuple[np.ndarray, np.ndarray]] = [None] * len(live)
    final = np.zeros(live[0], np.int16)
    for t in range(1, len(live)):
        done, n = live[t - 1], live[t]
        if n < done:
            final[n:done] = best[n:done].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        other = best[np.arange(n), top][:, None] - penalty
        jump = other > best
        jumps[t] = (top.astype(np.int16), jump)
        best = np.where(jump, other, best) + scores[begin[:n] + t]
    final[: len(best)] = best.argmax(axis=1)
    state = np.zeros(live[0], np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        ended = live[t + 1] if t + 1 < len(live) else 0
        state[ended:n] = final[ended:n]
        path[begin[:n] + t] = state[:n]
        if t:
            top, jump = jumps[t]
            moved = jump[np.arange(n), state[:n]]
            state[:n] = np.where(moved, top, state[:n])
    return path


def label_texts(
    documents: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", carry: bool = False
) -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, spans``, and with ``carry`` the whole row as ``row``.

    Spans give start and end (code points, end exclusive) of stretches of words in one language. The
    prediction is the language with most letters, the first by name on a tie; the score is its part of all letters.
    A text that is null or has no letter is ``und`` with score 0 and no spans; so is every text if
    nothing was learned. Other columns are not read; repeated rows are labelled alike.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, own = letter_tables(), sent.value
        names = np.array([*own.languages, UNDETERMINED], dtype=object)

        def finish(rows: list[pa.RecordBatch], texts: list[TextWords], scores: list[np.ndarray]) -> pa.RecordBatch:
            base = np.cumsum([0] + [t.rows for t in texts])
            row = np.concatenate([t.row + b for t, b in zip(texts, base, strict=False)])
            start, end, letters = (np.concatenate([getattr(t, k) for t in texts]) for k in ("start", "end", "letters"))
            offsets = np.searchsorted(row, np.arange(base[-1] + 1))
            path = viterbi(np.concatenate(scores), offsets, own.penalty)
            wide = max(1, len(own.languages))
            share = np.bincount(row * wide + path, letters, minlength=base[-1] * wide).reshape(base[-1], wide)
            total = share.sum(axis=1)
            pred = np.where(total > 0, share.argmax(axis=1), len(own.languages))
            opens = np.ones(len(path), dtype=bool)
            opens[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(opens)
            last = np.append(first[1:], len(path)) - 1 if len(path) else first
            values = pa.StructArray.from_arrays(
                [pa.array(start[first]), pa.array(end[last]), pa.array(names[path[first]], pa.string())], fields=list(span)
            )
            bounds = np.searchsorted(row[first], np.arange(base[-1] + 1)).astype(np.int32)
            held = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays(
                [
                    held.column(0),
                    pa.array(names[pred], pa.string()),
                    pa.array(share.max(axis=1, initial=0) / np.maximum(total, 1)),
                    pa.ListArray.from_arrays(pa.array(bounds), values),
                    *held.columns[1 : 1 + carry],
                ],
                ["doc_id", "lang_pred", "score", "spans", *["row"] * carry],
            )

        for batch in batches:
            held: tuple[list, list, list] = ([], [], [])
            texts = pc.struct_field(batch.column(1), text_column) if carry else batch.column(1)
            for low, high in pieces(texts):
                words = TextWords(texts.slice(low, high - low).to_pylist(), tables)
                if not own.languages:
                    words = TextWords([""] * words.rows, tables)
                for part, value in zip(held, (batch.slice(low, high - low), words, own.word_scores(words)), strict=True):
                    part.append(value)
                if sum(len(s) for s in held[2]) > GROUP_WORDS:
                    yield finish(*held)
                    held = ([], [], [])
            if held[0]:
                yield finish(*held)

    # With the whole row, the text is read from there, so that it is sent once.
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.struct("*").alias("row") if carry else F.col(text_column).alias("text")
    )
    schema = T.StructType.fromDDL(
        "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    )
    return rows.mapInArrow(label, T.StructType([*schema.fields, *rows.schema.fields[1 : 1 + carry]]))
