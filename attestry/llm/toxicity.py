"""Toxicity of texts: a convolutional classifier over hashed word embeddings.

A word's vector is the sum of the vectors of its hash and of the hashes of its first
four and five bytes, so inflected forms share most of it. Filters of several widths slide over
a whole text, their largest responses are pooled, and a logistic layer reads the pool.
The classifier is trained in numpy on a bounded sample of labelled rows; every text is
scored. A threshold per language, found on the counts of all labelled rows that were kept from training, is
mapped to the common decision score. The language is guessed from the words of the text alone, by word counts of all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.storage import stored
from attestry.llm.words import ALNUM, Words, pieces, text_bytes

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 4000
CELLS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 10
BATCH = 32
RATE = 0.08
LANGUAGE_CELLS = 1 << 14
#: Logits are counted in steps of this width, up to a bound either way.
STEP, BOUND = 1 / 256, 64
#: Rows of each class that a language needs for a threshold of its own.
LEAST = 20
#: Languages whose word counts a task holds at once.
HELD_LANGUAGES = 64
DECISION = 0.7
PIECE = 1 << 20
PAD = CELLS


def encode(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, three cells per word, and word offsets per row."""
    data, offsets = text_bytes(column)
    for low, high in pieces(offsets, limit):
        words = Words(data, offsets[low : high + 1], ALNUM)
        hashes = [words.hashes(width) for width in (0, 4, 5)]
        shift = np.uint64(64 - CELLS.bit_length() + 1)
        cells = [((h + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32) for salt, h in enumerate(hashes)]
        yield low, np.stack(cells, axis=1), words.offsets


def padded(cells: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with empty words after each text, so that no filter reaches into the next; and new starts."""
    gap = max(WIDTHS) - 1
    count = np.diff(offsets)
    rows = np.repeat(np.arange(len(count)), count)
    out = np.full((len(cells) + gap * len(count), cells.shape[1]), PAD, np.int32)
    out[np.arange(len(cells)) + rows * gap] = cells
    return out, offsets[:-1] + np.arange(len(count)) * gap


@dataclass
class Classifier:
    """Parameters, and per language the logit at which a text counts as toxic."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    languages: np.ndarray | None = None
    thresholds: np.ndarray | None = None

    @staticmethod
    def fresh(seed: int = 7) -> Classifier:
        rng = np.random.RandomState(seed)
        embedding = rng.normal(0, 0.3, (CELLS + 1, DIM)).astype(np.float32)
        embedding[PAD] = 0
        return Classifier(
            embedding,
            [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
            0.0,
        )

    def responses(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """Per width, the filters' responses at every place."""
        vectors = self.embedding[words[:, 0]]
        for part in range(1, words.shape[1]):
            vectors = vectors + self.embedding[words[:, part]]
        for weights, bias in zip(self.filters, self.biases, strict=True):
            out = vectors @ weights[0]
            for step in range(1, len(weights)):
                out[:-step] += vectors[step:] @ weights[step]
            yield out + bias

    def pooled(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, starts = padded(cells, offsets)
        count = np.diff(offsets)
        empty = words[:, 0] == PAD
        pools = []
        for out in self.responses(words):
            out[empty] = 0  # as low as a response counts
            pools.append(np.maximum(np.maximum.reduceat(out, starts, axis=0), 0))
        pool = np.concatenate(pools, axis=1)
        pool[count == 0] = 0
        return pool

    def logits(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(offsets) - 1:
            return np.zeros(0, np.float32)
        return self.pooled(cells, offsets) @ self.output + self.bias

    def language(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The likeliest of the languages that have a threshold of their own, by words; the last threshold is for no words."""
        last = len(self.thresholds) - 1
        count = np.diff(offsets)
        if not len(cells) or not last:
            return np.full(len(count), last)
        run = np.concatenate((np.zeros((1, last)), np.cumsum(self.languages[cells[:, 0] % LANGUAGE_CELLS], axis=0, dtype=np.float64)))
        return np.where(count > 0, (run[offsets[1:]] - run[offsets[:-1]]).argmax(axis=1), last)

    def scores(self, cells: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability-like scores; at a language's threshold the score is the decision score."""
        bound = self.thresholds[self.language(cells, offsets)]
        return sigmoid(self.logits(cells, offsets) - bound + np.log(DECISION / (1 - DECISION)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.asarray(x, np.float64), -50, 50)))


class Adagrad:
    """Step sizes per parameter."""

    def __init__(self, shape: tuple[int, ...]):
        self.sums = np.full(shape, 1e-4, np.float32)

    def step(self, values: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        self.sums[at] += gradient * gradient
        values[at] -= RATE * gradient / np.sqrt(self.sums[at])


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Classifier:
    """Stochastic gradient descent on the logistic loss; both classes weigh the same.

    A pooled response has one place, so a text's gradient touches few words whatever its length.
    """
    model = Classifier.fresh(seed)
    rng = np.random.RandomState(seed + 1)
    steps = {
        "embedding": Adagrad(model.embedding.shape),
        "output": Adagrad(model.output.shape),
        "bias": Adagrad((1,)),
        "filters": [Adagrad(f.shape) for f in model.filters],
        "biases": [Adagrad(b.shape) for b in model.biases],
    }
    bias = np.zeros(1, np.float32)
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * max(1, len(labels) - positive)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            offsets = np.concatenate(([0], np.cumsum([len(texts[i]) for i in some])))
            words, starts = padded(np.concatenate([texts[i] for i in some]), offsets)
            ends = starts + np.diff(offsets)
            pools, places = [], []
            for out in model.responses(words):
                place = np.stack([s + out[s:e].argmax(axis=0) if e > s else np.zeros(FILTERS, np.int64) for s, e in zip(starts, ends, strict=True)])
                top = np.take_along_axis(out, place, axis=0)
                top[ends == starts] = 0
                pools.append(np.maximum(top, 0))
                places.append(place)
            pool = np.concatenate(pools, axis=1)
            error = ((sigmoid(pool @ model.output + bias[0]) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            back = error[:, None] * model.output
            steps["output"].step(model.output, pool.T @ error)
            steps["bias"].step(bias, error.sum(keepdims=True))
            touched, change = [], []
            for at, width in enumerate(WIDTHS):
                part = slice(at * FILTERS, (at + 1) * FILTERS)
                own = np.where(pools[at] > 0, back[:, part], 0)
                gradient = np.zeros_like(model.filters[at])
                for step in range(width):
                    cells = words[places[at] + step]
                    vectors = model.embedding[cells].sum(axis=2)
                    gradient[step] = np.einsum("nfd,nf->df", vectors, own)
                    flow = own[:, :, None] * model.filters[at][step].T
                    for piece in range(cells.shape[2]):
                        touched.append(cells[:, :, piece].ravel())
                        change.append(flow.reshape(-1, DIM))
                steps["filters"][at].step(model.filters[at], gradient)
                steps["biases"][at].step(model.biases[at], own.sum(axis=0))
            touched, change = np.concatenate(touched), np.concatenate(change)
            rows, inverse = np.unique(touched, return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inverse, change)
            steps["embedding"].step(model.embedding, total, rows)
            model.embedding[PAD] = 0
    model.bias = float(bias[0])
    return model


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The logit that separates the classes with the best F1, in the middle of the gap to the next one."""
    weights = np.ones(len(logits)) if weights is None else weights
    values, place = np.unique(logits, return_inverse=True)
    ranked = values[::-1]
    hits = np.cumsum(np.bincount(place, weights * labels)[::-1])
    every = np.cumsum(np.bincount(place, weights)[::-1])
    at = int((2 * hits / (every + hits[-1])).argmax())
    return float((ranked[at] + ranked[at + 1]) / 2) if at + 1 < len(ranked) else float(ranked[at] - STEP / 2)


def language_words(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``lang, text`` in order, and the logs of their shares of words per cell, from every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def release() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used])], ["lang", "cell", "n"]
                )
            held.clear()

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            number = names.indices.to_numpy()
            for low, cells, offsets in encode(batch.column(1)):
                owner = np.repeat(number[low : low + len(offsets) - 1], np.diff(offsets))
                place = cells[:, 0] % LANGUAGE_CELLS
                for at in np.unique(owner):
                    name = names.dictionary[int(at)].as_py()
                    if name not in held and len(held) == HELD_LANGUAGES:
                        yield from release()
                    counts = held.setdefault(name, np.zeros(LANGUAGE_CELLS, np.int64))
                    counts += np.bincount(place[owner == at], minlength=LANGUAGE_CELLS)
        yield from release()

    found = rows.where("lang is not null").select("lang", "text").mapInArrow(count, "lang string, cell int, n long")
    found = found.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(found["lang"]))
    counts = np.full((LANGUAGE_CELLS, len(names)), 0.5)
    counts[found["cell"].to_numpy(np.int64), np.searchsorted(np.array(names, object), found["lang"].to_numpy(object))] += found["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def logit_counts(rows: DataFrame, known: DataFrame, model: Classifier, fitted: np.ndarray) -> DataFrame:
    """``guess, step, fitted, label, n``: labelled rows by guessed language, logit and whether the network was fitted on them.

    The texts stay where they are; what is joined with the labels are numbers.
    """
    sent = rows.sparkSession.sparkContext.broadcast((vars(model), fitted))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = sent.value
        own = Classifier(**parts)
        for batch in batches:
            for low, cells, offsets in encode(batch.column(1)):
                ids = batch.column(0).slice(low, len(offsets) - 1)
                step = np.floor(np.clip(own.logits(cells, offsets), -BOUND, BOUND) / STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.language(cells, offsets).astype(np.int32)), pa.array(step), pa.array(np.isin(ids.to_numpy(), seen))],
                    ["doc_id", "guess", "step", "fitted"],
                )

    found = rows.where("doc_id is not null").select("doc_id", "text").mapInArrow(measure, "doc_id long, guess int, step int, fitted boolean")
    return found.join(known, "doc_id").groupBy("guess", "step", "fitted", "label").agg(F.count("*").alias("n"))


def choose_thresholds(model: Classifier, counts: DataFrame) -> None:
    """Thresholds from ``logit_counts``: the common one, and one for each language with enough rows.

    Rows that the network was fitted on lie too far from the threshold to choose it. The others stand for them: a class
    weighs as many rows as it has in all. Where a class has no other row, the fitted ones are taken.
    """
    found = counts.toPandas()
    guess, truth, n = (found[c].to_numpy(np.int64) for c in ("guess", "label", "n"))
    logits, fitted = (found["step"].to_numpy() + 0.5) * STEP, found["fitted"].to_numpy(bool)
    weights = np.zeros(len(n))
    for label in (0, 1):
        of = truth == label
        free = of & ~fitted if (of & ~fitted).any() else of
        weights[free] = n[free] * (n[of].sum() / max(n[free].sum(), 1))
    used = weights > 0
    both = {0, 1} <= set(truth[used])
    model.thresholds[:] = best_threshold(logits[used], truth[used], weights[used]) if both else 0.0
    for at in range(len(model.thresholds) - 1):
        own = used & (guess == at)
        if all(n[own & (truth == label)].sum() >= LEAST for label in (0, 1)):
            model.thresholds[at] = best_threshold(logits[own], truth[own], weights[own])


def train_classifier(
    documents: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    label_column: str = "toxic",
) -> Classifier:
    """Fit on at most ``sample`` labelled rows of each class, chosen by the hash of the id; thresholds come from all labelled rows.

    The larger of several labels of an id counts; null labels, and labels without a document, are left out. Whole texts
    are used, and a quarter of the sample is kept from training. Without any labelled row the classifier scores by its random start.
    """
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    known = known.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg((F.max(label_column) > 0).cast("int").alias("label"))
    known = stored(known, "toxic-labels")
    chosen = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)
    ]
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(language_column).cast("string").alias("lang")
    )
    # The choice has at most two times ``sample`` rows.
    some = rows.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").dropDuplicates(["doc_id"])
    some = stored(some.select("doc_id", "label", "text"), "toxic-sample")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, label = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            label += batch.column(1).to_pylist()
            for _, cells, offsets in encode(batch.column(2)):
                texts += [cells[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
        texts, ids = [texts[i] for i in order], np.array(ids, dtype=np.int64)[order]
        truth = np.array(label, dtype=np.int64)[order]
        fitted = np.flatnonzero(np.arange(len(texts)) % 4 != 3)
        model = fit([texts[i] for i in fitted], truth[fitted])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((vars(model), ids[fitted]))], pa.binary())], ["model"])

    fitted = some.coalesce(1).mapInArrow(train, "model binary").first()
    if fitted is None:
        model = Classifier.fresh()
        model.languages, model.thresholds = np.zeros((LANGUAGE_CELLS, 0), np.float32), np.zeros(1)
        return model
    parts, ids = pickle.loads(fitted[0])
    model = Classifier(**parts)
    names, model.languages = language_words(rows)
    model.thresholds = np.zeros(len(names) + 1)
    choose_thresholds(model, logit_counts(rows, known, model, ids))
    return model


def score_texts(documents: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` for every row.

    Only the text decides. A null, empty or wordless text gets the score of an empty pool. Repeated rows are
    scored alike; other columns are not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vars(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(**sent.value)
        for batch in batches:
            for low, cells, offsets in encode(batch.column(1)):
                values = own.scores(cells, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(values)), pa.array(values, pa.float64())], ["doc_id", "score"]
                )

    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double")


def predicted(score: Column) -> Column:
    return F.when(score >= DECISION, 1).otherwise(0).cast("int")
