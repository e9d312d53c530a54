import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import language


def best_path(scores, penalty):
    def value(path):
        changes = sum(a != b for a, b in itertools.pairwise(path))
        return sum(scores[t, s] for t, s in enumerate(path)) - penalty * changes

    return max(value(p) for p in itertools.product(range(scores.shape[1]), repeat=len(scores))), value


def test_viterbi_by_enumeration():
    rng = np.random.RandomState(1)
    lengths = [0, 5, 1, 6, 0, 3]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    scores = rng.normal(0, 2, (offsets[-1], 3)).astype(np.float32)
    path = language.viterbi(scores, offsets, 1.5)
    for a, b in itertools.pairwise(offsets):
        if b > a:
            best, value = best_path(scores[a:b], 1.5)
            assert np.isclose(value(path[a:b].tolist()), best, atol=1e-4)
    assert len(language.viterbi(scores[:0], np.array([0, 0]), 1.0)) == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out("doc_id", 4, 2)
    model = language.train_languages(docs.where(~held))
    found = language.label_texts(docs.where(held), model).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", "the house and the garden with a dog that was there " * 5), ("de", "das haus und der garten mit einem hund der dort war " * 5), ("ru", "дом и сад с собакой которая была там " * 5)]
    return language.train_languages(spark.createDataFrame(rows, "lang string, text string"))


def test_spans_and_scripts(spark, model):
    text = "the dog and the house was there with a garden. DAS HAUS und der garten mit dem hund war dort! дом собака"
    (row,) = language.label_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert text[row["spans"][1]["start"] : row["spans"][1]["end"]].startswith("DAS HAUS")
    assert text[row["spans"][2]["start"] : row["spans"][2]["end"]] == "дом собака"
    assert row["lang_pred"] == "de" and 0 < row["score"] < 1


def test_awkward_rows(awkward, nothing, model):
    found = language.label_texts(awkward, model, carry=True).collect()
    assert len(found) == awkward.count()
    undetermined = [(r["doc_id"], r["score"], r["spans"]) for r in found if r["lang_pred"] == "und"]
    assert sorted(undetermined, key=str) == [(3, 0.0, []), (4, 0.0, []), (5, 0.0, []), (8, 0.0, []), (None, 0.0, [])]
    assert all(0 <= r["score"] <= 1 and r["row"]["size"] == "y" for r in found)
    assert all(r["row"]["doc_id"] == r["doc_id"] for r in found)
    assert language.label_texts(nothing, model).count() == 0
    empty = language.train_languages(nothing)
    assert {r["lang_pred"] for r in language.label_texts(awkward, empty).collect()} == {"und"}
