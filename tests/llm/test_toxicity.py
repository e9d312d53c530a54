import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import toxicity
from attestry.llm.language import held_out


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = held_out("doc_id", 3, 1)
    model = toxicity.train_classifier(docs.where(~held), labels.where(~held))
    rows = toxicity.score_texts(docs.where(held), model).join(labels, "doc_id").collect()
    good, bad = (np.array([r["score"] for r in rows if r["toxic"] == t]) for t in (0, 1))
    assert (bad[:, None] > good[None, :]).mean() > 0.95
    assert (bad >= toxicity.DECISION).mean() > 0.8 and (good >= toxicity.DECISION).mean() < 0.06


def test_pool_is_the_plain_convolution():
    rng = np.random.RandomState(2)
    model = toxicity.Classifier.fresh(3)
    lengths = [0, 1, 2, 9]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    cells = rng.randint(0, toxicity.CELLS, (offsets[-1], 3)).astype(np.int32)
    pool = model.pooled(cells, offsets)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        vectors = np.concatenate((model.embedding[cells[a:b]].sum(axis=1), np.zeros((2, toxicity.DIM))))
        plain = []
        for weights, bias in zip(model.filters, model.biases, strict=True):
            out = [sum(vectors[t + j] @ weights[j] for j in range(len(weights))) + bias for t in range(b - a)]
            plain.append(np.maximum(np.max(out, axis=0), 0) if out else np.zeros(toxicity.FILTERS))
        np.testing.assert_allclose(pool[row], np.concatenate(plain), atol=1e-4)


def test_threshold_maximises_f1():
    rng = np.random.RandomState(0)
    logits, labels = rng.normal(0, 1, 300), rng.randint(0, 2, 300)
    logits += labels

    def f1(bound):
        hit = ((logits >= bound) & (labels == 1)).sum()
        return 2 * hit / ((logits >= bound).sum() + labels.sum())

    assert f1(toxicity.best_threshold(logits, labels)) == pytest.approx(max(f1(x) for x in logits))


def test_score_meets_the_decision_at_the_threshold():
    model = toxicity.Classifier.fresh()
    model.languages, model.thresholds = np.zeros((toxicity.LANGUAGE_CELLS, 0)), np.array([0.0])
    cells, offsets = np.zeros((1, 3), np.int32), np.array([0, 1])
    model.thresholds[:] = model.logits(cells, offsets)[0]
    assert model.scores(cells, offsets)[0] == pytest.approx(toxicity.DECISION)


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (7, 0), (3, 1), (99, 1), (None, 1), (6, None), (4, 0)], "doc_id long, toxic int"
    )
    model = toxicity.train_classifier(awkward, labels)
    rows = toxicity.score_texts(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1
    for docs, known in ((nothing, labels), (awkward, labels.where("false"))):
        untrained = toxicity.train_classifier(docs, known)
        assert toxicity.score_texts(awkward, untrained).where(F.col("score").isNull()).count() == 0
    assert toxicity.score_texts(nothing, model).count() == 0


def test_thresholds_from_all_labelled_rows(spark):
    rng = np.random.RandomState(5)
    rows, labels = [], []
    for i in range(3600):
        lang = "en" if i % 3 else "de"
        toxic = rng.rand() < 0.1
        words = [f"{lang}{rng.randint(40)}" for _ in range(12)]
        # Half of the clean texts have one bad word; in one language toxic texts have many more of them.
        for _ in range((3 if lang == "en" else 8) if toxic else rng.randint(2)):
            words[rng.randint(12)] = f"bad{rng.randint(6)}"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = toxicity.train_classifier(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sample=60)
    truth, language = dict(labels), {i: x for i, _, x in rows}
    assert len(model.thresholds) == 3 and len(set(model.thresholds)) == 3
    scored = toxicity.score_texts(docs, model).collect()
    for lang in ("en", "de"):
        score, label = (np.array(x) for x in zip(*[(r["score"], truth[r["doc_id"]]) for r in scored if language[r["doc_id"]] == lang]))

        def f1(bound, score=score, label=label):
            hit = ((score >= bound) & (label == 1)).sum()
            return 2 * hit / ((score >= bound).sum() + label.sum())

        assert f1(toxicity.DECISION) > max(f1(x) for x in score) - 0.03


def test_fitted_rows_do_not_choose_and_classes_keep_their_share(spark):
    model = toxicity.Classifier.fresh()
    model.thresholds = np.zeros(1)
    # 30 toxic rows of which 20 were fitted; the other ten stand for all 30 beside 40 clean rows.
    rows = [(0, 2560, True, 1, 20), (0, 256, False, 1, 9), (0, 0, False, 1, 1), (0, 0, False, 0, 4), (0, -256, False, 0, 36)]
    toxicity.choose_thresholds(model, spark.createDataFrame(rows, "guess int, step int, fitted boolean, label int, n long"))
    assert 0 < model.thresholds[0] <= 1 + toxicity.STEP
