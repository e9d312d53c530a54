import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import hmm
from attestry.llm.storage import stored


def chain(rng, states):
    start = rng.dirichlet(np.ones(states))
    return hmm.Chain(start, rng.dirichlet(np.ones(states), states))


def paths(emission, model):
    """Every state path of one text, with its probability."""
    for path in itertools.product(range(len(model.start)), repeat=len(emission)):
        p = model.start[path[0]] * emission[0, path[0]]
        for t in range(1, len(path)):
            p *= model.transition[path[t - 1], path[t]] * emission[t, path[t]]
        yield path, p


@pytest.mark.parametrize("segment", [1, 2, 3, 128])
def test_likelihood_and_counts_by_enumeration(monkeypatch, segment):
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    rng = np.random.RandomState(segment)
    model = chain(rng, 3)
    lengths = [1, 7, 2, 4, 3]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    emission = rng.uniform(1e-6, 1e-3, (offsets[-1], 3))
    cut = hmm.Segments(offsets)
    log, _ = cut.forward(*cut.products(emission, model.transition), model.start, model.transition)
    gamma, starts, moves = hmm.expected(emission.astype(np.float32), offsets, model)
    true_starts, true_moves, true_gamma = np.zeros(3), np.zeros((3, 3)), np.zeros_like(emission)
    for i, (a, b) in enumerate(itertools.pairwise(offsets)):
        every = list(paths(emission[a:b], model))
        total = sum(p for _, p in every)
        assert math.isclose(log[i], math.log(total), rel_tol=1e-9)
        for path, p in every:
            true_starts[path[0]] += p / total
            for t, s in enumerate(path):
                true_gamma[a + t, s] += p / total
                if t:
                    true_moves[path[t - 1], s] += p / total
    np.testing.assert_allclose(gamma, true_gamma, atol=1e-4)
    np.testing.assert_allclose(starts, true_starts, atol=1e-3)
    np.testing.assert_allclose(moves, true_moves, atol=1e-3)


def test_long_text_does_not_underflow():
    rng = np.random.RandomState(0)
    emission = rng.uniform(1e-14, 1e-9, (30_000, 4))
    model = chain(rng, 4)
    cut = hmm.Segments(np.array([0, 30_000]))
    log, _ = cut.forward(*cut.products(emission, model.transition), model.start, model.transition)
    state, total = model.start * emission[0], 0.0
    for t in range(1, len(emission)):
        total += math.log(state.sum())
        state = state / state.sum() @ model.transition * emission[t]
    assert math.isclose(log[0], total + math.log(state.sum()), rel_tol=1e-10)


def test_scores_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = {r["doc_id"]: r for r in hmm.score_documents(docs.withColumn("held_out", held)).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + ["end"] for r in docs.collect()}
    learned, counts = 0, {}
    for doc, tokens in texts.items():
        if zlib.crc32(str(doc).encode()) % 7 != 2:
            learned += len(tokens)
            for token in tokens:
                counts[token] = counts.get(token, 0) + 1
    assert set(found) == set(texts)
    gain = 0.0
    for doc, tokens in texts.items():
        row = found[doc]
        base = sum(math.log10((counts.get(t, 0) + 1) / (learned + len(counts) + 1)) for t in tokens)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert (row["n_tokens"], row["n_known"]) == (len(tokens), sum(t in counts for t in tokens))
        assert row["train_tokens"] == learned and math.isfinite(row["score"]) and row["score"] < 0
        gain += (row["score"] - base) * row["held_out"]
    assert gain > 0  # better than the unigrams on unseen texts


def test_awkward_rows(awkward):
    held = F.col("doc_id") == 6
    found = hmm.score_documents(awkward.withColumn("held_out", held)).collect()
    assert len(found) == awkward.count()
    assert sum(r["doc_id"] is None for r in found) == 2
    empty = {r["doc_id"]: (r["n_tokens"], r["n_known"]) for r in found if r["doc_id"] in (3, 4, 5)}
    assert empty == {3: (1, 1), 4: (1, 1), 5: (1, 1)}
    one, other = (r for r in found if r["doc_id"] == 1)
    assert one == other


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    one, many = ({r["doc_id"]: r["score"] for r in hmm.score_documents(docs.repartition(n)).collect()} for n in (1, 40))
    assert len(one) == 200
    assert all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)


def test_nothing_to_learn_or_score(awkward, nothing):
    assert hmm.score_documents(nothing.withColumn("held_out", F.lit(False))).count() == 0
    found = hmm.score_documents(awkward.withColumn("held_out", F.lit(True))).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in found} == {(0, 0, 0.0)}
    assert all(abs(r["score"]) < 1e-9 for r in found)


def test_head_does_not_depend_on_partitions(spark):
    texts = [(i, False, f"the cat w{i % 40} and w{i % 7} v{i}") for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, held boolean, text string")
    one, many = (hmm.tied_rounds(stored(hmm.encode(df.repartition(n), "held"), f"head-{n}")) for n in (1, 60))
    assert len(one.head) == 1 + 3 + 40 + 120 and (one.head == many.head).all()
    np.testing.assert_allclose(one.background, many.background)


@pytest.mark.parametrize("parts", [1, 5])
def test_counts_of_all_blocks_come_back_in_the_order_of_each(spark, parts):
    texts = [(i, i % 5 == 0, f"the cat w{i % 40} and w{i % 7} v{i}") for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, held boolean, text string")
    blocks = stored(hmm.encode(df.repartition(7), "held"), "summed")
    counts = hmm.emission_counts(blocks, hmm.tied_rounds(blocks), parts).collect()
    true, cells = {}, {}
    for row in (r for r in counts if r["part"] >= 0):
        for word, c, n in zip(
            np.frombuffer(row["words"], "<u8"), np.frombuffer(row["c"], "<u4"), np.frombuffer(row["cells"], "<f4").reshape(4, -1).T, strict=True
        ):
            true[word], cells[word] = true.get(word, 0) + c, cells.get(word, 0) + n
    assert max(true.values()) == 96
    words = {(r["block"], r["part"]): np.frombuffer(r["words"], "<u8") for r in counts}
    found = hmm.summed(spark.createDataFrame(counts, hmm.PARTS)).collect()
    assert len(found) == len(counts)
    for row in (r for r in found if r["part"] >= 0):
        held = words[row["block"], row["part"]]
        assert np.frombuffer(row["c"], "<i8").tolist() == [true[w] for w in held]
        np.testing.assert_allclose(np.frombuffer(row["cells"], "<f4").reshape(4, -1).T, [cells[w] for w in held], rtol=1e-5, atol=1e-6)


def test_no_row_is_sent_per_word(spark):
    """Counts meet blocks packed: no join on words, and no hashes beside a block's tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held_out", F.lit(False))
    plan = hmm.score_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 0


def test_many_ranges_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).repartition(3)
    one = {r["doc_id"]: r for r in hmm.score_documents(docs).collect()}
    monkeypatch.setattr(hmm, "RANGE_WORDS", 50)
    many = {r["doc_id"]: r for r in hmm.score_documents(docs).collect()}
    assert len(one) == 200 and set(one) == set(many)
    for i, row in one.items():
        assert row["n_known"] == many[i]["n_known"] and math.isclose(row["base_score"], many[i]["base_score"], rel_tol=1e-12)
        assert math.isclose(row["score"], many[i]["score"], rel_tol=1e-6)
