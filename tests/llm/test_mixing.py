import random

import pytest
from pyspark.sql import functions as F

from attestry.llm import mixing


def level_by_bisection(sizes, weights, repeats):
    total, low, high = sum(sizes), 0.0, 1e9
    for _ in range(200):
        t = (low + high) / 2
        if sum(min(repeats * s, w * t) for s, w in zip(sizes, weights, strict=True)) < total:
            low = t
        else:
            high = t
    return [min(repeats * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_targets_by_bisection(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 20):
        sizes = [rng.choice([0, 1, 10, 1000, 50_000]) * rng.randrange(1, 9) for _ in range(n)]
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
        rows = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        expected = level_by_bisection(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)], 3)
        if sum(sizes):
            assert [rows[s] for s in names] == pytest.approx(expected, rel=1e-6, abs=1e-3)


@pytest.mark.parametrize("ordered", [100_000, 5])
def test_queue_by_brute_force(spark, monkeypatch, ordered):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    rng = random.Random(8)
    docs = [(i, "w " * rng.randrange(0, 40), rng.choice("aaab") if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    rows = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    total = sum(r["size"] for r in rows)
    source = {d[0]: d[2] for d in docs}
    taken, target = {}, {}
    for r in rows:
        assert r["size"] == docs[r["doc_id"]][1].count("w") and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        key = source[r["doc_id"]]
        taken[key] = taken.get(key, 0) + r["taken"]
        target[key] = r["target"]
    assert total - 40 < sum(taken.values()) <= total and sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[k] - target[k]) <= 80 for k in taken)


def test_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", 50)
    docs = [(None, "same text here", "a")] * 700 + [(None, f"w{i} " * (i % 9), "b") for i in range(300)] + [(i, "x y", "a") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = sorted(map(str, mixing.mix_sources(df).collect()))
    assert rows == sorted(map(str, mixing.mix_sources(df.repartition(2)).collect())) and len(rows) == len(docs)
    found = mixing.mix_sources(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 30 for r in found)
    assert sum(r["size"] for r in found) - 30 < sum(r["taken"] for r in found) <= sum(r["size"] for r in found)


def test_awkward_rows(awkward, nothing):
    found = mixing.mix_sources(awkward)
    assert found.count() == awkward.count()
    rows = found.collect()
    assert {r["doc_id"]: r["size"] for r in rows if r["doc_id"] in (3, 4, 5, 9)} == {3: 0, 4: 0, 5: 0, 9: 1}
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix_sources(nothing).count() == 0
    blank = mixing.mix_sources(awkward.withColumn("text", F.lit(" ")))
    assert {r["taken"] for r in blank.collect()} == {0}
