import math

import numpy as np
import pytest

from attestry.llm import bitslice


def brute_force(rows, queries, k, scale):
    def clean(part):
        return [
            (i, np.array([math.floor(scale * float(np.float32(x))) for x in v]))
            for i, v in part
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
        ]

    out = []
    rows = clean(rows)
    for own, q in clean(queries):
        scored = sorted((-int(q @ v), i) for i, v in rows if i != own and len(v) == len(q))[:k]
        out += [(own, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "block"), [(0, 16_384), (1, 50), (2, 7)])
def test_same_rows_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", block)
    monkeypatch.setattr(bitslice, "QUERY_ROWS", 3)
    rng = np.random.RandomState(seed)
    vectors = rng.normal(0, [0.12, 5, 300][seed], (200, 6)).tolist()
    rows = list(enumerate(vectors))
    rows += [(i, vectors[3]) for i in range(300, 340)]  # one common vector: ties
    rows += [(7, vectors[9]), (None, vectors[1]), (400, None), (401, [1.0, None] + [0.0] * 4), (402, [math.inf] + [0.0] * 5)]
    rows += [(403, [math.nan] * 6), (404, [1.0, 2.0]), (405, []), (406, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [r for r in rows if r[0] in (403, 404, 405, 7)]
    asked = df.where("vec_id % 20 = 0 or vec_id in (403, 404, 405, 7)")
    found = sorted(map(tuple, bitslice.top_k(df, asked, k=5, scale=1024).collect()))
    assert found == brute_force(rows, queries, 5, 1024)


def test_many_equal_queries_lose_nothing(spark):
    rows = [(i % 3, [float(i % 3), 1.0]) for i in range(1800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for size in (256, 40):
        bitslice.QUERY_ROWS, before = size, bitslice.QUERY_ROWS
        try:
            found = bitslice.top_k(df, df, k=5)
            assert found.count() == 1800 * 5
            counts = {tuple(r)[:2]: r["n"] for r in found.groupBy("query_id", "rank").count().withColumnRenamed("count", "n").collect()}
        finally:
            bitslice.QUERY_ROWS = before
        assert counts == {(i, rank): 600 for i in range(3) for rank in range(1, 6)}


def test_copies_on_the_grid_grow_slower_than_pairs():
    def copied(blocks, chunks):
        down, across = bitslice.grid(blocks, chunks)
        assert 1 <= down <= blocks and 1 <= across <= chunks
        return blocks * bitslice.BLOCK_ROWS * across + chunks * bitslice.QUERY_ROWS * down

    assert bitslice.grid(1, 1) == (1, 1) and bitslice.grid(13, 9) == (13, 1)
    # Twice the rows and queries are four times the pairs.
    assert copied(80_000, 40_000) < 4.1 * copied(40_000, 20_000)
    assert copied(6000, 4000) < 0.6 * 6000 * 4000 * bitslice.QUERY_ROWS


def test_clashing_columns_are_not_read(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    more = df.selectExpr("*", "1 as block", "'x' as dim", "2 as id", "3 as query_id", "4 as score", "5 as rank")
    assert sorted(bitslice.top_k(more, more, 3).collect()) == sorted(bitslice.top_k(df, df, 3).collect())


def test_nothing_to_search(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    none = df.where("false")
    assert bitslice.top_k(df, none).count() == bitslice.top_k(none, df).count() == bitslice.top_k(df, df).count() == 0


def test_kth_value():
    rng = np.random.RandomState(4)
    values = rng.randint(0, 1000, 500)
    total = [bitslice.pack((values[None, :] >> b & 1).astype(bool))[0] for b in range(10)]
    rows = bitslice.pack(np.ones((1, 500), dtype=bool))[0]
    for k in (1, 10, 500):
        assert bitslice.kth_value(total, rows, k) == np.sort(values)[-k]
    for bound in (-3, 0, 500, 999, 1000, 5000):
        assert np.bitwise_count(bitslice.at_least(total, bound, rows)).sum() == (values >= bound).sum()
