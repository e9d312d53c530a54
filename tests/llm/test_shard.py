import zlib

import pytest
from pyspark import SparkContext

from attestry.llm import shard
from attestry.llm.storage import stored


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append(text or "")
    load, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        assert r["text_crc32"] in [zlib.crc32(t.encode()) for t in texts[r["doc_id"]]]
        assert r["size"] in [len(t.encode()) + 1 for t in texts[r["doc_id"]]]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return load


def test_near_equal_sizes_and_whole_groups(spark):
    docs = [(i, f"text {i} " * (i % 50)) for i in range(4000)]
    docs += [(5000 + i, "a group of copies " * 20) for i in range(300)]  # less than a shard: stays whole
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = shard.assign_shards(df, 8).collect()
    load = check(rows, docs, 8)
    assert max(load) - min(load) < 0.01 * sum(load)
    assert len({r["shard"] for r in rows if r["doc_id"] >= 5000}) == 1
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {
        (r["doc_id"], r["shard"], r["slot"]) for r in shard.assign_shards(df.repartition(7), 8).collect()
    }


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_a_group_of_a_third_of_all_rows(spark, shards):
    docs = [(i, "the same text again " * 9 if i % 3 else f"text number {i} " * 12) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    load = check(shard.assign_shards(df, shards).collect(), docs, shards)
    assert max(load) - min(load) < 0.02 * sum(load)


def test_many_empty_rows_without_an_id_are_split(spark):
    docs = [(None, None) if i % 3 else (i, f"text number {i} " * 9) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    load = check(shard.assign_shards(df, 8).collect(), docs, 8)
    assert max(load) - min(load) < 0.02 * sum(load)
    rows = shard.keyed_rows(df).cache()
    assert len(shard.heavy_groups(rows, 1e9, shard.LIGHT_ROWS)) == 1
    assert rows.where("doc_id is null").select("_spread").distinct().count() == 2000


def test_few_samples_are_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(shard, "SAMPLE", 3)
    docs = [(i, "x" * (i * 37 % 1000)) for i in range(3000)]
    load = check(shard.assign_shards(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect(), docs, 8)
    assert max(load) - min(load) < 0.01 * sum(load)


def test_awkward_rows(awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check(shard.assign_shards(awkward, 4).collect(), docs, 4)
    assert shard.assign_shards(nothing, 8).count() == 0


def test_short_lists_need_no_python_process(spark, monkeypatch):
    """Lists of the plan go to the executors as Arrow data; parallelized rows would be unpickled by further processes."""
    docs = [(i, "one text again " * 9 if i % 3 else f"text number {i} " * 12) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")

    def refused(*args, **kwargs):
        raise AssertionError("rows are sent through Python")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    check(shard.assign_shards(df, 3).collect(), docs, 3)


def test_ranges_are_looked_up_once(spark, monkeypatch):
    """A task that looks up ranges runs one Python process, not a second one that only tests them for null."""
    plans = []

    def seen(df, name, *files):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, *files)

    monkeypatch.setattr(shard, "stored", seen)
    docs = [(i, f"text number {i} " * 12) for i in range(300)]
    check(shard.assign_shards(spark.createDataFrame(docs, "doc_id long, text string"), 3).collect(), docs, 3)
    assert any("range_of" in plan for plan in plans)
    for plan in plans:
        for branch in plan.split("Scan parquet"):
            assert branch.count("ArrowEvalPython") <= 1, plan
