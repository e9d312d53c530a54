import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from attestry.llm.storage import stored

SMALL = "/root/testdata/sf0.001"


def keep_all(stage):
    return dict(pipeline.STAGES)[stage]


def test_every_stage_keeps_the_columns_and_the_clean(spark, awkward):
    docs = awkward
    for name, stage in pipeline.STAGES:
        after = stored(stage(spark, docs, SMALL), name)
        if name != "shards":
            assert after.columns == docs.columns
        docs = after
    assert set(awkward.columns) <= set(docs.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").distinct().collect())
    # Without letters: 3, 4, 5, 8 and a null row. Copies: the second 1, and 2. The mixture may leave some out.
    assert {i for null, i in ids if not null} <= {1, 6, 7, 9, -10}


def test_language_stage(spark, awkward):
    after = keep_all("language")(spark, awkward, SMALL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == [
        (False, -10), (False, 1), (False, 1), (False, 2), (False, 6), (False, 7), (False, 9), (True, 0),
    ]


def test_near_duplicate_stage(spark, awkward):
    after = keep_all("near-duplicates")(spark, awkward, SMALL).collect()
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == [-10, 1, 3, 4, 5, 6, 7, 8, 9]
    assert sum(r["doc_id"] is None for r in after) == 2


def test_mixture_stage_repeats_whole_rows(spark):
    rows = [(i, f"words of {i} " * (i % 7 + 1), "en", "s1" if i % 10 else "s2", 3) for i in range(300)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = pipeline.mixing.mix_sources(docs).collect()
    copies = {}
    for r in taken:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["taken"] // r["size"]
    after = [tuple(r) for r in keep_all("mixture")(spark, docs, SMALL).collect()]
    assert sorted(after) == sorted(row for row in set(rows) for _ in range(copies[row[0]]))


def test_shard_stage_places_every_row_once(spark, awkward):
    after = keep_all("shards")(spark, awkward, SMALL).collect()
    assert len(after) == awkward.count()
    assert len({(r["shard"], r["slot"]) for r in after}) == len(after)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_no_rows(spark, nothing, name):
    assert keep_all(name)(spark, nothing, SMALL).count() == 0


def test_run_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = pipeline.run(spark, SMALL)
    assert found.columns == [*docs.columns, "shard", "slot"]
    assert 0 < found.count() and found.join(docs, docs.columns, "left_anti").count() == 0


def test_without_a_labelled_row_texts_with_letters_stay(spark, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    after = keep_all("language")(spark, docs, SMALL)
    assert after.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after.collect()) == [
        (False, -10), (False, 1), (False, 1), (False, 2), (False, 6), (False, 7), (False, 9), (True, 0),
    ]
