import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from attestry.llm import neardup, storage
from attestry.llm.bloom import lookup
from attestry.llm.graph import connected_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_force(rows, width, percent):
    sets = [shingles(text, width) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((doc, len(sets[i]), least[root(i)], doc == least[root(i)]) for i, (doc, _) in enumerate(rows))


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_same_groups_as_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for size in (4, 6, 7, 8, 9, 12, 40, 150):
        for _ in range(2):
            base = " ".join(f"w{rng.randrange(400)}" for _ in range(size))
            texts += [base] + [varied(rng, base, rng.randrange(0, 2 + size // 12)) for _ in range(10)]
            texts += [base + " tail", base.rsplit(" ", 1)[0], base.upper(), f"  {base}\n"]
    texts += ["common pair " + str(i) for i in range(40)] + ["one"] * 3 + ["", None]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted(map(tuple, neardup.near_duplicates(df, width=2).collect()))
    assert found == brute_force(rows, 2, 80)


def test_links_that_no_star_holds(spark):
    """Members far from the centre but near each other are still linked."""
    rng = random.Random(11)
    base = " ".join(f"w{i}" for i in range(200))
    rows = [base] + [varied(rng, base, 3) for _ in range(20)]
    for _ in range(6):
        far = varied(rng, base, 16)
        rows += [far, varied(rng, far, 4)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(df, width=2).collect())) == brute_force(rows, 2, 80)


def test_awkward_rows(awkward):
    found = [tuple(r) for r in neardup.near_duplicates(awkward, width=5).collect()]
    assert len(found) == awkward.count()
    by_id = {}
    for doc, n, component, kept in found:
        by_id.setdefault(doc, []).append((n, component, kept))
    assert by_id[1] == [(6, 1, True)] * 2 and by_id[2] == [(6, 1, False)]
    assert by_id[3] == by_id[5] == [(0, 3, True)] or by_id[3] == [(0, 3, True)] and by_id[5] == [(0, 5, True)]
    assert sorted(by_id[None]) == [(0, None, True), (4, None, True)]
    assert by_id[9] == [(1, 9, True)]


def test_no_rows(nothing):
    assert neardup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("columns", [1, 7, 4096])
def test_shared_counts(monkeypatch, columns):
    monkeypatch.setattr(neardup, "COLUMNS", columns)
    rng = np.random.RandomState(3)
    sides = [[np.unique(rng.randint(0, 60, rng.randint(0, 40))).astype(np.uint64) for _ in range(9)] for _ in range(2)]
    expected = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert neardup.shared_counts(*sides).tolist() == expected
    assert neardup.shared_counts([], sides[1]).shape == (0, 9)


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(1)
    for size in (8, 30, 2000):
        values = np.unique(rng.randint(0, 2**62, 2 * size).astype(np.uint64) * np.uint64(3))
        one, two = np.sort(values[: int(size * 0.9)]), np.sort(values[int(size * 0.1) : size])
        lines = neardup.signatures(np.concatenate((one, two)), np.array([0, len(one), len(one) + len(two)]))
        true = len(np.intersect1d(one, two)) / size
        assert abs((lines[0] == lines[1]).mean() - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r["node"]: r["label"] for r in found}
    assert len({label[i] for i in range(31)}) == 1 and len({label[i] for i in range(100, 160)}) == 1
    assert label[0] != label[100] and len(label) == 31 + 60
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_pairs_of_a_bucket_far_from_its_centre(spark, monkeypatch):
    """Many documents share most of their text, and meet in one bucket only; pairs among them are linked."""
    monkeypatch.setattr(neardup, "BANDS", 1)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(201)]

    def band(words):
        _, value, offsets = next(neardup.shingle_sets(pa.array([" ".join(words)]), 2))
        return tuple(neardup.signatures(value, offsets)[0, : neardup.ROWS])

    def drawn(make):
        return next(words for words in iter(make, None) if band(words) == hot)

    hot = band(passage)
    texts = []
    for at in range(40):
        words = drawn(lambda: passage + [f"own{rng.randrange(10**9)}" for _ in range(100)])
        texts.append(" ".join(words))
        if at % 5 == 0:
            copy = drawn(lambda words=words: passage + varied(rng, " ".join(words[201:]), 7).split())
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()))
    expected = brute_force(rows, 2, 80)
    assert sum(not kept for *_, kept in expected) >= 8 and found == expected


def test_groups_of_one_cluster_are_compared_once(spark):
    """A bucket whose groups lie in one cluster was compared there; buckets of several clusters are looked at."""
    shared = [(key, node, 50, 3) for key, nodes in ((1, (1, 2, 3)), (2, (1, 2, 4)), (3, (1, 5, 6))) for node in nodes]
    shared = spark.createDataFrame(shared, "key long, node long, n long, size long")
    centers = spark.createDataFrame([(key, 0, 1, 50) for key in (1, 2, 3)], "key long, lead int, a long, m long")
    labels = [(1, 1, 1), (2, 2, 1), (3, 2, 1), (4, 4, 4)]
    labels = spark.createDataFrame(labels, "node long, label long, part long")
    found = neardup.mixed_buckets(shared, centers, labels, 80).select("cluster", "node", "label", "part").collect()
    assert sorted(map(tuple, found)) == [(2, 1, 1, 1), (2, 2, 2, 1), (2, 4, 4, 4), (3, 1, 1, 1), (3, 5, 5, 5), (3, 6, 6, 6)]


def test_a_block_of_near_copies_needs_little_memory():
    """Every set is linked with every other: memory follows the tiles, not the block's pairs."""
    base = np.arange(100, dtype=np.uint64)
    sets = [np.append(base, np.uint64(1000 + i)).tobytes() for i in range(2500)]
    rows = pd.DataFrame({"node": range(2500), "label": np.arange(2500) % 50 // 49, "left": True, "right": True, "set": sets})
    tracemalloc.start()
    found = neardup.block_links(rows, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and peak < 40e6


def test_sets_and_buckets_take_one_python_process_a_task(spark):
    """The filter is looked up where the sets and keys are made: no second Python node in the stage."""
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (None, "i j k"), (4, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(7, 1), (8, 4)], "node long, doc_id long")
    sets = neardup.class_sets(wanted, docs, 2)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert {r["doc_id"]: len(r["set"]) for r in sets.collect()} == {1: 24, 4: 0}


def test_lookup_keeps_every_row_of_the_ids(spark):
    ids = spark.range(-500, 500)
    batch = pa.RecordBatch.from_arrays([pa.array([*range(-2000, 2000), None])], ["id"])
    left = lookup(ids)(batch).column(0).to_pylist()
    assert set(range(-500, 500)) <= set(left) and len(left) < 1100
    assert lookup(ids.where("false"))(batch).num_rows == 0


def test_small_tables_are_few_files(spark, monkeypatch, tmp_path):
    """Files follow the documents, not the partitions of a shuffle, and the result is the same."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        rng = random.Random(i // 4)
        text = [rng.choice(words) for _ in range(60)]
        text[i % 4 * 3] = f"own{i}"
        rows.append((i, " ".join(text)))
    wanted = brute_force(rows, 2, 80)
    assert any(not kept for *_, kept in wanted)
    monkeypatch.setattr(storage, "shared_dir", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    parts, coalesce = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(parts), spark.conf.get(coalesce)
    spark.conf.set(parts, "40")
    spark.conf.set(coalesce, "false")
    try:
        found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2, 80)
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect())
    finally:
        spark.conf.set(parts, before[0])
        spark.conf.set(coalesce, before[1])
    assert got == wanted
    files = {p.name: len(list(p.glob("part-*"))) for p in tmp_path.iterdir()}
    assert len(files) > 20 and max(files.values()) <= 3, files
