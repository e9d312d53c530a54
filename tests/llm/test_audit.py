import itertools
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import pyarrow.parquet as pq
import pytest

from attestry.llm import audit
from attestry.llm.audit import ORDERS, failed_filters, filter_audit, term_matrix
from attestry.llm.storage import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_flags(rows):
    texts = [(i, t or "", s) for i, t, s in rows]
    found = []
    for doc_id, text, source in texts:
        words = WORD.findall(text)
        fails = [
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            doc_id is not None and any(i is not None and i < doc_id and t == text for i, t, _ in texts),
        ]
        found.append((doc_id, source, fails))
    return found


def plain_audit(rows, good, toxic):
    flags = plain_flags(rows)
    out = {}
    for part in {s or "" for _, s, _ in flags}:
        own = [(i, f) for i, s, f in flags if (s or "") == part]
        removed_in_all = Counter()
        for order in ORDERS:
            kept = own
            for step, letter in enumerate(order, 1):
                at = "ABCDE".index(letter)
                gone = [(i, f) for i, f in kept if f[at]]
                redundant = sum(f[at] for _, f in own) - len(gone)
                kept = [(i, f) for i, f in kept if not f[at]]
                removed_in_all[letter] += len(gone)
                out[part, order, step] = [
                    len(kept), len(gone), redundant, sum(f[at] and sum(f) == 1 for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for order, (step, letter) in itertools.product(ORDERS, enumerate("ABCDE")):
            out[part, order, order.index(letter) + 1].append(removed_in_all[letter])
    return out


def as_dict(found):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = found.collect()
    by_key = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(by_key) == len(rows)
    return by_key


LABELS = "doc_id long, quality int, toxic int"


def test_awkward_rows_against_brute_force(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)], LABELS)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert as_dict(filter_audit(awkward, labels)) == plain_audit(rows, {1, 7}, {1, 2})


def test_filters_at_their_limits(frame, spark):
    texts = [
        " ".join(f"w{i}" for i in range(200)),
        " ".join(f"w{i}" for i in range(199)),
        " ".join(f"w{i % 100}" for i in range(200)),
        " ".join(f"w{i % 99}" for i in range(200)),
        "A" + "b" * 49,
        "A" + "b" * 48,
        "é" * 49 + "Z",
        "50%",
        " a b\x1cc",
        "The the THE",
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts * 2)] + [(None, texts[0], "s"), (5, "50%", None), (-3, "50%", "t")]
    found = failed_filters(frame(rows, "doc_id long, text string, source string"))
    bits = Counter((i, s, sum(1 << k for k, f in enumerate(fails) if f)) for i, s, fails in plain_flags(rows))
    assert Counter((r["doc_id"], r["source"], r["flags"]) for r in found.collect()) == bits


def test_matrix_holds_every_count(awkward, monkeypatch):
    monkeypatch.setattr(audit, "PART", 50)
    shards, dictionary = term_matrix(awkward)
    numbers = {r["number"]: r["word"] for r in dictionary.collect()}
    assert len(numbers) == dictionary.count() == len(set(numbers.values()))
    found = Counter()
    for shard in shards.collect():
        for at, doc_id in enumerate(shard["doc_ids"]):
            a, b = shard["starts"][at], shard["starts"][at + 1]
            columns = shard["columns"][a:b]
            assert columns == sorted(set(columns))
            found[doc_id, tuple(sorted((numbers[c], n) for c, n in zip(columns, shard["counts"][a:b])))] += 1
    expected = Counter(
        (r["doc_id"], tuple(sorted(Counter(WORD.findall(r["text"] or "")).items()))) for r in awkward.collect()
    )
    assert found == expected


def test_small_blocks_give_the_same(awkward):
    labels = awkward.sparkSession.createDataFrame([], LABELS)
    one = as_dict(filter_audit(awkward.coalesce(1), labels))
    assert one == as_dict(filter_audit(awkward.repartition(17), labels))


def test_empty_tables(nothing, awkward, spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert filter_audit(nothing, labels).count() == 0
    assert sum(v[4] + v[5] for v in as_dict(filter_audit(awkward, labels.where("false"))).values()) == 0


@pytest.mark.parametrize("order", ["ABCDE", "EDCBA"])
def test_zero_rows_are_there(frame, spark, order):
    clean = " ".join(f"w{i}" for i in range(300))
    found = as_dict(filter_audit(frame([(1, clean, "s")], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)))
    assert len(found) == 600 and found["s", order, 5] == [1, 0, 0, 0, 0, 0, 0]


def test_five_filters():
    assert len(ORDERS) == 120 and audit.FILTERS == "ABCDE"


def test_a_row_group_holds_one_block(frame, spark, monkeypatch):
    """A writer would hold 100 blocks before it looks at their size, a reader all blocks of a file."""
    kept = []
    monkeypatch.setattr(audit, "stored", lambda df, name, **more: kept.append(stored(df, name, **more)) or kept[-1])
    texts = [" ".join(f"w{i + n}" for i in range(250_000)) for n in range(5)]
    documents = frame([(n, text, "s") for n, text in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    assert {r["flags"] for r in failed_filters(documents).collect()} == {0}
    (file,) = kept[0].inputFiles()
    groups = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    assert [groups.row_group(i).num_rows for i in range(groups.num_row_groups)] == [1] * 5
