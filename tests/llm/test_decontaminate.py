import random
import re

import pytest

from attestry.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_force(docs, items, window):
    patterns = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            patterns.setdefault(tuple(own[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for size in {len(p) for p in patterns}:
            for i in range(len(own) - size + 1):
                match = patterns.get(tuple(own[i : i + size]))
                if match:
                    hit |= set(range(i, i + size))
                    found |= match
        out.append((doc, len(own), sorted(hit), sorted(found)))
    return out


def positions(hits):
    return sorted({i for h in hits for i in range(h["first"], h["last"] + 1)})


@pytest.mark.parametrize("part_bytes", [2_000_000, 300])
def test_same_hits_as_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    rng = random.Random(2)
    vocabulary = ["a", "b", "Ab", "c9", "é", "ÉE", "日本", "zz"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 16)))) for i in range(40)]
    items += [(5, items[7][1]), (41, items[7][1] + "!"), (42, None), (43, "rare"), (44, "two rare")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(items)[1] or "", rng.choice(["RARE", "two-rare", "..", "x" * 30])]
        docs.append((i, "; ".join(parts)))
    docs += [(60, " ".join(["zz"] * 900 + ["rare"])), (61, None), (62, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_benchmark(df, bench, window=6).collect()}
    for doc, n, hit, listed in brute_force(docs, items, 6):
        assert (found[doc]["n_words"], positions(found[doc]["hits"]), sorted(found[doc]["items"])) == (n, hit, listed)


def test_awkward_rows(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "the mat AND the dog"), (None, "naïve"), (2, None)], "item_id long, text string")
    found = decontaminate.find_benchmark(awkward, bench, carry=True).collect()
    assert len(found) == awkward.count()
    assert sorted((r["doc_id"], len(r["hits"])) for r in found if r["hits"]) == [(-10, 1), (1, 1), (1, 1), (2, 1)]
    assert [r["items"] for r in found if r["doc_id"] == -10] == [[None]]
    assert all(r["row"]["seen"] is not None and r["row"]["row"] == "y" for r in found)
    assert decontaminate.find_benchmark(nothing, bench).count() == 0
    clean = decontaminate.find_benchmark(awkward, bench.where("false")).collect()
    assert len(clean) == awkward.count() and not any(r["hits"] for r in clean)
