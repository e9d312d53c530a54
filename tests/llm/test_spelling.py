import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from attestry.llm import spelling
from attestry.llm.spelling import checksums, letters, roots, spelling_variants
from attestry.llm.words import Words

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(rows, damaged):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damaged and h % damaged == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, damaged):
    words = plain_words(rows, damaged)
    forms, found = {}, {}
    for word, n in words.items():
        around = [w for w in words if near(w, word)]
        best = min(around, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
        found[word] = (n, len(around))
    out = set()
    for word, (n, n_near) in found.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.add((word, forms[word], root, n, n_near, words[forms[word]] if forms[word] else None))
    return out


def rows_of(found):
    rows = found.collect()
    out = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("damaged", [97, 5, None])
def test_random_words_against_brute_force(spark, damaged):
    rng = random.Random(damaged)
    stems = ["aabbb", "abbbb", "couleur", "naïveté", "ÀÉîöû", "banana", "mississippi", "aaaaa", "aaaaaa"]
    texts = []
    for doc_id in range(60):
        words = []
        for _ in range(40):
            word = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(word) + 1)
                word = rng.choice([word[:at] + rng.choice("abés") + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice("abÀ") + word[at + 1 :]])
            words.append(rng.choice([word, word.upper(), word.title()]))
        texts.append((rng.choice([doc_id, None, -doc_id]), rng.choice([" ", "-", "1", "ĀŁ", "̀"]).join(words)))
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    expected = plain(texts, damaged)
    assert rows_of(spelling_variants(documents, damaged)) == expected
    assert any(f for _, f, *_ in expected) and len(expected) > 20


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rows_of(spelling_variants(awkward)) == plain(rows, 97)


def test_empty_table(nothing):
    assert spelling_variants(nothing).count() == 0


def test_no_join_collects_words_for_a_broadcast(spark, monkeypatch):
    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    kept = spelling.stored
    monkeypatch.setattr(spelling, "stored", lambda df, name, **more: kept(planned(df), name, **more))
    text = "banana banana banana banana banana banana banena banena banena"
    found = planned(spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), None))
    assert {(r["word"], r["root"]) for r in found.collect()} == {("banana", "banana"), ("banena", "banana")}
    assert sum(plan.count("SortMergeJoin") for plan in plans) >= 5
    assert not [plan for plan in plans if "Broadcast" in plan]


def test_chains_end_at_the_last_form(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(50)] + [("x", "y")]
    found = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w050" if w != "x" else "y" for w, _ in chain}


def test_checksums_of_runs():
    text = "Été ÀÁ zebra ÿ x naïve Ā Ærø÷×"
    raw = np.frombuffer(text.encode(), np.uint8)
    from attestry.llm.spelling import LETTER

    single, bounds = letters(raw, np.array([0, 0, len(raw)]))
    words = Words(single, bounds, LETTER)
    runs = [r.translate(LOWER) for r in RUN.findall(text)]
    assert [words.word(i).decode("latin-1") for i in range(len(words.starts))] == runs
    assert checksums(words, ["", "-17"]).tolist() == [zlib.crc32(f"-17:{r}".encode()) for r in runs]
