import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import packing
from attestry.llm.packing import best_configuration, best_fit, pack_documents, plan_sequences, sequences, slots

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(found, documents, tokenizer, capacity):
    """Pieces are the documents' ids in order, cut only where they must be, and lie in sequences without gaps."""
    expected = Counter()
    for doc_id, text in documents:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    rows = found.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        reach = 0
        for offset, length in sorted(pieces):
            assert offset == reach
            reach += length
        assert reach <= capacity
    return len(held)


def test_awkward_rows(awkward, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    packed = pack_documents(awkward, PATH, with_ids=True)
    assert check(packed, texts, tokenizer, 2048) == -(-packed.agg({"length": "sum"}).first()[0] // 2048)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64])
def test_small_capacities(spark, tokenizer, capacity):
    words = ["the", "naïve", "ＦＵＬＬ", "don't", "<|endoftext|>", "x" * 40, "12 34", "é", " ", "\x1c", "日本", "a\x01b", "\x01", "\u0308x", "ΑΣ"]
    texts = [(i, " ".join(words[j % len(words)] for j in range(i, 3 * i))) for i in range(30)] + [(None, None), (None, ""), (3, " \n")]
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    check(pack_documents(documents, PATH, capacity), texts, tokenizer, capacity)


def test_forgotten_words_are_tokenized_again(awkward, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    words = packing.WordTokens(PATH)
    for text in (["ab", "abc"], ["abcd", "ab", "\x01"], ["x"], ["ab", "a\x01 \x01b"]):
        ids, begins, sizes = words.of(text)
        assert [ids[b : b + n].tolist() for b, n in zip(begins, sizes)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in text]


def test_sequences_hold_the_ids(awkward, tokenizer):
    packed = pack_documents(awkward, PATH, with_ids=True).cache()
    ids = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in packed.collect():
        assert ids[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, ids.values())) == packed.agg({"length": "sum"}).first()[0]
    packed.unpersist()


def test_empty_table(nothing):
    assert pack_documents(nothing, PATH).count() == 0


def test_one_length_with_a_third_of_all_rows(spark, tokenizer):
    texts = [(i, "one two three" if i % 3 else " ".join(["word"] * (i % 50))) for i in range(3000)]
    packed = pack_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(7), PATH, 100)
    total = packed.agg({"length": "sum"}).first()[0]
    assert check(packed, texts, tokenizer, 100) <= total / 100 * 1.01 + 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1), st.integers(40, 60))
def test_plans(counts, capacity):
    lengths = np.array(sorted(counts), dtype=np.int64)
    numbers = np.array([counts[x] for x in sorted(counts)], dtype=np.int64)
    plan, bound = plan_sequences(lengths, numbers, capacity, rounds=120)
    used = Counter()
    for held, number in plan:
        assert number > 0 and sum(x * n for x, n in held.items()) <= capacity
        for x, n in held.items():
            used[x] += n * number
    assert used == counts
    total = sum(number for _, number in plan)
    assert bound - 1e-6 <= total <= sum(n for _, n in best_fit(lengths, numbers, [], capacity))
    table = slots(plan)
    for x, part in table.groupby("length"):
        assert part["first"].is_monotonic_increasing and part["first"].iloc[0] == 0


@pytest.mark.parametrize(
    ("counts", "most"), [({3: 1000, 4: 1000, 5: 1000, 8: 1000, 9: 1000, 11: 1000}, 2005), ({5: 3000, 6: 2000, 7: 1000, 8: 1500, 13: 500}, 2640)]
)
def test_configurations_beat_best_fit(counts, most):
    lengths, numbers = np.array(list(counts)), np.array(list(counts.values()))
    plan, bound = plan_sequences(lengths, numbers, 20)
    total = sum(n for _, n in plan)
    assert bound <= total <= most < sum(n for _, n in best_fit(lengths, numbers, [], 20))


def test_knapsack_against_all_choices():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 12, 4))
        weights = rng.random(len(lengths))
        best = [0.0] * 25
        for room in range(1, 25):
            best[room] = max([best[room - 1]] + [best[room - x] + w for x, w in zip(lengths, weights) if x <= room])
        chosen, worth = best_configuration(lengths, weights, 24)
        assert abs(worth - best[24]) < 1e-9 and sum(lengths[i] * n for i, n in chosen.items()) <= 24
        assert abs(sum(weights[i] * n for i, n in chosen.items()) - worth) < 1e-9
