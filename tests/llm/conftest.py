import datetime

import pytest

CLASHING = ["row", "size", "node", "key", "shard", "slot", "spans", "taken", "label", "text_key", "_id", "_text", "held"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows and clashing columns."""
    long_text = " ".join(f"word{i % 977} the of and" for i in range(12_000))
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a"),
        (1, "the cat sat on the mat and the dog ran", "en", "a"),
        (2, "the cat sat on the mat and the dog ran", "en", None),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n", "de", None),
        (None, "der hund und die katze sind im haus", "de", "a"),
        (None, None, None, None),
        (6, "der hund und die katze sind im garten", "de", "c"),
        (7, long_text, None, "a"),
        (8, "1234 5678 !!", "en", "c"),
        (9, "x", "en", "\U0001f600"),
        (-10, "Größe naïve ſecret \U0001f600 token=abcdefgh12", "fr", "é"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, seen timestamp, tags array<string>, "
    schema += ", ".join(f"`{c}` string" for c in CLASHING)
    more = [(r + (5, datetime.datetime(2024, 1, 1), ["x"]) + ("y",) * len(CLASHING)) for r in rows]
    return spark.createDataFrame(more, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
