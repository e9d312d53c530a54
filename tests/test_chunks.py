from pyspark.sql import functions as F

from attestry.sources import segments
from attestry.operators import chunks as ops
from attestry.sources.segments import concat_segments


def windows(length):
    """Windows of 1000 characters, 800 apart."""
    if length == 0:
        return []
    found, start = [], 0
    while True:
        end = min(start + 1000, length)
        found.append((start, end))
        if end == length:
            return found
        start += 800


LENGTHS = [0, 1, 799, 800, 801, 999, 1000, 1001, 1799, 1800, 1801, 2600, 2601, 12345]


def test_windows_tile_every_length(frame):
    texts = {n: ("äb𝒳d" * (n // 4 + 1))[:n] for n in LENGTHS}
    df = frame([(n, t) for n, t in texts.items()], "doc_id int, text string")
    found = {}
    for r in ops.chunk_documents(df).orderBy("doc_id", "idx").collect():
        found.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"]))
        assert texts[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"]
        assert len(found[r["doc_id"]]) == r["idx"] + 1
    assert found == {n: windows(n) for n in LENGTHS if n}


def test_windows_never_cross_a_heading(frame):
    text = "# A\n" + "x" * 1500 + "\n# B\n" + "y" * 10
    rows = ops.chunk_documents(frame([(1, text)], "doc_id int, text string")).orderBy("idx").collect()
    assert [r["text"][:3] for r in rows] == ["# A", "xxx", "# B"]
    assert [r["idx"] for r in rows] == [0, 1, 2]


def test_pages_are_inherited(frame):
    pages = frame([("d", 1, "a" * 50), ("d", 2, "b" * 1200), ("d", 3, "")], "doc string, page int, text string")
    placed = concat_segments(pages, ["doc"], "page", "")
    rows = ops.chunk_segments(placed, "doc", "page").orderBy("idx").collect()
    assert [(r["idx"], r["page"], r["char_start"], r["char_end"]) for r in rows] == [
        (0, 1, 0, 50),
        (1, 2, 50, 1050),
        (2, 2, 850, 1250),
    ]


def test_dedupe_is_per_corpus(frame):
    df = frame(
        [(1, "a", "h"), (2, "a", "h"), (3, "b", "h"), (4, "a", "k")],
        "doc_id int, corpus_id string, content_hash string",
    )
    assert {r["doc_id"] for r in ops.dedupe_documents(df).collect()} == {1, 3, 4}
    stored = df.where("doc_id = 1")
    assert {r["doc_id"] for r in ops.new_documents(df, stored).collect()} == {3, 4}


def test_highlight_is_clamped(frame):
    docs = frame([(1, "ab𝒳def")], "doc_id int, text string")
    spans = frame([(1, 2, 4), (1, -3, 1), (1, 5, 99), (1, 9, 2)], "doc_id int, span_start long, span_end long")
    found = {
        (r["span_start"], r["span_end"]): (r["before"], r["marked"], r["after"])
        for r in ops.highlight_span(docs, spans).collect()
    }
    assert found == {
        (2, 4): ("ab", "𝒳d", "ef"),
        (-3, 1): ("", "a", "b𝒳def"),
        (5, 99): ("ab𝒳de", "f", ""),
        (9, 2): ("ab𝒳def", "", ""),
    }


def test_scope(frame):
    docs = frame(
        [(1, "a", "f1", 3), (2, "a", "f2", 1), (3, "b", "f3", 2)],
        "doc_id int, corpus_id string, filename string, ingested_at int",
    )
    runs = frame(
        [("i", "a", "initial", None), ("u", "a", "update", 1)],
        "run_id string, corpus_id string, kind string, triggering_document_id int",
    )
    near = frame([("u", 2, 1)], "run_id string, doc_id int, position int")
    found = ops.run_scope(docs, runs, near).select("run_id", "doc_id").collect()
    assert {tuple(r) for r in found} == {("i", 1), ("i", 2), ("u", 1), ("u", 2)}
    order = ops.initial_scope(docs, runs).orderBy(F.col("ingested_at")).collect()
    assert [r["doc_id"] for r in order] == [2, 1]


def test_control_characters_stay_in_their_segment(spark):
    text = "a\x01b\n# H\x01\n\x01\x02c\x03\n# \x02\nd\x01\x03"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = segments.segment_by_heading(df).orderBy("seg").collect()
    assert [p["text"] for p in parts] == ["a\x01b\n", "# H\x01\n\x01\x02c\x03\n", "# \x02\nd\x01\x03"]
    assert all(text[p["char_start"] : p["char_end"]] == p["text"] for p in parts)
