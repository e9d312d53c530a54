import json
import re

import pytest
from pyspark.sql import functions as F

from attestry.sources import export
from attestry.sources.files import file_kind, read_files, scan_documents, split_admission
from attestry.sources.segments import (
    concat_segments,
    csv_parts,
    joined_text,
    json_parts,
    segment_by_heading,
    segment_csv_rows,
    segment_json_elements,
)

HEADED = [
    "# Overview\n\ntext\n\n# Requirements\n\n## Non-goals\nx\n",
    "no heading\nat all",
    "",
    "intro\n# A\nx\n#B\n# \n# C",
    "# \n# swallowed\ntext",
    "#\tTab\r\n# Next",
    "##  two\n #  indented\n# nbsp",
    "# one\n\n\n# two",
    "a # not a line start",
    "#\n\nword after blank lines\n# end",
    "\n".join(f"# {i}\nx" for i in range(1500)),
]


def split_by_regex(text):
    starts = [m.start() for m in re.finditer(r"^#\s+\S.*$", text, re.MULTILINE)]
    if not starts:
        return [(0, len(text))]
    bounds = starts if starts[0] == 0 else [0, *starts]
    bounds = [*bounds, len(text)]
    return list(zip(bounds, bounds[1:]))


def test_headings_match_the_line_rule(frame):
    df = frame(list(enumerate(HEADED)), "doc_id int, text string")
    found = {}
    for r in segment_by_heading(df).orderBy("doc_id", "seg").collect():
        found.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"]))
        assert HEADED[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"]
    assert found == {i: split_by_regex(t) for i, t in enumerate(HEADED)}


def test_csv_and_json_parts():
    csv = "id,title,status,owner\nT-1,Add export,in_progress,priya\nT-2,short\n"
    assert csv_parts(csv)[0] == "id: T-1\ntitle: Add export\nstatus: in_progress\nowner: priya"
    assert csv_parts(csv)[1] == "id: T-2\ntitle: short"
    assert csv_parts("a,b\n") == [] and csv_parts("") == []
    assert json_parts('[{"a": 1}, "ü"]') == ['$[0]\n{\n  "a": 1\n}', '$[1]\n"ü"']
    assert [p.split("\n")[0] for p in json_parts('{"a":{"x":1},"b":{"y":2}}')] == ["$.a", "$.b"]
    assert json_parts("3") == ["$\n3"]
    assert json_parts("{broken") == []


def test_part_offsets_point_into_the_joined_text(frame):
    files = frame([(1, 'h,k\n"a\nb",2\nc,3\n'), (2, "h\n")], "doc_id int, text string")
    parts = segment_csv_rows(files)
    whole = {r["doc_id"]: r["text"] for r in joined_text(parts, ["doc_id"], "seg", "\n\n").collect()}
    rows = parts.collect()
    assert len(rows) == 2
    for r in rows:
        assert whole[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"]
    elements = segment_json_elements(frame([(1, json.dumps({"a": 1, "b": [2]}))], "doc_id int, text string"))
    assert elements.count() == 2


@pytest.mark.parametrize("separator,skip", [("", False), ("\n", True), ("\n\n", False)])
def test_concat_segments(frame, separator, skip):
    texts = ["one", " \n\t", "", "𝒳 four", "five "]
    parts = frame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)], "doc int, pos int, text string")
    kept = [t for t in texts if t.strip()] if skip else texts
    whole = separator.join(kept)
    placed = concat_segments(parts, ["doc"], "pos", separator, skip).collect()
    assert len(placed) == 2 * len(kept)
    for r in placed:
        assert whole[r["char_start"] : r["char_end"]] == r["text"]
    joined = joined_text(parts, ["doc"], "pos", separator, skip).collect()
    assert [r["text"] for r in joined] == [whole, whole]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.MD").write_bytes("# Ü\r\nx\ry".encode())
    (tmp_path / "b.exe").write_bytes(b"MZ")
    (tmp_path / "c.pdf").write_text("just text")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "e.docx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "h").write_text("none")
    (tmp_path / "i.txt").write_bytes(b"%PDF-1.7")
    (tmp_path / "j.tar.json").write_text("[1]")
    files = read_files(spark, str(tmp_path))
    accepted, rejected = split_admission(files)
    assert {r["filename"] for r in accepted.collect()} == {"a.MD", "d.pdf", "e.docx", "j.tar.json"}
    reasons = {r["filename"]: r["reason"] for r in rejected.collect()}
    assert reasons["b.exe"] == reasons["h"] == "unsupported extension"
    assert reasons["c.pdf"] == reasons["f.txt"] == reasons["i.txt"] == "content does not match extension"
    texts = {r["filename"]: r for r in scan_documents(files).collect()}
    assert texts["a.MD"]["text"] == "# Ü\nx\ny"
    assert texts["a.MD"]["mime_type"] == "text/markdown"


def test_an_empty_file_passes(frame):
    df = frame([("/x/g.csv", bytearray()), ("/x/g.pdf", bytearray())], "path string, content binary")
    accepted, rejected = split_admission(df)
    assert accepted.count() == 2 and rejected.count() == 0
    assert [r["text"] for r in scan_documents(df).collect()] == [""]


def test_extension_rules(frame):
    names = {"/x/.md": "", "/x/a.md": ".md", "/x/a.b.TXT": ".txt", "/x.md/plain": "", "/x/a.": ""}
    df = file_kind(frame([(p,) for p in names], "path string"))
    assert {r["path"]: r["extension"] for r in df.collect()} == names


FIELDS = "feature_key string, fields struct<status:string,name:string,extra:string,open_risks:array<string>>"


def test_export_lines_and_file(spark, tmp_path):
    rows = [
        ("a", ("x", 'say "hi", all', None, ["r1", "r2"])),
        ("b", (None, "line\nbreak", "e", [])),
    ]
    df = spark.createDataFrame(rows, FIELDS)
    assert export.csv_header(df) == "feature_key,name,status,open_risks,extra"
    lines = [r["line"] for r in export.register_export_csv(df).orderBy("feature_key").collect()]
    assert lines == ['a,"say ""hi"", all",x,r1; r2,', 'b,"line\nbreak",,,e']
    export.write_register_csv(df.where(F.col("feature_key") == "a"), str(tmp_path / "out"))
    part = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert part.read_bytes() == (
        b'feature_key,name,status,open_risks,extra\r\na,"say ""hi"", all",x,r1; r2,\r\n'
    )


def test_export_file_is_the_lines(spark, tmp_path):
    rows = [(f"k{i:03}", (" lead ", f"cr\rlf\n{i}", "tail\t", [" a"])) for i in range(50)]
    df = spark.createDataFrame(rows, FIELDS).repartition(5)
    export.write_register_csv(df, str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    lines = [r["line"] for r in export.register_export_csv(df).orderBy("feature_key").collect()]
    expected = "".join(f"{line}\r\n" for line in [export.csv_header(df), *lines])
    assert b"".join(p.read_bytes() for p in parts) == expected.encode()
