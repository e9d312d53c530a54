import base64
import gzip
import hashlib

import pytest

from attestry.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, original string"


def expected(rows, least):
    first = {}
    for page, html in rows:
        first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= least and first[html or ""] != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out)


def flat(captures):
    out = []
    for c in captures.collect():
        fields = dict((f["key"], f["value"]) for f in c["metadata"]["fields"])
        r = c["response"]
        size = r["payload_bytes"] if r["payload_bytes"] is not None else int(fields["fetchedBytes"])
        refers = r["refers_to"] and int(r["refers_to"].rpartition(":")[2][:-1])
        out.append((int(fields["page"]), size, r["payload_digest"], r["record_type"], refers))
        assert c["request"]["record_id"] == f"<urn:page:request:{fields['page']}>"
    return sorted(out)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    tricky = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\n"
    pages = [(5, "same"), (3, "same"), (9, "same"), (1, None), (2, ""), (4, tricky), (6, tricky), (7, "é\U0001f600" * 50_000), (-8, "same text"), (10, "same text")]
    rows = [(p, f"http://x/{p}\r\nInjected: 1" if p % 2 else None, h, "d", "o") for p, h in pages]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    captures = warc.round_trip(df, least)
    assert flat(captures) == expected(pages, least)
    payloads = {int(c["capture"].rpartition(":")[2][:-1]): c["response"]["payload"] for c in captures.collect()}
    assert payloads[7] == pages[7][1].encode() and payloads[4] == tricky.encode()


def test_repeated_and_null_ids(spark):
    rows = [(None, None, "a", "", ""), (1, None, "a", "", ""), (1, None, "a", "", ""), (None, None, "b", "", "")]
    captures = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    kinds = sorted((c["capture"], c["response"]["record_type"], c["response"]["refers_to"]) for c in captures)
    assert kinds == [
        ("<urn:page:capture:1>", "response", None),
        ("<urn:page:capture:1>", "response", None),
        ("<urn:page:capture:>", "response", None),
        ("<urn:page:capture:>", "revisit", "<urn:page:capture:1>"),
    ]


@pytest.mark.parametrize("least", [0, 3])
def test_repeated_ids_with_other_payloads(spark, least):
    pages = [(3, "BBBB"), (5, "A"), (5, "BBBB"), (5, "CCC"), (5, "CCC"), (None, "A"), (None, "long enough"), (None, "BBBB"), (7, None), (7, "x")]
    rows = [(p, f"http://{p}", h, "d", "o") for p, h in pages]
    found = []
    for c in warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), least).collect():
        fields = dict((f["key"], f["value"]) for f in c["metadata"]["fields"])
        r = c["response"]
        size = r["payload_bytes"] if r["payload_bytes"] is not None else int(fields["fetchedBytes"])
        found.append((fields["page"], int(fields["fetchedBytes"]), size, r["payload_digest"], r["record_type"], r["refers_to"]))
    expected = []
    for page, html in pages:
        payload = (html or "").encode()
        ids = [p for p, h in pages if (h or "") == (html or "") and p is not None]
        revisit = len(payload) >= least and len(pages) and bool(ids) and page != min(ids)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = ("revisit", f"<urn:page:capture:{min(ids)}>") if revisit else ("response", None)
        expected.append(("" if page is None else str(page), len(payload), len(payload), digest, *kind))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_and_truncation():
    def record(body):
        return b"WARC/1.0\r\nWARC-Type: response\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)

    bodies = [b"", b"x" * 3_000_000, b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nbody"]
    packed = b"".join(gzip.compress(record(b)) for b in bodies)
    assert [block for _, block in warc.records(packed, 1000)] == bodies
    assert [block for _, block in warc.records(gzip.compress(b"".join(map(record, bodies))))] == bodies
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(gzip.compress(record(b"abc")[:-6])))


def test_requests_of_other_writers(spark):
    rows = [("r1", "response", []), ("q2", "request", ["r1"]), ("q1", "request", ["r1"]), ("lost", "metadata", ["none"]), ("r2", "response", [])]
    df = spark.createDataFrame(
        [(i, k, None, c, None, None, None, {}, None) for i, k, c in rows], warc.RECORDS
    )
    found = {c["capture"]: (c["request"] and c["request"]["record_id"], c["metadata"]) for c in warc.assemble(df).collect()}
    assert found == {"r1": ("q1", None), "r2": (None, None)}


def test_the_query_moves_no_payload_between_records(spark):
    from attestry.llm.queries import QUERIES

    plan = QUERIES["op8_warc"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = [line for line in plan.splitlines() if "MapInArrow" not in line]
    assert len(above) > 3 and not [line for line in above if " payload#" in line]
