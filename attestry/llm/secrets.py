"""Secrets in texts: fixed patterns, and credentials whose parts are linked.

Patterns find assignments, access identifiers, hex runs, endpoints, and weak candidates: strings
that look like a secret or a user name but are reported only in company. Parts
of one text are joined by interval: a weak candidate is reported when an access identifier or
user part, and an endpoint, both lie within ``scope`` characters of it.

The join is on the text and a bin of ``scope`` characters, with the bins on either side; per
bin, a kind is reduced to its outermost parts, which decide whether any part is near
enough. So no list of parts is paired with another, however many a text holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.storage import stored
from attestry.llm.words import Words, pieces, text_bytes

# The reported kinds in order; an assignment's value and an access identifier have a least length.
KINDS = ("assign", "access", "hex", "weak")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Parts of credentials that mean something only together: user names and endpoints.
USER = re.compile(rb"""(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.IGNORECASE)
ENDPOINT = re.compile(rb"""(?:[A-Za-z][A-Za-z0-9+.-]*)?://[^\s"'<>]+|arn:[A-Za-z0-9:/_.-]+""", re.IGNORECASE)
#: How every match but runs of hex or token characters begins, in lower case. No anchor ends with a letter that
#: another begins with, so none hides another.
ANCHOR = re.compile(rb"passw|secre|toke|api|aki|user|logi|acco|clien|://|arn")
STARTS = {b"p": ASSIGN, b"s": ASSIGN, b"t": ASSIGN, b"u": USER, b"l": USER, b"c": USER, b":": ENDPOINT}
#: Least length of a weak candidate: token characters with a digit and a letter of either case.
WEAK = 20
#: What stands between a name and its value; an equals sign at the end of a run is padding.
SEPARATOR = re.compile(rb"=+(?=[^=])")
SCOPE = 400
PART = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
PART_TYPE = "array<struct<kind: string, start: long, end: long>>"


def byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[np.frombuffer(chars, np.uint8)] = True
    return found


UPPER, LOWER, DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))
HEX = byte_set(DIGITS + b"abcdef")
TOKEN = byte_set(UPPER + LOWER + DIGITS + b"+/_=-")


def anchored(raw: bytes) -> list[tuple[str, int, int]]:
    """Assignments, access identifiers, user names and endpoints, each kind leftmost and without overlap.

    A match can begin only at an anchor, so the patterns are tried nowhere else.
    """
    found, free = [], dict.fromkeys((ASSIGN, ACCESS, USER, ENDPOINT), 0)

    def take(pattern: re.Pattern, at: int) -> re.Match | None:
        match = pattern.match(raw, at) if at >= free[pattern] else None
        if match:
            free[pattern] = match.end()
        return match

    low = raw.lower()
    for anchor in ANCHOR.finditer(low):
        at, first = anchor.start(), anchor.group()[:1]
        for pattern in (ASSIGN, ACCESS, ENDPOINT, USER) if first == b"a" else (STARTS[first],):
            match = take(pattern, at)
            if not match:
                continue
            if pattern is ASSIGN and match.end(2) - match.start(2) >= LEAST["assign"]:
                found.append(("assign", match.start(), match.end()))
            elif pattern is ACCESS and match.end() - match.start() >= LEAST["access"]:
                found.append(("access", match.start(), match.end()))
            elif pattern is USER:
                found.append(("user", match.start(), match.end()))
            elif pattern is ENDPOINT:
                scheme = re.search(rb"[A-Za-z][A-Za-z0-9+.-]*$", raw[max(0, at - 12) : at])
                found.append(("endpoint", at - len(scheme.group()) if scheme else at, match.end()))
    return found


def runs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """Row, kind, start and end of hex runs and of weak candidates, found for many texts at once."""
    hexes = Words(raw, offsets, HEX)
    for at in np.flatnonzero(hexes.ends - hexes.starts >= LEAST["hex"]):
        row = hexes.rows[at]
        yield row, "hex", hexes.starts[at] - offsets[row], hexes.ends[at] - offsets[row]
    tokens = Words(raw, offsets, TOKEN)
    length = tokens.ends - tokens.starts
    for at in np.flatnonzero(length >= WEAK):
        row = tokens.rows[at]
        for start, end in weak_parts(tokens.word(at)):
            yield row, "weak", tokens.starts[at] + start - offsets[row], tokens.starts[at] + end - offsets[row]


def weak_parts(run: bytes) -> list[tuple[int, int]]:
    """Weak candidates of a run: its parts between separators, or the whole run where no part is one."""

    def weak(word: bytes) -> bool:
        return len(word) >= WEAK and all(re.search(kind, word) for kind in (rb"[0-9]", rb"[a-z]", rb"[A-Z]"))

    if not weak(run):
        return []
    cuts = [0, *(x for m in SEPARATOR.finditer(run) for x in m.span()), len(run)]
    parts = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if weak(run[a:b])]
    return parts or [(0, len(run))]


def scan(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``row, doc_id, spans, parts``: what each text holds, in code points; texts stay where they are."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2), lower=False)
            spans, parts = ([[] for _ in range(batch.num_rows)] for _ in range(2))
            for low, high in pieces(offsets):
                bounds = offsets[low : high + 1]
                found: dict[int, list] = {}
                for row, *part in runs(raw[bounds[0] : bounds[-1]], bounds - bounds[0]):
                    found.setdefault(int(row), []).append(part)
                for row in range(high - low):
                    text = raw[bounds[row] : bounds[row + 1]]
                    own = found.get(row, []) + anchored(text.tobytes())
                    if own:
                        points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                    for kind, start, end in own:
                        (spans if kind in LEAST else parts)[low + row].append(
                            {"kind": kind, "start": int(points[start]), "end": int(points[end])}
                        )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(PART)), pa.array(parts, pa.list_(PART))],
                ["row", "doc_id", "spans", "parts"],
            )

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")
    )
    return rows.mapInArrow(parse, f"row long, doc_id long, spans {PART_TYPE}, parts {PART_TYPE}")


def linked_candidates(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, start, end, access_at, endpoint_at`` of weak candidates near both complementary parts.

    ``access_at`` and ``endpoint_at`` name a part that lies near enough.
    """
    every = found.where("size(parts) > 0").select(
        "row", F.explode(F.concat("parts", F.filter("spans", lambda s: s["kind"] == "access"))).alias("part")
    )
    every = every.select("row", "part.*").withColumn("bin", F.floor(F.col("start") / scope))
    side = F.when(F.col("kind").isin("access", "user"), "access").when(F.col("kind") == "endpoint", "endpoint")
    edges = (
        every.withColumn("side", side)
        .where("side is not null")
        .groupBy("row", "bin", "side")
        .agg(F.min("start").alias("least"), F.max("start").alias("most"))
    )
    # The part last in the bin before, any part of the own bin, and the part first in the bin after are the ones that can be near.
    reach = edges.select(
        "row", "side", F.explode(F.array(
            F.struct((F.col("bin") + 1).alias("bin"), F.col("most").alias("at")),
            F.struct(F.col("bin").alias("bin"), F.col("least").alias("at")),
            F.struct((F.col("bin") - 1).alias("bin"), F.col("least").alias("at")),
        )).alias("near"),
    ).select("row", "side", "near.*")
    weak = every.where("kind = 'weak'").select("row", "bin", "start", "end")
    near = weak.join(reach, ["row", "bin"]).where(F.abs(F.col("at") - F.col("start")) <= scope)
    sides = near.groupBy("row", "start", "end").agg(
        F.min(F.when(F.col("side") == "access", F.col("at"))).alias("access_at"),
        F.min(F.when(F.col("side") == "endpoint", F.col("at"))).alias("endpoint_at"),
    )
    return sides.where("access_at is not null and endpoint_at is not null")


def find_secrets(
    documents: DataFrame, scope: int = SCOPE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, spans``: kind, start and end of every reported secret, in order of start, then kind.

    Kinds are those of the fixed patterns, and ``weak`` for linked candidates; a weak candidate that a fixed pattern's
    span covers is not reported again. It has no greatest length, and in ``name=value`` it is the value alone. A null or empty text has no spans. Repeated rows are reported
    each on their own, and so are rows without an id. Other columns are not read.
    """
    found = stored(scan(documents, id_column, text_column), "secret-parts")
    linked = linked_candidates(found, scope)
    # A text's own parts, bounded by its length.
    more = linked.groupBy("row").agg(
        F.collect_list(F.struct(F.lit("weak").alias("kind"), "start", "end")).alias("more")
    )
    joined = found.join(more, "row", "left")
    new = F.filter(
        F.coalesce("more", F.array().cast(PART_TYPE)),
        lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])),
    )
    return joined.select("doc_id", in_order(F.concat("spans", new)).alias("spans"))


def in_order(spans: F.Column) -> F.Column:
    place = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS)), strict=True) for x in pair])
    ranked = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(
        F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    )


def joined_text(spans: F.Column) -> F.Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
