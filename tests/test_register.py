"""Register build, diff, review and commit on small hand-written tables."""

import datetime as dt
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from attestry import schemas
from attestry.functions.ids import PROPOSAL_NAMESPACE
from attestry.operators import commit, register, review
from attestry.plans import tables

ROWS = (
    "claim_id string, run_id string, corpus_id string, subject string, predicate string, object string,"
    " confidence float, ingested_at timestamp, citations array<struct<chunk_id:string,quote:string,document:string>>"
)
ENTRIES = (
    "entry_id string, corpus_id string, feature_key string,"
    " fields struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>,"
    " version int, last_updated_run_id string, updated_at timestamp"
)
SOURCES = "entry_id string, field string, claim_id string"
OLD, NEW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def row(claim_id, predicate, value, confidence, when=OLD, subject="Export", run="r1"):
    return (claim_id, run, "c", subject, predicate, value, confidence, when, [("k", f"q{claim_id}", "d.md")])


def fields_of(df):
    return {r["feature_key"]: r["fields"].asDict() for r in df.collect()}


def test_winners_and_risks(frame):
    rows = frame(
        [
            row("1", "owner", "Sam", 0.6),
            row("2", "owner", "Alex", 0.9),
            row("3", "target_release", "v1", 0.5, OLD),
            row("4", "target_release", "v2", 0.5, NEW),
            row("6", "status", "b", 0.4),
            row("5", "status", "a", 0.4),
            row("7", "risk", "slow", 0.3),
            row("8", "risk", "slow", 0.7),
            row("9", "risk", "late", 0.5, None),
            row("10", "risk", "late", 0.5, OLD),
            row("11", "note", "best", 0.95, subject="EXPORT!"),
            row("12", "risk", "x", 0.1, subject="Other"),
        ],
        ROWS,
    )
    found = fields_of(register.build_fields(rows))
    assert found["export"] == {
        "name": "EXPORT!",
        "owner": "Alex",
        "target_release": "v2",
        "status": "a",
        "open_risks": ["slow", "late"],
    }
    assert found["other"]["owner"] is None and found["other"]["open_risks"] == ["x"]
    cited = {(r["field"], r["claim_id"]) for r in register.field_citations(rows).where("feature_key = 'export'").collect()}
    assert cited == {
        ("name", "11"),
        ("owner", "2"),
        ("target_release", "4"),
        ("status", "5"),
        ("open_risks", "8"),
        ("open_risks", "10"),
    }
    runs = frame([("r1", "c", "initial")], "run_id string, corpus_id string, kind string")
    additions, _ = register.build_register(rows, runs)
    ids = {r["feature_key"]: r["item_id"] for r in additions.collect()}
    assert ids["export"] == str(uuid.uuid5(uuid.UUID(PROPOSAL_NAMESPACE), "r1:export"))


def test_a_claim_without_source_vanishes(frame):
    claims = frame(
        [("1", "r", "c", "S", "owner", "A", 0.9), ("2", "r", "c", "S", "owner", "B", 0.99)],
        "claim_id string, run_id string, corpus_id string, subject string, predicate string, object string, confidence float",
    )
    sources = frame([("1", "k", "q"), ("1", "k2", "q")], "claim_id string, chunk_id string, quote string")
    chunks = frame([("k", 1), ("k2", 2)], "chunk_id string, doc_id int")
    docs = frame([(1, "a.md", OLD), (2, "b.md", NEW)], "doc_id int, filename string, ingested_at timestamp")
    (only,) = register.claim_rows(claims, sources, chunks, docs).collect()
    assert only["claim_id"] == "1" and only["ingested_at"] == NEW and len(only["citations"]) == 2


def stored(spark, rows):
    """Entries and field sources from committing the features of ``rows``."""
    won = register.winners(rows)
    entries = register.fields_of(won).select(
        register.entry_id().alias("entry_id"),
        *register.FEATURE,
        "fields",
        F.lit(1).alias("version"),
        F.lit("r0").alias("last_updated_run_id"),
        F.lit(OLD).alias("updated_at"),
    )
    return entries, won.select(register.entry_id().alias("entry_id"), "field", "claim_id")


def keys(frame, run, *features):
    return frame([(run, "c", f) for f in features], "run_id string, corpus_id string, feature_key string")


def test_diff_proposes_changes_additions_and_nothing(frame, spark):
    old = [
        row("1", "owner", "Sam", 0.6),
        row("2", "risk", "slow", 0.5),
        row("3", "owner", "Kim", 0.8, subject="Login"),
    ]
    entries, sources = stored(spark, frame(old, ROWS))
    new = [
        *old,
        row("4", "owner", "Alex", 0.9, run="r2"),
        row("5", "risk", "late", 0.4, run="r2"),
        row("50", "risk", "down", 0.3, run="r2"),
        row("6", "owner", "Lee", 0.1, subject="Login", run="r2"),
        row("7", "owner", "New", 0.1, subject="Search", run="r2"),
        row("8", "owner", "Out", 0.99, subject="Untouched", run="r1"),
    ]
    additions, changes, unaffected = register.diff_register(
        frame(new, ROWS), keys(frame, "r2", "export", "login", "search", "gone"), entries, sources
    )
    # a touched feature whose claims lost their sources is still proposed, empty
    assert {r["feature_key"]: r["fields"]["owner"] for r in additions.collect()} == {"search": "New", "gone": None}
    found = {r["field"]: (r["old_value"], r["new_value"], r["claim_id"]) for r in changes.collect()}
    assert found == {
        "name": (["Export"], ["Export"], "4"),
        "owner": (["Sam"], ["Alex"], "4"),
        "open_risks": (["slow"], ["slow", "late", "down"], "5"),
    }
    assert [r["feature_key"] for r in unaffected.collect()] == ["login"]


@pytest.mark.parametrize("mode,again", [("append", {"owner", "name"}), ("replace", set())])
def test_old_sources_stay_unless_replaced(frame, spark, mode, again):
    first = [row("1", "owner", "Sam", 0.6)]
    entries, sources = stored(spark, frame(first, ROWS))
    rows = frame([*first, row("2", "owner", "Alex", 0.9, run="r2")], ROWS)
    additions, changes, _ = register.diff_register(rows, keys(frame, "r2", "export"), entries, sources)
    approved = changes.withColumn("status", F.lit("approved")).withColumn("committed_at", F.lit(NEW))
    none = additions.withColumn("committed_at", F.lit(NEW))
    no_claims = frame([("x", "name", "0")], "item_id string, field string, claim_id string")
    entries, sources = commit.next_snapshot(entries, sources, none, no_claims, approved, mode)
    (entry,) = entries.collect()
    assert entry["version"] == 3 and entry["fields"]["owner"] == "Alex" and entry["updated_at"] == NEW
    assert entry["last_updated_run_id"] == "r2"
    _, later, _ = register.diff_register(rows, keys(frame, "r3", "export"), entries, sources)
    assert {r["field"] for r in later.collect()} == again


CHANGES = (
    "item_id string, run_id string, corpus_id string, feature_key string, entry_id string, field string,"
    " old_value array<string>, new_value array<string>, claim_id string, status string"
)


def change(item, field, new, key="export", run="r2", status="pending"):
    return (item, run, "c", key, "e1", field, ["old"], new, "9", status)


def test_mixed_decisions(frame):
    entries = frame(
        [
            ("e1", "c", "export", ("Export", "Sam", "v1", None, ["slow"]), 1, "r0", OLD),
            ("e2", "c", "login", ("Login", "Kim", None, None, []), 4, "r0", OLD),
        ],
        ENTRIES,
    )
    changes = frame(
        [
            change("i1", "owner", ["Alex"]),
            change("i2", "open_risks", []),
            change("i3", "target_release", ["v9"]),
            change("i4", "status", ["done"], key="missing"),
            change("i5", "status", ["open"]),
        ],
        CHANGES,
    )
    reviews = frame(
        [
            ("register_change", "i1", "reject", "p", OLD),
            ("register_change", "i1", "approve", "p", NEW),
            ("register_change", "i2", "approve", "p", NEW),
            ("register_change", "i3", "reject", "p", NEW),
            ("register_change", "i4", "approve", "p", NEW),
            ("finding", "i5", "approve", "p", NEW),
        ],
        "item_type string, item_id string, decision string, reviewer string, decided_at timestamp",
    )
    decided = review.register_decisions(changes, reviews).withColumn("committed_at", F.lit(NEW))
    assert {r["item_id"]: r["status"] for r in decided.collect()} == {
        "i1": "approved",
        "i2": "approved",
        "i3": "rejected",
        "i4": "approved",
        "i5": "pending",
    }
    after = {r["feature_key"]: r for r in commit.commit_field_changes(entries, decided).collect()}
    assert after["export"]["version"] == 3
    assert after["export"]["fields"].asDict() == {
        "name": "Export",
        "owner": "Alex",
        "target_release": "v1",
        "status": None,
        "open_risks": [],
    }
    assert after["login"]["version"] == 4 and after["login"]["updated_at"] == OLD
    same = commit.untouched_entries(entries, commit.commit_field_changes(entries, decided), decided).collect()
    assert [(r["feature_key"], r["unchanged"]) for r in same] == [("login", True)]
    nothing = frame([("a", "r2", "c", "zzz", "pending")], "item_id string, run_id string, corpus_id string, feature_key string, status string")
    nothing = nothing.withColumn("fields", F.lit(None).cast(entries.schema["fields"].dataType))
    claims = frame([("x", "name", "0")], "item_id string, field string, claim_id string")
    runs = frame([("r2",), ("r7",)], "run_id string")
    events = commit.commit_events(entries, nothing, claims, decided, runs).collect()
    assert sorted((r["run_id"], r["event_type"]) for r in events) == [
        ("r2", "register_field_change_rejected"),
        ("r2", "register_field_change_skipped"),
        ("r2", "register_field_updated"),
        ("r2", "register_field_updated"),
        ("r7", "commit_skipped"),
    ]


def test_an_addition_is_committed_once(frame):
    entries = frame([("e1", "c", "old", ("Old", None, None, None, []), 1, "r0", OLD)], ENTRIES)
    proposals = frame(
        [
            ("a1", "r2", "c", "new", ("New", "A", None, None, []), "approved"),
            ("a2", "r3", "c", "new", ("New", "B", None, None, []), "approved"),
            ("a3", "r2", "c", "old", ("Old", "C", None, None, []), "approved"),
            ("a4", "r2", "c", "no", ("No", "D", None, None, []), "rejected"),
        ],
        "item_id string, run_id string, corpus_id string, feature_key string,"
        " fields struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>, status string",
    )
    (fresh,) = commit.commit_additions(entries, proposals).collect()
    assert fresh["feature_key"] == "new" and fresh["fields"]["owner"] == "A" and fresh["version"] == 1


ADDITIONS = (
    "item_id string, run_id string, corpus_id string, feature_key string,"
    " fields struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>,"
    " status string, committed_at timestamp"
)


def test_the_time_of_a_commit_decides_and_not_its_run_id(frame):
    entries = frame([("e1", "c", "export", ("Export", "Sam", None, None, []), 1, "r0", OLD)], ENTRIES)
    proposals = frame(
        [
            ("a1", "run-9", "c", "new", ("New", "late", None, None, []), "approved", NEW),
            ("a2", "run-10", "c", "new", ("New", "early", None, None, []), "approved", OLD),
        ],
        ADDITIONS,
    )
    (fresh,) = commit.commit_additions(entries, proposals).collect()
    assert fresh["fields"]["owner"] == "early" and fresh["last_updated_run_id"] == "run-10"
    changes = frame(
        [
            (*change("i1", "owner", ["OLD"], run="run-9", status="approved"), OLD),
            (*change("i2", "owner", ["NEW"], run="run-10", status="approved"), NEW),
        ],
        CHANGES + ", committed_at timestamp",
    )
    (after,) = commit.commit_field_changes(entries, changes).collect()
    assert after["fields"]["owner"] == "NEW" and after["last_updated_run_id"] == "run-10"
    assert after["updated_at"] == NEW and after["version"] == 3


@pytest.mark.parametrize("mode", ["append", "replace"])
def test_what_a_commit_refuses_leaves_no_trace(frame, mode):
    entries = frame([("e1", "c", "old", ("Old", None, None, None, []), 1, "r0", OLD)], ENTRIES)
    backing = frame([("e-gone", "owner", "1")], "entry_id string, field string, claim_id string")
    additions = frame(
        [
            ("a1", "r2", "c", "new", ("New", None, None, None, []), "approved", OLD),
            ("a2", "r3", "c", "new", ("New", None, None, None, []), "approved", NEW),
            ("a3", "r2", "c", "old", ("Old", None, None, None, []), "approved", NEW),
        ],
        ADDITIONS,
    )
    claims = frame([(a, "name", a) for a in ("a1", "a2", "a3")], "item_id string, field string, claim_id string")
    changes = frame(
        [(*change("i1", "owner", ["X"], key="gone", status="approved"), NEW)], CHANGES + ", committed_at timestamp"
    )
    after, sources = commit.next_snapshot(entries, backing, additions, claims, changes, mode)
    assert sorted(r["feature_key"] for r in after.collect()) == ["new", "old"]
    assert {(r["field"], r["claim_id"]) for r in sources.collect()} == {("owner", "1"), ("name", "a1")}
    runs = frame([("r2",), ("r3",)], "run_id string")
    events = commit.commit_events(entries, additions, claims, changes, runs).collect()
    assert sorted((r["run_id"], r["event_type"]) for r in events) == [
        ("r2", "register_entry_committed"),
        ("r2", "register_field_change_skipped"),
    ]


def test_decisions_of_one_time_do_not_depend_on_row_order(spark):
    rows = [
        ("finding", "f", "reject", "a", NEW, 1),
        ("finding", "f", "approve", "b", NEW, 2),
        ("finding", "f", "reject", "c", OLD, 3),
    ]
    schema = "item_type string, item_id string, decision string, reviewer string, decided_at timestamp, review_id long"
    for order in (rows, rows[::-1]):
        (found,) = review.latest_decisions(spark.createDataFrame(order, schema).coalesce(1), "finding").collect()
        assert (found["decision"], found["reviewer"]) == ("approve", "b")


def test_conflict_and_finding_decisions(frame):
    conflicts = frame(
        [("x1", "r", "unresolved", None, None), ("x2", "r", "unresolved", None, None), ("x3", "r", "unresolved", None, None)],
        "conflict_id string, run_id string, resolution string, resolved_by string, resolved_at timestamp",
    )
    findings = frame(
        [("f1", "r", "pending", None, None), ("f2", "r", "pending", None, None)],
        "finding_id string, run_id string, status string, reviewer string, reviewed_at timestamp",
    )
    reviews = frame(
        [
            ("r", "conflict", "x1", "approve", "ann", NEW),
            ("r", "conflict", "x2", "reject", "bob", NEW),
            ("r", "finding", "f1", "approve", "ann", NEW),
        ],
        "run_id string, item_type string, item_id string, decision string, reviewer string, decided_at timestamp",
    )
    done = {r["conflict_id"]: (r["resolution"], r["resolved_by"]) for r in review.apply_conflict_decisions(conflicts, reviews).collect()}
    assert done == {"x1": ("kept_both", "human:ann"), "x2": ("rejected_both", "human:bob"), "x3": ("unresolved", None)}
    judged = review.apply_finding_decisions(findings, reviews)
    assert {r["finding_id"]: r["status"] for r in judged.collect()} == {"f1": "approved", "f2": "pending"}
    waiting = review.pending_items(review.apply_conflict_decisions(conflicts, reviews), judged, [])
    assert {r["item_id"] for r in waiting.collect()} == {"x3", "f2"}
    runs = frame([("r",), ("idle",)], "run_id string")
    gate = {r["run_id"]: (r["conflicts"], r["findings"], r["gated"]) for r in review.review_gate(runs, waiting).collect()}
    assert gate == {"r": (1, 1, True), "idle": (0, 0, False)}
    late = frame([("r", "x1", "conflict"), ("r", "x3", "conflict"), ("r", "x3", "finding")], "run_id string, item_id string, item_type string")
    assert {tuple(r) for r in review.invalid_decisions(late, waiting).select("item_id", "item_type").collect()} == {
        ("x1", "conflict"),
        ("x3", "finding"),
    }


def test_winners_match_a_plain_search_with_a_hot_feature(frame):
    chance = random.Random(11)
    rows = []
    for i in range(900):
        subject = chance.choice(["Hot one", "hot ONE", "hot/one"]) if i % 2 else f"Feature {i % 37}"
        predicate = chance.choice(["owner", "target_release", "status", "risk", "note"])
        when = chance.choice([None, OLD, NEW])
        rows.append(row(f"{i:04d}", predicate, f"v{chance.randrange(6)}", chance.choice([0.1, 0.5, 0.9]), when, subject))
    chance.shuffle(rows)

    def trust(r):
        return (-r[6], -(r[7] or dt.datetime.min).timestamp() if r[7] else 1e18, r[0])

    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[^a-z0-9]+", "-", r[3].lower()), []).append(r)
    expected = {}
    for key, members in groups.items():
        ordered = sorted(members, key=trust)
        fields = {"name": ordered[0][3]}
        for field in ("owner", "target_release", "status"):
            fields[field] = next((r[5] for r in ordered if r[4] == field), None)
        fields["open_risks"] = list(dict.fromkeys(r[5] for r in ordered if r[4] == "risk"))
        expected[key] = fields
    assert fields_of(register.build_fields(frame(rows, ROWS))) == expected


def test_enumerated_columns_are_checked(frame):
    df = frame([("r1", "initial", "done"), ("r2", "other", None)], "run_id string, kind string, status string")
    found = {r["column_name"]: (r["rows"], r["invalid"]) for r in schemas.value_check(df, "runs").collect()}
    assert found == {"kind": (2, 1), "status": (2, 1)}
    assert [r["run_id"] for r in schemas.valid_rows(df, "runs").collect()] == ["r1"]
    for text in schemas.SCHEMAS.values():
        assert frame([], text).columns


def test_keys_are_taken_once_per_subject(spark):
    claims = spark.createDataFrame(
        [("c:update", "c", "Feature A"), ("c:update", "c", "feature/a"), ("c:initial", "c", "Feature B")],
        "run_id string, corpus_id string, subject string",
    )
    runs = spark.createDataFrame([("c:update", "update"), ("c:initial", "initial")], "run_id string, kind string")
    found = register.affected_keys(claims, runs)
    assert [tuple(r) for r in found.collect()] == [("c:update", "c", "feature-a")]
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    keyed, grouped = ([i for i, line in enumerate(lines) if word in line] for word in ("regexp_replace", "Aggregate ["))
    assert grouped[-1] > keyed[-1]  # claims are grouped by subject below the step that takes keys


def test_reviews_are_derived_once(spark):
    """Decisions are read back from a table: sent ones and those that were taken need no joins of their own."""
    plan = tables.reviews(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Relation" in plan
