import datetime as dt

from pyspark.sql import functions as F

from attestry.operators import reports

T0 = dt.datetime(2024, 1, 1)


def test_snippets(frame):
    text = "a" * 100 + "QUOTE" + "b" * 100
    df = frame([(1, text, "QUOTE"), (2, text, "absent"), (3, "short", "short"), (4, "x", "")], "i int, text string, quote string")
    shown = df.select("i", *reports.citation_snippet(F.col("text"), F.col("quote"))).collect()
    found = {r["i"]: (r["snippet"], r["highlight_start"], r["highlight_end"]) for r in shown}
    assert found == {
        1: ("a" * 80 + "QUOTE" + "b" * 80, 80, 85),
        2: ("a" * 80, 0, 0),
        3: ("short", 0, 5),
        4: ("x", 0, 0),
    }


EVENTS = "id long, run_id string, event_type string, payload string, occurred_at timestamp"


def event(i, kind, run="r", seconds=0):
    return (i, run, kind, f"p{i}", T0 + dt.timedelta(seconds=seconds))


def test_stage_and_timeline(frame):
    events = frame(
        [
            event(1, "classify_start"),
            event(2, "classify_end"),
            event(3, "extract_start"),
            event(4, "claim_rejected_bad_quote"),
            event(5, "classify_start", "s"),
            event(6, "mystery_end", "s"),
            event(7, "register_entry_proposed", "t"),
        ],
        EVENTS,
    )
    stages = {r["run_id"]: r["stage"] for r in reports.current_stage(events).collect()}
    assert stages == {"r": "extract", "s": "mystery"}
    runs = frame([("r",), ("t",)], "run_id string")
    rows = reports.stage_timeline(runs, events).orderBy("run_id", "position").collect()
    assert len(rows) == 18
    first = {r["stage"]: (r["status"], r["start_payload"], r["end_payload"]) for r in rows if r["run_id"] == "r"}
    assert first["classify"] == ("done", "p1", "p2")
    assert first["extract"] == ("running", "p3", None)
    assert first["commit"] == ("pending", None, None)


def test_audit_is_ordered_by_time_then_id(frame):
    events = frame([event(1, "c", seconds=9), event(3, "b", seconds=5), event(2, "a", seconds=5)], EVENTS)
    assert [r["id"] for r in reports.run_audit(events).collect()] == [2, 3, 1]


def test_budget_is_checked_against_earlier_calls(frame, monkeypatch):
    monkeypatch.setattr(reports, "CALLS_PER_BLOCK", 10)
    calls = [(i, "hot", 10, 5) for i in range(100)] + [(200, "one", 999, 5)]
    found = reports.budget_breaches(frame(calls, "id long, run_id string, micro_usd long, estimate long"), 500)
    assert {r["id"] for r in found.collect()} == set(range(50, 100))
    worst = frame([(0,), (3,), (400,)], "n int").select(reports.worst_case_micro_usd(F.col("n")).alias("w"))
    assert sorted(r["w"] for r in worst.collect()) == [122883, 122883, 123180]


def test_cost_total_is_the_sum_of_stages(frame):
    costs = frame(
        [("r", "extract", 1, 2, 3, 10), ("r", "extract", 1, 2, 3, 5), ("r", "embed", 4, 0, 1, 2)],
        "run_id string, stage string, input_tokens long, output_tokens long, latency_ms long, micro_usd long",
    )
    found = {r["stage"]: (r["calls"], r["micro_usd"], str(r["usd_cost"])) for r in reports.run_cost(costs).collect()}
    assert found == {"extract": (2, 15, "0.000015"), "embed": (1, 2, "0.000002"), None: (3, 17, "0.000017")}


def test_requests_are_idempotent_per_key(frame):
    asked = frame(
        [(1, "a", "k"), (2, "a", "k"), (3, "b", "k"), (4, "a", None), (5, "a", "")],
        "request_id int, corpus_id string, idempotency_key string",
    )
    resolved, conflicts = reports.idempotent_requests(asked)
    assert {(r["request_id"], r["run_request"], r["created"]) for r in resolved.collect()} == {
        (1, 1, True),
        (2, 1, False),
        (4, 4, True),
        (5, 5, True),
    }
    assert [(r["request_id"], r["first_corpus_id"]) for r in conflicts.collect()] == [(3, "a")]


def test_lists(frame):
    corpora = frame(
        [("corpus-one-long", "One", "/in", T0), ("c2", "Two", "/in", T0 + dt.timedelta(1)), ("c3", "Three", None, T0)],
        "corpus_id string, name string, inbox_path string, created_at timestamp",
    )
    assert [r["corpus_id"] for r in reports.corpora_list(corpora).collect()][0] == "c2"
    files = frame([("f", "/in"), ("g", "/other")], "path string, inbox_path string")
    assert [(r["path"], r["corpus_id"]) for r in reports.inbox_owner(files, corpora).collect()] == [("f", "corpus-one-long")]
    runs = frame(
        [("r1", "c2", T0), ("r2", "deleted-corpus", T0 + dt.timedelta(1))],
        "run_id string, corpus_id string, started_at timestamp",
    )
    costs = frame([("r1", 5), ("r1", 7)], "run_id string, micro_usd long")
    listed = reports.runs_list(runs, corpora, costs).collect()
    assert [(r["run_id"], r["corpus"], r["micro_usd"]) for r in listed] == [("r2", "deleted-", 0), ("r1", "Two", 12)]


def test_register_order(frame):
    entries = frame(
        [
            ("e1", "c", "b-key", (None, "zoe", ["x"])),
            ("e2", "c", "z-key", ("apple", "Émile", [])),
            ("e3", "c", "c-key", ("", "adam", ["x", "y"])),
        ],
        "entry_id string, corpus_id string, feature_key string, fields struct<name:string,owner:string,open_risks:array<string>>",
    ).withColumn("fields", F.struct("fields.*", F.lit(None).cast("string").alias("target_release"), F.lit(None).cast("string").alias("status")))
    sources = frame([("e1",), ("e1",), ("e2",)], "entry_id string")

    def order(by, ascending=True):
        return [r["entry_id"] for r in reports.register_sorted(entries, sources, by, ascending).collect()]

    assert order("feature") == ["e2", "e1", "e3"]
    assert order("owner") == ["e3", "e2", "e1"]
    assert order("open_risks", False) == ["e3", "e1", "e2"]
    assert order("sources") == ["e3", "e2", "e1"]


def test_claims_that_nobody_shows_meet_no_text(spark):
    from attestry.plans import tables

    sf_dir = "/root/testdata/sf0.001"
    wanted = tables.field_sources(spark, sf_dir).limit(3)
    shown = tables.cited(spark, sf_dir, of=wanted)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "shuffle_hash" in plan
    ids = {r["claim_id"] for r in wanted.select("claim_id").collect()}
    every = [tuple(r) for r in tables.cited(spark, sf_dir).collect() if r["claim_id"] in ids]
    assert sorted(map(str, every)) == sorted(str(tuple(r)) for r in tables.cited(spark, sf_dir, of=wanted).collect())
