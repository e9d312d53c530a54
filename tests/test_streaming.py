import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from attestry.operators import reports
from attestry.session import shared_dir
from attestry.streaming import commit, inbox, keyed, runs
from attestry.streaming.keyed import KeyedLog
from attestry.streaming.sink import newest_per_key

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, run_id string, event_type string, payload string, occurred_at timestamp"


def event(i, kind, run="r"):
    return (i, run, kind, "{}", T0)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_inbox_twice(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    corpora = spark.createDataFrame(
        [("c1", str(box), T0)], "corpus_id string, inbox_path string, created_at timestamp"
    )

    def run():
        inbox.stream_inbox(inbox.read_inbox(spark, str(box)), corpora, out).awaitTermination()

    (box / "a.md").write_text("# A\n" + "x" * 1500)
    (box / "b.csv").write_text("k,v\n1,2\n3,4\n")
    (box / "c.json").write_text('{"a": 1}')
    (box / "bad.exe").write_text("x")
    (box / "report.pdf").write_bytes(b"%PDF-1.7 x")
    (box / "broken.json").write_text('{"a": ')
    (box / "empty.json").write_text("[ ]")
    (box / ".hidden.md").write_text("x")
    run()
    rejects = {r["filename"]: r["reason"] for r in spark.read.parquet(f"{out}/rejects").collect()}
    assert rejects == {
        "bad.exe": "unsupported extension",
        "report.pdf": "no text extraction for this type",
        "broken.json": "content is not JSON",
    }
    assert spark.read.parquet(f"{out}/runs").count() == 4
    assert spark.read.parquet(f"{out}/documents").count() == 4
    chunks = {}
    names = {r["doc_id"]: r["filename"] for r in spark.read.parquet(f"{out}/documents").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{out}/documents").collect()}
    for r in spark.read.parquet(f"{out}/chunks").collect():
        chunks.setdefault(names[r["doc_id"]], []).append(r["idx"])
        assert texts[r["doc_id"]][r["char_start"] : r["char_end"]] == r["text"]
    assert {k: sorted(v) for k, v in chunks.items()} == {"a.md": [0, 1], "b.csv": [0, 1], "c.json": [0]}
    run()
    assert spark.read.parquet(f"{out}/runs").count() == 4
    (box / "again.md").write_text("# A\n" + "x" * 1500)
    (box / "new.txt").write_text("new")
    run()
    # known content starts a run for the document it repeats, and is not stored again
    documents = spark.read.parquet(f"{out}/documents")
    assert sorted(r["filename"] for r in documents.collect()) == ["a.md", "b.csv", "c.json", "empty.json", "new.txt"]
    started = spark.read.parquet(f"{out}/runs").groupBy("triggering_document_id").count()
    by_name = {names.get(r[0], "new"): r[1] for r in started.collect()}
    assert by_name == {"a.md": 2, "b.csv": 1, "c.json": 1, "empty.json": 1, "new": 1}


def test_feed_stops_at_the_end_of_a_run(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        runs.stream_run_events(stream, out).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(f"{out}/feed").collect())

    feed(spark, source, [event(1, "a_start"), event(2, "a_start", "s"), event(3, "a_end")], EVENTS)
    assert run() == [1, 2, 3]
    feed(spark, source, [event(4, "run_completed"), event(5, "late"), event(6, "x", "s")], EVENTS)
    assert run() == [1, 2, 3, 4, 6]
    feed(spark, source, [event(7, "later"), event(8, "run_failed", "s")], EVENTS)
    assert run() == [1, 2, 3, 4, 6, 8]
    assert run() == [1, 2, 3, 4, 6, 8]


def test_live_stage_equals_the_batch_result(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    for rows in ([event(1, "a_start"), event(2, "b_start", "s")], [event(3, "a_end"), event(4, "c_start")]):
        feed(spark, source, rows, EVENTS)
        runs.stream_current_stage(spark.readStream.schema(EVENTS).parquet(source), out).awaitTermination()
        expected = reports.current_stage(spark.read.schema(EVENTS).parquet(source)).collect()
        found = newest_per_key(spark, f"{out}/stage", ["run_id"]).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


COSTS = "run_id string, stage string, input_tokens long, output_tokens long, latency_ms long, micro_usd long"


def test_live_cost_adds_up(spark, tmp_path):
    source, out = str(tmp_path / "costs"), str(tmp_path / "out")
    for n in (1, 2):
        feed(spark, source, [("r", "extract", 1, 1, 1, 10), ("r", "embed", 1, 0, 1, n)], COSTS)
        runs.stream_run_cost(spark.readStream.schema(COSTS).parquet(source), out).awaitTermination()
    found = {r["stage"]: (r["calls"], r["micro_usd"]) for r in newest_per_key(spark, f"{out}/cost", ["run_id", "stage"]).collect()}
    assert found == {"extract": (2, 20), "embed": (2, 3)}


REVIEWS = "item_type string, item_id string, decision string, reviewer string, decided_at timestamp"


def test_commits_are_serial_and_applied_once(spark, frame, tmp_path):
    source, out = str(tmp_path / "reviews"), shared_dir(spark, "commit-test")
    fields = "struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>"
    entries = frame(
        [("e1", "c", "export", ("Export", "Sam", None, None, []), 1, "r0", T0)],
        f"entry_id string, corpus_id string, feature_key string, fields {fields}, version int, last_updated_run_id string, updated_at timestamp",
    )
    field_sources = frame([("e1", "owner", "1")], "entry_id string, field string, claim_id string")
    additions = frame(
        [("a1", "r2", "c", "search", ("Search", None, None, None, []), "pending")],
        f"item_id string, run_id string, corpus_id string, feature_key string, fields {fields}, status string",
    ).withColumn("committed_at", F.lit(T0))
    backing = frame([("a1", "name", "7")], "item_id string, field string, claim_id string")
    changes = frame(
        [
            ("i1", "r2", "c", "export", "e1", "owner", ["Sam"], ["Alex"], "2", "pending"),
            ("i2", "r2", "c", "export", "e1", "status", [], ["done"], "3", "pending"),
        ],
        "item_id string, run_id string, corpus_id string, feature_key string, entry_id string, field string,"
        " old_value array<string>, new_value array<string>, claim_id string, status string",
    ).withColumn("committed_at", F.lit(T0))

    def decide(*items):
        feed(spark, source, [("register_change", i, "approve", "p", T0) for i in items], REVIEWS)
        stream = spark.readStream.schema(REVIEWS).parquet(source)
        commit.stream_commit(stream, entries, field_sources, additions, backing, changes, out).awaitTermination()
        return {r["feature_key"]: r for r in commit.latest_snapshot(spark, f"{out}/entries").collect()}

    after = decide("i1")
    assert after["export"]["version"] == 2 and set(after) == {"export"}
    after = decide("i1", "i2", "a1")
    assert after["export"]["version"] == 3 and after["search"]["version"] == 1
    assert after["export"]["fields"].asDict()["owner"] == "Alex" and after["export"]["fields"]["status"] == "done"
    backed = {(r["field"], r["claim_id"]) for r in commit.latest_snapshot(spark, f"{out}/field_sources").collect()}
    assert backed == {("owner", "1"), ("owner", "2"), ("status", "3"), ("name", "7")}


PAIRS = "k string, v long"


def test_keyed_rows_are_those_of_the_newest_batch(spark, tmp_path):
    folder = f"{tmp_path}/log"
    log = KeyedLog(spark, folder, ["k"])
    assert log.newest() is None
    make = lambda *rows: spark.createDataFrame(list(rows), PAIRS)
    log.begin(make(("a", 1), ("b", 1), ("b", 2), (None, 9)))
    log.begin(make(("z", 1)))
    log.append(make(("b", 3), ("c", 1)), 0)
    held = lambda **at: sorted(map(tuple, KeyedLog(spark, folder).newest(**at).collect()), key=str)
    # a delta counts once the pointer names it
    assert held() == [("a", 1), ("b", 1), ("b", 2), (None, 9)]
    log.commit(0)
    log.append(make(), 1)
    log.commit(1)
    after = [("a", 1), ("b", 3), ("c", 1), (None, 9)]
    assert held() == held(before=2) == after and held(before=0) == [("a", 1), ("b", 1), ("b", 2), (None, 9)]
    log.compact(1)
    assert held() == after
    log.append(make(("a", 7), ("a", 8)), 2)
    log.append(make(("a", 7)), 2)
    log.commit(2)
    assert held() == [("a", 7), ("b", 3), ("c", 1), (None, 9)] and held(before=2) == after
    only = KeyedLog(spark, folder, ["k"])
    one = only.buckets_of(make(("c", 0)))
    assert ("c", 1) in {tuple(r) for r in only.newest(buckets=one).collect()}
    log.compact(2, F.col("v") < 8)
    assert held() == [("a", 7), ("b", 3), ("c", 1)]


def bytes_of(paths):
    return sum(Path(p.removeprefix("file:")).stat().st_size for p in paths)


def test_batches_read_and_write_alike_whatever_came_before(spark, frame, tmp_path, monkeypatch):
    source, out = str(tmp_path / "reviews"), shared_dir(spark, "flat-test")
    fields = "struct<name:string,owner:string,target_release:string,status:string,open_risks:array<string>>"
    n = 600
    entries = frame(
        [(f"e{i}", "c", f"key{i}", (f"Key {i}", "Sam", None, None, []), 1, "r0", T0) for i in range(n)],
        f"entry_id string, corpus_id string, feature_key string, fields {fields}, version int, last_updated_run_id string, updated_at timestamp",
    )
    field_sources = frame([(f"e{i}", "owner", str(i)) for i in range(n)], "entry_id string, field string, claim_id string")
    additions = frame([], f"item_id string, run_id string, corpus_id string, feature_key string, fields {fields}, status string")
    additions = additions.withColumn("committed_at", F.lit(T0))
    changes = frame(
        [(f"i{i}", "r2", "c", f"key{i}", f"e{i}", "owner", ["Sam"], [f"Alex {i}"], f"n{i}", "pending") for i in range(n)],
        "item_id string, run_id string, corpus_id string, feature_key string, entry_id string, field string,"
        " old_value array<string>, new_value array<string>, claim_id string, status string",
    ).withColumn("committed_at", F.lit(T0))
    read, plain = {}, KeyedLog.rows

    def counted(self, before=None, buckets=None):
        found = plain(self, before, buckets)
        if buckets is not None and found is not None:
            files = found.select(F.input_file_name()).distinct().collect()
            read[before] = read.get(before, 0) + bytes_of(r[0] for r in files)
        return found

    monkeypatch.setattr(KeyedLog, "rows", counted)
    batches = 10
    for number in range(batches):
        rows = [("register_change", f"i{7 * number + k}", "approve", "p", T0) for k in range(3)]
        feed(spark, source, rows, REVIEWS)
    stream = spark.readStream.schema(REVIEWS).option("maxFilesPerTrigger", 1).parquet(source)
    commit.stream_commit(
        stream, entries, field_sources, additions, frame([], "item_id string, field string, claim_id string"), changes, out, compact_every=4
    ).awaitTermination()
    after = {r["feature_key"]: r["fields"]["owner"] for r in commit.latest_snapshot(spark, f"{out}/entries").collect()}
    decided = {7 * number + k for number in range(batches) for k in range(3)}
    assert after == {f"key{i}": f"Alex {i}" if i in decided else "Sam" for i in range(n)}
    written = [bytes_of(map(str, Path(f"{out}/entries/delta/batch={b}").rglob("*.parquet"))) for b in range(batches)]
    assert max(written) <= 1.5 * min(written)
    assert max(read.values()) <= 2 * min(read.values()), read
    assert max(read.values()) < bytes_of(map(str, Path(f"{out}/entries/base/batch=-1").rglob("*.parquet"))) / 2


def test_ended_runs_leave_the_table(spark, tmp_path):
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    for n in range(6):
        feed(spark, source, [event(10 * n, "a_start", f"r{n}"), event(10 * n + 1, "run_completed", f"r{n}")], EVENTS)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        runs.stream_run_events(stream, out, compact_every=2, keep_batches=2).awaitTermination()
    assert spark.read.parquet(f"{out}/feed").count() == 12
    held = {r["run_id"] for r in KeyedLog(spark, f"{out}/closed").newest().collect()}
    assert "r0" not in held and {"r4", "r5"} <= held and keyed.BUCKETS > 1


def test_known_contents_are_looked_up_by_bucket(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    corpora = spark.createDataFrame([("c1", str(box), T0)], "corpus_id string, inbox_path string, created_at timestamp")
    for n in range(5):
        (box / f"new{n}.txt").write_text(f"new {n}")
        (box / f"again{n}.txt").write_text("the same")
        inbox.stream_inbox(inbox.read_inbox(spark, str(box)), corpora, out, compact_every=2).awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == 6
    assert KeyedLog(spark, f"{out}/contents").newest().count() == 6
    assert spark.read.parquet(f"{out}/runs").count() == 10


def test_new_files_are_written_once_before_they_are_parsed(spark, tmp_path):
    box, out = tmp_path / "box", str(tmp_path / "out")
    box.mkdir()
    corpora = spark.createDataFrame([("c1", str(box), T0)], "corpus_id string, inbox_path string, created_at timestamp")
    for name in ("a.md", "b.md"):
        (box / name).write_text("same")
    inbox.stream_inbox(inbox.read_inbox(spark, str(box)), corpora, out).awaitTermination()
    fresh = spark.read.parquet(f"{out}/fresh")
    assert [r["filename"] for r in fresh.collect()] == ["a.md"] == [r["filename"] for r in spark.read.parquet(f"{out}/documents").collect()]
