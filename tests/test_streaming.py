import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import reconcile
from mnemospark.sources import tables
from mnemospark.streaming import events as ev
from mnemospark.streaming import jobs

T0 = dt.datetime(2026, 6, 1, 12)
EVENT = "ts timestamp, kind string, path string, new_path string, hash string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(make, spark, tmp_path):
    """Write row batches as files of one folder, in order, and read them as a stream."""

    def build(schema, *batches, name="in"):
        folder = tmp_path / name
        for n, rows in enumerate(batches):
            make(schema, rows).coalesce(1).write.parquet(str(folder / f"b{n}"))
        frame = make(schema, [])
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))

    return build


def run(stream, spark, tmp_path, name="out"):
    out = str(tmp_path / name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_debounce_stream_equals_batch(feed, make, spark, tmp_path):
    rows = [
        (at(0), "modify", "a", None, "1"), (at(0.4), "modify", "a", None, "2"), (at(1.2), "modify", "a", None, "3"), (at(0.5), "create", "a", None, "4"),
        (at(9), "modify", "a", None, "5"), (at(3), "delete", "a", None, "6"),
    ]
    tail = [(at(100), "modify", "z", None, "z")]
    want = {("modify", "a", "3", 3), ("create", "a", "4", 1), ("modify", "a", "5", 1)}
    key = lambda df: {(r["kind"], r["path"], r["hash"], r["n_events"]) for r in df.collect() if r["path"] != "z"}
    assert key(ev.debounce(make(EVENT, rows))) == want
    stream = ev.debounce(feed(EVENT, rows, tail, [(at(200), "modify", "z", None, "y")]), delay="1 second")
    assert key(run(stream, spark, tmp_path)) == want
    assert ev.immediate(make(EVENT, rows)).count() == 1


def test_rewrite_ignored(make):
    rows = [
        (at(0), "move", "a.md", ".git/a.md", None), (at(1), "move", "x.tmp", "b.md", None), (at(2), "move", ".git/a", ".git/b", None),
        (at(3), "move", "c.md", "d.md", None), (at(4), "modify", ".git/q", None, None), (at(5), "modify", "e.md", None, None),
    ]
    got = [tuple(r)[1:4] for r in ev.rewrite_ignored(make(EVENT, rows), [".git", "*.tmp"]).orderBy("ts").collect()]
    assert got == [("delete", "a.md", None), ("create", "b.md", None), ("move", "c.md", "d.md"), ("modify", "e.md", None)]


def test_unchanged(make):
    e = make("ts timestamp, path string, size long, mtime double, hash string", [
        (at(0), "a", 1, 1.0, "h"), (at(0), "b", 2, 9.0, "h"), (at(0), "c", 1, 9.0, "x"), (at(0), "new", 1, 1.0, "h"),
    ])
    m = make("vault_path string, hash string, size long, mtime double", [("a", "old", 1, 1.0), ("b", "h", 1, 1.0), ("c", "h", 1, 1.0)])
    judged = ev.judge_unchanged(e, m)
    assert {r["path"]: r["verdict"] for r in judged.collect()} == {"a": "same", "b": "touch", "c": "changed", "new": "changed"}
    got = {r["vault_path"]: (r["size"], r["mtime"]) for r in ev.touch_manifest(m, judged).collect()}
    assert got == {"a": (1, 1.0), "b": (2, 9.0), "c": (1, 1.0)}


MOVES = [
    (at(0), "delete", "A", None, None), (at(1), "create", "B", None, "h1"),  # a move
    (at(0), "delete", "Z", None, None),  # unknown path: deleted at once
    (at(10), "delete", "C", None, None),  # expires
    (at(20), "delete", "D1", None, None), (at(21), "delete", "D2", None, None), (at(22), "create", "E", None, "h4"),  # the latest wins
    (at(22.5), "create", "F", None, "h4"),  # consumed once
    (at(30), "delete", "G", None, None), (at(35), "create", "H", None, "h5"),  # too late
]
KNOWN = [("A", "h1"), ("C", "h3"), ("D1", "h4"), ("D2", "h4"), ("G", "h5")]
WANT = {
    ("moved", "A", "B"), ("deleted", None, "Z"), ("deleted", None, "C"), ("moved", "D2", "E"), ("created", None, "F"),
    ("deleted", None, "G"), ("created", None, "H"),
}


def test_move_correlation(feed, make, spark, tmp_path):
    known = make("vault_path string, hash string", KNOWN)
    key = lambda df: {(r["kind"], r["old_path"], r["path"]) for r in df.collect() if not r["path"].startswith("tail")}
    assert key(reconcile.correlate_moves(make(EVENT, MOVES), known)) == WANT
    early = [e for e in MOVES if e[0] < at(20)]
    late = [e for e in MOVES if e[0] >= at(20)]
    tails = [[(at(s), "create", f"tail{s}", None, f"t{s}")] for s in (100, 200)]
    stream = jobs.correlate_move_stream(feed(EVENT, early, late, *tails), known)
    assert key(run(stream, spark, tmp_path)) == WANT


def test_settled_folders(make):
    e = make("ts timestamp, kind string, path string", [
        (at(0), "create_dir", "inbox/drop"), (at(2), "create", "inbox/drop/a"), (at(6), "create", "inbox/drop/b"), (at(30), "create", "inbox/drop/late"),
        (at(1), "create", "inbox/loose.md"), (at(1), "create", "Projects/A/sub/x"),
    ])
    settled = ev.settled_folders(e)
    assert [(r["folder"], r["n_files"], r["stable_at"]) for r in settled.collect()] == [("inbox/drop", 2, at(11))]
    assert {r["path"] for r in ev.loose_files(e, settled).collect()} == {"inbox/drop/late", "inbox/loose.md", "Projects/A/sub/x"}


HOP = "id long, ts timestamp, src string, dst string"
HOPS = [(1, at(0), "A", "B"), (2, at(3), "B", "C"), (3, at(7), "C", "D"), (4, at(20), "D", "E"), (5, at(1), "X", "Y"), (6, at(2), "Y", "X")]


def test_move_chains(make):
    got = {(r["src"], r["dst"], r["hops"]) for r in reconcile.coalesce_chains(make(HOP, HOPS)).collect()}
    assert got == {("A", "D", 3), ("D", "E", 1), ("X", "X", 2)}
    long = make(HOP, [(i, at(i), f"p{i}", f"p{i + 1}") for i in range(70)])
    assert [(r["src"], r["dst"], r["hops"]) for r in reconcile.coalesce_chains(long).collect()] == [("p0", "p70", 70)]


def test_move_chain_stream(feed, spark, tmp_path):
    found = []
    stream = feed(HOP, HOPS[:2] + HOPS[4:], HOPS[2:3], [(9, at(50), "Q", "R")], [(10, at(90), "S", "T")])
    writer = jobs.chain_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck"), lambda df, n: found.extend(df.collect()))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert {(r["src"], r["dst"], r["hops"]) for r in found} == {("A", "D", 3), ("X", "X", 2), ("Q", "R", 1)}


def test_self_moves(feed, make, spark, tmp_path):
    events = [("a", at(1)), ("a", at(2)), ("b", at(9)), ("c", at(1))]
    claims = [("a", at(0)), ("b", at(0))]
    want = {("a", at(2)), ("b", at(9)), ("c", at(1))}
    s = "path string, ts timestamp"
    assert {tuple(r) for r in ev.suppress_registered(make(s, events), make(s, claims)).collect()} == want
    twice = [("p", at(2)), ("p", at(2))]
    assert ev.suppress_registered(make(s, twice), make(s, [("p", at(1))])).count() == 1
    stream = jobs.suppress_stream(feed(s, events, name="e"), feed(s, claims, name="c"))
    assert {tuple(r) for r in run(stream, spark, tmp_path).collect()} == want


def test_confirm_deletes(make):
    deleted, counters = ev.confirm_deletes(
        make("path string, present boolean", [("a", False), ("b", False), ("c", True)]), make("path string, n int", [("a", 1), ("c", 1), ("d", 1)])
    )
    assert [r["path"] for r in deleted.collect()] == ["a"]
    assert {tuple(r) for r in counters.collect()} == {("b", 1), ("d", 1)}


DOC = "id long, vault_path string, title string, summary string, content_hash string, full_body string, created_at timestamp, updated_at timestamp"


def test_ingest_stream(feed, make, spark, tmp_path):
    catalog = str(tmp_path / "catalog")
    jobs.create_catalog(make(DOC, [(1, "a.md", "T", "s", "h1", "old", at(0), at(0))]), catalog)
    up = "vault_path string, full_body string, content_hash string, seq long, ts timestamp"
    stream = feed(up, [("a.md", "new", "h2", 1, at(1)), ("b.md", "b", "h3", 2, at(2))], [("b.md", "b", "h3", 3, at(3)), ("a.md", "newer", "h4", 4, at(4))])
    jobs.ingest_stream(stream, catalog, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    docs = jobs.open_catalog(spark, catalog).read()
    assert {("a.md", "newer"), ("b.md", "b")} == {(r["vault_path"], r["full_body"]) for r in docs.collect()}
    assert {(r["id"], r["vault_path"], r["full_body"]) for r in docs.collect()} == {(1, "a.md", "newer"), (2, "b.md", "b")}


def test_ingest_keeps_a_return_to_earlier_content(feed, make, spark, tmp_path):
    catalog = str(tmp_path / "catalog")
    jobs.create_catalog(make(DOC, [(1, "a.md", "T", "s", "h1", "old", at(0), at(0))]), catalog)
    up = "vault_path string, full_body string, content_hash string, seq long, ts timestamp"
    change, back = ("a.md", "new", "h2", 1, at(1)), ("a.md", "old", "h1", 2, at(2))
    stream = feed(up, [change], [back, change], [back])
    jobs.ingest_stream(stream, catalog, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    docs = jobs.open_catalog(spark, catalog).read()
    assert [(r["id"], r["content_hash"]) for r in docs.collect()] == [(1, "h1")]


def test_ingest_takes_late_files(feed, make, spark, tmp_path):
    catalog = str(tmp_path / "catalog")
    jobs.create_catalog(make(DOC, [(1, "a.md", "T", "s", "h1", "old", at(0), at(0))]), catalog)
    up = "vault_path string, full_body string, content_hash string, seq long, ts timestamp"
    hours = [("b.md", "b", "h2", 200, at(3600 * 40)), ("c.md", "c", "h3", 300, at(3600 * 60))]
    stream = feed(up, *[[row] for row in hours], [("late.md", "l", "h4", 5, at(0))], [("b.md", "stale", "h5", 100, at(10))])
    jobs.ingest_stream(stream, catalog, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    docs = jobs.open_catalog(spark, catalog).read().collect()
    # a file older than all others is stored, and so is an older copy that replaces a stored one
    assert {(r["vault_path"], r["full_body"]) for r in docs} == {("a.md", "old"), ("b.md", "stale"), ("c.md", "c"), ("late.md", "l")}
    assert sorted(r["id"] for r in docs) == [1, 2, 3, 4]


def test_confirm_delete_stream(feed, spark, tmp_path):
    """Counters survive between batches; a path that is back, or is confirmed, starts anew."""
    s = "path string, sweep long, present boolean"
    sweeps = [[("a", k, k % 3 == 0), ("b", k, False), ("c", k, k > 0), ("d", k, True)] for k in range(5)]
    found = run(jobs.confirm_delete_stream(feed(s, *sweeps), confirmations=2), spark, tmp_path).collect()
    assert sorted((r["path"], r["sweep"]) for r in found) == [("a", 2), ("b", 1), ("b", 3)]


def test_confirm_delete_job_equals_stream(feed, spark, tmp_path):
    """The same counts by batches, several sweeps and paths that are not reported included, without a call per path."""
    s = "path string, sweep long, present boolean"
    sweeps = [[("a", k, k % 3 == 0), ("b", k, False), ("c", k, k > 0), ("d", k, True)] for k in range(5)]
    sweeps += [[("a", 6, False), ("a", 5, True), ("a", 8, False), ("a", 7, False)], [("b", 9, False), (None, 9, False)], [(None, 10, False)]]
    state, log = str(tmp_path / "state"), str(tmp_path / "log")
    jobs.confirm_delete_job(feed(s, *sweeps), state, log, confirmations=2).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r["path"] or "-", r["sweep"]) for r in jobs.confirmed_deletes(spark, state).collect())
    assert found == [("-", 10), ("a", 2), ("a", 7), ("b", 1), ("b", 3), ("b", 9)]


def test_work_stream_takes_late_documents(feed, spark, tmp_path):
    s = "id long, content_hash string, classify_content_hash string, status string, updated_at timestamp"
    stream = jobs.work_stream(feed(s, [(1, "a", None, None, at(3600 * 90))], [(2, "b", None, None, at(0))], [(1, "a", None, None, at(0))]))
    assert {(r["id"], r["content_hash"]) for r in run(stream, spark, tmp_path).collect()} == {(1, "a"), (2, "b")}


def test_oversize_files_are_reported(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (root / "big.md").write_text("x" * 100)
    (root / "small.md").write_text("x")
    rows = run(jobs.oversize_stream(jobs.file_stream(spark, str(root)), 50), spark, tmp_path).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["size"], r["reason"]) for r in rows] == [("big.md", 100, "larger than 50 bytes")]


def test_upload_stream_reads_files(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (root / "a b.md").write_text("---\nx: y\n---\nhello\n")
    (root / "p.pdf").write_bytes(b"%PDF")
    stream = jobs.upload_stream(jobs.file_stream(spark, str(root)), str(root))
    rows = {r["vault_path"]: r["full_body"] for r in run(stream, spark, tmp_path).collect()}
    assert rows == {"a b.md": "hello", "p.pdf": None}


def test_work_stream(feed, spark, tmp_path):
    s = "id long, content_hash string, classify_content_hash string, status string, updated_at timestamp"
    stream = jobs.work_stream(feed(s, [(1, "a", None, None, at(0)), (2, "a", "a", None, at(0))], [(1, "a", None, None, at(1)), (1, "b", "a", None, at(2))]))
    assert {(r["id"], r["content_hash"]) for r in run(stream, spark, tmp_path).collect()} == {(1, "a"), (1, "b")}


def test_first_shown_stream(feed, make, spark, tmp_path):
    s = "session_id string, id long, ts timestamp"
    rows = [("s", 1, at(0)), ("s", 1, at(1)), ("t", 1, at(2))]
    assert ev.first_shown(make(s, rows)).count() == 2
    stream = ev.first_shown(feed(s, rows, [("s", 1, at(5)), ("s", 2, at(5))], [("s", 3, at(90 * 3600))], [("s", 4, at(0)), ("s", 1, at(0))]))
    assert {(r["session_id"], r["id"]) for r in run(stream, spark, tmp_path).collect()} == {("s", 1), ("t", 1), ("s", 2), ("s", 3), ("s", 4)}


def test_sweeps(spark):
    assert jobs.sweep_rows(spark, "2026-01-01", "2026-01-04").count() == 4
    assert ev.owning_folder(F.lit("x")) is not None
