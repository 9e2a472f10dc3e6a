import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import reconcile, state
from mnemospark.session import cut_lineage, literal_rows, pin, small
from mnemospark.sources import tables

DOC = (
    "id long, vault_path string, title string, summary string, content_hash string, full_body string, original_filename string, "
    "file_size_bytes long, blob_ref string, mime_type string, classify_content_hash string, classify_attempts int, "
    "classify_last_error string, status string, batch_id long, created_at timestamp, updated_at timestamp, key_topics array<string>"
)
OLD = dt.datetime(2026, 1, 1)
NOW = "2026-06-01 00:00:00"
UP = "vault_path string, full_body string, content_hash string, original_filename string, file_size_bytes long, blob_ref string, mime_type string, title string, seq long"


def doc(id, path, h="h1", title="T", blob="b1", stamp=None, attempts=0, status=None):
    return (id, path, title, "sum", h, "body", "f", 4, blob, "text/plain", stamp, attempts, None, status, None, OLD, OLD, [])


def up(path, h, text="new", title=None, seq=0, blob="b9"):
    return (path, text, h, "g", 3, blob, "text/plain", title, seq)


def apply(make, docs, uploads, **kw):
    return {r["vault_path"]: r for r in state.upsert_uploads(make(DOC, docs), make(UP, uploads), now=NOW, **kw).collect()}


def test_upsert(make):
    got = apply(make, [doc(1, "a.md"), doc(2, "b.md", stamp="h1"), doc(3, "c.md")],
                [up("a.md", "h1", "other text"), up("b.md", "h2"), up("d/new.txt", "h3"), up("e.md", "h4", title="Named", seq=1)])
    a, b, d, e = got["a.md"], got["b.md"], got["d/new.txt"], got["e.md"]
    assert (a["action"], a["full_body"], a["updated_at"]) == ("unchanged", "body", OLD)
    assert (b["action"], b["full_body"], b["title"], b["summary"], b["classify_content_hash"], b["blob_ref"]) == ("updated", "new", "T", "sum", "h1", "b9")
    assert b["updated_at"] == dt.datetime(2026, 6, 1) and b["created_at"] == OLD
    assert (d["id"], d["title"], d["action"]) == (4, "new", "inserted") and (e["id"], e["title"]) == (5, "Named")


def test_upsert_batch_order(make):
    # Same hash twice keeps the first text; back to the stored hash is a real change.
    got = apply(make, [doc(1, "a.md")], [up("a.md", "h2", "x1", seq=1), up("a.md", "h2", "x2", seq=2), up("n.md", "h5", "y1", seq=3), up("n.md", "h5", "y2", seq=4)], chunk=2)
    assert got["a.md"]["full_body"] == "x1" and got["n.md"]["full_body"] == "y1"
    got = apply(make, [doc(1, "a.md")], [up("a.md", "h2", "x1", title="N", seq=1), up("a.md", "h1", "x2", seq=2)], chunk=1)
    assert (got["a.md"]["full_body"], got["a.md"]["action"], got["a.md"]["title"]) == ("x2", "updated", "N")


def test_upsert_random(make):
    rnd = random.Random(3)
    docs = [doc(i, f"p{i}", h=f"h{rnd.randint(0, 2)}") for i in range(5)]
    ups = [up(f"p{rnd.choice([0, 0, 0, 1, 2, 6, 7])}", f"h{rnd.randint(0, 2)}", f"t{k}", rnd.choice([None, "", f"T{k}"]), k) for k in range(200)]
    table = {d[1]: {"h": d[4], "text": "body", "title": "T"} for d in docs}
    for path, text, h, *_, title, _ in ups:
        row = table.get(path)
        if row is None:
            table[path] = {"h": h, "text": text, "title": title or path}
        elif row["h"] != h:
            row.update(h=h, text=text, title=title or row["title"])
    got = apply(make, docs, ups, chunk=13)
    assert {p: (r["content_hash"], r["full_body"], r["title"]) for p, r in got.items()} == {p: (v["h"], v["text"], v["title"]) for p, v in table.items()}


def test_summaries_and_renames(make):
    d = make(DOC, [doc(1, "a.md"), doc(2, "b.md"), doc(3, "c.md")])
    out, unknown = state.attach_summaries(d, make("vault_path string, summary string, title string", [("a.md", "S", None), ("zz", "S", "T")]))
    assert {r["id"]: (r["summary"], r["title"]) for r in out.collect()}[1] == ("S", "T")
    assert unknown.count() == 1
    twice = make("vault_path string, summary string, title string, seq long", [("a.md", "late", None, 2), ("a.md", "early", "E", 1)])
    rows = state.attach_summaries(d, twice)[0].filter("id = 1").collect()
    assert [(r["summary"], r["title"]) for r in rows] == [("late", "E")]
    out, refused = state.rename_paths(d, make("old_path string, new_path string", [("a.md", "x.md"), ("b.md", "c.md"), ("q", "r"), ("c.md", "x.md")]))
    assert {r["id"]: r["vault_path"] for r in out.collect()} == {1: "x.md", 2: "b.md", 3: "c.md"}
    assert refused.count() == 3


ENTRY = "id long, status string, sources array<string>"


def test_delete(make):
    d = make(DOC, [doc(1, "a.md", blob="b1"), doc(2, "b.md", blob="b1"), doc(3, "c.md", blob="b3"), doc(4, "d.md", blob=None)])
    e = make(ENTRY, [(1, "confident", ["1", "2"]), (2, "confident", ["3"])])
    p = make("id long, term string", [(1, "x"), (2, "x")])
    out = state.delete_paths(d, e, make("vault_path string", [("a.md",), ("c.md",), ("d.md",)]), postings=p)
    assert [r["id"] for r in out.docs.collect()] == [2]
    assert {r["id"]: (r["sources"], r["status"]) for r in out.entries.collect()} == {1: (["2"], "confident"), 2: ([], "pending")}
    assert [r["blob_ref"] for r in out.orphan_blobs.collect()] == ["b3"]
    assert [r["id"] for r in out.postings.collect()] == [2]
    assert state.blob_refcounts(d).filter("blob_ref = 'b1'").first()["cnt"] == 2


def test_replace(make):
    d = make(DOC, [doc(1, "a.md"), doc(2, "b.md")])
    r = make("old_path string, vault_path string, title string, tags array<string>, full_body string, content_hash string, seq long",
             [("a.md", "n/x.md", None, ["type/note", "free", "domain/Q"], "t", "h", 1)])
    got = {x["id"]: x for x in state.replace_paths(d, r, NOW).collect()}
    assert set(got) == {2, 3} and got[3]["key_topics"] == ["free"] and got[3]["title"] == "x"


def test_outcomes(make):
    d = make(DOC, [doc(1, "a", attempts=1), doc(2, "b", attempts=0), doc(3, "c", attempts=2), doc(4, "d")])
    o = make("doc_id long, dimension string, clean boolean, error string", [
        (1, "x", True, None), (1, "y", True, None), (2, "y", False, "e2"), (2, "x", False, "e1"), (2, "z", True, None), (3, "x", False, "e"),
    ])
    got = {r["id"]: (r["classify_content_hash"], r["classify_attempts"], r["classify_last_error"], r["status"]) for r in state.apply_outcomes(d, o).collect()}
    assert got == {1: ("h1", 0, None, None), 2: (None, 1, "e1; e2", None), 3: (None, 3, "e", "needs-review"), 4: (None, 0, None, None)}
    audit = state.classify_audit(o, F.lit("c"), NOW)
    assert {r["outcome"] for r in audit.collect()} == {"classify", "needs-retry"}


def test_audit_rows_of_transitions(make):
    c, ids = F.lit("c"), lambda df: {(r["outcome"], tuple(r["source_ids"])) for r in df.collect()}
    before, after = make(DOC, [doc(1, "a", status="needs-review"), doc(2, "b")]), make(DOC, [doc(1, "a", status="needs-review"), doc(2, "b", status="needs-review")])
    assert ids(state.parked_audit(before, after, c)) == {("parked", ("2",))}
    files = make("id long, mime_type string, file_size_bytes long", [(1, "image/png", 5), (2, "text/plain", 5)])
    assert ids(state.describe_audit(files, c)) == {("DESCRIBED", ("1",)), ("SKIPPED", ("2",))}
    assert ids(state.failure_audit(make("vault_path string, reason string", [("p", "too big")]), c)) == {("FAILED", ("p",))}
    assert ids(state.report_audit(make("id long, report_type string, title string", [(7, "x", "t")]), c)) == {("GENERATED", ("7",))}
    assert ids(state.corrections_audit(make("entry_id long, operation string", [(3, "reject")]), c)) == {("APPLIED", ("3",))}
    kept = state.capture_audit(state.upsert_uploads(make(DOC, [doc(1, "a.md")]), make(UP, [up("a.md", "h1"), up("b.md", "h")]), now=NOW), c)
    assert ids(kept) == {("CAPTURED", ("2",))}
    good, _ = tables.check_audit(kept)
    assert good.count() == 1


def test_comments_need_their_entry(make):
    c = make("id long, entry_id long, comment_text string, created_at timestamp", [])
    r = make("id long, entry_id long, comment_text string, created_at timestamp", [(1, 1, "x", OLD), (2, 5, "y", OLD)])
    kept, rejects = state.append_comments(c, r, make(ENTRY, [(1, "confident", [])]))
    assert kept.count() == 1 and rejects.first()["reason"] == "unknown entry"
    assert state.drop_with_entries(r, make("id long", [(1,)])).first()["id"] == 2


def test_batches(make):
    d = make(DOC, [doc(1, "inbox/drop/a.md"), doc(2, "inbox/drop/b.md"), doc(3, "inbox/c.md"), doc(4, "Projects/A/sub/x.md"), doc(5, "Projects/A/y.md")])
    b = state.folder_batches(d)
    got = {r["folder_path"]: (r["folder_name"], r["destination_type"], r["destination_name"], r["file_count"]) for r in b.collect()}
    assert got == {"inbox/drop": ("drop", "inbox", None, 2), "Projects/A/sub": ("sub", "project", "A", 1)}
    stored = make("batch_id long, folder_path string, status string, created_at timestamp", [(1, "inbox/drop", "pending", OLD), (2, "inbox/drop", "pending", OLD)])
    assert {r["id"]: r["batch_id"] for r in state.stamp_batches(d, stored).collect()} == {1: 2, 2: 2, 3: None, 4: None, 5: None}
    done = state.set_batch_status(stored, make("batch_id long, status string", [(2, "done")]))
    assert {r["batch_id"]: r["status"] for r in done.collect()} == {1: "pending", 2: "done"}


# --- reconcile ---------------------------------------------------------------

MAN = "vault_path string, hash string, size long, mtime double"


def sweep(make, disk=(), cache=(), server=(), unreadable=(), candidates=(), n=2):
    row = lambda x: (x[0], x[1], 1, 1.0)
    return reconcile.reconcile_3way(
        make(MAN, [row(x) for x in disk]), make(MAN, [row(x) for x in cache]), make("vault_path string, hash string", list(server)),
        make("vault_path string", [(x,) for x in unreadable]), make("vault_path string, n int", list(candidates)), n,
    )


@pytest.mark.parametrize("disk,cache,server,want", [
    ([("p", "h")], [], [], "uploaded"), ([("p", "h")], [("p", "h")], [], "re_uploaded"), ([("p", "h")], [], [("p", None)], "re_uploaded"),
    ([("p", "h")], [("p", "x")], [("p", "g")], "re_uploaded"), ([("p", "h")], [], [("p", "h")], "skipped"), ([], [("p", "h")], [("p", "h")], "candidate"),
    ([], [("p", "h")], [], "forgotten"), ([], [], [("p", "h")], "candidate"), ([], [("p", "h")], [("p", None)], None),
])
def test_three_way_table(make, disk, cache, server, want):
    out = sweep(make, disk, cache, server)
    assert [r["action"] for r in out.actions.collect()] == ([want] if want else [])
    assert [r["vault_path"] for r in out.cache.collect()] == (["p"] if want == "skipped" else [])


def test_delete_needs_confirmation(make):
    first = sweep(make, server=[("p", "h"), ("q", "h")], unreadable=["q"])
    assert {(r["vault_path"], r["action"]) for r in first.actions.collect()} == {("p", "candidate")}
    assert [tuple(r) for r in first.candidates.collect()] == [("p", 1)]
    second = sweep(make, server=[("p", "h")], candidates=[("p", 1), ("other", 1)])
    assert [r["action"] for r in second.actions.collect()] == ["deleted"]
    assert [tuple(r) for r in second.candidates.collect()] == [("other", 1)]
    back = sweep(make, disk=[("p", "h")], server=[("p", "h")], candidates=[("p", 1)])
    assert back.candidates.count() == 0
    assert [r["action"] for r in sweep(make, server=[("p", "h")], n=1).actions.collect()] == ["deleted"]


def test_cache_advances_on_acknowledgement(make):
    disk = make(MAN, [("a", "1", 1, 1.0), ("b", "2", 1, 1.0)])
    cache = make(MAN, [("b", "old", 1, 1.0)])
    got = reconcile.advance_cache(cache, disk, make("vault_path string", [("b",)]))
    assert [(r["vault_path"], r["hash"]) for r in got.collect()] == [("b", "2")]


def test_two_way(make):
    got = reconcile.reconcile_2way(
        make(MAN, [("a", "1", 1, 1.0), ("b", "2", 1, 1.0), ("c", "3", 1, 1.0)]),
        make("vault_path string, hash string", [("b", "2"), ("c", None), ("d", "4"), ("e", "5")]), make("vault_path string", [("e",)]),
    )
    assert {tuple(r) for r in got.collect()} == {("a", "uploaded"), ("b", "skipped"), ("c", "re_uploaded"), ("d", "deleted")}


def test_changes(make):
    s = "vault_path string, content_hash string"
    run = lambda now, old: {tuple(r) for r in reconcile.detect_changes(make(s, now), make(s, old)).collect()}
    assert run([("Projects/X/foo.md", "h")], [("inbox/foo.md", "h")]) == {("moved", "Projects/X/foo.md", "inbox/foo.md")}
    assert run([("a", "h"), ("b", "h")], [("o", "h")]) == {("added", "a", None), ("added", "b", None), ("deleted", "o", None)}
    assert run([("a", "h"), ("b", "x")], [("a", None), ("b", "x"), ("c", None)]) == {("modified", "a", None), ("deleted", "c", None)}


def test_registry(make):
    p = make("name string, tags array<string>", [("P1", ["x", "domain/Nope", "domain/Ops", "domain/HR"]), ("P2", []), ("P3", None), ("P4", ["domain/HR"])])
    got = {tuple(r) for r in reconcile.project_registry(p, make("domain string", [("Ops",), ("HR",), ("Empty",)])).collect()}
    assert got == {("Ops", "P1", False), ("HR", "P4", False), ("Empty", None, False), ("Uncategorized", "P2", True), ("Uncategorized", "P3", True)}


# --- tables ------------------------------------------------------------------


def test_snapshots_and_logs(make, spark, tmp_path):
    path = str(tmp_path / "docs")
    assert tables.latest_version(spark, path) is None
    tables.write_snapshot(make("id long", [(1,)]), path, 0)
    tables.write_snapshot(make("id long", [(2,)]), path, 1)
    assert tables.latest_version(spark, path) == 1
    assert tables.read_snapshot(spark, path, 0).first()["id"] == 1
    with pytest.raises(Exception):
        tables.write_snapshot(make("id long", [(3,)]), path, 1)
    rows = make("id long, timestamp timestamp, pipeline string, correlation_id string", [(1, OLD, "capture", "c"), (2, OLD, "capture", None), (3, OLD, "capture", "")])
    assert tables.append_audit(rows, str(tmp_path / "audit")).count() == 2
    tables.append_audit(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    tables.append_report(make("report_type string, title string", [("x", "t")]), str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).first()["body"] is None


def test_loading_tolerates_old_tables(make, spark, tmp_path):
    make("id long, vault_path string, key_topics string", [(1, "a", '["x","y"]'), (2, "b", ""), (3, "c", None)]).write.parquet(str(tmp_path / "d"))
    got = {r["id"]: (r["key_topics"], r["mime_type"]) for r in tables.load_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {1: (["x", "y"], None), 2: ([], None), 3: ([], None)}
    make("id long, sources string, trust_score double, retrieval_count int", [(1, '["7"]', None, 3)]).write.parquet(str(tmp_path / "e"))
    row = tables.load_entries(spark, str(tmp_path / "e")).first()
    assert (row["sources"], row["trust_score"], row["retrieval_score"], row["reasoning"]) == (["7"], 0.5, 3.0, "")


def test_broadcast_only_below_the_bound(make):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = make("id long", [(i,) for i in range(20)])
    assert hinted(small(df, 20)) and not hinted(small(df, 19))
    assert pin(df, 20).count() == 20 and cut_lineage(df).count() == 20
    assert literal_rows(df.sparkSession, [], df.schema).count() == 0
