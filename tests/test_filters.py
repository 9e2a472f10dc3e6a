import datetime as dt

from pyspark.sql import functions as F

from mnemospark.operators import filters

DOCS = "id long, vault_path string, title string, project string, updated_at timestamp, summary string, full_body string"


def docs(make):
    t = dt.datetime
    return make(DOCS, [
        (1, "Projects/Alpha/stakeholder.md", "Stakeholder Resistance Management", "Alpha", t(2026, 6, 10, 12), "s1", "b1"),
        (2, "inbox/budget.md", "Quarterly Budget Analysis Q3", None, t(2026, 6, 10, 12, 0, 0, 500000), None, "b2"),
        (3, "inbox/vacation.md", "Vacation Policy Update 2026", None, t(2026, 1, 15, 9), "s3", None),
        (4, "Projects/Beta/status.md", "Project Status Report June", "Beta", None, "s4", "b4"),
        (5, "inboxes/x.md", "Other", None, t(2026, 1, 1), "s5", "b5"),
    ])


def ids(df):
    return [r["id"] for r in df.collect()]


def test_filters(make):
    d = docs(make)
    assert filters.filter_documents(d) is d
    assert ids(filters.filter_documents(d, project="Alpha")) == [1]
    assert ids(filters.filter_documents(d, location="inbox")) == [2, 3]
    # Bounds are inclusive at second precision.
    assert ids(filters.filter_documents(d, since="2026-06-10 12:00:00.9", until="2026-06-10 12:00:00")) == [1, 2]
    assert ids(filters.filter_documents(d, since="7d", now="2026-01-20 00:00:00", until="2026-02-01")) == [3]


def test_listing(make):
    assert ids(filters.listing(docs(make), 10)) == [2, 1, 3, 5, 4]
    assert len(ids(filters.listing(docs(make), 2))) == 2


def test_choose_content(make):
    d = make("id int, full_body string, summary string", [(1, "x" * 8, "s"), (2, "x" * 7, "s"), (3, "", "s"), (4, None, None), (5, "x" * 40, None)])
    assert [r["content"] for r in filters.choose_content(d, 2).orderBy("id").collect()] == ["x" * 8, "x" * 7, "s", "", "x" * 40]


def test_resolve_counts_missing_ids(make):
    asked = make("request_id int, ids array<long>", [(1, [99, 1, 3, 2])])
    d = docs(make)
    got = {r["id"]: (r["pos"], r["content"], r["degraded"]) for r in filters.resolve(d, asked, "text", 2).collect()}
    # The unknown id holds position 0, so only one text fits.
    assert got == {1: (1, "b1", False), 3: (2, "s3", True), 2: (3, "[Summary pending]", True)}
    assert {r["content"] for r in filters.resolve(d, asked, "file").collect()} == {"Projects/Alpha/stakeholder.md", "inbox/vacation.md", "inbox/budget.md"}


def test_unclassified_three_valued(make):
    d = make("id int, content_hash string, classify_content_hash string, status string", [
        (1, "a", None, None), (2, "a", "b", None), (3, "a", "a", None), (4, None, "a", None), (5, "a", None, "needs-review"),
    ])
    assert ids(filters.find_unclassified(d)) == [1, 2]


def test_first_occurrence(make):
    rows = make("id long, pos int, v string", [(1, 2, "b"), (1, 1, "a"), (None, 3, "n1"), (None, 4, "n2")])
    assert sorted(r["v"] for r in filters.first_occurrence(rows).collect()) == ["a", "n1", "n2"]


def test_latest_batch(make):
    rows = make("folder_path string, created_at string, batch_id long", [("f", "2026-01-01", 1), ("f", "2026-01-02", 2), ("f", "2026-01-02", 3)])
    assert filters.latest_batches(rows).first()["batch_id"] == 3


def test_audit_query(make):
    a = make("id long, timestamp string, pipeline string, correlation_id string", [
        (2, "2026-01-01 10:00:00", "capture", "c"), (1, "2026-01-01 23:59:59", "capture", "c"), (3, "2026-01-02 00:00:00", "capture", "c"),
    ]).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert ids(filters.query_audit(a, date="2026-01-01", pipeline="capture", correlation_id="c")) == [1, 2]
