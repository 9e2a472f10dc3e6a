import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import context, folds, learning, reports

ENTRY = (
    "id long, dimension string, entity string, tag string, fact string, status string, confidence double, "
    "sources array<string>, reasoning string, trust_score double, retrieval_score double"
)
T0 = dt.datetime(2026, 6, 1)


def entry(id, trust=0.5, entity="E", score=0.0):
    return (id, "people", entity, "role", f"fact {id}", "confident", 0.9, ["1"], "why", trust, score)


def log(make, rows):
    return make("id long, entry_id long, operation string, created_at timestamp", rows)


@pytest.mark.parametrize("op,start,want", [("confirm", 0.5, 0.55), ("reject", 0.5, 0.4), ("revise", 0.5, 0.6), ("confirm", 0.98, 1.0), ("reject", 0.03, 0.0)])
def test_single_step(make, op, start, want):
    out, _ = folds.replay_trust(make(ENTRY, [entry(1, start)]), log(make, [(1, 1, op, T0)]))
    assert out.first()["trust_score"] == want


def test_replay_matches_a_sequential_fold(make):
    rnd = random.Random(2)
    entries = [entry(i, rnd.random()) for i in range(6)]
    rows = [(k, rnd.choice([0, 0, 0, 1, 2, 3]), rnd.choice(["confirm", "reject", "reject", "revise", "zap"]), T0 + dt.timedelta(minutes=rnd.randint(0, 600))) for k in range(400)]
    out, rejects = folds.replay_trust(make(ENTRY, entries), log(make, rows))
    want = {e[0]: e[9] for e in entries}
    for _, e, op, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        t = want[e]
        want[e] = {"confirm": min(1.0, t + 0.05), "reject": max(0.0, t - 0.1), "revise": 0.6}.get(op, t)
    got = {r["id"]: r["trust_score"] for r in out.collect()}
    assert got == pytest.approx(want, abs=1e-8)
    assert rejects.count() == sum(r[2] == "zap" for r in rows)


def test_decay(make):
    bump = lambda *rows: make("entry_id long, ts timestamp, event_id long", rows or [(99, T0, 0)])
    none = make("ts timestamp", [(T0,)]).limit(0)
    e = make(ENTRY, [entry(1), entry(2, score=5.0)])
    got = {r["id"]: r["retrieval_score"] for r in folds.decayed_scores(e, bump((1, T0, 1), (2, T0, 2)), none).collect()}
    assert got == {1: 1.0, 2: 5.75}
    e = make(ENTRY, [entry(1, score=10.0), entry(2, score=20.0)])
    got = {r["id"]: r["retrieval_score"] for r in folds.decayed_scores(e, bump(), make("ts timestamp", [(T0,)])).collect()}
    assert got == {1: 9.5, 2: 19.0}


def test_decay_matches_a_sequential_run(make):
    rnd = random.Random(4)
    entries = [entry(i, score=float(i)) for i in range(5)]
    bumps = [(rnd.choice([0, 0, 1, 2]), T0 + dt.timedelta(minutes=rnd.randint(0, 5000)), k) for k in range(300)]
    sweeps = [T0 + dt.timedelta(days=d, seconds=1) for d in range(4)]
    ops = sorted([(t, 1, k, e) for e, t, k in bumps] + [(t, 0, -1, None) for t in sweeps])
    want = {e[0]: e[10] for e in entries}
    for _, kind, _, e in ops:
        for i in want if kind == 0 else [e]:
            want[i] = want[i] * 0.95 + kind
    out = folds.decayed_scores(make(ENTRY, entries), make("entry_id long, ts timestamp, event_id long", bumps), make("ts timestamp", [(s,) for s in sweeps]))
    assert {r["id"]: r["retrieval_score"] for r in out.collect()} == pytest.approx(want, abs=1e-6)


def test_hot_key_is_folded_in_pieces(make):
    # One entry in one time slot: 500 steps in pieces of 7.
    rnd = random.Random(1)
    rows = [(k, 1, rnd.choice(["confirm", "reject", "revise"]), T0 + dt.timedelta(seconds=k)) for k in range(500)]
    steps = log(make, rows).select("entry_id", "created_at", "id", folds.clamp_step(F.col("operation")).alias("step"))
    order = ["created_at", "id"]
    trust, before = 0.5, {}
    for k, _, op, _ in rows:
        before[k] = trust
        trust = {"confirm": min(1.0, trust + 0.05), "reject": max(0.0, trust - 0.1), "revise": 0.6}[op]
    total = folds.compose_steps(steps, "entry_id", order, chunk=7).select(folds.apply_step(F.lit(0.5), F.col("step")).alias("t"))
    assert [r["t"] for r in total.collect()] == pytest.approx([trust], abs=1e-8)
    seen = folds.steps_before(steps, "entry_id", order, chunk=7).select("id", folds.apply_step(F.lit(0.5), F.col("before")).alias("t"))
    assert {r["id"]: r["t"] for r in seen.collect()} == pytest.approx(before, abs=1e-8)


def test_number_rows(make):
    df = make("seq long", [(i * 3,) for i in range(50)]).repartition(7)
    got = folds.number_rows(df, ["seq"], "n", 100).orderBy("seq").collect()
    assert [r["n"] for r in got] == list(range(101, 151))


REQ = "id long, entry_id long, operation string, value string, reason string, reason_category string, feedback string, created_at timestamp"


def request(id, entry_id, op, value=None, reason=None, minute=0):
    return (id, entry_id, op, value, reason, "ai_error", "", T0 + dt.timedelta(minutes=minute))


def sequential(entries, requests):
    rows = {e[0]: dict(zip(("id", "dimension", "entity", "tag", "fact", "status", "confidence", "sources", "reasoning", "trust", "s"), e)) for e in entries}
    logs, spawned = {}, []
    for id, eid, op, value, reason, _, _, _ in sorted(requests, key=lambda r: (r[7], r[0])):
        row = rows.get(eid)
        if row is None or op not in learning.OPERATIONS or (op in ("edit_fact", "change_tag", "change_entity", "revise") and not value) or (op == "retire" and not reason):
            continue
        before = dict(row)
        new_fact, new_trust = None, None
        if op == "retire":
            row.update(status="retired", reasoning=reason)
        elif op == "edit_fact":
            row["fact"] = new_fact = value
        elif op == "change_tag":
            row["tag"] = value
        elif op == "change_entity":
            row["entity"] = value
        elif op in ("promote", "confirm"):
            row.update(status="confident", trust=min(1.0, row["trust"] + 0.05))
        elif op == "un_retire":
            row.update(status="confident", reasoning=None)
        elif op == "reject":
            row.update(status="retired", reasoning=reason or "Rejected by user", trust=max(0.0, row["trust"] - 0.1))
        elif op == "revise":
            row.update(status="retired", reasoning=reason or "Revised by user")
            new_fact, new_trust = value, 0.6
            spawned.append((eid, before["entity"], before["tag"], value, reason or f"Revised from entry {eid}"))
        logs[id] = (before["fact"], new_fact, round(before["trust"], 6), round(row["trust"] if new_trust is None else new_trust, 6))
    return rows, logs, spawned


@pytest.mark.parametrize("chunk", [3, 1000])
def test_corrections_match_a_sequential_run(make, chunk):
    rnd = random.Random(9)
    entries = [entry(i, rnd.random()) for i in range(1, 6)]
    ops = [*learning.OPERATIONS, "zap"]
    requests = [request(k, rnd.choice([1, 1, 1, 1, 2, 3, 4, 5, 99]), rnd.choice(ops), rnd.choice(["", f"v{k}", f"w{k}"]), rnd.choice([None, f"r{k}"]), rnd.randint(0, 600)) for k in range(300)]
    out = learning.apply_corrections(make(ENTRY, entries), make(REQ, requests), chunk=chunk)
    rows, logs, spawned = sequential(entries, requests)
    for r in out.entries.collect():
        want = rows[r["id"]]
        assert (r["fact"], r["tag"], r["entity"], r["status"], r["reasoning"]) == tuple(want[c] for c in ("fact", "tag", "entity", "status", "reasoning"))
        assert r["trust_score"] == pytest.approx(want["trust"], abs=1e-8)
    got = {r["id"]: (r["old_fact"], r["new_fact"], round(r["old_trust_score"], 6), round(r["new_trust_score"], 6)) for r in out.log.collect()}
    assert got == logs
    assert out.rejects.count() == len(requests) - len(logs)
    new = out.spawned.orderBy("id").collect()
    assert [(r["entry_id"], r["entity"], r["tag"], r["fact"], r["reasoning"]) for r in new] == spawned
    assert [r["id"] for r in new] == list(range(6, 6 + len(spawned)))
    assert {r["trust_score"] for r in new} == {0.6} and {r["status"] for r in new} == {"pending"}


CORR = "id long, entry_id long, operation string, reason_category string, feedback string, old_fact string, new_fact string, created_at timestamp"


def test_few_shot_scoring(make):
    entries = make("id long, dimension string, entity string", [(1, "people", "Alice"), (2, "tools", "Git"), (3, "tools", None)])
    rows = [(k, 1 + k % 3, "reject", "ai_error" if k % 4 else "other", f"fb{k}" if k % 2 else "", f"old{k}", f"new{k}" if k % 5 else None, T0 + dt.timedelta(minutes=k)) for k in range(40)]
    got = context.few_shot(make(CORR, rows), entries, make("target string, entities array<string>", [("tools", ["ALICE"])]), cap=6).orderBy("rank").collect()
    keyed = {1: ("people", "Alice"), 2: ("tools", "Git"), 3: ("tools", None)}
    pool = sorted((r for r in rows if r[3] == "ai_error"), key=lambda r: r[7], reverse=True)[:20]
    scored = []
    for idx, r in enumerate(pool):
        dim, ent = keyed[r[1]]
        scored.append((-((3 if dim == "tools" else 0) + (2 if ent and ent.lower() == "alice" else 0) + max(0, 1 - idx * 0.1)), idx, r[0]))
    assert [r["id"] for r in got] == [k for *_, k in sorted(scored, key=lambda s: (round(s[0], 9), s[1]))[:6]]
    first = next(r for r in rows if r[0] == got[0]["id"])
    assert got[0]["line"].startswith('- For [') and f'"{first[5]}".' in got[0]["line"]


def test_extraction_requests_prefer_corrections_of_known_entities(make):
    """An old correction about an entity of the dimension's facts comes before newer ones about others."""
    shape = ENTRY + ", updated_at timestamp"
    entries = make(shape, [
        (*entry(1, entity="Alice"), T0), (*entry(2, entity=None), T0),
        (3, "tools", "ALICE", *entry(3)[3:], T0), (4, "places", "Rome", *entry(4)[3:], T0),
    ])
    corrections = [(0, 3, "reject", "ai_error", "", "about alice", "right", T0)]
    corrections += [(k, 4, "reject", "ai_error", "", f"old{k}", "right", T0 + dt.timedelta(days=k)) for k in range(1, 31)]
    docs = make(
        "id long, full_body string, summary string, classify_content_hash string, content_hash string, status string, classify_last_error string",
        [(7, "body", None, None, "h", None, None)],
    )
    rulebook = {d: {"tags": ["other"], "guidance": "g"} for d in ("people", "empty")}
    comments = make("id long, entry_id long, comment_text string, created_at timestamp", [])
    got = {r["dimension"]: r["few_shot"] for r in context.extraction_requests(docs, entries, make(CORR, corrections), comments, rulebook).collect()}
    assert '"about alice"' in got["people"][0] and [f'"old{30 - i}"' in x for i, x in enumerate(got["people"][1:])] == [True] * 4
    assert len(got["empty"]) == 5 and not any("about alice" in x for x in got["empty"])


def test_reports(make):
    e = make("id long, dimension string, entity string, tag string, fact string, status string, confidence double, trust_score double, sources array<string>", [
        (1, "people", "A", "role", "f1", "confident", 0.9, 0.6, ["1"]), (2, "people", "A", "role", "f2", "pending", 0.5, 0.5, ["2"]),
        (3, "people", "A", "role", "f3", "confident", 0.9, 0.9, ["x"]), (4, "people", "B", "role", "f4", "confident", 0.9, 0.5, []),
        (5, "people", "B", "role", "f5", "pending", 0.9, 0.5, []), (6, "people", None, "role", "f6", "confident", 0.9, 0.9, []),
        (7, "people", None, "role", "f7", "pending", 0.9, 0.5, []),
    ])
    c = reports.detect_conflicts(e).collect()
    assert [(r["trusted_id"], r["pending_id"], r["n_trusted"]) for r in c] == [(3, 2, 2)]
    assert {(r["id"], r["role"]) for r in reports.conflict_members(e).collect()} == {(1, "trusted"), (2, "pending"), (3, "trusted")}
    keys = make("entity string, dimension string, tag string", [("A", "people", "role")])
    assert {(r["trusted_id"], r["pending_id"]) for r in reports.conflict_pairs(e, keys).collect()} == {(1, 2), (3, 2)}
    line = reports.conflict_lines(reports.detect_conflicts(e)).first()["line"]
    assert line == '  Trusted [3] A/people/role: "f3" (trust=0.9) vs Pending [2]: "f2"'
    docs = make("id long, title string, summary string", [(1, "T", "s" * 300), (2, "U", None), (3, "V", "x")])
    assert [r["id"] for r in reports.uncovered_documents(docs, e).collect()] == [3]
    lines = {r["id"]: r["line"] for r in reports.summary_lines(docs).collect()}
    assert lines[1] == "  [1] T: " + "s" * 300 and lines[2] == "  [2] U: "
    assert set(reports.build_report("conflicts", e, None, docs)) == {"members", "conflicts"}
    with pytest.raises(ValueError):
        reports.build_report("nope", e, None, docs)


def test_orientation_order(make):
    t = dt.datetime
    rows = [
        ("people", "Alice", "A1", "confident", 0.90, 0.95, 10.0, t(2026, 6, 1, 10)), ("people", "Alice", "A2", "confident", 0.85, 0.80, 5.0, t(2026, 6, 1, 9)),
        ("people", "Alice", "A3", "confident", 0.85, 0.80, 7.0, t(2026, 6, 1, 8)), ("people", "Bob", "B1", "retired", 0.99, 0.99, 100.0, t(2026, 6, 1, 11)),
        ("process", "standup", "P1", "confident", 0.70, 0.60, 2.0, t(2026, 6, 1, 7)), ("people", "Charlie", "C1", "confident", 0.95, 0.80, 7.0, t(2026, 6, 1, 6)),
        ("people", "Diana", "D1", "confident", 0.90, 0.80, 7.0, t(2026, 6, 2)), ("people", "Eve", "E1", None, 0.9, 0.99, 7.0, t(2026, 6, 2)),
        ("people", "Eve", "E2", "confident", 0.9, None, 7.0, t(2026, 6, 2)), ("people", "Eve", "E3", "confident", 0.9, 0.29, 7.0, t(2026, 6, 2)),
    ]
    e = make("id long, dimension string, entity string, fact string, status string, confidence double, trust_score double, retrieval_score double, updated_at timestamp", [(i, *r) for i, r in enumerate(rows)])
    got = context.orientation(e).orderBy("dimension", "rank").collect()
    assert [r["fact"] for r in got] == ["A1", "C1", "D1", "A3", "A2", "P1"]
    # Alice has the best fact, so she claims the people dimension.
    names = make("entity string", [("Diana",), ("Alice",), ("standup",)])
    got = context.orientation_for_entities(e, names).orderBy("dimension", "rank").collect()
    assert [r["fact"] for r in got] == ["A1", "A3", "A2", "P1"]
    top = context.top_entries(e, 2).collect()
    assert {r["fact"] for r in top} == {"A1", "C1", "P1"}
    ents = {r["entity"]: r["cnt"] for r in context.entity_map(e, 2).collect()}
    assert ents == {"Alice": 3, "Eve": 3, "standup": 1}
    assert {r["extra"] for r in context.entity_map(e, 2).filter("dimension = 'people'").collect()} == {2}


def test_comments_and_bullets(make):
    e = make("id long, entity string, fact string, confidence double, reasoning string", [(1, "A", "f", 0.9, "why"), (2, "B", "g", 0.5, "")])
    c = make("id long, entry_id long, comment_text string, created_at timestamp", [(2, 1, "late", T0 + dt.timedelta(hours=1)), (1, 1, "early", T0), (3, 9, "x", T0)])
    got = {r["id"]: r["reasoning"] for r in context.attach_comments(e, c).collect()}
    assert got == {1: "why\nComments: early; late", 2: ""}
    log_ = make("entry_id long", [(1,)] * 3 + [(2,)] * 2)
    got = {r["id"]: r["bullet"] for r in context.mark_volatile(e, log_).collect()}
    assert got == {1: "- [A] f (confidence: 0.9) [frequently corrected]", 2: "- [B] g (confidence: 0.5)"}
