import pytest
from pyspark.sql import functions as F

from mnemospark.functions import paths, quality
from mnemospark.schemas import Bands


@pytest.fixture
def paths_df(make):
    return lambda *p: make("p string", [(x,) for x in p])


def verdicts(df, column):
    return {r["p"]: r["x"] for r in df.select("p", column.alias("x")).collect()}


def test_location_context(paths_df):
    got = verdicts(paths_df("Domain/Ops/a.md", "Projects/A/b/c.md", "inbox/x.md", "Projects/x.md", "else/y.md", "inbox"), paths.location_context(F.col("p")))
    assert {k: (v["type"], v["name"]) for k, v in got.items()} == {
        "Domain/Ops/a.md": ("domain", "Ops"), "Projects/A/b/c.md": ("project", "A"), "inbox/x.md": ("inbox", None),
        "Projects/x.md": ("project", "x.md"), "else/y.md": (None, None), "inbox": (None, None),
    }


def test_excluded(paths_df):
    keep = ["Projects/A/n.md", "Projects/A/attachment/.summaries/a.pdf.md", "inbox/.summaries/a.md", "a/~x.md"]
    drop = [
        ".git/x", "Projects/A/.obsidian/y", "Projects/A/.summaries/z.md", "A/Briefings/b.md", "A/.hidden/x.md", "A/.x.md",
        "A/n.sync-conflict-1.md", "A/~$doc.docx", "A/._r", "A/x.lock", "A/CLAUDE.md", "A/Thumbs.db", "node_modules/a.md",
        "attachment/.summaries/.x.md",
    ]
    got = verdicts(paths_df(*keep, *drop), paths.is_excluded(F.col("p")))
    assert got == {**dict.fromkeys(keep, False), **dict.fromkeys(drop, True)}


def test_managed_areas_and_misplaced(paths_df):
    df = paths_df("Projects/A/attachment/x.pdf", "Projects/A/.summaries/x.md", "inbox/q.md", "Projects/s.md", "Domain/Briefings", "Projects/A/x.md")
    assert [k for k, v in verdicts(df, paths.is_managed_attachment(F.col("p"))).items() if v] == ["Projects/A/attachment/x.pdf"]
    managed = {k for k, v in verdicts(df, paths.is_managed_summaries(F.col("p"))).items() if v}
    assert managed == {"Projects/A/attachment/x.pdf", "Projects/A/.summaries/x.md", "inbox/q.md"}
    assert [k for k, v in verdicts(df, paths.is_misplaced(F.col("p"))).items() if v] == ["Projects/s.md"]


def test_batch_folder(paths_df):
    df = paths_df("inbox", "inbox/drop", "inbox/attachment", "Projects/A", "Projects/A/sub", "Domain/D/Archive", "other/x")
    assert {k for k, v in verdicts(df, paths.is_batch_folder(F.col("p"))).items() if v} == {"inbox/drop", "Projects/A/sub"}


def test_placement(paths_df):
    got = verdicts(paths_df("inbox/a.PDF", "Projects/A/b.docx"), paths.placement(F.col("p"), F.lit("project"), F.lit("A")))
    assert tuple(got["inbox/a.PDF"]) == ("Projects/A/attachment", "Projects/A/attachment/.summaries", True)
    assert tuple(got["Projects/A/b.docx"]) == ("Projects/A", "Projects/A/.summaries", False)


def test_ignore_patterns(paths_df):
    df = paths_df(".git/refs/x", "a/.DS_Store", "a/~$x.docx", "a/b.tmp", "a.tmp/b.md", "a/gitx")
    got = verdicts(df, paths.matches_ignore(F.col("p"), [".git", ".DS_Store", "~$*", "*.tmp"]))
    assert [k for k, v in got.items() if not v] == ["a.tmp/b.md", "a/gitx"]


def test_path_checks(make):
    ok, bad = paths.split_valid_paths(make("vault_path string", [("a/b.md",), ("",), ("/x",), ("a/../b",), ("a\0b",), ("a..b",)]))
    assert {r[0] for r in ok.collect()} == {"a/b.md", "a..b"}
    assert bad.count() == 4


def test_bands(make):
    df = make("c double", [(0.85,), (0.6,), (0.59,), (None,)])
    got = [tuple(r) for r in df.select(quality.route(F.col("c")), quality.status_of(F.col("c"))).collect()]
    assert got == [("AUTO", "confident"), ("SUGGEST", "pending"), ("CLUELESS", "pending"), (None, None)]
    with pytest.raises(ValueError):
        Bands(auto=0.5, suggest=0.5)


def test_describable(make):
    df = make("m string, s long", [("image/png", 5), ("image/png", 50), ("text/plain", 500), (None, 1)])
    got = [r[0] for r in df.select(quality.describable(F.col("m"), F.col("s"), max_bytes=10)).collect()]
    assert got == ["ok", "too big", "unsupported type", "unsupported type"]


def test_tag_audit(make):
    df = make("id int, tags array<string>", [
        (1, ["type/note", "domain/Ops", "free", "type/note"]),
        (2, ["type/zzz", "domain/zzz", "a b", "x/1", "12", ""]),
        (3, ["type/note", "domain/12/3"]),
    ])
    rows = {r["id"]: r for r in quality.audit_tags(df, ["note"], ["Ops"]).collect()}
    assert rows[1]["valid"] == ["type/note", "domain/Ops", "free"] and len(rows[1]["violations"]) == 1
    assert rows[2]["valid"] == [] and len(rows[2]["violations"]) == 7
    assert rows[3]["valid"] == ["type/note"] and len(rows[3]["violations"]) == 1


def test_rename_plan(make):
    files = make("vault_path string, title string", [
        ("inbox/known.pdf", "T"), ("inbox/Budget plan.docx", "T"), ("inbox/a meeting.md", "Q3: plan"), ("inbox/notes.pdf", "x" * 200),
        ("inbox/3f2a9c.pdf", "Real/Title"), ("inbox/xkdhg.pdf", "T"), ("inbox/ab.md", "T"), ("inbox/2024-01.pdf", "T"), ("inbox/report.pdf", "T"),
    ])
    plan = quality.rename_plan(files, make("vault_path string", [("inbox/known.pdf",)]))
    got = {r["vault_path"][6:]: (r["action"], r["final_stem"], r["confidence"]) for r in plan.collect()}
    assert got == {
        "known.pdf": ("SKIP", "known", 1.0), "Budget plan.docx": ("SKIP", "Budget plan", 0.9),
        "a meeting.md": ("AUGMENT", "a meeting - Q3 plan", 0.85), "notes.pdf": ("AUGMENT", "notes", 0.85),
        "3f2a9c.pdf": ("FULL_RENAME", "RealTitle", 0.9), "xkdhg.pdf": ("FULL_RENAME", "T", 0.9), "ab.md": ("FULL_RENAME", "T", 0.9),
        "2024-01.pdf": ("FULL_RENAME", "T", 0.9), "report.pdf": ("SKIP", "report", 0.5),
    }


def test_rulebook(make):
    with pytest.raises(ValueError):
        quality.check_rulebook({"people": {"tags": ["role"], "guidance": "g"}})
    with pytest.raises(ValueError):
        quality.check_rulebook({"people": {"tags": ["other"], "guidance": " "}})
    facts = make("dimension string, tag string", [("people", "role"), ("people", "zz"), ("tools", "other"), ("people", None)])
    ok, bad = quality.validate_fact_tags(facts, {"people": {"tags": ["role", "other"], "guidance": "g"}})
    assert ok.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["unknown dimension", "unknown tag", "unknown tag"]
