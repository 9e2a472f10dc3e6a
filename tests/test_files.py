import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from mnemospark.sources import files

NOTE = """---
title: "Plan: A"
type: meeting
tags: [a, b]
project: no
mood: yes
domain: old
list:
  - x
  - y
---
Body line
"""


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "my vault"
    tree = {
        "Projects/A/n 1%+.md": NOTE, "Projects/A/plain.MD": "just text\n\n", "Projects/A/broken.md": "---\ntitle: x\nno end", "inbox/CLAUDE.md": "x",
        "_notes.md": "kept", ".git/a.md": "x", "Briefings/b.md": "x", "inbox/.summaries/doc.pdf.md": "---\nsummary: s\n---\n", "inbox/doc.pdf": "pdf", "inbox/other.pdf": "pdf2",
        "Projects/A/attachment/z.png": "png", "Projects/A/sheet.csv": "﻿a,\"b,c\"\n1,2\n", "Projects/A/.hidden.md": "x",
        "Projects/A/" + unicodedata.normalize("NFD", "é") + ".md": "accent",
    }
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    (root / "Projects/A/bad.md").write_bytes(b"\xff\xfe\xfa")
    (root / "Projects/A/link.md").symlink_to(root / "_notes.md")
    return root


def test_scan_notes(spark, vault):
    notes, rejects = files.scan_notes(spark, str(vault))
    rows = {r["vault_path"]: r for r in notes.collect()}
    assert set(rows) == {"Projects/A/n 1%+.md", "Projects/A/plain.MD", "inbox/.summaries/doc.pdf.md", "Projects/A/é.md", "_notes.md"}
    n = rows["Projects/A/n 1%+.md"]
    assert (n["title"], n["note_type"], n["tags"], n["project"]) == ("Plan: A", "meeting", ["a", "b"], "no")
    assert n["extra"] == {"mood": "yes", "domain": "old", "list": "x, y"}
    assert n["content_hash"] == hashlib.sha256(b"Body line").hexdigest()
    kept = notes.select(files.output_extra(F.col("extra")).alias("x")).filter("size(x) > 0").first()["x"]
    assert kept == {"mood": "yes", "list": "x, y"}
    assert {r["vault_path"] for r in rejects.collect()} == {"Projects/A/broken.md", "Projects/A/bad.md"}


def test_scan_drops(spark, vault):
    drops = files.scan_drops(files.list_files(spark, str(vault)))
    assert {r["vault_path"] for r in drops.collect()} == {"inbox/other.pdf", "Projects/A/sheet.csv"}


def test_manifest_and_changed_listing(spark, vault):
    manifest, unreadable = files.build_manifest(spark, str(vault), [".git", "*.png"])
    assert unreadable.count() == 0
    rows = {r["vault_path"]: r for r in manifest.collect()}
    assert ".git/a.md" not in rows and "Projects/A/attachment/z.png" not in rows
    assert rows["inbox/doc.pdf"]["hash"] == hashlib.sha256(b"pdf").hexdigest() and rows["inbox/doc.pdf"]["size"] == 3
    manifest = spark.createDataFrame(manifest.collect(), manifest.schema)
    (vault / "inbox/doc.pdf").write_text("longer")
    changed = files.changed_since(spark, str(vault), manifest, [".git", "*.png"])
    assert [r["vault_path"] for r in changed.collect()] == ["inbox/doc.pdf"]


def test_unreadable_files_are_reported(spark, vault):
    listing = files.list_files(spark, str(vault))
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    (vault / "inbox/doc.pdf").unlink()
    good, bad = files.read_contents(listing, str(vault))
    assert [r["vault_path"] for r in bad.collect()] == ["inbox/doc.pdf"]
    assert good.count() == listing.count() - 1


MAIL = b"From: a@x\r\nTo: b@y\r\nSubject: Hi\r\nDate: now\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=Q\r\n\r\n--Q\r\nContent-Type: text/plain\r\n\r\none\r\n--Q\r\nContent-Type: text/html\r\n\r\n<b>no</b>\r\n--Q\r\nContent-Type: text/plain\r\n\r\ntwo\r\n--Q--\r\n"
PAGE = "<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><p>Main article <b>text</b></p><script>1</script><footer>f</footer></body></html>"


def test_extract(make):
    raw = [
        ("a.md", b"---\ntitle: t\n---\nBody\n\n"), ("b.csv", "﻿x,\"y\"\n1,2\n\n".encode()), ("empty.csv", b""), ("c.html", PAGE.encode()),
        ("d.html", b"<html><head><title>only</title></head></html>"), ("e.eml", MAIL), ("f.pdf", b"%PDF"), ("g.md", b"\xff\xff"), ("big.md", b"x" * 2000),
    ]
    df = make("vault_path string, content binary", raw).withColumn("size", F.length("content").cast("long"))
    rows, rejects = files.extract_text(df, max_bytes=1000)
    got = {r["vault_path"]: r for r in rows.collect()}
    text = {k: v["text"] for k, v in got.items()}
    assert text == {
        "a.md": "Body", "b.csv": "x,y\n1,2", "empty.csv": "", "c.html": "Main article\ntext", "d.html": None,
        "e.eml": "From: a@x\nTo: b@y\nSubject: Hi\nDate: now\n\none\ntwo", "f.pdf": None, "g.md": None,
    }
    assert got["f.pdf"]["mime"] == "application/pdf" and got["f.pdf"]["kind"] == "binary"
    assert got["g.md"]["content_hash"] == hashlib.sha256(b"\xff\xff").hexdigest()
    assert [r["vault_path"] for r in rejects.collect()] == ["big.md"]


def test_html_corners(spark):
    run = lambda h: spark.range(1).select(files.html_to_text(F.lit(h)).alias("t")).first()["t"]
    assert run("<nav>a<nav>b</nav>c</nav>d &amp; e<!-- no -->f") == "d & e\nf"
    assert run("<p>  </p>") is None
    assert run("<header>kept</header></nav>tail") == "kept\ntail"


def test_texts_become_python_objects_a_few_at_a_time(spark):
    """Pages and files of one batch are cut into pieces; nulls, empty pages and order stay."""
    rows = [(i, None if i % 7 == 3 else f"<p>a{i}</p>" if i % 5 else "") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, html string").coalesce(1)
    got = {r["id"]: r["t"] for r in df.select("id", files.html_to_text("html").alias("t")).collect()}
    assert got == {i: f"a{i}" if h else None for i, h in rows}
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    raw = df.select(F.concat(F.col("id"), F.lit(".md")).alias("vault_path"), F.lit(1).cast("long").alias("size"), F.encode("html", "utf-8").alias("content"))
    found, _ = files.extract_text(raw)
    assert "MapInArrow" in plan(found) and "Pandas" not in plan(found)
    assert {r["vault_path"]: r["text"] for r in found.collect()} == {f"{i}.md": h for i, h in rows}
