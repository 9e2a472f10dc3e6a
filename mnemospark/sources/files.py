"""Folders of files: note scans, drop scans, manifests and text extraction."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import mimetypes
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemospark.functions.paths import is_excluded, is_managed_attachment, matches_ignore
from mnemospark.functions.text import extension, note_hash
from mnemospark.schemas import DEFAULTS
from mnemospark.session import cut_lineage, literal_rows

# Front-matter keys with a column of their own, and retired keys.
KNOWN_KEYS = (
    "title", "type", "tags", "project", "created", "updated", "confidence", "updated_by_human", "summary",
    "source", "source_file", "attachment_path", "status", "source_hash", "suggested_project",
    "suggested_primary_domain", "classify_confidence", "classify_reasoning",
)
DEPRECATED_KEYS = ("domain",)


_LISTED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("vault_path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
    ]
)


def _open_root(root: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^[a-zA-Z0-9]+:", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _list_folders(root: str):
    """Entries of each folder in a batch of ``path``; symlinks are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _open_root(root)
        base = base.rstrip("/") + "/"
        local = isinstance(files, fs.LocalFileSystem)
        for pdf in batches:
            for folder in pdf["path"]:
                found = files.get_file_info(fs.FileSelector(folder))
                kept = [i for i in found if not (local and os.path.islink(i.path))]
                yield pd.DataFrame(
                    {
                        "path": [i.path for i in kept],
                        "vault_path": [unicodedata.normalize("NFC", i.path[len(base) :]) for i in kept],
                        "is_dir": [i.type == fs.FileType.Directory for i in kept],
                        "size": pd.array([i.size for i in kept], dtype="Int64"),
                        "mtime": [i.mtime.timestamp() if i.mtime else None for i in kept],
                    },
                    columns=_LISTED.names,
                )

    return run


def list_files(
    spark: SparkSession, root: str, prune: Callable[[Column], Column] | None = None, max_depth: int = 100
) -> DataFrame:
    """``(path, vault_path, size, mtime)`` of all files under ``root``, hidden ones too.

    Spark's own file sources skip names that start with a dot or an underscore, and
    summary notes live in dot folders. Folders are listed level by level, each level
    by one distributed job. ``prune`` drops folders before they are entered.
    """
    _files, base = _open_root(root)
    frontier = literal_rows(spark, [(base.rstrip("/"),)], T.StructType([T.StructField("path", T.StringType())]))
    levels = []
    for _ in range(max_depth):
        found = cut_lineage(frontier.mapInPandas(_list_folders(root), _LISTED))
        levels.append(found.filter(~F.col("is_dir")).drop("is_dir"))
        frontier = found.filter("is_dir")
        if prune is not None:
            frontier = frontier.filter(~prune(F.concat("vault_path", F.lit("/-"))))
        if frontier.isEmpty():
            break
        frontier = frontier.select("path").repartition(spark.sparkContext.defaultParallelism)
    else:
        raise RuntimeError("folders are nested too deeply; raise max_depth")
    return reduce(DataFrame.unionByName, levels)


def read_contents(listing: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Add ``content`` to listed files; also returns the files that cannot be read."""
    schema = T.StructType(
        [
            *[f for f in listing.schema.fields],
            T.StructField("content", T.BinaryType()),
            T.StructField("reason", T.StringType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _base = _open_root(root)
        for pdf in batches:
            for n in range(len(pdf)):
                row = pdf.iloc[n : n + 1].copy()
                try:
                    with files.open_input_stream(row["path"].iloc[0]) as stream:
                        content, reason = stream.read(), None
                except OSError as problem:
                    content, reason = None, str(problem)
                yield row.assign(content=[content], reason=[reason])

    # Spread by path: one folder may hold most of the files.
    read = listing.repartition(F.xxhash64("path")).mapInPandas(run, schema)
    return read.filter(F.col("reason").isNull()).drop("reason"), read.filter(F.col("reason").isNotNull()).drop("content")


def _yaml_scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return text


def split_front_matter(text: str) -> tuple[dict[str, list[str] | str], str]:
    """Front matter of plain ``key: value`` lines and lists, and the note body.

    Raises ``ValueError`` for a block that is opened but never closed.
    """
    if not text.startswith("---\n"):
        return {}, text
    lines = text.split("\n")
    closing = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None)
    if closing is None:
        raise ValueError("front matter is not closed")
    fields: dict[str, list[str] | str] = {}
    key = None
    for line in lines[1:closing]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key is not None:
            items = fields[key] if isinstance(fields[key], list) else []
            fields[key] = [*items, _yaml_scalar(line.lstrip()[2:])]
            continue
        key, colon, value = line.partition(":")
        key = key.strip()
        if not colon:
            raise ValueError(f"front matter line without key: {line!r}")
        value = value.strip()
        if value.startswith("[") and value.endswith("]"):
            fields[key] = [_yaml_scalar(v) for v in value[1:-1].split(",") if v.strip()]
        else:
            fields[key] = _yaml_scalar(value)
    return fields, "\n".join(lines[closing + 1 :])


# Words YAML 1.1 reads as booleans; notes keep them as yes / no.
_YES, _NO = ("yes", "on", "true"), ("no", "off", "false")


def _as_text(value: list[str] | str) -> str:
    if isinstance(value, list):
        return ", ".join(value)
    return "yes" if value.lower() in _YES else "no" if value.lower() in _NO else value


_NOTE = T.StructType(
    [
        T.StructField("vault_path", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("note_type", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("project", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)


def _parse_notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.name for f in _NOTE.fields]
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["vault_path"], pdf["content"]):
            try:
                fields, body = split_front_matter(bytes(content).decode("utf-8"))
            except ValueError as problem:
                rows.append([path, None, None, None, None, None, None, None, None, str(problem)])
                continue
            tags = fields.get("tags", [])
            tags = tags if isinstance(tags, list) else [tags] if tags else []
            pick = [_as_text(fields[k]) if k in fields else None for k in ("type", "project", "summary", "status")]
            title = fields.get("title")
            extra = {k: _as_text(v) for k, v in fields.items() if k not in KNOWN_KEYS}
            rows.append([path, _as_text(title) if title else None, pick[0], tags, *pick[1:], body, extra, None])
        yield pd.DataFrame(rows, columns=names)


def parse_notes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``files(vault_path, content)`` to notes with body hash, and unreadable ones."""
    parsed = files.select("vault_path", "content").mapInPandas(_parse_notes, _NOTE)
    notes = parsed.filter(F.col("reason").isNull()).drop("reason").withColumn("content_hash", note_hash(F.col("body")))
    return notes, parsed.filter(F.col("reason").isNotNull()).select("vault_path", "reason")


def output_extra(extra: Column) -> Column:
    """Unknown front-matter keys as written back: retired keys are left out."""
    return F.map_filter(extra, lambda k, v: ~k.isin(*DEPRECATED_KEYS))


def scan_notes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Markdown notes of a folder tree and the notes that could not be read."""
    path = F.col("vault_path")
    listed = list_files(spark, root, prune=is_excluded)
    readable, broken = read_contents(listed.filter(~is_excluded(path) & F.lower(path).endswith(".md")), root)
    notes, rejects = parse_notes(readable)
    return notes, rejects.unionByName(broken.select("vault_path", "reason"))


def scan_drops(listing: DataFrame) -> DataFrame:
    """Non-markdown files that still need capture, from ``listing(vault_path, ...)``.

    Files in managed attachment folders are done, and so are inbox files that have
    a summary note beside them.
    """
    path = F.col("vault_path")
    drops = listing.filter(~is_excluded(path) & ~F.lower(path).endswith(".md") & ~is_managed_attachment(path))
    name = F.element_at(F.split(path, "/"), -1)
    marker = F.when(path.startswith("inbox/"), F.concat(F.lit("inbox/.summaries/"), name, F.lit(".md")))
    done = listing.filter(path.startswith("inbox/.summaries/")).select(path.alias("_marker"))
    return drops.withColumn("_marker", marker).join(done, "_marker", "left_anti").drop("_marker")


def _unignored(spark: SparkSession, root: str, ignore: list[str]) -> DataFrame:
    def skipped(path: Column) -> Column:
        return matches_ignore(path, [p for p in ignore if not set(p) & set("*?[")])

    return list_files(spark, root, prune=skipped).filter(~matches_ignore(F.col("vault_path"), ignore))


def build_manifest(spark: SparkSession, root: str, ignore: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(vault_path, hash, size, mtime)`` of every file that no pattern ignores, and
    the unreadable paths."""
    files, unreadable = read_contents(_unignored(spark, root, ignore or []), root)
    manifest = files.select("vault_path", F.sha2("content", 256).alias("hash"), "size", "mtime")
    return manifest, unreadable.select("vault_path", "reason")


def changed_since(spark: SparkSession, root: str, cache: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Files whose size or time differs from the cache: listed without reading contents."""
    same = cache.select("vault_path", "size", "mtime")
    return _unignored(spark, root, ignore or []).join(same, ["vault_path", "size", "mtime"], "left_anti")


# --- text extraction ----------------------------------------------------------

# Element subtrees that carry no article text.
PIECE = 64  # rows that are Python objects at once
_DROPPED = ("script", "style", "head", "nav", "footer")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.depth.append(tag)
        elif tag == "body" and self.depth == ["head"]:
            self.depth.clear()

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth.pop() != tag:
                pass

    def handle_data(self, data):
        text = data.strip()
        if text and not self.depth:
            self.found.append(text)


def _html_text(html: str) -> str | None:
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.found) or None


def _by_pieces(one: Callable, *columns: pa.Array) -> pa.Array:
    """``one`` of each row as strings, of ``PIECE`` rows at a time, so that few are Python objects at once."""
    parts = [pa.array([], pa.string())]
    for at in range(0, len(columns[0]), PIECE):
        parts.append(pa.array([one(*row) for row in zip(*(c.slice(at, PIECE).to_pylist() for c in columns))], pa.string()))
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def html_to_text(html: pa.Array) -> pa.Array:
    """Visible text of pages, one text node per line; NULL when nothing is left."""
    return _by_pieces(lambda page: None if page is None else _html_text(page), html)


def _markdown_text(raw: bytes) -> str:
    return split_front_matter(raw.decode("utf-8"))[1].rstrip("\n")


def _csv_text(raw: bytes) -> str:
    rows = csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))
    return "\n".join(",".join(row) for row in rows).strip()


def _page_text(raw: bytes) -> str:
    text = _html_text(raw.decode("utf-8", errors="replace"))
    if text is None:
        raise ValueError("page has no text")
    return text


def _mail_text(raw: bytes) -> str:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    head = [f"{name}: {message.get(name, '')}" for name in ("From", "To", "Subject", "Date")]
    plain = [p.get_content() for p in message.walk() if p.get_content_type() == "text/plain"]
    return ("\n".join(head) + "\n\n" + "\n".join(plain).strip()).strip()


EXTRACTORS = {"md": _markdown_text, "csv": _csv_text, "html": _page_text, "htm": _page_text, "eml": _mail_text}

_EXTRACTED = T.StructType(
    [
        T.StructField("vault_path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mime", T.StringType()),
    ]
)


def extract_text(files: DataFrame, max_bytes: int = DEFAULTS.max_file_bytes, extractors=None) -> tuple[DataFrame, DataFrame]:
    """``files(vault_path, size, content)`` to extracted rows, and oversize rejects.

    Size is judged before the content is read. A file whose extractor fails, or that
    has none, keeps its row with NULL text and a guessed mime type. The hash is over
    the raw bytes.
    """
    routes = extractors or EXTRACTORS

    schema = to_arrow_schema(_EXTRACTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (batch.slice(at, PIECE) for batch in batches for at in range(0, batch.num_rows, PIECE)):
            rows = []
            for path, ext, digest, size, content in zip(*(c.to_pylist() for c in piece.columns)):
                text = None
                extractor = routes.get(ext)
                if extractor is not None:
                    try:
                        text = extractor(bytes(content))
                    except Exception:  # a broken file must not fail the job
                        text = None
                kind = "binary" if text is None else "text"
                mime = mimetypes.guess_type(path)[0] or "application/octet-stream"
                rows.append((path, kind, text, digest, size, mime))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    small = files.filter(F.col("size") <= max_bytes).select(
        "vault_path", extension(F.col("vault_path")).alias("ext"), F.sha2("content", 256).alias("hash"), "size",
        # Contents without an extractor never cross to Python.
        F.when(extension(F.col("vault_path")).isin(*routes), F.col("content")).alias("content"),
    )
    rejects = files.filter(F.col("size") > max_bytes).select("vault_path", "size", F.lit("file too big").alias("reason"))
    return small.mapInArrow(run, _EXTRACTED), rejects


def text_column(path: Column, content: Column) -> Column:
    """Extracted text of a content column, NULL where there is none; also for streams."""

    @F.arrow_udf(T.StringType())
    def extract(ext: pa.Array, raw: pa.Array) -> pa.Array:
        def one(e: str, data: bytes | None) -> str | None:
            try:
                return EXTRACTORS[e](bytes(data))
            except Exception:  # a broken file must not fail the job
                return None

        return _by_pieces(one, ext, raw)

    known = F.when(extension(path).isin(*EXTRACTORS), content)
    return extract(extension(path), known)
