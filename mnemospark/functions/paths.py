"""Rules over vault-relative POSIX paths, as Column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import extension
from mnemospark.schemas import DEFAULTS

# Folder layout and names that are never notes.
IGNORE_DIRS = (".git", ".obsidian", ".trash", ".stversions", "node_modules", "_assets", "_system")
IGNORE_FILES = (".DS_Store", "Thumbs.db", "CLAUDE.md")
GENERATED_DIRS = ("Documentation", "Synthesis", "Briefings")
NON_BATCH_DIRS = ("attachment", ".summaries", "Archive")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent(path: Column) -> Column:
    """Everything before the last ``/``; '' for a top-level name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def location_context(path: Column) -> Column:
    """``struct<type, name>`` of the area a path lies in."""
    p = parts(path)
    top, child = F.element_at(p, 1), F.try_element_at(p, F.lit(2))
    nested = F.size(p) > 1
    kind = (
        F.when(nested & (top == "Domain"), "domain")
        .when(nested & (top == "Projects"), "project")
        .when(nested & (top == "inbox"), "inbox")
    )
    name = F.when(nested & top.isin("Domain", "Projects"), child)
    return F.struct(kind.alias("type"), name.alias("name"))


def is_generated(path: Column) -> Column:
    return F.arrays_overlap(parts(path), _strings(GENERATED_DIRS))


def is_lock_file(path: Column) -> Column:
    return F.element_at(parts(path), -1).rlike(r"^(~\$|\.~lock|\._)|\.lock$")


def is_excluded(path: Column) -> Column:
    """Ignored folders, generated output, dot names, sync conflicts, lock and index files.

    A ``.summaries`` folder is kept when its parent is ``attachment`` or ``inbox``.
    """
    kept = F.regexp_replace(path, r"(^|/)(attachment|inbox)/\.summaries/", "$1$2/")
    name = F.element_at(parts(path), -1)
    return (
        F.arrays_overlap(parts(path), _strings(IGNORE_DIRS + GENERATED_DIRS))
        | kept.rlike(r"(^|/)\.")
        | name.contains(".sync-conflict-")
        | is_lock_file(path)
        | name.isin(*IGNORE_FILES)
    )


def is_managed_attachment(path: Column) -> Column:
    return path.rlike(r"^(Projects|Domain)/[^/]+/attachment/.")


def is_managed_summaries(path: Column) -> Column:
    return path.rlike(
        r"^inbox(/|$)|^(Projects|Domain)/[^/]+/attachment/.|^(Projects|Domain)/[^/]+/\.summaries(/|$)"
    )


def is_misplaced(path: Column) -> Column:
    return path.rlike(r"^(Projects|Domain)/[^/]+$") & ~is_generated(path)


def is_batch_folder(path: Column) -> Column:
    """Whether a *folder* path gets a batch record."""
    blocked = F.element_at(parts(path), -1).isin(*NON_BATCH_DIRS)
    return path.rlike(r"^inbox/.|^(Projects|Domain)/[^/]+/.") & ~blocked


def placement(path: Column, target_type: Column, target_name: Column) -> Column:
    """Where a file of a project or domain belongs, and whether it must move."""
    base = F.concat(F.when(target_type == "project", "Projects/").otherwise("Domain/"), target_name)
    fixed = extension(path).isin(*DEFAULTS.no_edit_extensions)
    final = F.when(fixed, F.concat(base, F.lit("/attachment"))).otherwise(base)
    return F.struct(
        final.alias("final_dir"),
        F.concat(final, F.lit("/.summaries")).alias("sibling_dir"),
        (parent(path) != final).alias("needs_move"),
    )


def matches_ignore(path: Column, patterns: list[str]) -> Column:
    """Plain patterns match any path component; glob patterns the file name only."""
    plain = [p for p in patterns if not set(p) & set("*?[")]
    globs = [p for p in patterns if set(p) & set("*?[")]
    hit = F.arrays_overlap(parts(path), _strings(plain)) if plain else F.lit(False)
    name = F.element_at(parts(path), -1)
    for glob in globs:
        hit = hit | name.rlike(_glob_regex(glob))
    return hit


def _glob_regex(glob: str) -> str:
    """Anchored Java pattern; ``translate`` ends with a two-character end anchor."""
    return "^" + fnmatch.translate(glob)[:-2] + r"\z"


def invalid_path_reason(path: Column) -> Column:
    """NULL for an acceptable upload path, else why it is refused."""
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(path.contains("\x00"), "NUL byte in path")
        .when(path.startswith("/"), "absolute path")
        .when(F.array_contains(parts(path), ".."), "parent component in path")
    )


def split_valid_paths(df: DataFrame, column: str = "vault_path") -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reason", invalid_path_reason(F.col(column)))
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )
