"""Rules that judge tags, file names and confidences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import extension, path_stem, safe_stem, strip
from mnemospark.schemas import DEFAULTS, Bands

# Characters a tag may not hold, and placeholder file names.
TAG_FORBIDDEN = r"""[ \t\r\n#@!.,;:"'`\\^*+=%&|<>(){}\[\]?]"""
GENERIC_NAMES = (
    "untitled", "notes", "note", "meeting", "a meeting",
    "new note", "draft", "scratch", "temp", "tmp",
    "document", "new document", "file", "new file",
    "inbox", "todo", "wip",
)


def route(confidence: Column, bands: Bands = DEFAULTS.bands) -> Column:
    return (
        F.when(confidence >= bands.auto, "AUTO")
        .when(confidence >= bands.suggest, "SUGGEST")
        .when(confidence.isNotNull(), "CLUELESS")
    )


def status_of(confidence: Column, bands: Bands = DEFAULTS.bands) -> Column:
    return F.when(confidence >= bands.auto, "confident").when(confidence.isNotNull(), "pending")


def describable(mime: Column, size: Column, prefixes=DEFAULTS.describable_prefixes, max_bytes=DEFAULTS.describable_bytes) -> Column:
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.coalesce(mime, F.lit("")).startswith(prefix)
    return F.when(~wanted, "unsupported type").when(size > max_bytes, "too big").otherwise("ok")


def well_formed_tag(tag: Column) -> Column:
    bad_segment = F.exists(F.split(tag, "/"), lambda s: s.rlike(r"^\d*$"))
    return (tag != "") & ~tag.rlike(TAG_FORBIDDEN) & ~bad_segment


def audit_tags(df: DataFrame, types: list[str], domains: list[str], column: str = "tags") -> DataFrame:
    """Add ``valid`` tags and ``violations`` to a table of notes.

    Exactly one known ``type/`` tag is expected; later ones are dropped.
    """
    allowed = F.array(*[F.lit(f"type/{t}") for t in types], *[F.lit(f"domain/{d}") for d in domains])

    def verdict(tag: Column) -> Column:
        quoted = F.concat(F.lit("'"), tag, F.lit("'"))
        return (
            F.when(~well_formed_tag(tag), F.concat(F.lit("invalid tag format: "), quoted))
            .when(F.array_contains(allowed, tag), F.lit("ok"))
            .when(tag.startswith("type/"), F.concat(F.lit("unknown type tag: "), quoted))
            .when(tag.startswith("domain/"), F.concat(F.lit("unknown domain tag: "), quoted))
            .when(tag.contains("/"), F.concat(F.lit("free tag has namespace prefix: "), quoted))
            .otherwise("ok")
        )

    judged = F.transform(F.col(column), lambda t: F.struct(t.alias("tag"), verdict(t).alias("why")))
    out = df.withColumn("_judged", judged)
    good = F.transform(F.filter("_judged", lambda x: x["why"] == "ok"), lambda x: x["tag"])
    bad = F.transform(F.filter("_judged", lambda x: x["why"] != "ok"), lambda x: x["why"])
    out = out.withColumn("_good", good).withColumn("_bad", bad)
    n_types = F.size(F.filter("_good", lambda t: t.startswith("type/")))
    first_type = F.array_position(F.transform("_good", lambda t: t.startswith("type/")), F.lit(True))
    kept = F.filter("_good", lambda t, i: ~t.startswith("type/") | (i + 1 == first_type))
    note = (
        F.when(n_types == 0, F.array(F.lit("no type/ tag found")))
        .when(n_types > 1, F.array(F.format_string("multiple type/ tags found (%d)", n_types)))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        out.withColumn("valid", kept)
        .withColumn("violations", F.concat("_bad", note))
        .drop("_judged", "_good", "_bad")
    )


def is_legible(stem: Column) -> Column:
    words = F.split(strip(stem), r"\s+")
    return (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("[a-zA-Z]"))


def is_generic(stem: Column) -> Column:
    return F.lower(strip(stem)).isin(*GENERIC_NAMES)


def is_illegible(stem: Column) -> Column:
    plain = F.regexp_replace(stem, "[-_]", "")
    words = F.regexp_extract_all(stem, F.lit("[a-zA-Z]{3,}"), F.lit(0))
    return (
        (F.length(stem) <= 2)
        | plain.rlike("^[0-9a-fA-F]{6,}$")
        | (F.size(words) == 0)
        | ~F.exists(words, lambda w: w.rlike("[aeiouAEIOU]"))
    )


def rename_plan(
    files: DataFrame,
    known: DataFrame,
    office=DEFAULTS.office_extensions,
    max_stem: int = DEFAULTS.max_stem_length,
) -> DataFrame:
    """Classify ``files(vault_path, title)`` as SKIP, AUGMENT or FULL_RENAME.

    ``known(vault_path)`` lists documents already in the catalog.
    """
    flags = known.select("vault_path").distinct().withColumn("_known", F.lit(True))
    stem = path_stem(F.col("vault_path"))
    title = safe_stem(F.coalesce(F.col("title"), F.lit("")))
    longer = F.concat(stem, F.lit(" - "), title)
    room = F.lit(max_stem) - F.length(stem) - 3
    fits = (room > 0) & (F.length(title) <= room)
    augmented = F.when(fits, longer).otherwise(stem)
    case = (
        F.when(F.col("_known"), "existing")
        .when(extension(F.col("vault_path")).isin(*office) & is_legible(stem) & ~is_generic(stem), "office")
        .when(is_generic(stem), "generic")
        .when(is_illegible(stem), "illegible")
        .otherwise("unclear")
    )
    c = F.col("_case")
    return (
        files.join(flags, "vault_path", "left")
        .withColumn("_case", case)
        .withColumn(
            "action",
            F.when(c == "generic", "AUGMENT").when(c == "illegible", "FULL_RENAME").otherwise("SKIP"),
        )
        .withColumn("final_stem", F.when(c == "generic", augmented).when(c == "illegible", title).otherwise(stem))
        .withColumn("reason", c)
        .withColumn(
            "confidence",
            F.when(c == "existing", 1.0)
            .when(c.isin("office", "illegible"), 0.9)
            .when(c == "generic", 0.85)
            .otherwise(0.5),
        )
        .drop("_known", "_case")
    )


def check_rulebook(rulebook: dict[str, dict]) -> None:
    """Each dimension needs guidance and the catch-all tag ``other``."""
    for dimension, rule in rulebook.items():
        if "other" not in rule.get("tags", []):
            raise ValueError(f"dimension {dimension!r} lacks the tag 'other'")
        if not str(rule.get("guidance", "")).strip():
            raise ValueError(f"dimension {dimension!r} has no guidance")


def validate_fact_tags(facts: DataFrame, rulebook: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Split facts by whether (dimension, tag) is in the rulebook, a small literal map."""
    check_rulebook(rulebook)
    rules = F.create_map(
        *[x for d, r in rulebook.items() for x in (F.lit(d), F.array(*[F.lit(t) for t in r["tags"]]))]
    )
    tags = F.try_element_at(rules, F.col("dimension"))
    reason = (
        F.when(tags.isNull(), "unknown dimension")
        .when(~F.coalesce(F.array_contains(tags, F.col("tag")), F.lit(False)), "unknown tag")
    )
    judged = facts.withColumn("reason", reason)
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()),
    )
