"""Text functions: tokens, stems, links, slugs, titles, formatted lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def _fold_tables() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition.

    Combining marks come last without a partner, so ``translate`` deletes them.
    """
    accented, base = [], []
    for block in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for code in range(*block):
            letter = chr(code).lower()
            if len(letter) != 1 or letter in accented:
                continue
            parts = unicodedata.normalize("NFD", letter)
            if len(parts) > 1 and parts[0].isascii() and all(map(unicodedata.combining, parts[1:])):
                accented.append(letter)
                base.append(parts[0])
    marks = "".join(map(chr, range(0x0300, 0x0370)))
    return "".join(accented) + marks, "".join(base)


FOLD_FROM, FOLD_TO = _fold_tables()


def fold(text: Column) -> Column:
    """Lower-case and strip accents."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; NULL text has no tokens."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


# --- stemming ---------------------------------------------------------------

_VOWELS = set("aeiou")


def _consonant(word: str, i: int) -> bool:
    if word[i] == "y":
        return i == 0 or not _consonant(word, i - 1)
    return word[i] not in _VOWELS


def _shape(stem: str) -> str:
    """The stem as runs, e.g. ``CVC``."""
    runs = ""
    for i in range(len(stem)):
        kind = "C" if _consonant(stem, i) else "V"
        if not runs.endswith(kind):
            runs += kind
    return runs


def _measure(stem: str) -> int:
    return _shape(stem).count("VC")


def _ends_cvc(word: str) -> bool:
    return (
        len(word) > 2
        and _consonant(word, len(word) - 1)
        and not _consonant(word, len(word) - 2)
        and _consonant(word, len(word) - 3)
        and word[-1] not in "wxy"
    )


# Suffix rules of the published Porter (1980) algorithm.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def porter(word: str) -> str:
    """Porter stem of one lower-case ASCII word; other words come back unchanged."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "V" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _ends_cvc(word):
                word += "e"
    if word.endswith("y") and "V" in _shape(word[:-1]):
        word = word[:-1] + "i"

    for table in (_STEP2, _STEP3):
        rules = dict(table)
        hit = _longest(word, rules)
        if hit and _measure(word[: -len(hit)]) > 0:
            word = word[: -len(hit)] + rules[hit]
    hit = _longest(word, _STEP4)
    if hit:
        stem = word[: -len(hit)]
        if _measure(stem) > 1 and (hit != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


STEM_CACHE = 500_000


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem whole token arrays; only the distinct words of a batch become Python strings, and a cache per task keeps stems."""
    known: dict[str, str] = {}

    def stem(word: str) -> str:
        found = known.get(word)
        if found is None:
            if len(known) >= STEM_CACHE:
                known.clear()
            found = known[word] = porter(word)
        return found

    for arrays in batches:
        words = arrays.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends), pa.int32()), stems, mask=arrays.is_null())


# --- links ------------------------------------------------------------------

# Link pattern, trailing punctuation and video hosts.
URL_PATTERN = r"https?://[^\s\)\]\>\"]+"
URL_TRAILING = ".,;:!?"
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "youtu.be", "m.youtube.com")
VIDEO_WATCH_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com")


def extract_urls(text: Column) -> Column:
    """Distinct links in order of first appearance, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(URL_PATTERN), F.lit(0))
    trimmed = F.transform(found, lambda u: F.rtrim(u, F.lit(URL_TRAILING)))
    return F.array_distinct(F.filter(trimmed, lambda u: u != ""))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def is_video_link(url: Column) -> Column:
    return url_netloc(url).isin(*VIDEO_HOSTS)


def video_id(url: Column) -> Column:
    """``v`` parameter of a watch page, or the path of a short link; NULL otherwise."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    watch = F.try_url_decode(F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]*/*([^?#]*)", 1)
    short = F.regexp_replace(path, r";[^/]*$", "")
    return (
        F.when(url_netloc(url).isin(*VIDEO_WATCH_HOSTS), F.nullif(watch, F.lit("")))
        .when(url_netloc(url) == "youtu.be", F.nullif(short, F.lit("")))
    )


# --- strings ----------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.trim(dashed, F.lit("-")), 1, 50)


def _unique_slug(text: Column) -> Column:
    """The slug, followed by a digest of the text where it was cut: two texts then never share it."""
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.length(dashed) <= 50, dashed).otherwise(F.concat(F.substring(dashed, 1, 50), F.lit("-"), F.substring(F.sha2(text, 256), 1, 16)))


def chat_path(ts: Column, title_hint: Column) -> Column:
    hint = F.when(F.coalesce(title_hint, F.lit("")) == "", "insight").otherwise(title_hint)
    return F.concat(F.lit("chat/"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), _unique_slug(hint), F.lit(".md"))


_TITLE_LINE = r"(?s)^(?:(.*)\n)?Title:([^\n]*)"


def split_summary(content: Column) -> Column:
    """Reply text to ``struct<summary, title>``; the last ``Title:`` line is the title."""
    body = strip(content)
    found = body.rlike(_TITLE_LINE)
    title = F.when(found, strip(F.regexp_extract(body, _TITLE_LINE, 2))).otherwise("")
    summary = F.when(found, strip(F.regexp_extract(body, _TITLE_LINE, 1))).otherwise(body)
    return F.struct(
        summary.alias("summary"),
        F.when(title == "", "Untitled").otherwise(title).alias("title"),
    )


def tag_segment(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("-"))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


def nfc(text: Column) -> Column:
    """NFC-normalise. ASCII rows go to the UDF as NULL, so they cost no transfer."""
    non_ascii = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(non_ascii, text)), text)


def safe_stem(title: Column) -> Column:
    """A title as file stem; feed it through :func:`nfc` first when it may be decomposed."""
    cleaned = F.regexp_replace(title, r'[/\\:*?"<>|]', "")
    return F.regexp_replace(strip(cleaned), r"\s+", " ")


def path_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Lower-case extension without dot, '' when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))


def derive_title(title: Column, extra_title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(extra_title, F.lit("")), path_stem(path))


def derive_topics(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~(t.startswith("domain/") | t.startswith("type/")))


def embedding_text(title: Column, note_type: Column, tags: Column, summary: Column) -> Column:
    parts = F.array(
        F.concat(F.lit("title: "), F.coalesce(title, F.lit("None"))),
        F.concat(F.lit("type: "), F.coalesce(note_type, F.lit("None"))),
        F.concat(F.lit("tags: "), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")),
        F.nullif(summary, F.lit("")),
    )
    return F.concat_ws(" | ", parts)


def note_hash(body: Column) -> Column:
    """Hash of a note body; trailing newlines do not count."""
    return F.sha2(F.regexp_replace(body, r"\n+\z", ""), 256)


def token_estimate(text: Column) -> Column:
    return (F.length(text) / 4).cast("long")


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def fact_bullet(entity: Column, fact: Column, confidence: Column, n_corrections: Column, volatile_at: int) -> Column:
    mark = F.when(F.coalesce(n_corrections, F.lit(0)) >= volatile_at, " [frequently corrected]").otherwise("")
    return F.concat(
        F.lit("- ["), entity, F.lit("] "), fact, F.lit(" (confidence: "), confidence.cast("string"), F.lit(")"), mark
    )


def few_shot_line(entity: Column, dimension: Column, old_fact: Column, new_fact: Column, feedback: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("- For ["), blank(entity), F.lit("] in ["), blank(dimension),
        F.lit(']: The AI incorrectly extracted "'), blank(old_fact), F.lit('".'),
        F.when(blank(new_fact) != "", F.concat(F.lit(' The correct fact is "'), new_fact, F.lit('".'))).otherwise(""),
        F.when(blank(feedback) != "", F.concat(F.lit(" "), feedback)).otherwise(""),
    )
