from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.functions.text import porter


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_porter_examples():
    # Worked examples of the published algorithm.
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "motoring": "motor",
        "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
        "vietnamization": "vietnam", "formaliti": "formal", "electrical": "electr", "replacement": "replac",
        "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll", "an": "an", "été": "été",
    }
    assert {w: porter(w) for w in pairs} == pairs


def test_tokens_fold_case_and_accents(spark):
    got = one(spark, text.tokens(F.col("t")), t="Quản LÝ résumé, x2-Y")
    assert got == ["quan", "ly", "resume", "x2", "y"]


def test_stem_tokens(spark):
    assert one(spark, text.stem_tokens(text.tokens(F.col("t"))), t="Ponies hopping") == ["poni", "hop"]


def test_urls(spark):
    got = one(spark, text.extract_urls(F.col("t")), t="see (http://a.io/x). and https://b.io/y, http://a.io/x!")
    assert got == ["http://a.io/x", "https://b.io/y"]


def test_video_ids(spark):
    rows = {
        "https://www.youtube.com/watch?v=abc&t=1": "abc",
        "https://youtu.be/xyz?t=3": "xyz",
        "https://youtube.com/watch": None,
        "https://other.io/watch?v=abc": None,
    }
    for url, want in rows.items():
        assert one(spark, text.video_id(F.col("u")), u=url) == want


def test_slug_and_chat_path(spark):
    assert one(spark, text.slug(F.col("t")), t="--Héllo, Wörld 42!") == "h-llo-w-rld-42"
    ts = F.lit("2026-06-10 12:00:05").cast("timestamp")
    assert one(spark, text.chat_path(ts, F.col("t")), t="") == "chat/20260610-120005-insight.md"


def test_split_summary(spark):
    cases = {
        "a\nb\nTitle: T1\n": ("a\nb", "T1"),
        "Title: x\nmid\nTitle:  y ": ("Title: x\nmid", "y"),
        "only text": ("only text", "Untitled"),
        "say Title: no": ("say Title: no", "Untitled"),
        "Title: alone": ("", "alone"),
    }
    for reply, want in cases.items():
        got = one(spark, text.split_summary(F.col("t")), t=reply)
        assert (got["summary"], got["title"]) == want


def test_note_hash_ignores_final_newlines_only(spark):
    h = lambda s: one(spark, text.note_hash(F.col("t")), t=s)
    assert h("a\n\n") == h("a") != h("a\n b")


def test_embedding_text(spark):
    col = text.embedding_text(F.col("t"), F.lit(None).cast("string"), F.array(F.lit("x"), F.lit("y")), F.lit(""))
    assert one(spark, col, t="T") == "title: T | type: None | tags: x, y"


def test_nfc_and_safe_stem(spark):
    assert one(spark, text.nfc(F.col("t")), t="é") == "é"
    assert one(spark, text.safe_stem(F.col("t")), t=' a/b:  "c"\td ') == "ab c d"


def test_stem_and_extension(spark):
    got = lambda p: (one(spark, text.path_stem(F.col("p")), p=p), one(spark, text.extension(F.col("p")), p=p))
    assert got("a.b/c.d.PDF") == ("c.d", "pdf")
    assert got("x/.hidden") == (".hidden", "")
    assert got("noext") == ("noext", "")
