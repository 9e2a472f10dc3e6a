"""Mixing, token files and quality rules against brute force; the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mnemospark.llm import mixing, outliers, token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- mixing


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(9)
    rows = []
    for name, n in (("hot", 600), ("mid", 200), ("small", 40), (None, 20)):
        rows += [(len(rows) + i, " ".join("w" for _ in range(rng.randint(0, 50))), name) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


@pytest.mark.parametrize("goal", [{"repetitions": 1.4}, {"entropy": 0.9}, {"repetitions": 0.5}, {"entropy": 1.0}])
def test_mix_matches_brute_force(sources, goal):
    plan = mixing.plan_mix(sources, block_tokens=500, budget_share=1.3 if "repetitions" in goal else 1.0, **goal)
    rows = sources.collect()
    tokens = {r["doc_id"]: len(words_of(r["text"])) for r in rows}
    total = collections.Counter()
    for r in rows:
        total[r["source"]] += tokens[r["doc_id"]]
    everything = sum(total.values())
    p = np.array([t / everything for t in total.values()])
    budget = plan.budget

    def weights(a):
        w = p**a
        return w / w.sum()

    def met(a):
        w = weights(a)
        if "entropy" in goal:
            return -(w * np.log(w)).sum() >= goal["entropy"] * math.log(len(p)) - 1e-12
        return (w * budget / (p * everything)).max() <= goal["repetitions"] + 1e-9

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = ((mid, high) if met(mid) else (low, mid)) if "entropy" in goal else ((low, mid) if met(mid) else (mid, high))
    assert plan.exponent == pytest.approx(low, abs=1e-5)

    got = collections.defaultdict(lambda: collections.defaultdict(set))
    names = {r["doc_id"]: r["source"] for r in rows}
    mixed = mixing.mix(sources, plan).collect()
    for r in mixed:
        assert r["doc_id"] not in got[names[r["doc_id"]]][r["mix_pass"]] and 0 <= r["mix_block"] < plan.blocks
        got[names[r["doc_id"]]][r["mix_pass"]].add(r["doc_id"])
    keys = {r["doc_id"]: r["k"] for r in sources.select("doc_id", mixing.row_key("doc_id", "text").alias("k")).collect()}
    place = {(r["doc_id"], n): r[f"p{n}"] for r in sources.select("doc_id", *[mixing._place(mixing.row_key("doc_id", "text"), F.lit(n), 42).alias(f"p{n}") for n in range(12)]).collect() for n in range(12)}
    for name, w in zip(total, weights(plan.exponent)):
        passes = w * budget / total[name]
        whole = math.floor(passes + 1e-12)
        own = [d for d, s in names.items() if s == name]
        for n in range(whole):
            assert got[name][n] == set(own)
        rest, chosen = (passes - whole) * total[name], set()
        for d in sorted(own, key=lambda d: (place[d, whole], keys[d])):
            rest -= tokens[d]
            if rest < -1e-6:
                break
            chosen.add(d)
        if passes > whole:
            assert got[name][whole] == chosen


def test_mix_edges(edges, nothing):
    plan = mixing.plan_mix(edges, repetitions=1.0)
    rows = mixing.mix(edges, plan).collect()
    assert len(rows) == edges.count() and "_key" in rows[0].asDict() and {r["mix_pass"] for r in rows} == {0}
    assert mixing.mix(nothing, mixing.plan_mix(nothing, entropy=0.5)).collect() == []
    blank = edges.where("text is null")
    assert mixing.mix(blank, mixing.plan_mix(blank, repetitions=2.0)).count() == 2
    with pytest.raises(ValueError):
        mixing.plan_mix(edges)


# -- token files


def test_tokens_round_trip(spark, corpus, edges, nothing, tmp_path):
    library = Tokenizer.from_file(TOKENIZER)
    for k, table in enumerate((corpus, edges, nothing)):
        path = f"{tmp_path}/{k}"
        token_files.write_tokens(table, path, TOKENIZER, parts=5)
        rows = token_files.read_tokens(spark, path).orderBy("start").collect()
        given = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        start = 0
        assert len(rows) == len(given)
        for r, (doc_id, text) in zip(rows, given):
            ids = library.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, start, len(ids), ids)
            start += len(ids)
        sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_files.checksums(token_files.read_tokens(spark, path)).collect()}
        assert sums == {(r["doc_id"], r["start"]): zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}
    few = token_files.read_documents(spark, f"{tmp_path}/0", [3, 7])
    assert sorted(r["doc_id"] for r in few.collect()) == [3, 7]
    assert "PushedFilters: [In(doc_id, [3,7])]" in few._jdf.queryExecution().executedPlan().toString()


def test_encoder_on_added_tokens():
    """A text that spells an added token has its id, between other texts and at both ends."""
    library = Tokenizer.from_file(TOKENIZER)
    own = token_files.TextEncoder(TOKENIZER)
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "", "x<|endoftext|><|endoftext|> y", "<|endoftext", "more words"]
    ids, counts = own.encode(texts)
    assert 50256 in ids
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_odd_spacing():
    library = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(6)
    own = token_files.TextEncoder(TOKENIZER)
    texts = ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "9", "é", "!", "'s", " ", "\x1f", "\x85", "\u2003", "\u200b", "漢"]) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    ids, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


# -- quality rules


def base_of(text):
    own = words_of(text)
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            repeated += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_base_statistics_match_brute_force(spark, corpus, edges):
    loops = spark.createDataFrame([(1, "a b " * 40), (2, "x y z " * 9), (3, "p\np\n p\np"), (4, "a b c d e f g h " * 2)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for table in (corpus, edges, loops):
        rows = outliers.measure(table, ["text"]).select("text", "q.*").collect()
        assert all(base_of(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in rows)


def test_outliers_find_planted_ones_and_keep_the_rest(spark):
    rng = random.Random(8)
    rows = []
    for d in range(1200):
        text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200)))
        if d % 40 == 0:
            text = " ".join(w + rng.choice(["###", "***", "$$$"]) for w in text.split())
        rows.append((d, text, rng.choice(["en", "de"]), "s"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured = outliers.measure(table, ["doc_id"])
    kept = {r["doc_id"]: r["kept"] for r in outliers.judge(measured, outliers.fit_outliers(measured), ["doc_id"]).collect()}
    assert all(kept[d] == (d % 40 != 0) for d in kept)


@pytest.mark.parametrize("kind", ["lines", "words", "length", "symbols", "short"])
def test_each_statistic_rejects_by_itself(spark, kind):
    """One in 40 texts is odd in one statistic only; all the others have nothing of it."""
    rng = random.Random(kind)
    word = lambda low, high: "".join(rng.choice("abcde") for _ in range(rng.randint(low, high)))

    def text(odd):
        own = [word(5, 9) for _ in range(rng.randint(100, 200))]
        if odd and kind == "lines":  # copies too short for a window of 8 words
            return "\n".join(x for i in range(0, 96, 8) for x in (" ".join(own[i : i + 8]), "more"))
        if odd and kind == "words":
            return " ".join(own[:100] + own[:13])
        if odd and kind == "length":
            own = [word(2, 3) for _ in own]
        if odd and kind == "symbols":
            own = [w + "#" * (i % 5 == 0) for i, w in enumerate(own)]
        if odd and kind == "short":
            own = own[:25]
        return "\n".join(" ".join(own[i : i + 10]) for i in range(0, len(own), 10))

    table = spark.createDataFrame([(d, text(d % 40 == 0), "en", "s") for d in range(800)], "doc_id long, text string, lang string, source string")
    measured = outliers.measure(table, ["doc_id"])
    rows = outliers.judge(measured, outliers.fit_outliers(measured), ["doc_id"]).collect()
    assert not any(r["base_failed"] for r in rows)
    assert all(r["kept"] == (r["doc_id"] % 40 != 0) for r in rows)


def test_concentration_steps_lower_the_determinant(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    measured = outliers.measure(docs, ["doc_id"]).persist()

    def size(steps):
        model = outliers.fit_outliers(measured, steps=steps, min_rows=100)
        return {(r["lang"], r["source"]): -sum(math.log(r[f"w_{i}_{i}"]) for i in range(5)) for r in model.collect()}

    one, five = size(1), size(5)
    assert one.keys() == five.keys() and np.mean([five[k] - one[k] for k in one]) < 1e-6


def test_outlier_edges(edges, nothing):
    measured = outliers.measure(edges, ["doc_id", "key", "_key"])
    rows = outliers.judge(measured, outliers.fit_outliers(measured), ["doc_id", "key"]).collect()
    assert len(rows) == edges.count()  # too few rows for an estimate: the base rules decide
    assert all(r["kept"] != r["base_failed"] for r in rows)
    empty = outliers.measure(nothing, ["doc_id"])
    assert outliers.judge(empty, outliers.fit_outliers(empty), ["doc_id"]).collect() == []


def test_chi_square_quantiles():
    assert outliers.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert outliers.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-6)


# -- pipeline


def test_pipeline_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, data).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if i == 0:
            failed = {r["doc_id"] for r in before.collect() if (lambda b: b[0] < 20 or 100 * b[4] > 30 * b[0])(base_of(r["text"]))}
            assert not failed & {r["doc_id"] for r in after.collect()}
        if i == 1:
            texts = [r["text"] for r in after.collect()]
            assert len(set(texts)) == len(texts)  # no exact copies
        before = after
    assert before.where("not decoded_ok").count() == 0 and before.count() > 0


def test_pipeline_edges(spark, edges, nothing, tmp_path):
    for name, table in (("edges", edges), ("nothing", nothing)):
        before = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, before, "").write.parquet(f"{tmp_path}/{name}{i}")
            before = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert (before.count() > 0) == (name == "edges")
