"""Toxicity, language id, language model and segmentation sampling."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from mnemospark.llm import langid, lm, pieces, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# -- toxicity


def test_severity_separates_held_out_documents(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    grades = toxicity.severity_grades(labels)
    model = toxicity.fit_severity(docs, grades.where("doc_id % 2 = 0"))
    scores = {r["doc_id"]: r["severity"] for r in toxicity.score_severity(docs, model).collect()}
    toxic = [scores[r["doc_id"]] for r in labels.where("doc_id % 2 = 1 and toxic = 1").collect()]
    clean = [scores[r["doc_id"]] for r in labels.where("doc_id % 2 = 1 and toxic = 0").collect()]
    better = np.mean([[a > b for b in clean] for a in toxic])
    assert better > 0.8
    assert np.all(np.diff(model.thresholds) >= 0) and len(model.thresholds) == 2


def test_severity_orders_grades(spark):
    rng = random.Random(0)
    rows = []
    for d in range(300):
        grade = d % 3
        rows.append((d, " ".join(rng.choice("abcdefgh") * 4 for _ in range(20)) + " bad" * (grade > 0) + " worse" * (grade > 1), grade))
    table = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit_severity(table, table.select("doc_id", "grade"), buckets=1 << 14)
    tests = spark.createDataFrame([(0, rows[0][1]), (1, rows[1][1]), (2, rows[2][1])], "doc_id long, text string")
    found = sorted((r["doc_id"], r["grade"]) for r in toxicity.score_severity(tests, model).collect())
    assert found == [(0, 0), (1, 1), (2, 2)]


def test_severity_edges(spark, edges, nothing):
    grades = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (12, None), (99, 2), (None, 1)], "doc_id long, grade int")
    model = toxicity.fit_severity(edges, grades, buckets=1 << 12, min_texts=1)
    rows = toxicity.score_severity(edges, model, keep=("doc_id", "key")).collect()
    assert len(rows) == edges.count() and all(0 <= r["p_toxic"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["severity"] for r in rows}
    assert by_id[2] == by_id[3] == by_id[4] and by_id[1] > by_id[6]
    none = toxicity.fit_severity(edges, grades.where("false"))
    assert {r["severity"] for r in toxicity.score_severity(edges, none).collect()} == {0.0}
    assert toxicity.score_severity(nothing, model).collect() == []


# -- language id


def test_number_signs_are_no_letters():
    assert not langid._has_letter("½ ² ⅷ 12 _") and langid._has_letter("½ é") and langid._has_letter("漢")


def test_languages_of_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit_languages(docs.where(~langid.held_out()))
    rows = langid.identify_languages(docs, model, keep=("doc_id", "lang")).withColumn("held", langid.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_languages_do_not_depend_on_the_batch(spark, corpus):
    model = langid.fit_languages(corpus)
    texts = [r["text"] for r in corpus.limit(30).collect()]
    together = langid.identify_languages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1), model).collect()
    alone = langid.identify_languages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(30), model).collect()
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in together} == {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in alone}


def test_language_edges(edges, nothing):
    model = langid.fit_languages(edges)
    assert model.languages == ("de", "en", "fr")
    rows = {r["doc_id"]: r for r in langid.identify_languages(edges, model, keep=("doc_id", "key")).collect()}
    assert {rows[d]["lang_pred"] for d in (2, 3, 4, 14)} == {"und"} and rows[2]["score"] == 0.0
    assert rows[6]["lang_pred"] == "en"
    assert langid.identify_languages(nothing, model).collect() == []
    none = langid.fit_languages(nothing)
    assert none.languages == () and {r["lang_pred"] for r in langid.identify_languages(edges, none).collect()} == {"und"}


# -- language model


def test_shuffled_texts_are_less_likely(spark):
    rng = random.Random(2)
    follows = {w: rng.sample([f"w{i}" for i in range(40)], 2) for w in (f"w{i}" for i in range(40))}

    def chain(n):
        out = ["w0"]
        while len(out) < n:
            out.append(rng.choice(follows[out[-1]]))
        return out

    train = spark.createDataFrame([(i, " ".join(chain(400))) for i in range(200)], "doc_id long, text string").repartition(4)
    model = lm.fit_window_model(train, words=64, rare=8)
    tests = [chain(60) for _ in range(30)]
    mixed = [rng.sample(t, len(t)) for t in tests]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(tests + mixed)], "doc_id long, text string")
    scores = {r["doc_id"]: r["mean_log_prob"] for r in lm.score_documents(table, model).collect()}
    assert all(scores[i] > scores[i + 30] for i in range(30))
    assert np.mean([scores[i] for i in range(30)]) > -math.log(40) + 1


def test_word_probabilities_add_up_to_one(corpus):
    model = lm.fit_window_model(corpus, words=50, rare=6, rounds=1)
    tokens = np.array([56, 56, 3, 9, 1, 56, 56], np.int16)
    total = 0.0
    for w in range(56):
        own = tokens.copy()
        own[3] = w
        total += float(np.exp(lm._scores(model.weights, own, np.array([3]), 2))[0])
    assert abs(total - 1) < 1e-4


def test_words_in_their_buckets(spark):
    """Rare words of the corpus score as their counts say, and higher than words it lacks."""
    rng = random.Random(2)
    names = [f"rare{i}" for i in range(300)]
    texts = [" ".join(x for _ in range(20) for x in (rng.choice("abcdefgh"), rng.choice(names))) for _ in range(300)]
    model = lm.fit_window_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=8, rare=4)
    counts = collections.Counter(w for x in texts for w in x.split() if len(w) > 1)
    bucket = lambda w: zlib.crc32(w.encode()) % 4
    size = collections.Counter()
    for w, n in counts.items():
        size[bucket(w)] += n + 1
    got = {r["h"]: r["lp"] for r in model.inside.collect()}
    want = {xxhash.xxh64_intdigest(w.encode(), 42): math.log((n + 1) / (size[bucket(w)] + 1)) for w, n in counts.items()}
    assert {h % 2**64: pytest.approx(v) for h, v in got.items()} == want and model.unseen < min(want.values())
    prose = "a rare7 b rare8 rare7"
    made_up = prose
    for w in ("rare7", "rare8"):  # other words of the same buckets
        made_up = made_up.replace(w, next(x for i in range(999) if bucket(x := f"zq{i}") == bucket(w)))
    rows = {r["doc_id"]: r["log_prob"] for r in lm.score_documents(spark.createDataFrame([(0, prose), (1, made_up), (0, prose)], "doc_id long, text string"), model).collect()}
    own = {w: want[xxhash.xxh64_intdigest(w.encode(), 42)] for w in ("rare7", "rare8")}
    assert rows[0] - rows[1] == pytest.approx(2 * own["rare7"] + own["rare8"] - 3 * model.unseen, rel=1e-6)


def test_language_model_edges(edges, nothing):
    model = lm.fit_window_model(edges, words=100, rare=10)
    rows = lm.score_documents(edges, model, keep=("doc_id", "key")).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == edges.count() and by_id[2]["n_tokens"] == by_id[4]["n_tokens"] == 0 and by_id[2]["log_prob"] == 0.0
    assert by_id[1]["log_prob"] == pytest.approx(by_id[7]["log_prob"]) and by_id[6]["n_tokens"] == 6000
    empty = lm.fit_window_model(nothing, words=100, rare=10)
    assert empty.vocabulary == () and len(lm.score_documents(edges, empty).collect()) == edges.count()
    assert lm.score_documents(nothing, model).collect() == []


# -- segmentation sampling


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(MODEL)


def all_segmentations(lattices, text):
    """Every path of the lattice with its probability."""
    whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
    paths, done = [(0, 0.0, ())], {}
    while paths:
        at, lp, ids = paths.pop()
        if at == len(whole):
            done[ids] = lp
            continue
        for n in range(1, len(whole) - at + 1):
            found = lattices.pieces.get(whole[at : at + n])
            if found:
                paths.append((at + n, lp + found[1], (*ids, found[0])))
    z = np.logaddexp.reduce(list(done.values()))
    return {k: math.exp(v - z) for k, v in done.items()}


def test_samples_follow_the_distribution_without_replacement(lattices):
    text, n, k = "ab an", 6000, 3
    p = all_segmentations(lattices, text)
    rng = random.Random(4)
    found = pieces.sample(lattices, [lattices.codes(lattices.units(text))] * n, [rng.getrandbits(64) for _ in range(n)], k)
    first, estimate = {}, 0.0
    for own in found:
        ids = [tuple(map(int, x[0])) for x in own]
        assert len(set(ids)) == k and set(ids) <= set(p)
        assert all(math.isclose(math.exp(x[1]), p[i], rel_tol=1e-9) for x, i in zip(own, ids))
        first[ids[0]] = first.get(ids[0], 0) + 1
        estimate += sum(math.exp(x[1] - x[2]) for x in own) / n
    assert all(abs(first.get(i, 0) / n - q) < 4 * math.sqrt(q / n) + 1e-3 for i, q in p.items())
    assert abs(estimate - 1) < 0.02  # weights by inclusion are unbiased


def test_few_segmentations_are_all_given(lattices):
    for text in ("x", " ", "xy"):
        p = all_segmentations(lattices, text)
        (own,) = pieces.sample(lattices, [lattices.codes(lattices.units(text))], [7], len(p) + 3)
        assert {tuple(map(int, x[0])) for x in own} == set(p) and {x[2] for x in own} == {0.0}


def test_round_trip_with_the_library(edges, nothing):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = pieces.sample_segmentations(edges, MODEL, k=3).collect()
    assert all(r["decoded_ok"] for r in rows)
    texts = {(r["doc_id"]): (r["text"] or "").replace(pieces.SPACE, " ") for r in edges.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert sp.decode(r["ids"]) == texts[r["doc_id"]]
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["rank"], tuple(r["ids"])))
    assert by_id[2] == by_id[3] == [(0, ())] and len(by_id[6]) == 3 and len({i for _, i in by_id[6]}) == 3
    assert len(by_id[12]) == 6 and len(set(by_id[12])) == 3
    assert pieces.sample_segmentations(nothing, MODEL).collect() == []


def test_samples_depend_on_the_row_alone(edges):
    def of(df):
        return {(r["doc_id"], r["rank"]): (tuple(r["ids"]), round(r["inclusion"], 9)) for r in pieces.sample_segmentations(df.where("doc_id is not null"), MODEL).collect()}

    assert of(edges) == of(edges.repartition(6))


def test_paths_are_spelled_together(lattices):
    texts = ["", "plain words, 12 of them", "▁ and ▁", "café \U0001f600\n\n end", " leading", "x" * 300_000]
    codes = [lattices.codes(lattices.units(x)) for x in texts]
    paths = [[ids for ids, _, _ in own] for own in pieces.sample(lattices, codes, list(range(len(texts))), 2)]
    flat = [ids for own in paths for ids in own]
    assert [lattices.spell(ids) for ids in flat] == [b"".join(lattices.fixed[i] for i in ids.tolist()) for ids in flat]
    assert pieces.faithful(lattices, texts, paths) == [True] * len(flat)
    moved = [*texts[1:], "another"]
    told = [pieces.decode(lattices, ids) == x.replace("▁", " ") for x, own in zip(moved, paths) for ids in own]
    assert pieces.faithful(lattices, moved, paths) == told and not any(told)
    assert pieces.faithful(lattices, [], []) == []


def test_new_words_are_learned_a_slice_at_a_time(monkeypatch):
    sizes, learn = [], pieces.Lattices.learn
    monkeypatch.setattr(pieces.Lattices, "learn", lambda self, new: (sizes.append(sum(map(len, new))), learn(self, new))[1])
    own = pieces.Lattices(MODEL)
    rng = random.Random(5)
    units = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(20_000)] + ["z" * 50_000]
    codes = own.codes(units)
    assert max(sizes) <= 50_000 and sorted(sizes)[-2] <= 1 << 15  # 100,000 characters or more at once before
    assert [own.steps[w] for w in units] == codes.tolist()


def test_words_are_numbered_and_counted_in_one_pass():
    texts = [b"A b zz zz b", b"", b"yy a zz"]
    others: list = []
    tokens, counts = lm._tokens(texts, lm._Codes((b"a", b"b"), 4), 1, others)
    code = {b"a": 0, b"b": 1, b"zz": 2 + zlib.crc32(b"zz") % 4, b"yy": 2 + zlib.crc32(b"yy") % 4}
    want = [[6] + [code[w] for w in x.lower().split()] for x in texts]
    assert tokens.tolist() == sum(want, []) + [6] and counts.tolist() == [5, 0, 3]
    assert others == [{b"zz": 2}, {}, {b"yy": 1, b"zz": 1}]


def test_gradient_is_the_slope_of_the_scores():
    weights = tuple(w.astype(np.float64) for w in lm._start(12, 2, 3))
    tokens = np.array([12, 12, 1, 5, 5, 0, 11, 3, 12, 12], np.int16)
    at = np.arange(2, 8)
    found = lm._gradient(weights, tokens, at, 2)
    for w, g in zip(weights[:-1], found):
        for i in range(0, w.size, 5):
            own, held = w.reshape(-1), w.reshape(-1)[i]
            own[i] = held + 1e-5
            up = -lm._scores(weights, tokens, at, 2).mean()
            own[i] = held - 1e-5
            down = -lm._scores(weights, tokens, at, 2).mean()
            own[i] = held
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6
