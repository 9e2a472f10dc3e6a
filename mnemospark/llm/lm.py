"""Language-model scores: masked pseudo-likelihood of a small bidirectional network.

Every word is predicted from the ``reach`` words on either side, itself masked. Each side's
positions have their own embeddings; their sum and a tanh give a hidden vector, which
predicts first the class of the word (words of neighbouring frequency) and then the word
in its class. A document's score is the sum over its words of those log-probabilities.

The vocabulary holds the ``words`` most frequent of the whole corpus, by default as many as
the root of the number of distinct words, and 1,024 at least. The network knows other words
by ``rare`` hash buckets; to the log-probability of its bucket such a word adds that of the
word in the bucket, from the counts of all words. The counts stay a distributed table,
which joins the distinct rare words of each document; one is added to each count, and a
word that the corpus lacks costs more than any it has.
Training reads every document once, in ``rounds``: in a round each partition starts from
the same weights and takes gradient steps over its share of the documents; then the
weights are averaged by the number of words trained on. What is shuffled grows with the
number of partitions, what reaches the driver is one set of weights.

Defined cases: a null text, or one without words, has no words and the score 0; a corpus
without words leaves the network as it began; words are split at ASCII white space, and
A-Z are lower-cased; repeated rows count as often as they occur and each have a row; words
of equal frequency enter the vocabulary in their own order; very long texts are scored whole;
an empty table gives no rows. The weights depend on how the rows lie in partitions, as these
are trained apart and averaged.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import blocks, partitions, stored, tune, worker_cache

BATCH = 8192
SLICES = 16


@dataclass(frozen=True)
class WindowModel:
    vocabulary: tuple[bytes, ...]
    rare: int
    reach: int
    weights: tuple[np.ndarray, ...]  # embeddings (positions, tokens + 1, d), bias (d), classes (d, c), class bias, words (c, d, m), word bias (c, m)
    inside: DataFrame | None = None  # h, lp: hashes of the other words and their log-probabilities in their buckets
    unseen: float = 0.0


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` over all documents, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for block in blocks(batches, "text"):
            for x in block.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                total.update(x.lower().split())
            if len(total) > 200_000:
                yield rows_of(total)
                total = Counter()
        yield rows_of(total)

    def rows_of(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return stored(docs.select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(counted: DataFrame, words: int) -> tuple[bytes, ...]:
    """The most frequent words, ties in the order of their bytes."""
    return tuple(bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(words).collect())


def inside_buckets(counted: DataFrame, known: tuple[bytes, ...], rare: int) -> tuple[DataFrame, float]:
    """``h, lp``: the log-probability in its bucket of each word that is not ``known``, and that of any other word."""
    names = counted.sparkSession.createDataFrame(pa.table({"word": pa.array(known, pa.binary())}))
    others = counted.join(F.broadcast(names), "word", "left_anti").withColumn("bucket", F.crc32("word") % rare)
    sizes = others.groupBy("bucket").agg((F.sum("n") + F.count("*") + 1).alias("all"))
    total = sizes.agg(F.sum(F.col("all") - 1)).first()[0] or 0
    table = others.join(F.broadcast(sizes), "bucket").select(F.xxhash64("word").alias("h"), F.log((F.col("n") + 1) / F.col("all")).alias("lp"))
    return stored(table), -float(np.log(total + 1))


def _start(tokens: int, reach: int, size: int, seed: int = 42) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    classes = int(np.ceil(np.sqrt(tokens)))
    inside = -(-tokens // classes)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    free = np.full((classes, inside), -1e9, np.float32)  # places of a class that no word has
    free.reshape(-1)[:tokens] = 0
    return small(2 * reach, tokens + 1, size), np.zeros(size, np.float32), small(size, classes), np.zeros(classes, np.float32), small(classes, size, inside), free


class _Codes(dict):
    """Token numbers by word; those of words outside the vocabulary are hashed as they are asked for."""

    def __init__(self, vocabulary_: tuple[bytes, ...], rare: int) -> None:
        super().__init__((w, i) for i, w in enumerate(vocabulary_))
        self.words, self.rare = len(vocabulary_), rare

    def __missing__(self, word: bytes) -> int:
        code = self[word] = self.words + zlib.crc32(word) % self.rare
        return code

    def shrink(self) -> None:
        """Forget the words outside the vocabulary where there are too many."""
        if len(self) > 600_000:
            for k in [k for k, v in self.items() if v >= self.words]:
                del self[k]


def _tokens(texts: list[bytes], known: _Codes, reach: int, others: list[Counter] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all texts, ``reach`` pads around each, and how many words each text has; ``others`` gets the counts of its other words."""
    words = known.words
    parts, counts = [], []
    pad = np.full(reach, words + known.rare, np.int16)
    for x in texts:
        known.shrink()
        split = x.lower().split()
        own = np.fromiter(map(known.__getitem__, split), np.int16, len(split))
        if others is not None:
            others.append(Counter([split[i] for i in np.flatnonzero(own >= words).tolist()]))
        counts.append(len(own))
        parts += (pad, own)
    return np.concatenate([*parts, pad]), np.array(counts, np.int64)


def _positions(counts: np.ndarray, reach: int) -> np.ndarray:
    """Where the words stand among the padded tokens."""
    run = np.repeat(np.arange(len(counts)), counts)
    return np.arange(int(counts.sum())) + reach * (run + 1)


def _hidden(weights, tokens, at, reach):
    embed, bias = weights[0], weights[1]
    sides = [k for k in range(-reach, reach + 1) if k]
    context = [tokens[at + k] for k in sides]
    total = embed[0][context[0]]
    for p in range(1, len(sides)):
        total += embed[p][context[p]]
    total += bias
    return np.tanh(total, out=total), context


def _softmax(x: np.ndarray) -> np.ndarray:
    """The probabilities in each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_chosen(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The log-probability of the ``goal`` row of each column; changes ``x``."""
    x -= x.max(0)
    chosen = x[goal, np.arange(x.shape[1])]
    return chosen - np.log(np.exp(x, out=x).sum(0))


def _by_class(group: np.ndarray, classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the words by class, and (class, begin, end) of each class that has some."""
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(classes + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


def _scores(weights, tokens, at, reach):
    """The log-probability of each word at ``at``."""
    _, _, to_class, class_bias, to_word, word_bias = weights
    hidden, _ = _hidden(weights, tokens, at, reach)
    group, place = np.divmod(tokens[at], np.int16(word_bias.shape[1]))
    order, runs = _by_class(group, len(to_word))
    out = _log_chosen(to_class.T @ hidden.T + class_bias[:, None], group)
    hidden, place, inner = hidden[order], place[order], np.empty_like(out)
    for c, a, b in runs:
        inner[a:b] = _log_chosen(to_word[c].T @ hidden[a:b].T + word_bias[c][:, None], place[a:b])
    out[order] += inner
    return out


def _gradient(weights, tokens, at, reach):
    _, _, to_class, class_bias, to_word, word_bias = weights
    hidden, context = _hidden(weights, tokens, at, reach)
    n = len(at)
    group, place = np.divmod(tokens[at], np.int16(word_bias.shape[1]))
    miss = _softmax(to_class.T @ hidden.T + class_bias[:, None])
    miss[group, np.arange(n)] -= 1
    miss /= n
    g_class, g_class_bias = (miss @ hidden).T, miss.sum(1)
    g_hidden = (to_class @ miss).T
    g_word, g_word_bias = np.zeros_like(to_word), np.zeros_like(word_bias)
    order, runs = _by_class(group, len(to_word))
    sorted_hidden, place, inner = hidden[order], place[order], np.empty_like(hidden)
    for c, a, b in runs:
        h = sorted_hidden[a:b]
        miss = _softmax(to_word[c].T @ h.T + word_bias[c][:, None])
        miss[place[a:b], np.arange(b - a)] -= 1
        miss /= n
        g_word[c], g_word_bias[c] = (miss @ h).T, miss.sum(1)
        inner[a:b] = (to_word[c] @ miss).T
    g_hidden = np.ascontiguousarray(g_hidden)
    g_hidden[order] += inner
    g_hidden *= 1 - hidden * hidden
    g_embed = np.zeros_like(weights[0])
    by_size = g_hidden.T.astype(np.float64)
    for p, own in enumerate(context):
        for d, values in enumerate(by_size):
            g_embed[p, :, d] = np.bincount(own, values, minlength=g_embed.shape[1])
    return g_embed, g_hidden.sum(0), g_class, g_class_bias, g_word, g_word_bias


def _learn(weights, squares, tokens, at, reach, rate):
    """One step, each weight scaled by the gradients it has had."""
    for w, s, g in zip(weights, squares, _gradient(weights, tokens, at, reach)):
        s += g * g
        w -= rate * g / (np.sqrt(s) + 1e-7)


def fit_window_model(docs: DataFrame, words: int | None = None, rare: int = 128, reach: int = 2, size: int = 16, rounds: int = 3, rate: float = 0.1, text: str = "text", doc_id: str = "doc_id") -> WindowModel:
    """Train on every document of ``docs``, each in one of the rounds."""
    spark = tune(docs.sparkSession)
    if (words or 0) + rare > 32_000:
        raise ValueError("tokens are 16-bit numbers")
    counted = word_counts(docs, text)
    if words is None:
        words = min(max(1024, int(counted.count() ** 0.5)), 32_000 - rare)
    known_words = vocabulary(counted, words)
    inside, unseen = inside_buckets(counted, known_words, rare)
    n_words = len(known_words)
    weights = _start(n_words + rare, reach, size)
    rows = docs.select(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(rounds)).alias("turn"), F.col(text).alias("text"))
    for turn in range(rounds):
        ship = spark.sparkContext.broadcast((known_words, weights))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary_, begin = ship.value
            known = _Codes(vocabulary_, rare)
            own = tuple(w.copy() for w in begin)
            squares = tuple(np.zeros_like(w) for w in begin)
            trained = 0
            for block in blocks(batches, "text", 2 << 20):
                tokens, counts = _tokens(block.column("text").cast(pa.binary()).fill_null(b"").to_pylist(), known, reach)
                at = np.random.default_rng(trained).permutation(_positions(counts, reach))
                for i in range(0, len(at), BATCH):
                    _learn(own, squares, tokens, at[i : i + BATCH], reach, rate)
                trained += len(at)
            if trained:
                flat = np.array_split(np.concatenate([w.ravel() for w in own]) * np.float32(trained), SLICES)
                yield packed(list(range(SLICES)), [trained] * SLICES, flat)

        def packed(part: list[int], n: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], ["part", "n", "weights"])

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for p, n, w in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("weights").to_pylist()):
                    held = sums.setdefault(p, [0, 0.0])
                    held[0] += n
                    held[1] = held[1] + np.frombuffer(w, np.float32).astype(np.float64)
            for p, (n, total) in sums.items():
                yield packed([p], [n], [total / n])

        # sums of sums: each task adds up what it reads, by slice
        shape = "part int, n long, weights binary"
        trained = rows.where(F.col("turn") == turn).select("text").mapInArrow(train, shape)
        mean = trained.repartition(min(SLICES, partitions(spark)), "part").mapInArrow(add_up, shape).collect()
        if not mean:
            continue
        flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["part"])])
        ends = np.cumsum([w.size for w in weights])
        weights = tuple(flat[e - w.size : e].reshape(w.shape).copy() for w, e in zip(weights, ends))
    return WindowModel(known_words, rare, reach, weights, inside, unseen)


def score_documents(docs: DataFrame, model: WindowModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``n_tokens``, ``log_prob`` (summed over all words) and ``mean_log_prob``."""
    spark = tune(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long, __net double, __h array<long>, __n array<int>"
    ship = spark.sparkContext.broadcast((model.vocabulary, model.rare, model.reach, model.weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rare, reach, weights = ship.value
        held = worker_cache(f"lm_{hash((words, rare))}")
        known = held.setdefault("codes", None)
        if known is None:
            known = held["codes"] = _Codes(words, rare)
        for block in blocks(batches, "__text", 2 << 20):
            texts = block.column("__text").cast(pa.binary()).fill_null(b"").to_pylist()
            others: list[Counter] = []
            tokens, counts = _tokens(texts, known, reach, others)
            ends = pa.array(np.cumsum([0, *map(len, others)]), pa.int32())
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for x in others for w in x], np.uint64).view(np.int64)
            often = np.array([n for x in others for n in x.values()], np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (hashes, often)]
            at = _positions(counts, reach)
            found = np.concatenate([np.zeros(1)] + [_scores(weights, tokens, at[i : i + BATCH], reach).astype(np.float64) for i in range(0, len(at), BATCH)])
            sums = np.cumsum(found)
            ends = np.cumsum(counts)
            total = sums[ends] - sums[ends - counts]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(counts), pa.array(total), *lists], [*keep, "n_tokens", "__net", "__h", "__n"])

    # rows may be repeated and ids null: each row gets a number of its own, which is stored with it
    scored = stored(rows.mapInArrow(score, schema).withColumn("__row", F.monotonically_increasing_id()))
    terms = scored.select("__row", F.explode(F.arrays_zip("__h", "__n")).alias("x")).select("__row", F.col("x.__h").alias("h"), F.col("x.__n").alias("n"))
    lp = F.lit(model.unseen)
    if model.inside is not None:
        terms, lp = terms.join(model.inside, "h", "left"), F.coalesce("lp", lp)
    sums = terms.groupBy("__row").agg(F.sum(F.col("n") * lp).alias("__inside"))
    total = (F.col("__net") + F.coalesce("__inside", F.lit(0.0))).alias("log_prob")
    out = scored.drop("__h", "__n").join(sums, "__row", "left").select(*keep, "n_tokens", total)
    return out.withColumn("mean_log_prob", F.col("log_prob") / F.greatest("n_tokens", F.lit(1)))
