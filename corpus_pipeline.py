"""The corpus pipeline: raw documents in, sampled training pieces out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``. Rows that share an id and a text are one document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import mixing, outliers, pieces, similar, substrings
from mnemospark.llm.common import scratch_folder, stored, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """The documents with a key that is never null, and a hash of all they hold."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    return docs.select(*COLUMNS, key.alias("_key"), F.xxhash64("text", "lang", "source").alias("_hash"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    rows = _named(docs)
    measured = stored(outliers.measure(rows, ["_key", "_hash"]))
    judged = outliers.judge(measured, outliers.fit_outliers(measured), ["_key", "_hash"])
    return rows.join(judged.where("kept"), ["_key", "_hash"], "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles one stays, that with the smallest id.

    Candidates share a SimHash block within three bits or one of 40 min-max bands, which a pair
    at 0.8 misses five times in a million; every link is checked on the shingles themselves.
    Rows that share an id are told apart by their contents.
    """
    rows = _named(docs)
    found = similar.similar_documents(rows.select(F.col("_key").alias("doc_id"), "text", F.col("_hash").alias("body")), words=5, percent=80)
    stay = found.select(F.col("first_id").alias("_key"), F.col("first_body").alias("_hash")).distinct()
    return rows.join(stay, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that stand earlier in the corpus go; texts that lose nothing keep their spacing."""
    found = substrings.remove_repeats(docs, window=20, keep=("lang", "source"), respace=False)
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, with sources evened out as far as none repeats more than 1.5 times, in the order of the blocks."""
    rows = docs.select(*COLUMNS)
    plan = mixing.plan_mix(rows, repetitions=1.5)
    return mixing.in_order(mixing.mix(rows, plan)).select(*COLUMNS)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, with their ids and inclusion scores."""
    return pieces.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sampled_pieces),
]

#: Covariance estimates, fingerprints, hashed permutations and lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
