"""A training corpus from raw documents: language, near-duplicates, repeated passages, source mix, packed sequences.

Each stage is written as Parquet and read again by the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brierworks.llm import langid, mixing, packing, simhash, substrings
from brierworks.session import shared_folder


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the languages that are learned: those without a letter go, and those whose prediction is hardly better
    than a guess. Where no language could be learned all with a letter stay."""
    return langid.identify(docs).where("plausible").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles."""
    return simhash.deduplicate(docs, words=5, budget=14, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; a text that loses nothing stays as it is."""
    cut = substrings.remove_repeats(docs, window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    own = {"text": text.alias("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("doc.n_chars")).cast("long").alias("n_chars")}
    return cut.select(*[own.get(c, F.col(f"doc.`{c}`")) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # no stage can be said in SQL; tests/llm/test_pipeline.py compares each with plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the stages' tables lie in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
