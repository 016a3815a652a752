"""Documents to training tokens in five stages. Each takes (spark, docs, sf_dir) and works on all that the one before it kept.

Null and empty texts count as empty texts throughout; an empty table gives an empty result; rows
that repeat another are rows of their own until a stage for copies drops them. Columns other than
those of documents pass the first four stages, whatever they are named (but for names in two underscores).
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import bpe, exact_dedup, mixing, near_dedup, quality
from rowforge.llm._shared import shared_folder

TOKENIZER = "byte_bpe_50k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes. Without labels none does: every score is then 0.5."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; a null id comes last, and rows that repeat the id that stays stay too."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 in shingles of five words the one with the smallest id. Texts without words and null ids stay."""
    return near_dedup.drop_near_copies(docs, shingle=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same weight for every source, a null one too; a document is repeated as its source's rate asks, alike for equal ids."""
    return mixing.mix_sources(docs, extras=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of what they decode to, of every copy; a null text has no tokens."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The classifier's and tokenizer's stages have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
