"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the documents are written as Parquet in the shared
folder and read again. All but the last return the columns of documents.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.llm import decontaminate, language_id, line_dedup, packing, simhash, words
from tabcast.operators.order import checkpoint_folder


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin stay."""
    words.ship(spark)
    return language_id.accepted(docs, language_id.train(docs))


def remove_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; n_chars follows the text."""
    words.ship(spark)
    less = line_dedup.deduplicated(docs)
    return less.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    words.ship(spark)
    return simhash.keep_one(docs)


def remove_benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    words.ship(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences."""
    words.ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_dedup", remove_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

# Compression sizes, fingerprints and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
