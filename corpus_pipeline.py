"""A corpus pipeline of five operators, from documents to packed sequences.

Each stage takes all that the one before it kept. Stages but the last return the columns of
documents; the last returns one row for each packed piece. SQL can't express the language model,
the tokenizer or the plan of the packing, so ORACLE_SQL is None; stages are tested against
brute-force versions. Without the subpackage lakeloom.llm this module can't be imported; only
__spark_entry__.py guards against that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import langcrf, linedup, minhash, mix, packing
from lakeloom.llm.common import WORD_REGEX, fresh_names, shared_dir
from lakeloom.llm.queries import tokenizer_path

LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language, or in which no language has a share of 0.3 of the words."""
    model = langcrf.train_on(docs)
    lang, score = fresh_names(docs.columns, "__lang", "__score")
    labelled = langcrf.identify_languages(spark, docs, model, carry=tuple(docs.columns), result=(lang, score))
    return labelled.filter((F.col(lang) != langcrf.NO_LANGUAGE) & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later matches of lines out of texts. A document of which no word is left goes."""
    lines, removed = fresh_names(docs.columns, "__lines", "__removed")
    cut = linedup.dedup_lines(spark, docs, names=(lines, removed)).filter((F.col(removed) == 0) | F.col("text").rlike(WORD_REGEX))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.keep_one_of_each_group(spark, docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks for."""
    return mix.mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    return packing.pack_documents(spark, docs, tokenizer_path(), with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
