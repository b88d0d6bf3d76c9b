"""The corpus pipeline: language ID, near-duplicates, decontamination, pseudonyms, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Nulls, empty tables and repeated rows have the results that the operators state:

1. language: documents without a language (null, no letter, mostly background) go;
2. near_duplicates: of each group of near-duplicates the document with the smallest id stays; of rows that repeat an
   id one stays; rows with a null id cannot be grouped and stay;
3. decontaminate: documents that share a benchmark window go;
4. pseudonyms: personal data in the texts are replaced;
5. tokens: every text is encoded and decoded, one row per document with its ids and the decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.llm import bpe, decontamination, language_id, near_duplicates, pseudonyms
from snipdex.llm.queries import PSEUDONYM_KEY, WORD_BPE
from snipdex.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.reject_unknown(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonym(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY, found_col="pii_found").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.decode(bpe.encode(docs, WORD_BPE), WORD_BPE)
    return found.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("decontaminate", decontaminate), ("pseudonyms", pseudonym), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: No SQL: language ID, pseudonyms and tokens cannot be expressed; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
