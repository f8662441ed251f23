"""From raw documents to token files: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage's result is written as Parquet into the
folder all executors share and read again as the next one's documents, so a lost
executor costs no more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabforge.llm.decontaminate import keep_clean
from tabforge.llm.files import work_folder
from tabforge.llm.mixing import Mix
from tabforge.llm.ngram_jaccard import keep_first
from tabforge.llm.quality import keep_good
from tabforge.llm.token_binary import token_binary
from tabforge.sources.tables import load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return keep_clean(docs, load(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row per document and round of repetition."""
    return Mix(docs).documents()


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files."""
    return token_binary(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token-ID output", token_files),
]

#: SQL cannot code tokens; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
