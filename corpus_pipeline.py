"""From raw documents to training text: five stages, each one operator over all that the one before kept.

1. language_id (7): documents without a determinable language go. The model is learned
   from the labelled rows of the documents themselves, as in the query of that operator.
2. near_dedup (6): of each group of near-duplicates, the document with the smallest id stays.
3. decontaminate (5): passages of the benchmark are cut out; documents that are mostly such go.
4. pii (1): personal data becomes format-preserving pseudonyms.
5. bpe (3): texts are encoded and decoded again; token counts and digests are returned.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridstat.llm import bpe, decontaminate, langid, pii, simhash
from gridstat.llm.common import read_table, shared_folder

#: Session setting that holds the secret of the pseudonyms; without it, the documented key of op1.
KEY_SETTING = "spark.gridstat.pii.key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(langid.learnable(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def pseudonymize_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(docs, key=spark.conf.get(KEY_SETTING, pii.KEY))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("pii", pseudonymize_pii),
    ("bpe", encode_bpe),
]

#: Language scores and BPE merges can't be stated in SQL: run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
