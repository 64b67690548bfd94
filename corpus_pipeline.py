"""A corpus pipeline of five stages over `documents`.

Each stage takes what its predecessor kept, as Parquet, and returns the columns of documents; the last returns the packing.
In every stage null texts count as empty, rows with null ids pass like others, extra columns go, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm import jaccard, mixing, packing, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; equal texts share their fate."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(spark, docs.select("doc_id", "text"), C.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(spark, docs, model).filter(F.col("score") < toxicity.LIMIT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id stays.

    Rows with a null id stay.  Rows that share an id stay if one of them does; equal ones become one."""
    docs = docs.select(*COLUMNS)
    found = jaccard.jaccard_join(spark, docs)
    ids = C.cut(found.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("k")))
    gone = ids.filter("stays = 0").select("doc_id")
    kept = docs.join(C.small(gone, gone.count(), jaccard.BROADCAST_ROWS), "doc_id", "left_anti").select(*COLUMNS)
    return kept.dropDuplicates() if ids.filter("k > 1").limit(1).count() else kept


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets."""
    found = pii.redact(pii.extract(spark, docs.select(*COLUMNS)))
    return found.withColumn("n_chars", F.when(F.size("all") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it: not at all, once or twice.  Equal rows share their fate."""
    return mixing.sample(spark, docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their sequences; a text without words keeps a row without one.  Equal rows are told apart by
    `copy`."""
    return packing.pack(spark, docs.select(*COLUMNS))


STAGES = [("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources to target weights", mixed), ("best-fit packing", packed)]

#: The classifier and the packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of what all stages leave of `documents`; each stage's result is a table in the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
