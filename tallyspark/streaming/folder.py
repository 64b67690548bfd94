"""A watched folder of invoice files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import nfe


def stream(spark: SparkSession, folder: str, done: str | None = None) -> DataFrame:
    """(arquivo, xml) of the folder's XML files as they come; files that are through move to `done`."""
    source = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.[xX][mM][lL]")
    if done:
        source = source.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return source.load(folder).select(F.col("_metadata.file_path").alias("arquivo"), F.col("value").alias("xml"))


def watch(spark: SparkSession, folder: str, notes: str, failed: str, checkpoint: str, done: str | None = None, seconds: int = 0) -> StreamingQuery:
    """Usable new notes are appended to the table at `notes`, one a key; unusable files to `failed`.  Events are skipped.

    Keys that have come are kept as the stream's state, so a batch costs what it brings and reads nothing that is written.
    Each batch writes a folder named after its number, so a repeated batch overwrites what it left.
    seconds=0: what is there now, then stop."""
    files = stream(spark, folder, done)
    plain = files.filter(~nfe.is_event(F.col("xml")))
    read = nfe.read(plain).withColumn("_key_", F.when(F.col("erro").isNull(), F.col("chave_acesso")).otherwise(F.col("arquivo"))).dropDuplicates(["_key_"]).drop("_key_")

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.filter("erro is null").write.mode("overwrite").parquet(f"{notes}/batch={number}")
        batch.filter("erro is not null").select("arquivo", "erro").write.mode("overwrite").parquet(f"{failed}/batch={number}")
        batch.unpersist()

    out = read.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()
