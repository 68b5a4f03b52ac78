"""Reading the given tables and cutting lineage; shared by the operators of this folder."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.storage import spread_scan, store

__all__ = ["documents", "emptied", "ids_and_texts", "spread_scan", "store", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, spread over all cores if it has fewer splits."""
    return spread_scan(table(spark, sf_dir, "documents"), "doc_id")


def ids_and_texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads; whatever else the table has cannot clash."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)


def emptied(*stored: DataFrame) -> None:
    """Free the disk of stored tables that later steps no longer read."""
    for df in stored:
        files = df.inputFiles()
        if files:
            none = df.sparkSession.createDataFrame([], df.schema)
            none.write.mode("overwrite").parquet(unquote(files[0].rsplit("/", 1)[0]))
