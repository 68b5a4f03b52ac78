"""Restartable document processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, folder: str, schema, file_glob: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """Parquet documents as a stream; the query checkpoint remembers what was processed."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet table as a stream, whether ``path`` is one file or a folder of part files.

    A stream takes folders and patterns only, so the path is given as a pattern that names itself.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return document_stream(spark, f"{folder}/{{{name}}}", schema, "*", max_files)


def process_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], results: str, checkpoint: str
) -> None:
    """Run ``transform`` over everything new and store the results, then stop.

    A batch overwrites its own folder, so a replay after a failure changes nothing.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch).withColumn("version", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def nlp_result(content: Column, tokens: Column, prefix: str = "") -> list[Column]:
    """Result and status columns: empty content is an error row, not an exception.

    ``prefix`` names the columns of a second text field, such as an abstract.
    """
    failed = content.isNull() | (F.length(content) == 0)
    return [
        F.when(~failed, tokens).alias(f"{prefix}tokens"),
        F.when(failed, "error").otherwise("done").alias(f"{prefix}status"),
    ]


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each row: an upsert as an append-only log with a reading rule."""
    columns = [c for c in results.columns if c not in (*keys, "version", "batch")]
    newest = F.max_by(F.struct(*columns), "version").alias("_row")
    return results.groupBy(*keys).agg(newest, F.max("version").alias("version")).select(*keys, "_row.*", "version")


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``changes`` replacing or joining it."""
    return latest(existing.unionByName(changes), keys)
