"""A keyed table of Parquet files that streams update in place, bucket by bucket.

Rows lie in hash buckets of their key. A batch rewrites the buckets it touches and no others: they
go to a folder of the batch, and a one-file manifest then names the batch as the newest version of each of
these buckets. Until the manifest is there, readers see the table as it was; a batch that is run
again reads the versions before it and writes the same files, so a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedTable:
    """The table below ``path``, with the columns of ``schema`` and one row per value of ``keys``.

    ``path``, ``keys`` and ``n_buckets`` belong together for good. A bucket is written by one task, so
    their number follows the final size of the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], n_buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.n_buckets = list(keys), n_buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int").alias("bucket")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """Newest version of every bucket that has one, or the newest one before a batch."""
        try:
            manifest = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/*")
            if before is not None:
                manifest = manifest.filter(F.col("version") < before)
            return {r["bucket"]: r["version"] for r in manifest.groupBy("bucket").agg(F.max("version").alias("version")).collect()}
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All rows as the last finished batch left them."""
        return self._rows(self.versions())

    def upsert(self, changes: DataFrame, version: int, newest: Column | None = None) -> None:
        """Set the columns of ``changes`` in the rows of its keys; other columns keep what they have.

        New keys get new rows, with nulls in columns that ``changes`` does not have. Of several
        changes of one key the one with the greatest ``newest`` counts, or the greatest row. Rows
        without a key are not stored.
        """
        given = [c for c in self.schema.names if c in changes.columns and c not in self.keys]
        row = F.struct(*[F.col(c) for c in given])
        pick = F.max(row) if newest is None else F.max_by(row, F.struct(newest, row))
        known = changes.dropna(subset=self.keys, how="any")
        changed = known.groupBy(*self.keys).agg(pick.alias("_new")).withColumn("_set", F.lit(True))
        touched = [r["bucket"] for r in known.select(self._bucket()).distinct().collect()]
        if not touched:
            return
        before = {b: v for b, v in self.versions(before=version).items() if b in set(touched)}
        merged = self._rows(before).join(changed, self.keys, "full_outer")
        columns = [F.when(F.col("_set"), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in self.schema.names]
        merged = merged.select(*columns, self._bucket())
        written = merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket")
        written.parquet(f"{self.path}/data/version={version}")
        self._publish(touched, version)

    def _publish(self, buckets: Sequence[int], version: int) -> None:
        manifest = self.spark.createDataFrame([(b, version) for b in sorted(buckets)], "bucket int, version long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={version}")


def upsert_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], table: BucketedTable, checkpoint: str, first_version: int = 0) -> int:
    """Run ``transform`` over everything new and upsert the results; the next free version.

    Versions are batch numbers of the query from ``first_version`` on; several streams into one table
    need ranges of their own, later ones higher.
    """
    last = first_version - 1

    def save(batch: DataFrame, batch_id: int) -> None:
        nonlocal last
        last = max(last, first_version + batch_id)
        table.upsert(transform(batch), first_version + batch_id)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last + 1
