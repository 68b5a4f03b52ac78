"""Text files as numbered lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.storage import store


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of every split, which come one behind the other, from 0."""
    last, done = None, 0
    for batch in batches:
        files, starts = batch["file"].to_numpy(zero_copy_only=False), batch["split_at"].to_numpy()
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (files[1:] != files[:-1])]))
        place = np.arange(len(starts)) - np.repeat(new, np.diff(new, append=len(starts)))
        if (files[0], starts[0]) == last:
            place[: new[1] if len(new) > 1 else len(place)] += done
        last, done = (files[-1], starts[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch["file"], batch["split_at"], pa.array(place, pa.int64()), batch["line"]], ["file", "split_at", "place", "line"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` with 0-based line numbers per file.

    Files are read in splits. A first scan counts the lines of every split; the second numbers them inside
    their split and adds the counts of the splits before it, one stored row per split. The lines
    themselves are not stored. How a file is split depends on the session: a scan that cuts it elsewhere
    than the first one finds no count for its splits and fails, it never numbers wrongly.
    """
    split = ["file", "split_at"]
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_at"), F.col("value").alias("line")
    )
    before = W.partitionBy("file").orderBy("split_at").rowsBetween(W.unboundedPreceding, -1)
    counts = scan.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    offsets = store(counts.select(*split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "split-offsets")
    numbered = scan.mapInArrow(_placed, "file string, split_at long, place long, line string").join(offsets, split, "left")
    missing = F.raise_error(F.lit("a file is split otherwise than when its lines were counted"))
    line_no = F.when(F.col("offset").isNull(), missing.cast("long")).otherwise(F.col("offset") + F.col("place"))
    return numbered.select("file", line_no.cast("long").alias("line_no"), "line")
