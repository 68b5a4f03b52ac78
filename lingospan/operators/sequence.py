"""Distributed ordinals: row numbers that never sort a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.storage import store

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 1024


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    split: Column,
    *,
    out: str = "seq",
    scan: bool = False,
    n_rows: int | None = None,
) -> DataFrame:
    """0-based position of each row inside its ``keys`` group under ``order``.

    Up to ``ROWS_PER_BUCKET`` rows are numbered by one window. Beyond that rows are cut at
    quantiles of ``split``, a long that never falls along ``order``; each bucket is numbered on
    its own and shifted by the sizes of the buckets before it, whatever the distribution of
    keys. Only the table of bucket sizes meets in one task.

    ``df`` is read several times, so it is stored first unless it is a plain ``scan``.
    """
    if not scan:
        df = store(df, "numbered")
    if n_rows is None:
        n_rows = df.count()
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    if n_rows <= ROWS_PER_BUCKET:
        return df.withColumn(out, position.cast("long"))

    marked = df.withColumn("_bucket", _bucket(df, split, n_rows))
    parts = [*keys, "_bucket"]
    sizes = marked.groupBy(*parts).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(W.partitionBy(*parts).orderBy(*order)) - 1
    return (
        marked.withColumn("_local", local)
        .join(offsets, parts)
        .withColumn(out, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def _bucket(df: DataFrame, split: Column, n_rows: int) -> Column:
    """Number of quantile points at or below ``split``.

    The points are fixed here, as constants of the plan: reading the rows twice, or again
    after a lost task, gives the same buckets.
    """
    n = min(MAX_BUCKETS, math.ceil(n_rows / ROWS_PER_BUCKET))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    found = df.select(split.cast("long").alias("s")).agg(F.percentile_approx("s", shares, F.lit(100 * n)))
    points = np.unique(np.array(found.first()[0] or [], dtype=np.int64))

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, values.to_numpy(), side="right"))

    return place(split.cast("long"))


def word_key(word: Column, n_bytes: int = 7) -> Column:
    """The first bytes of a word as a number with the same order."""
    digits = F.rpad(F.substring(F.hex(F.encode(word, "UTF-8")), 1, 2 * n_bytes), 2 * n_bytes, "0")
    return F.conv(digits, 16, 10).cast("long")


def count_key(count: Column, tie: Column) -> Column:
    """Number that falls with ``count`` and then rises with the 48-bit number ``tie``.

    Frequent counts have few words each and need no tie.
    """
    return F.when(count >= 128, -count).otherwise((127 - count) * F.lit(1 << 48) + tie)


def number_by_id(df: DataFrame, keys: Sequence[str], id_col: str, out: str = "seq", **options) -> DataFrame:
    """Position by ascending integer id."""
    return number_rows(df, keys, [F.col(id_col)], F.col(id_col), out=out, **options)


def number_by_word(df: DataFrame, keys: Sequence[str], word: str = "word", out: str = "seq") -> DataFrame:
    """Position by ascending word."""
    return number_rows(df, keys, [F.col(word)], word_key(F.col(word)), out=out)
