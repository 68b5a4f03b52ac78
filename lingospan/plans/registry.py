"""Names of runnable queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingospan.plans.corpus import PRELUDE, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUILDERS: dict[str, Callable[[Corpus], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(corpus)``; ``sql`` is its check on the derived views plus ``views``."""

    def register(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = fn
        QUERIES[name] = lambda spark, path: fn(Corpus(spark, path))
        if sql is not None:
            ORACLES[name] = PRELUDE.rstrip() + (f",\n{views.strip()}" if views else "") + "\n" + sql.strip()
        return fn

    return register


def six(value: Column | str) -> Column:
    """Six decimals without negative zero, the precision both engines agree on.

    The small shift keeps values that lie exactly between two roundings, such as 1/64, from
    falling to either side with the order of a sum.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(1e-9), 6) + F.lit(0.0)
