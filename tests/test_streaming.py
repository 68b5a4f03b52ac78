"""The bucketed table under streams: upserts, restarts, untouched buckets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.storage import scratch_path
from lingospan.streaming.bucketed import BucketedTable, upsert_stream

SCHEMA = T.StructType().add("id", "long").add("body", "string").add("head", "string")


def table(spark, n_buckets=4):
    return BucketedTable(spark, scratch_path(spark, "bucketed"), SCHEMA, ["id"], n_buckets)


def content(t):
    return {r["id"]: (r["body"], r["head"]) for r in t.read().collect()}


def test_only_given_columns_change(spark):
    t = table(spark)
    assert content(t) == {}
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "lost")], "id long, body string"), 0)
    t.upsert(spark.createDataFrame([(2, "h2"), (3, "h3")], "id long, head string"), 1)
    assert content(t) == {1: ("a", None), 2: ("b", "h2"), 3: (None, "h3")}
    t.upsert(spark.createDataFrame([(2, None)], "id long, body string"), 2)
    assert content(t)[2] == (None, "h2")


def test_newest_of_several_changes(spark):
    t = table(spark)
    changes = spark.createDataFrame([(1, "old", 1), (1, "new", 9), (1, "mid", 5)], "id long, body string, at int")
    t.upsert(changes, 0, newest=F.col("at"))
    assert content(t) == {1: ("new", None)}
    t.upsert(changes.drop("at"), 1)
    assert content(t) == {1: ("old", None)}


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    t = table(spark, 16)
    t.upsert(spark.range(200).select("id", F.lit("x").alias("body")), 0)
    t.upsert(spark.createDataFrame([(5, "y")], "id long, body string"), 1)
    versions = t.versions()
    assert sorted(versions.values()).count(1) == 1 and len(versions) == 16
    assert sum(b == "y" for b, _ in content(t).values()) == 1 and len(content(t)) == 200


def test_replay_after_a_kill_gives_the_same_table(spark, monkeypatch):
    t = table(spark)
    t.upsert(spark.createDataFrame([(i, f"a{i}") for i in range(20)], "id long, body string"), 0)
    before = content(t)
    changes = spark.createDataFrame([(i, f"b{i}") for i in range(5, 30)], "id long, body string")
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.upsert(changes, 1)
    assert content(t) == before
    t.upsert(changes, 1)
    after = content(t)
    assert after == {i: (f"b{i}" if i >= 5 else f"a{i}", None) for i in range(30)}
    t.upsert(changes, 1)
    assert content(t) == after


def test_streams_continue_where_they_stopped(spark):
    source, progress = scratch_path(spark, "source"), scratch_path(spark, "progress")
    t = table(spark)
    work = lambda batch: batch.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("body"))

    def stream():
        return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)

    spark.range(0, 10).repartition(2).write.mode("append").parquet(source)
    first = upsert_stream(stream(), work, t, progress)
    assert first >= 2 and len(content(t)) == 10
    spark.range(8, 15).coalesce(1).write.mode("append").parquet(source)
    assert upsert_stream(stream(), work, t, progress) == first + 1
    assert content(t) == {i: (f"n{i}", None) for i in range(15)}
    assert upsert_stream(stream(), work, t, progress) == 0
