from __future__ import annotations

import subprocess
import sys

SCRIPT = """
from pyspark.sql import SparkSession
from lingospan.storage import scratch_root, store
spark = (SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "{path}")
         .config("spark.ui.enabled", "false").getOrCreate())
assert scratch_root(spark) == "{path}", scratch_root(spark)
assert store(spark.range(3), "t").count() == 3
before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
assert store(spark.range(99).groupBy("id").count(), "u").count() == 99
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before == "false"
spark.stop()
"""


def test_scratch_follows_the_session_setting(tmp_path):
    code = SCRIPT.replace("{path}", str(tmp_path))
    done = subprocess.run([sys.executable, "-c", code], cwd=".", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert list(tmp_path.glob("t-*"))


def test_scratch_paths_differ(spark):
    from lingospan.storage import scratch_path, scratch_root

    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_root(spark) == scratch_root(spark)
