"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the longest one seen before plus one character (LZ78).
The set of phrases is hashed and MinHash of it is the fingerprint: texts that compress alike
share phrases. An edited text has its last quarter replaced, so its parse goes on from the
state that the original's parse has at that place.

Documents are compared with the next one by ascending doc_id. Rows are dealt to buckets of
neighbouring ids, and each bucket also gets the first row of the next one, so no row has to
see all others. The borders of the buckets are quantiles of doc_id, fixed in the plan.

Defined results: a null text is an empty one; an empty text has no phrases, and two empty
phrase sets have likeness 1. Rows without doc_id come first, rows with equal doc_id are
ordered by text; the row after the last is the first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts

MINIMA = 64
BUCKET_ROWS, MOST_BUCKETS = 1024, 8192
_SEEDS = wd.constants(MINIMA, 23)


def parse(text: str, phrases: set[str], prefix: str = "") -> str:
    """Adds the phrases of ``text`` to the set; what is left over at its end is returned."""
    for c in text:
        prefix += c
        if prefix not in phrases:
            phrases.add(prefix)
            prefix = ""
    return prefix


def hashes_of(phrases: list[str]) -> np.ndarray:
    """One 64-bit hash per phrase."""
    joined = "\x00".join(phrases).encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 0), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return wd.word_hashes(data, starts, ends)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 4096):
        out = np.minimum(out, ((hashes[at : at + 4096, None] * _SEEDS) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def fingerprints(text: str, following: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text and the fingerprints of the text and of the edited text."""
    tail = len(text) // 4
    head = len(text) - tail
    phrases: set[str] = set()
    # A NUL would cut the joined phrases; it counts as the unassigned character U+FFFF.
    state = parse(text[:head].replace("\x00", "￿"), phrases)
    shared = hashes_of(list(phrases)) if phrases else np.zeros(0, np.uint64)
    before = minima(shared)
    results = []
    for end in (text[head:], following[:tail]):
        added = _Grown(phrases)
        rest = parse(end.replace("\x00", "￿"), added, state)
        new = list(added.own)
        if rest and rest not in phrases and rest not in added.own:
            new.append(rest)
        results.append(np.minimum(before, minima(hashes_of(new))) if new else before)
    return text[:head] + following[:tail], results[0], results[1]


class _Grown:
    """A set that grows without changing the one it starts from."""

    def __init__(self, base: set[str]):
        self.base, self.own = base, set()
        self.add = self.own.add

    def __contains__(self, phrase: str) -> bool:
        return phrase in self.base or phrase in self.own


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def _walk(batches):
    """Rows of whole buckets in order; the guard row of a bucket is only looked at."""

    def row(now, following):
        edited, own, changed = fingerprints(now[2], following[2])
        return [now[1], len(now[2]), edited, as_text(own), as_text(changed), likeness(own, changed)], own

    held = waiting = waiting_print = None
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        for slice_ in wd.blocks([batch]):
            rows = []
            for bucket, doc_id, text, guard in zip(*(c.to_pylist() for c in slice_.columns), strict=True):
                now = (bucket, doc_id, text or "", guard)
                if held is not None and held[0] == bucket and not held[3]:
                    made, own = row(held, now)
                    if waiting is not None:
                        rows.append([*waiting, likeness(waiting_print, own)])
                    waiting, waiting_print = made, own
                if guard and (held is None or held[0] != bucket or not held[3]):
                    _, own, _ = fingerprints(now[2], "")
                    if waiting is not None:
                        rows.append([*waiting, likeness(waiting_print, own)])
                    waiting = None
                held = now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, edited text, both fingerprints, likeness to both."""
    texts = ids_and_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    n_rows = texts.count()
    n = min(MOST_BUCKETS, max(1, math.ceil(n_rows / BUCKET_ROWS)))
    points = []
    if n > 1:
        shares = F.array(*[F.lit(i / n) for i in range(1, n)])
        points = sorted(set(texts.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n))).first()[0] or []))
    limits = np.array(points, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        filled = ids.fillna(-(1 << 62)).astype(np.int64).to_numpy()
        return pd.Series(np.searchsorted(limits, filled, side="right").astype(np.int32))

    dealt = texts.withColumn("bucket", bucket("doc_id"))
    # Smallest id of each bucket that has rows: one row per bucket, at most MOST_BUCKETS.
    first = sorted((r[0], r[1]) for r in dealt.select("doc_id", "bucket").groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62))))).collect())
    spark = docs.sparkSession
    guards = [(first[i - 1][0], lowest) for i, (_, lowest) in enumerate(first)]
    guards = [(first[-1][0], first[0][1]), *guards[1:]] if guards else []
    guard_table = F.broadcast(spark.createDataFrame(guards, "to_bucket int, first_id long"))
    ids = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))
    heads = texts.join(guard_table, ids == F.col("first_id")).select(F.col("to_bucket").alias("bucket"), "doc_id", "text", F.lit(True).alias("guard"))
    rows = dealt.select("bucket", "doc_id", "text", F.lit(False).alias("guard")).unionByName(heads)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guard", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(_walk, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
