"""Document quality by hierarchical empirical Bayes.

Each text gets evidence from a logistic classifier over simple statistics of the whole text.
Sites have two levels, host and path. The mean quality of a path is shrunk toward its host and
that of a host toward all documents, by prior strengths that are estimated from the spread of
the groups (method of moments); a site with few documents stays near its parent. The score of
a document combines its own evidence with its path's shrunken mean, taken without the document
itself. All documents count in the sums; labelled ones count by their label.

Only sums per host and path are grouped, and rows are joined with them on a key whose other
side is unique, so a host with a third of all rows can be split.

Defined results: a null text is an empty one; a null host or path is a site of its own; rows
without doc_id are judged as unlabelled; repeated labels of one doc_id count once, the largest.
Without labels of both kinds the evidence is 0 for every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import store

PER_LABEL = 4000
LENGTHS = 16
NO_SITE = "(none)"


def _features(block: pa.RecordBatch) -> np.ndarray:
    """Byte shares, word-length shares, and shares of distinct words and lines."""
    data, offsets = wd.text_bytes(block.column(block.schema.get_field_index("text")))
    starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
    hashes = wd.word_hashes(data, starts, ends)
    newline = np.zeros(256, bool)
    newline[10] = True
    line_starts, line_ends, first_line = wd.word_spans(data, offsets, newline)
    lines = wd.word_hashes(data, line_starts, line_ends)
    sizes = np.minimum(ends - starts, LENGTHS - 1)
    out = np.zeros((block.num_rows, 128 + LENGTHS + 3), np.float32)
    for i in range(block.num_rows):
        text = data[offsets[i] : offsets[i + 1]]
        if not len(text):
            continue
        a, b, c, d = first[i], first[i + 1], first_line[i], first_line[i + 1]
        counts = np.bincount(text, minlength=256)
        out[i, :128] = np.sqrt(counts[:128] / len(text))
        out[i, 128 : 128 + LENGTHS] = np.bincount(sizes[a:b], minlength=LENGTHS) / max(1, b - a)
        out[i, -3] = len(np.unique(hashes[a:b])) / max(1, b - a)
        out[i, -2] = len(np.unique(lines[c:d])) / max(1, d - c)
        out[i, -1] = np.log1p(b - a) / 10
    return out


def _train(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by accelerated gradient steps."""
    centre, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3)
    z = (x - centre) * scale
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    rate = 1 / (0.25 * float((share * ((z * z).sum(axis=1) + 1)).sum()) + ridge)
    w = ww = np.zeros(x.shape[1])
    b = bb = 0.0
    for t in range(steps):
        pull = share * (y - 1 / (1 + np.exp(-np.clip(z @ ww + bb, -30, 30))))
        w_new, b_new = ww + rate * (z.T @ pull - ridge * ww), bb + rate * pull.sum()
        ww, bb = w_new + t / (t + 3) * (w_new - w), b_new + t / (t + 3) * (b_new - b)
        w, b = w_new, b_new
    return w * scale, float(b - (w * scale) @ centre)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, float] | None:
    """Train on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    The sample is chosen by a hash of doc_id from ids alone; only its ids, about ``per_label``
    a label, are sent to the texts, which stay where they are. Rows that share an id give one
    example.
    """
    labels = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = docs.select("doc_id").join(labels, "doc_id")
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, per_label / n))])
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)

    def run(batches):
        for block in wd.blocks(batches):
            packed = [v.tobytes() for v in _features(block)]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(packed, pa.binary())], ["doc_id", "quality", "features"])

    sample = store(known.distinct().where(draw < share[F.col("quality")]), "quality-sample")
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")
    rows = rows.mapInArrow(run, "doc_id long, quality int, features binary")
    drawn = rows.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).collect()
    drawn.sort(key=lambda r: (r[0], r[2]))
    if len({r[1] for r in drawn}) < 2:
        return None
    x = np.stack([np.frombuffer(r[2], np.float32) for r in drawn]).astype(float)
    return _train(x, np.array([r[1] for r in drawn], float))


def evidence(rows: DataFrame, model: tuple[np.ndarray, float] | None, *more: str) -> DataFrame:
    """``evidence`` (log odds of good quality at even odds before) with ``more`` columns."""
    weights, bias = model if model else (np.zeros(128 + LENGTHS + 3), 0.0)
    kept = rows.select("text", *more)

    def run(batches):
        for block in wd.blocks(batches):
            value = np.clip(_features(block) @ weights + bias, -12, 12)
            yield pa.RecordBatch.from_arrays([pa.array(value), *block.columns[1:]], ["evidence", *more])

    schema = "evidence double" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, schema)


def _strength(sums: DataFrame, mean: Column) -> float:
    """Prior strength from the spread of group means beyond what chance gives; 1 to 1e6."""
    n, good = F.col("n"), F.col("good")
    spread = (good / n - mean) * (good / n - mean)
    row = sums.where("n >= 2").agg(F.sum(n * spread).alias("s"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(mean * (1 - mean) * n).alias("v")).first()
    if not row["g"] or not row["v"]:
        return 1.0
    inside, between = row["v"] / row["n"], row["s"] / row["n"]
    extra = between - inside * row["g"] / row["n"]
    return float(np.clip(inside / extra - 1, 1.0, 1e6)) if extra > 0 else 1e6


def rated(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """``doc_id, host, path, evidence, prior, score, keep`` of every row of ``docs``."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(host, F.lit(NO_SITE)).alias("host"), F.coalesce(path, F.lit(NO_SITE)).alias("path"))
    model = fit(rows.select("doc_id", "text"), labels)
    judged = evidence(rows, model, "doc_id", "host", "path").join(labels, "doc_id", "left")
    chance = 1 / (1 + F.exp(-F.col("evidence")))
    judged = store(judged.select("doc_id", "host", "path", "evidence", F.coalesce(F.col("quality").cast("double"), chance).alias("own")), "evidence")

    paths = store(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good")), "path-sums")
    hosts = store(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "host-sums")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    mean = total[1] / total[0] if total[0] else 0.5
    of_hosts = _strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("good") + of_hosts * mean) / (F.col("n") + of_hosts)).alias("host_mean"))
    paths = paths.join(hosts, "host")
    of_paths = _strength(paths, F.col("host_mean"))
    alone = (F.col("good") - F.col("own") + of_paths * F.col("host_mean")) / (F.col("n") - 1 + of_paths)
    prior = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), alone))
    out = judged.join(paths, ["host", "path"]).withColumn("prior", prior)
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior"))))))
    return out.select("doc_id", "host", "path", "evidence", "prior", score.alias("score"), (score >= 0.5).alias("keep"))
