"""Exact neighbour search that sends a query only where a neighbour can be.

The space is dealt to pivots, vectors drawn from it: every vector belongs to its nearest pivot, and
the vectors of a pivot lie in blocks of bounded size. By the triangle inequality no vector of a
block is nearer to a query than the query's distance from the pivot less the radius of the block.
A query first searches the blocks of its own pivot; its last place there is what a block
has to beat, and only blocks that can are sent the query. Distances are angles for cosine scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingospan.functions.vectors import l2_normalise
from lingospan.operators.embedding import BLOCK_ROWS, _largest, skip_own, top_places
from lingospan.storage import store

#: Bounds are loosened by more than rounding can move a score.
SLACK = 1e-9
#: Rows that a task makes at once of queries and the blocks they are sent to.
SENT_ROWS = 1 << 15
#: Queries of a key that meet a block in one task.
ASKED_ROWS = 1 << 14


@dataclass
class Partition:
    """Pivots and blocks of one space, as many numbers as the space has blocks and pivots."""

    pivots: np.ndarray
    pivot: np.ndarray
    block: np.ndarray
    radius: np.ndarray
    least_weight: np.ndarray
    sizes: dict[int, int]


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean distances, or angles of unit vectors."""
    product = a @ b.T
    if metric != "euclidean":
        return np.arccos(np.clip(product, -1, 1))
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * product, 0))


def best_scores(least: np.ndarray, weight: np.ndarray, metric: str, beta: float) -> np.ndarray:
    """The highest score that a vector at these least distances can have."""
    if metric == "euclidean":
        return -least
    top = np.cos(np.clip(least, 0, np.pi))
    return np.exp(beta * top) / weight if metric == "softmax" else top


def top_of_block(q: pd.DataFrame, s: pd.DataFrame, top_n: int, metric: str, beta: float) -> pd.DataFrame:
    """The best ``top_n`` rows of a block for every query; ties go to the smaller item id."""
    s = s.sort_values("item_id", ignore_index=True)
    a, b = np.stack(q["vec"].to_numpy()).astype(np.float64), np.stack(s["vec"].to_numpy()).astype(np.float64)
    if metric == "euclidean":
        scores = -distances(a, b, metric)
    else:
        scores = a @ b.T
        if metric == "softmax":
            scores = np.exp(beta * scores) / s["weight"].to_numpy()[None, :]
    skip_own(scores, q["query_id"].to_numpy(), s["item_id"].to_numpy())
    row, column, value = top_places(scores, top_n)
    return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "item_id": s["item_id"].to_numpy()[column], "score": value})


def partitioned(
    space: DataFrame, key: str, metric: str, n_pivots: int, block_rows: int
) -> tuple[DataFrame, dict[str, Partition]]:
    """``(key, item_id, vec, weight, pivot, block)`` and the partition of every key.

    ``space(key, item_id, vec, weight)``. About ``n_pivots`` vectors of each space are drawn by a hash of their ids.
    """
    draw = F.pmod(F.xxhash64(F.lit("pivot"), "item_id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = space.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(draw, "item_id")).alias("_first"))
    chosen = space.join(sizes, key).where((draw <= n_pivots / F.col("_n")) | (F.col("item_id") == F.col("_first.item_id")))
    drawn: dict[str, list] = {}
    for row in chosen.select(key, "item_id", "vec").orderBy("item_id").collect():
        drawn.setdefault(row[key], []).append(row["vec"])
    pivots = {k: np.array(v, np.float64) for k, v in drawn.items()}

    def assign(batches):
        for pdf in batches:
            for k, rows in pdf.groupby(key, sort=False):
                away = distances(np.stack(rows["vec"].to_numpy()).astype(np.float64), pivots[k], metric)
                nearest = away.argmin(axis=1)
                yield rows.assign(pivot=nearest.astype(np.int32), away=away[np.arange(len(rows)), nearest])

    schema = f"{key} string, item_id string, vec array<double>, weight double, pivot int, away double"
    near = store(space.mapInPandas(assign, schema), "pivots")
    held = near.groupBy(key, "pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    items = near.join(held, [key, "pivot"]).withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int"))
    items = store(items.drop("_blocks"), "blocks")
    parts: dict[str, Partition] = {}
    stats = items.groupBy(key, "pivot", "block").agg(F.max("away").alias("radius"), F.min("weight").alias("least"), F.count(F.lit(1)).alias("n")).toPandas()
    for k, rows in stats.groupby(key):
        rows = rows.sort_values(["pivot", "block"])
        columns = [rows[c].to_numpy() for c in ("pivot", "block", "radius", "least")]
        parts[k] = Partition(pivots[k], *columns, rows.groupby("pivot")["n"].sum().to_dict())
    return items.drop("away"), parts


def _sent(queries: DataFrame, parts: dict[str, Partition], key: str, metric: str, beta: float, own: bool) -> DataFrame:
    """Queries once for every block they are sent to: those of their own pivot, or others that ``least`` leaves."""

    def run(batches):
        for pdf in batches:
            for k, rows in pdf.groupby(key, sort=False):
                part = parts.get(k)
                if part is None:
                    continue
                # As many queries at a time as make SENT_ROWS rows if all blocks get them.
                n = max(1, SENT_ROWS // max(1, len(part.block)))
                yield from (_dealt(rows.iloc[i : i + n], k, part) for i in range(0, len(rows), n))

    def _dealt(rows: pd.DataFrame, k: str, part: Partition) -> pd.DataFrame:
        away = distances(np.stack(rows["vec"].to_numpy()).astype(np.float64), part.pivots, metric)
        used = np.unique(part.pivot)
        home = used[away[:, used].argmin(axis=1)]
        at_home = part.pivot[None, :] == home[:, None]
        if own:
            row, block = np.nonzero(at_home)
        else:
            bound = best_scores(away[:, part.pivot] - part.radius[None, :], part.least_weight[None, :], metric, beta)
            least = rows["least"].to_numpy(np.float64)[:, None]
            row, block = np.nonzero(~at_home & (bound >= least - SLACK * np.maximum(1, np.abs(least))))
        return pd.DataFrame(
            {
                key: k,
                "query_id": rows["query_id"].to_numpy()[row],
                "vec": rows["vec"].to_numpy()[row],
                "pivot": part.pivot[block].astype(np.int32),
                "block": part.block[block].astype(np.int32),
            }
        )

    schema = f"{key} string, query_id string, vec array<double>, pivot int, block int"
    return queries.mapInPandas(run, schema)


def nearest_pruned(
    queries: DataFrame,
    space: DataFrame,
    top_n: int,
    *,
    key: str = "model_id",
    metric: str = "cosine",
    offset: DataFrame | None = None,
    beta: float = 10.0,
    n_pivots: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[DataFrame]]:
    """``(key, query_id, item_id, score, rank)`` as ``embedding.nearest``, and the queries as they were sent.

    The second value has a frame for each round, a row per query and block. A block goes to one task with the
    queries sent to it. Pivots, radii and the first round's last places are all that is known of the space.
    """
    vec = F.col("vec").cast("array<double>")
    unit = (vec if metric == "euclidean" else l2_normalise(vec)).alias("vec")
    items = space if offset is None else space.join(offset, [key, "item_id"])
    weight = F.lit(1.0) if offset is None else F.col("denominator").cast("double")
    items, parts = partitioned(store(items.select(key, "item_id", unit, weight.alias("weight")), "space"), key, metric, n_pivots, block_rows)
    asked = store(queries.select(key, "query_id", unit), "queries")
    by = [key, "pivot", "block", "part"]
    # Queries are dealt to parts, so how many meet in a task does not grow with them; a block is there once for each part.
    n_parts = max(1, -(-_largest(asked, key) // ASKED_ROWS))
    part = F.pmod(F.xxhash64(F.lit("part"), "query_id"), F.lit(n_parts)).cast("int")
    blocks = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def search(sent: DataFrame) -> DataFrame:
        def run(k: tuple, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(s):
                return pd.DataFrame(columns=[key, "query_id", "item_id", "score"])
            found = [top_of_block(q.iloc[i : i + 1024], s, top_n, metric, beta) for i in range(0, len(q), 1024)]
            return pd.concat(found).assign(**{key: k[0]})[[key, "query_id", "item_id", "score"]]

        found = sent.withColumn("part", part).groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(run, f"{key} string, query_id string, item_id string, score double")
        rank = F.row_number().over(W.partitionBy(key, "query_id").orderBy(F.desc("score"), "item_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= top_n)

    first = _sent(asked, parts, key, metric, beta, own=True)
    found = store(search(first), "first-round")
    last = found.filter(F.col("rank") == top_n).select(key, "query_id", F.col("score").alias("least"))
    open_ = asked.join(last, [key, "query_id"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    second = _sent(open_, parts, key, metric, beta, own=False)
    both = found.drop("rank").unionByName(search(second).drop("rank"))
    rank = F.row_number().over(W.partitionBy(key, "query_id").orderBy(F.desc("score"), "item_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top_n), [first, second]
