"""Word-vector spaces: alignment, neighbours, translation, language dimensions, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lingospan.functions.text import word_script_binary
from lingospan.functions.vectors import drop_dims, l2_normalise
from lingospan.storage import store

BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: So many blocks of these rows before a block gets more of them, and how many times as many at most.
MOST_BLOCKS, WIDE = 8, 8


# --- training and alignment -------------------------------------------------------------


def train_word2vec(
    sentences: DataFrame,
    *,
    vector_size: int = 100,
    window: int = 5,
    min_count: int = 15,
    max_iter: int = 1,
    partitions: int = 8,
    seed: int = 1,
    tokens: str = "tokens",
) -> DataFrame:
    """``(word, vec)`` trained on token arrays (hierarchical softmax).

    Partitions train side by side and are averaged after each pass, so their number is part
    of the model and does not follow the cores of the session.
    """
    model = Word2Vec(
        vectorSize=vector_size,
        windowSize=window,
        minCount=min_count,
        maxIter=max_iter,
        numPartitions=partitions,
        seed=seed,
        inputCol=tokens,
        outputCol="_doc",
    ).fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vec"))


def train_word2vec_per_language(docs: DataFrame, languages: Sequence[str], **options) -> DataFrame:
    """``(lang, word, vec)``: one space per language of ``docs(lang, tokens)``; the trainings share the cluster.

    A training reads its sentences twice, so they are stored first, a folder per language.
    """
    sentences = store(docs.filter(F.col("lang").isin(*languages)).select("lang", "tokens"), "sentences", ["lang"])
    sentences = sentences.filter(F.size("tokens") > 0)

    def train(lang: str) -> DataFrame:
        return train_word2vec(sentences.filter(F.col("lang") == lang), **options).withColumn("lang", F.lit(lang))

    with ThreadPoolExecutor(len(languages)) as pool:
        spaces = list(pool.map(train, languages))
    return reduce(DataFrame.unionByName, spaces)


def gram_cells(pairs: DataFrame, *, normalise: bool = True) -> DataFrame:
    """Cells ``(i, j, xx, xy)`` of XᵀX and XᵀY; each task sends one d × d partial sum."""
    x, y = F.col("x").cast("array<double>"), F.col("y").cast("array<double>")
    if normalise:
        x, y = l2_normalise(x), l2_normalise(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = xy = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            b = batch.column("y").flatten().to_numpy().reshape(batch.num_rows, -1)
            xx = a.T @ a if xx is None else xx + a.T @ a
            xy = a.T @ b if xy is None else xy + a.T @ b
        if xx is not None:
            d = xx.shape[0]
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(np.repeat(np.arange(d), d), pa.int32()),
                    "j": pa.array(np.tile(np.arange(d), d), pa.int32()),
                    "xx": xx.ravel(),
                    "xy": xy.ravel(),
                }
            )

    partial = pairs.select(x.alias("x"), y.alias("y")).mapInArrow(run, "i int, j int, xx double, xy double")
    return partial.groupBy("i", "j").agg(F.sum("xx").alias("xx"), F.sum("xy").alias("xy"))


def _matrices(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two d × d matrices; d is the vector width, a few hundred."""
    rows = cells.toPandas()
    d = int(rows["i"].max()) + 1
    xx, xy = np.zeros((d, d)), np.zeros((d, d))
    xx[rows["i"], rows["j"]] = rows["xx"]
    xy[rows["i"], rows["j"]] = rows["xy"]
    return xx, xy


def learn_translation_lstsq(pairs: DataFrame, *, normalise: bool = True) -> np.ndarray:
    """W minimising |XW − Y|², in closed form."""
    xx, xy = _matrices(gram_cells(pairs, normalise=normalise))
    return np.linalg.pinv(xx) @ xy


def learn_translation_procrustes(pairs: DataFrame, *, normalise: bool = True) -> np.ndarray:
    """Orthogonal W aligning X to Y, from the singular vectors of XᵀY."""
    _, xy = _matrices(gram_cells(pairs, normalise=normalise))
    u, _, vt = np.linalg.svd(xy)
    return u @ vt


def matrix_frame(spark, matrix: np.ndarray) -> DataFrame:
    """``(i, j, w)`` cells of a d × d matrix."""
    rows = [(i, j, float(w)) for i, line in enumerate(matrix) for j, w in enumerate(line)]
    return spark.createDataFrame(rows, "i int, j int, w double")


def apply_translation(vectors: DataFrame, matrix: np.ndarray, *, normalise: bool = True) -> DataFrame:
    """Row vectors times ``matrix``, unit length unless ``normalise`` is off."""
    matrix = np.asarray(matrix, dtype=np.float64)

    @F.pandas_udf("array<double>")
    def times(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.stack(vec.to_numpy()).astype(np.float64) @ matrix))

    moved = vectors.withColumn("vec", times("vec"))
    return moved.withColumn("vec", l2_normalise(F.col("vec"))) if normalise else moved


def concat_spaces(source: DataFrame, target: DataFrame) -> DataFrame:
    """One joint space: transformed source rows, then unit-length target rows."""
    unit = target.withColumn("vec", l2_normalise(F.col("vec")))
    return source.withColumn("part", F.lit(0)).unionByName(unit.withColumn("part", F.lit(1)))


# --- neighbours -------------------------------------------------------------------------


def _blocks(n_rows: int) -> int:
    """Blocks of ``BLOCK_ROWS`` rows up to ``MOST_BLOCKS``, then as many blocks of up to ``WIDE`` times these rows.

    Both sides of a key are copied for every block of the other, so their number decides how much is shuffled.
    """
    plain = max(1, math.ceil(n_rows / BLOCK_ROWS))
    return max(min(plain, MOST_BLOCKS), math.ceil(plain / WIDE))


def skip_own(scores: np.ndarray, ids: np.ndarray, names: np.ndarray) -> None:
    """Take a query out of its own row; ``names`` of the columns are sorted."""
    first, last = np.searchsorted(names, ids, "left"), np.searchsorted(names, ids, "right")
    for i in np.flatnonzero(first < last):
        scores[i, first[i] : last[i]] = -np.inf


def top_places(scores: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value, rounded to 12 digits, of the best ``top_n`` finite scores of every row, in their order.

    Ties go to the smaller column. Columns are dealt to lanes: the best ``top_n`` are no worse than the least of as many
    lanes' maxima, so only scores that reach it are rounded and ordered.
    """
    n = min(top_n, scores.shape[1])
    lanes = min(scores.shape[1], max(4 * n, 128))
    whole = scores.shape[1] // lanes * lanes
    maxima = scores[:, :whole].reshape(len(scores), -1, lanes).max(axis=1)
    least = np.partition(maxima, lanes - n, axis=1)[:, lanes - n]
    # Rounding may lift a score by less than this.
    row, column = np.nonzero(scores >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None])
    value = np.round(scores[row, column], 12)
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    kept = (np.arange(len(row)) - np.searchsorted(row, row) < n) & np.isfinite(value)
    return row[kept], column[kept], value[kept]


def _largest(rows: DataFrame, key: str) -> int:
    """Rows of the key that has most: blocks are dealt out inside every key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def nearest(
    queries: DataFrame,
    space: DataFrame,
    top_n: int,
    *,
    key: str = "model_id",
    metric: str = "cosine",
    offset: DataFrame | None = None,
    beta: float = 10.0,
    n_queries: int | None = None,
    n_space: int | None = None,
) -> DataFrame:
    """Best ``top_n`` rows of ``space`` for each query, exact.

    ``queries(key, query_id, vec)`` and ``space(key, item_id, vec)``, ids being strings. Both
    sides of a key are cut into hash blocks of about ``BLOCK_ROWS`` rows (``n_queries`` and ``n_space`` are
    the rows of the largest key, counted if not given); a task multiplies one block
    pair and keeps the best ``top_n`` per query, so no task sees a whole space and no pair of
    vectors becomes a row. ``metric``: ``cosine``, ``euclidean`` (nearest first, score is the
    negative distance) or ``softmax`` (exp(beta·cosine) over ``offset(key, item_id,
    denominator)``). Ties go to the smaller item id. Queries equal to an item id are skipped.
    """
    blocks_q = _blocks(_largest(queries, key) if n_queries is None else n_queries)
    blocks_s = _blocks(_largest(space, key) if n_space is None else n_space)
    vec = F.col("vec").cast("array<double>")
    unit = vec if metric == "euclidean" else l2_normalise(vec)

    def block(ids: str, n: int) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")

    def all_blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(
        F.col(key).alias(key), "query_id", unit.alias("vec"), block("query_id", blocks_q).alias("_q")
    ).withColumn("_s", all_blocks(blocks_s))
    items = space if offset is None else space.join(offset, [key, "item_id"])
    weight = F.lit(1.0) if offset is None else F.col("denominator")
    right = items.select(
        F.col(key).alias(key), "item_id", unit.alias("vec"), weight.alias("weight"), block("item_id", blocks_s).alias("_s")
    ).withColumn("_q", all_blocks(blocks_q))

    def best(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        columns = [key, "query_id", "item_id", "score"]
        if not len(q) or not len(s):
            return pd.DataFrame(columns=columns)
        a, b = np.stack(q["vec"].to_numpy()), np.stack(s["vec"].to_numpy())
        if metric == "euclidean":
            squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
            scores = -np.sqrt(np.maximum(squares, 0.0))
        else:
            scores = a @ b.T
            if metric == "softmax":
                scores = np.exp(beta * scores) / s["weight"].to_numpy()[None, :]
        names, ids = s["item_id"].to_numpy(), q["query_id"].to_numpy()
        skip_own(scores, ids, names)
        row, column, value = top_places(scores, top_n)
        return pd.DataFrame({key: q[key].to_numpy()[row], "query_id": ids[row], "item_id": names[column], "score": value})

    def in_parts(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        # Scores of some queries at a time, not of a whole block pair.
        n = max(1, min(QUERY_ROWS, QUERY_ROWS * BLOCK_ROWS // max(1, len(s))))
        s = s.sort_values("item_id", ignore_index=True)
        return pd.concat([best(q.iloc[i : i + n], s) for i in range(0, max(1, len(q)), n)])

    partial = (
        left.groupBy(key, "_q", "_s")
        .cogroup(right.groupBy(key, "_q", "_s"))
        .applyInPandas(in_parts, f"{key} string, query_id string, item_id string, score double")
    )
    rank = F.row_number().over(W.partitionBy(key, "query_id").orderBy(F.desc("score"), "item_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= top_n)


def softmax_denominators(
    samples: DataFrame,
    space: DataFrame,
    *,
    key: str = "model_id",
    beta: float = 10.0,
    n_samples: int | None = None,
    n_space: int | None = None,
) -> DataFrame:
    """Per target word: sum of exp(beta·cosine) over the sampled source vectors."""
    blocks_q = _blocks(samples.count() if n_samples is None else n_samples)
    blocks_s = _blocks(space.count() if n_space is None else n_space)
    unit = l2_normalise(F.col("vec").cast("array<double>")).alias("vec")
    left = samples.select(
        F.col(key).alias(key), unit, F.pmod(F.xxhash64("query_id"), F.lit(blocks_q)).cast("int").alias("_q")
    ).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(blocks_s - 1))))
    right = space.select(
        F.col(key).alias(key), "item_id", unit, F.pmod(F.xxhash64("item_id"), F.lit(blocks_s)).cast("int").alias("_s")
    ).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))

    def partial_sums(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame(columns=[key, "item_id", "part"])
        a, b = np.stack(q["vec"].to_numpy()), np.stack(s["vec"].to_numpy())
        sums = np.exp(beta * (b @ a.T)).sum(axis=1)
        return pd.DataFrame({key: s[key], "item_id": s["item_id"], "part": sums})

    return (
        left.groupBy(key, "_q", "_s")
        .cogroup(right.groupBy(key, "_q", "_s"))
        .applyInPandas(lambda q, s: partial_sums(q, s), f"{key} string, item_id string, part double")
        .groupBy(key, "item_id")
        .agg(F.sum("part").alias("denominator"))
    )


def translation_precision(
    test_pairs: DataFrame,
    neighbours: DataFrame,
    *,
    key: str = "model_id",
    cuts: Sequence[int] = (1, 5, 10, 30),
    exact_match: bool = False,
) -> DataFrame:
    """Precision at each cut over ``test_pairs(key, query_word, expected)``.

    A neighbour hits when it contains the expected word; every hit adds one, so the
    established score of a pair may exceed one. ``exact_match`` demands equality.
    """
    if exact_match:
        hit = F.col("neighbour") == F.col("expected")
    else:
        hit = F.col("neighbour").contains(F.col("expected"))
    # A pair that is listed several times is looked up once and counts as often as it is listed.
    pairs = test_pairs.groupBy(key, "query_word", "expected").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(neighbours, [key, "query_word"], "left")
    counts = joined.groupBy(key, "query_word", "expected", "n").agg(
        *[F.count_if(hit & (F.col("rank") <= c)).alias(f"p{c}") for c in cuts]
    )
    means = [(F.sum(F.col("n") * F.col(f"p{c}")) / F.sum("n")).alias(f"p_at_{c}") for c in cuts]
    return counts.groupBy(key).agg(F.sum("n").alias("n_pairs"), *means)


# --- language dimensions ----------------------------------------------------------------


def script_counts(vectors: DataFrame) -> DataFrame:
    """Words per script: ASCII words count as source, all others as target."""
    return vectors.groupBy(word_script_binary(F.col("word")).alias("script")).agg(
        F.count(F.lit(1)).alias("n_words")
    )


def _language_samples(vectors: DataFrame, is_target: Column) -> DataFrame:
    return vectors.select(
        array_to_vector(F.col("vec").cast("array<double>")).alias("features"),
        is_target.cast("double").alias("label"),
    )


def language_dim_coefficients(vectors: DataFrame, is_target: Column, *, c: float = 1.0) -> tuple[DataFrame, float]:
    """Coefficient per dimension of a logistic language classifier, and training accuracy."""
    samples = _language_samples(vectors, is_target)
    n = samples.count()
    model = LogisticRegression(regParam=1.0 / (c * n), standardization=False, tol=1e-6).fit(samples)
    coefs = [(i, float(v)) for i, v in enumerate(model.coefficients.toArray())]
    frame = vectors.sparkSession.createDataFrame(coefs, "dim int, coef double")
    return frame, float(model.summary.accuracy)


def language_dim_importance(vectors: DataFrame, is_target: Column, *, max_iter: int = 20, max_depth: int = 3, seed: int = 1) -> DataFrame:
    """Importance per dimension in boosted trees that tell the languages apart."""
    samples = _language_samples(vectors, is_target)
    model = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, seed=seed).fit(samples)
    values = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    return vectors.sparkSession.createDataFrame(values, "dim int, coef double")


def masked_dims(coefficients: DataFrame, removals: Sequence[int], *, two_sided: bool = True) -> DataFrame:
    """``(n_removed, dims)`` for each sweep value N: 2N positions.

    Two-sided takes the N lowest and N highest coefficients, otherwise the 2N largest. The
    input has one row per vector dimension.
    """
    low = F.row_number().over(W.orderBy("coef", "dim"))
    high = F.row_number().over(W.orderBy(F.desc("coef"), F.desc("dim")))
    ranked = coefficients.select("dim", low.alias("low"), high.alias("high"))
    sweep = F.array(*[F.lit(n) for n in removals])
    if two_sided:
        chosen = F.filter(sweep, lambda n: (F.col("low") <= n) | (F.col("high") <= n))
    else:
        chosen = F.filter(sweep, lambda n: F.col("high") <= 2 * n)
    return (
        ranked.select("dim", F.explode(chosen).alias("n_removed"))
        .groupBy("n_removed")
        .agg(F.sort_array(F.collect_set("dim")).alias("dims"))
    )


def removals_for_percent(dims: int, percents: Sequence[int]) -> list[int]:
    """N such that about ``percent`` of the dimensions remain after removing 2N."""
    return [int((dims - dims * (p / 100)) // 2) for p in percents]


def mask_language_dims(vectors: DataFrame, masks: DataFrame, removals: Sequence[int]) -> DataFrame:
    """Every masked space of the sweep: one copy of the vectors per value of ``removals``."""
    copies = vectors.withColumn("n_removed", F.explode(F.array(*[F.lit(n) for n in removals])))
    masked = copies.join(masks, "n_removed")
    return masked.withColumn("vec", drop_dims(F.col("vec"), F.col("dims"))).drop("dims")


# --- clusters ---------------------------------------------------------------------------


def cluster_words(vectors: DataFrame, *, words_per_cluster: int = 100, seed: int = 1, n_words: int | None = None):
    """K-means with one cluster per ``words_per_cluster`` words: assignments and centres."""
    n = vectors.count() if n_words is None else n_words
    k = max(2, n // words_per_cluster)
    features = vectors.withColumn("features", array_to_vector(l2_normalise(F.col("vec"))))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(features)
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    assigned = model.transform(features).drop("features")
    return assigned, vectors.sparkSession.createDataFrame(centres, "cluster int, vec array<double>")


def own_centre_nearest(words: DataFrame, centres: DataFrame, keep: Sequence[str], own: str = "own", slack: float = 1e-6) -> DataFrame:
    """``(keep…, near)``: whether no centre is nearer to ``vec`` than the one of the cluster ``own``, by squared distance.

    Centres, which come from the driver, go to every task; it multiplies some words with all of them at a time.
    """
    rows = centres.select("cluster", F.col("vec").cast("array<double>")).toPandas().sort_values("cluster")
    numbers, points = rows["cluster"].to_numpy(), np.array(rows["vec"].tolist(), np.float64)
    squares = (points * points).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), QUERY_ROWS):
                part = pdf.iloc[i : i + QUERY_ROWS]
                x = np.stack(part["vec"].to_numpy()).astype(np.float64)
                away = (x * x).sum(axis=1)[:, None] + squares[None, :] - 2 * (x @ points.T)
                at = np.searchsorted(numbers, part[own].to_numpy())
                yield part[list(keep)].assign(near=away[np.arange(len(part)), at] <= away.min(axis=1) + slack)

    words = words.select(*keep, own, F.col("vec").cast("array<double>").alias("vec"))
    return words.mapInPandas(run, T.StructType([words.schema[k] for k in keep] + [T.StructField("near", T.BooleanType())]))


def match_clusters(src_centres: DataFrame, tgt_centres: DataFrame, *, key: str = "model_id", metric: str = "euclidean") -> DataFrame:
    """Nearest target centre of every source centre; several may share one target."""
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    width = 9
    queries = src_centres.select(key, F.concat(F.lit("s"), F.lpad(F.col("cluster").cast("string"), width, "0")).alias("query_id"), "vec")
    space = tgt_centres.select(key, F.concat(F.lit("t"), F.lpad(F.col("cluster").cast("string"), width, "0")).alias("item_id"), "vec")
    found = nearest(queries, space, 1, key=key, metric=metric)
    distance = -F.col("score") if metric == "euclidean" else 1 - F.col("score")
    return found.select(
        key,
        F.substring("query_id", 2, width).cast("int").alias("src_cluster"),
        F.substring("item_id", 2, width).cast("int").alias("tgt_cluster"),
        distance.alias("distance"),
    )


def merged_cluster_dictionary(
    src_words: DataFrame, tgt_words: DataFrame, matches: DataFrame, key: str = "model_id"
) -> DataFrame:
    """Word lists of merged clusters as ``(key, concept_id, side, word)``.

    Matched target clusters come first in id order with all their source clusters, then
    source clusters nobody chose, then target clusters nobody chose.
    """
    pairs = matches.select(key, "src_cluster", "tgt_cluster")
    src_ids = src_words.select(key, F.col("cluster").alias("src_cluster")).distinct()
    tgt_ids = tgt_words.select(key, F.col("cluster").alias("tgt_cluster")).distinct()
    groups = (
        pairs.select(key, F.lit(0).alias("kind"), F.col("tgt_cluster").alias("cluster"))
        .distinct()
        .unionByName(
            src_ids.join(pairs, [key, "src_cluster"], "left_anti").select(
                key, F.lit(1).alias("kind"), F.col("src_cluster").alias("cluster")
            )
        )
        .unionByName(
            tgt_ids.join(pairs, [key, "tgt_cluster"], "left_anti").select(
                key, F.lit(2).alias("kind"), F.col("tgt_cluster").alias("cluster")
            )
        )
    )
    order = F.row_number().over(W.partitionBy(key).orderBy("kind", "cluster")) - 1
    numbered = groups.withColumn("concept_id", order.cast("long"))
    src_members = (
        pairs.select(key, F.lit(0).alias("kind"), F.col("tgt_cluster").alias("cluster"), "src_cluster")
        .join(numbered, [key, "kind", "cluster"])
        .select(key, "concept_id", "src_cluster")
        .unionByName(
            numbered.filter("kind = 1").select(key, "concept_id", F.col("cluster").alias("src_cluster"))
        )
    )
    tgt_members = numbered.filter("kind <> 1").select(key, "concept_id", F.col("cluster").alias("tgt_cluster"))
    src = src_words.withColumnRenamed("cluster", "src_cluster").join(src_members, [key, "src_cluster"])
    tgt = tgt_words.withColumnRenamed("cluster", "tgt_cluster").join(tgt_members, [key, "tgt_cluster"])
    return src.select(key, "concept_id", F.lit("src").alias("side"), "word").unionByName(
        tgt.select(key, "concept_id", F.lit("tgt").alias("side"), "word")
    )
