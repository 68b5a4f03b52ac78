"""Topic models: training, top words, centroids, cross-lingual clusters, merged weights."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.functions.text import is_ascii, word_script
from lingospan.functions.vectors import l1_normalise
from lingospan.operators.matching import frequent_rows
from lingospan.operators.tokens import document_frequency
from lingospan.storage import store


def top_words_per_topic(phi: DataFrame, keys: Sequence[str], top_n: int) -> DataFrame:
    """Ranked words of every topic; Spark cuts each task's rows to ``top_n`` before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("weight"), "word"))
    return phi.withColumn("rank", rank).filter(F.col("rank") <= top_n)


def split_topics_by_language(
    topic_words: DataFrame, keys: Sequence[str], *, binary: bool = False
) -> DataFrame:
    """Two ranked lists out of one mixed ranked list, order kept.

    Default: ASCII words are ``en``, words with a Han character ``cn``, others are dropped.
    ``binary`` sends every non-ASCII word to the other language.
    """
    script = (
        F.when(is_ascii(F.col("word")), "en").otherwise("other") if binary else word_script(F.col("word"))
    )
    split = topic_words.withColumn("side", script).filter(F.col("side").isNotNull())
    rank = F.row_number().over(W.partitionBy(*keys, "side").orderBy("rank"))
    return split.withColumn("rank", rank)


def split_concept_topics(
    topic_words: DataFrame, concepts: DataFrame, keys: Sequence[str], src_lang: str, by: Sequence[str] = ()
) -> DataFrame:
    """Per-language ranked lists of a concept model: a concept gives a word to both sides.

    ``by`` names the keys of models with concepts of their own, which both tables have.
    """
    named = concepts.select(*by, F.col("concept").alias("word"), "concept", "src_word", "tgt_word")
    joined = topic_words.join(named, [*by, "word"], "left")
    own_lang = F.substring_index("word", ":", 1)
    own_word = F.substring(F.col("word"), F.length(own_lang) + 2, F.length("word"))
    own_side = F.when(own_lang == src_lang, "src").otherwise("tgt")
    members = F.when(
        F.col("concept").isNotNull(),
        F.array(
            F.struct(F.lit("src").alias("side"), F.col("src_word").alias("w")),
            F.struct(F.lit("tgt").alias("side"), F.col("tgt_word").alias("w")),
        ),
    ).otherwise(F.array(F.struct(own_side.alias("side"), own_word.alias("w"))))
    rows = joined.select(*keys, "rank", F.explode(members).alias("m")).select(*keys, "rank", "m.side", F.col("m.w").alias("word"))
    rank = F.row_number().over(W.partitionBy(*keys, "side").orderBy("rank"))
    return rows.withColumn("rank", rank)


def topic_centroids(
    topic_words: DataFrame, vectors: DataFrame, keys: Sequence[str], top_p: int, space: Sequence[str] = ()
) -> DataFrame:
    """Mean vector of each topic's top words; words without a vector are left out.

    ``space`` names the keys of several vector spaces, which both tables have.
    """
    by = [*space, "lang", "word"]
    chosen = topic_words.filter(F.col("rank") <= top_p).join(vectors.select(*by, "vec"), by)
    cells = chosen.select(*keys, F.posexplode("vec").alias("dim", "x"))
    means = cells.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda c: c["x"]).alias("vec"))


def linkage_merges(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges of complete linkage by cosine distance: pairs of points of the merged clusters, and distances.

    A chain of nearest neighbours is followed until two clusters are nearest to each other; these
    can be merged whatever else there is. Distances from one cluster to all others are computed
    when the chain gets there, so memory grows with the points and not with their square.
    """
    norms = np.linalg.norm(points, axis=1, keepdims=True)
    unit = points / np.where(norms == 0, 1.0, norms)
    n = len(unit)
    label = np.arange(n)
    members: dict[int, np.ndarray] = {i: np.array([i]) for i in range(n)}

    def distances(cluster: int) -> np.ndarray:
        """Largest distance to any member, by cluster number; infinite for itself and numbers not in use."""
        own, far = members[cluster], np.full(n, -np.inf)
        for at in range(0, len(own), 256):
            far = np.maximum(far, (1.0 - unit @ unit[own[at : at + 256]].T).max(axis=1))
        out = np.full(n, -np.inf)
        np.maximum.at(out, label, far)
        out[cluster] = np.inf
        return np.where(out == -np.inf, np.inf, out)

    pairs, heights, chain = [], [], []
    while len(members) > 1:
        if not chain:
            chain.append(next(iter(members)))
        away = distances(chain[-1])
        nearest = int(np.argmin(away))
        # Of equally near clusters the one the chain came from, or the chain could go round.
        if len(chain) > 1 and away[chain[-2]] <= away[nearest]:
            nearest = chain[-2]
        if len(chain) < 2 or nearest != chain[-2]:
            chain.append(nearest)
            continue
        a, b = sorted((chain.pop(), chain.pop()))
        pairs.append((a, b))
        heights.append(away[nearest])
        members[a] = np.concatenate([members[a], members.pop(b)])
        label[members[a]] = a
    return np.array(pairs, np.int64).reshape(-1, 2), np.array(heights)


def complete_linkage(points: np.ndarray, n_clusters: int) -> np.ndarray:
    """Labels of complete-linkage clustering by cosine distance, numbered by first member."""
    pairs, heights = linkage_merges(points)
    parent = np.arange(len(points))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs[np.argsort(heights, kind="stable")[: max(0, len(points) - n_clusters)]]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return np.unique([root(i) for i in range(len(points))], return_inverse=True)[1]


def cluster_topics_crosslingual(centroids: DataFrame, n_clusters: int) -> DataFrame:
    """Group the topics of both sides of each model: ``(model_id, side, topic_id, cluster_id)``.

    A model has twice as many points as topics, so one model is one small group and a sweep
    of models runs in parallel.
    """

    def cluster(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["side", "topic_id"], ignore_index=True)
        vectors = np.stack(points["vec"].to_numpy()).astype(np.float64)
        labels = complete_linkage(vectors, min(n_clusters, len(points)))
        return points[["model_id", "side", "topic_id"]].assign(cluster_id=labels)

    return centroids.groupBy("model_id").applyInPandas(
        cluster, "model_id string, side string, topic_id string, cluster_id int"
    )


def cluster_topics_by_size(centroids: DataFrame) -> DataFrame:
    """As ``cluster_topics_crosslingual``, with as many clusters as a model's own ``n_topics``."""

    def cluster(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["side", "topic_id"], ignore_index=True)
        vectors = np.stack(points["vec"].to_numpy()).astype(np.float64)
        labels = complete_linkage(vectors, min(int(points["n_topics"].iloc[0]), len(points)))
        return points[["model_id", "side", "topic_id"]].assign(cluster_id=labels)

    return centroids.groupBy("model_id").applyInPandas(
        cluster, "model_id string, side string, topic_id string, cluster_id int"
    )


def topics_without_centroid(topic_words: DataFrame, centroids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Topics none of whose top words has a vector: they can be in no cluster."""
    return topic_words.select(*keys).distinct().join(centroids.select(*keys), list(keys), "left_anti")


def merge_topic_words(phi: DataFrame, topic_map: DataFrame, top_n: int) -> DataFrame:
    """Word weights summed over the member topics of each cluster, best ``top_n`` per side."""
    keys = ["model_id", "cluster_id", "side"]
    summed = (
        phi.join(topic_map, ["model_id", "side", "topic_id"])
        .groupBy(*keys, "lang", "word")
        .agg(F.sum("weight").alias("weight"))
    )
    return top_words_per_topic(summed, keys, top_n)


def merge_theta(theta: DataFrame, topic_map: DataFrame) -> DataFrame:
    """Document weight of a cluster: the sum over its member topics (long form)."""
    return (
        theta.join(topic_map, ["model_id", "side", "topic_id"])
        .groupBy("model_id", "side", "doc_id", "cluster_id")
        .agg(F.sum("weight").alias("weight"))
    )


def theta_from_phi(
    docs: DataFrame,
    bow: DataFrame,
    phi: DataFrame,
    topics: Sequence[str],
    keys: Sequence[str] = (),
    doc_columns: Sequence[str] = ("doc_id", "lang"),
) -> DataFrame:
    """Dense document-topic weights: counts times word-topic weights.

    One row per row of ``docs(keys…, doc_columns…)``; a document without any known word has
    zeros. ``phi`` becomes one row per word holding its weights. As many of the heaviest words as may be
    broadcast meet the tokens where these are; a document leaves with its sums and its other words, which
    alone are joined by word.
    """
    weights = [
        F.coalesce(F.sum(F.when(F.col("topic_id") == t, F.col("weight"))), F.lit(0.0)).alias(f"_w{n}")
        for n, t in enumerate(topics)
    ]
    wide = store(phi.groupBy(*keys, "lang", "word").agg(*weights, F.sum("weight").alias("_all")), "word-weights")
    columns, by = [f"_w{n}" for n in range(len(topics))], [*keys, *doc_columns]
    heavy, light = frequent_rows(wide, "_all")
    sums = [F.sum(F.col("tf") * F.col(c)).alias(c) for c in columns]
    if light is None:
        totals = bow.join(F.broadcast(heavy.drop("_all")), [*keys, "lang", "word"]).groupBy(*by).agg(*sums)
    else:
        met = bow.join(F.broadcast(heavy.withColumn("_met", F.lit(True))), [*keys, "lang", "word"], "left")
        other = [F.when(F.col("_met").isNull(), F.col(c)).alias(f"_{c}") for c in ("lang", "word")]
        parts = store(met.groupBy(*by, *other).agg(*sums, F.sum("tf").alias("_tf")), "weight-parts")
        words = light.withColumnsRenamed({"lang": "_lang", "word": "_word"})
        rest = parts.filter(F.col("_word").isNotNull()).select(*by, "_lang", "_word", F.col("_tf").alias("tf"))
        rest = rest.join(words, [*keys, "_lang", "_word"]).groupBy(*by).agg(*sums)
        both = parts.filter(F.col("_word").isNull()).select(*by, *columns).unionByName(rest)
        totals = both.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
    totals = totals.select(*by, F.array(*columns).cast("array<double>").alias("theta"))
    zeros = F.array_repeat(F.lit(0.0), len(topics))
    every = docs.select(*by).join(totals, by, "left")
    return every.withColumn("theta", F.coalesce("theta", zeros))


def normalise_theta(theta: DataFrame) -> DataFrame:
    return theta.withColumn("theta", l1_normalise(F.col("theta")))


def align_topics_by_rho(rho: DataFrame, key: str = "model_id") -> DataFrame:
    """Target topic of the largest link weight for each source topic; ties to the lower id."""
    best = F.max_by("tgt_topic", F.struct("w", -F.col("tgt_topic")))
    return rho.groupBy(key, "src_topic").agg(best.alias("tgt_topic"))


def map_theta_by_rho(theta: DataFrame, rho: DataFrame, key: str = "model_id") -> DataFrame:
    """Target document weights in source topics: rho times theta (long form).

    ``theta(key, doc_id, tgt_topic, weight)``.
    """
    return (
        theta.join(rho, [key, "tgt_topic"])
        .groupBy(key, "doc_id", "src_topic")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("weight"))
    )


def fit_lda(
    docs: DataFrame,
    n_topics: int,
    *,
    alpha_sum: float = 0.1,
    max_iter: int = 20,
    min_df: int = 1,
    vocab_size: int | None = None,
    seed: int = 1,
    doc_columns: Sequence[str] = ("doc_id",),
    tokens: str = "tokens",
) -> tuple[DataFrame, DataFrame]:
    """Online variational LDA: ``phi(topic_id, word, weight)`` and ``theta(doc…, theta)``.

    ``alpha_sum`` is the Dirichlet mass over all topics. The vocabulary is every word in at
    least ``min_df`` documents, or with ``vocab_size`` the most frequent of them; it and phi
    pass the driver, as in Spark ML.
    """
    frequency = document_frequency(docs, [], tokens).filter(F.col("df") >= min_df)
    # Ties in word order: the seeded start of the training depends on the word ids.
    ranked = frequency.orderBy(F.desc("df"), "word")
    words = [r.word for r in (ranked if vocab_size is None else ranked.limit(vocab_size)).collect()]
    vectoriser = CountVectorizerModel.from_vocabulary(words, inputCol=tokens, outputCol="_counts")
    counted = vectoriser.transform(docs.select(*doc_columns, tokens)).drop(tokens)
    # Every iteration reads the counts again, so they are written once.
    counted = store(counted.sortWithinPartitions(*doc_columns), "word-counts")
    lda = LDA(
        k=n_topics,
        maxIter=max_iter,
        optimizer="online",
        docConcentration=[alpha_sum / n_topics] * n_topics,
        seed=seed,
        featuresCol="_counts",
        topicDistributionCol="_theta",
        subsamplingRate=1.0,
    )
    model = lda.fit(counted)
    spark = docs.sparkSession
    described = model.describeTopics(len(words)).select(
        F.col("topic").alias("topic_id"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")
    )
    vocab = spark.createDataFrame(list(enumerate(words)), "word_id int, word string")
    phi = described.select("topic_id", F.col("t.termIndices").alias("word_id"), F.col("t.termWeights").alias("weight"))
    theta = model.transform(counted).select(*doc_columns, vector_to_array("_theta").alias("theta"))
    return phi.join(vocab, "word_id").drop("word_id"), theta


def lda_per_language(docs: DataFrame, languages: Sequence[str], n_topics: int, **options) -> tuple[DataFrame, DataFrame]:
    """One model per language; the trainings share the cluster."""

    def train(lang: str) -> tuple[DataFrame, DataFrame]:
        phi, theta = fit_lda(docs.filter(F.col("lang") == lang), n_topics, **options)
        return phi.withColumn("lang", F.lit(lang)), theta.withColumn("lang", F.lit(lang))

    with ThreadPoolExecutor(len(languages)) as pool:
        models = list(pool.map(train, languages))
    phis, thetas = zip(*models)
    return reduce(DataFrame.unionByName, phis), reduce(DataFrame.unionByName, thetas)


def lda_polylingual(pair_docs: DataFrame, n_topics: int, **options) -> tuple[DataFrame, DataFrame]:
    """Paired documents share one theta; phi is renormalised inside each language.

    ``pair_docs(pair_id, lang, tokens)``. An approximation of a tuple-level sampler: both
    sides are one bag of language-prefixed words.
    """
    prefixed = F.transform("tokens", lambda t: F.concat(F.col("lang"), F.lit(":"), t))
    bags = (
        pair_docs.select("pair_id", prefixed.alias("side"))
        .groupBy("pair_id")
        .agg(F.flatten(F.collect_list("side")).alias("tokens"))
    )
    phi, theta = fit_lda(bags, n_topics, doc_columns=["pair_id"], **options)
    split = phi.withColumn("lang", F.substring_index("word", ":", 1)).withColumn(
        "word", F.expr("substring(word, length(substring_index(word, ':', 1)) + 2)")
    )
    total = split.groupBy("topic_id", "lang").agg(F.sum("weight").alias("_total"))
    scaled = split.join(total, ["topic_id", "lang"]).withColumn("weight", F.col("weight") / F.col("_total"))
    return scaled.drop("_total"), theta


def model_grid(models: DataFrame, **grids: Sequence) -> DataFrame:
    """Every combination of model and parameter values, as rows instead of a loop."""
    for name, values in grids.items():
        models = models.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return models
