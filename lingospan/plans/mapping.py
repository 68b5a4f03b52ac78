"""The topic-mapping flow: monolingual topics to cross-lingual clusters with weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.operators import cooccurrence, gibbs, metrics, topics
from lingospan.storage import store


def topic_mapping_flow(
    phi: DataFrame, theta: DataFrame, vectors: DataFrame, *, top_p: int, n_clusters: int, top_n: int, space: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(topic_map, topic_words, theta)`` for every model at once.

    A topic none of whose representative words has a vector is in no cluster
    (``topics.topics_without_centroid``).

    ``phi(model_id, side, topic_id, lang, word, weight)``, ``theta(model_id, side, doc_id,
    topic_id, weight)``, ``vectors(lang, word, vec)``. Representative words, centroids,
    complete-linkage clusters, then summed word and document weights.
    """
    keys = ["model_id", "side", "topic_id"]
    representatives = topics.top_words_per_topic(phi, keys, top_p)
    centroids = topics.topic_centroids(representatives, vectors, keys, top_p, space)
    topic_map = store(topics.cluster_topics_crosslingual(centroids, n_clusters), "topic-map")
    merged = topics.merge_topic_words(phi, topic_map, top_n)
    return topic_map, merged, topics.merge_theta(theta, topic_map)


def topic_sweep(
    docs: DataFrame, sides: DataFrame, vectors: DataFrame, n_topics: Sequence[int], *, top_p: int = 10, top_n: int = 50, **options
) -> tuple[DataFrame, DataFrame]:
    """``(topic_words, theta)`` of cross-lingual topics for every cell of a grid, in one plan.

    ``docs(doc_id, lang, tokens)`` are modelled by language and number of topics in one training.
    ``sides(pair_model, lang, side)`` says which languages make up a model, and ``vectors(dims, lang, word,
    vec)`` holds a vector space per number of dimensions. A cell is named ``pair_model/topics/dims``; its
    topics of both sides are grouped into as many clusters as a side has topics. Word and document
    weights of a cluster are sums over its topics. ``theta(model_id, pair_model, n_topics, dims, side,
    doc_id, cluster_id, weight)``, ``topic_words(model_id, …, side, cluster_id, lang, word, weight, rank)``.
    """
    sizes = F.explode(F.array(*[F.lit(t) for t in n_topics])).alias("n_topics")
    phi, theta, _ = gibbs.lda_gibbs(docs.select("doc_id", "lang", "tokens", sizes), "n_topics", ["lang", "n_topics"], **options)
    phi, theta = store(phi, "sweep-phi"), store(theta, "sweep-theta")
    dims = vectors.select("dims").distinct()
    cell = F.concat_ws("/", "pair_model", "n_topics", "dims").alias("model_id")

    def cells(df: DataFrame, *columns: str) -> DataFrame:
        """Rows of a language repeated for every cell it takes part in: a few copies, as many as the grid has."""
        spread = df.join(F.broadcast(sides), "lang").join(F.broadcast(dims))
        return spread.select(cell, "pair_model", "n_topics", "dims", "side", "lang", *columns)

    topic_id = F.col("topic_id").cast("string").alias("topic_id")
    first = topics.top_words_per_topic(phi, ["lang", "n_topics", "topic_id"], top_p)
    keys = ["model_id", "n_topics", "side", "topic_id"]
    representatives = topics.top_words_per_topic(cells(first, topic_id, "word", "weight"), keys, top_p)
    centroids = topics.topic_centroids(representatives, vectors, [*keys, "dims"], top_p, ["dims"])
    topic_map = store(topics.cluster_topics_by_size(centroids), "sweep-map")
    # All words are merged. Dealt by word they are repeated for the cells where their sums are formed.
    words = cells(phi.repartition("lang", "word"), topic_id, "word", "weight")
    merged = topics.merge_topic_words(words, F.broadcast(topic_map), top_n)
    weights = theta.select("doc_id", "lang", "n_topics", F.posexplode("theta").alias("topic_id", "weight"))
    weights = cells(weights, "doc_id", topic_id, "weight")
    named = cells(first).select("model_id", "pair_model", "n_topics", "dims").distinct()
    merged_theta = topics.merge_theta(weights, F.broadcast(topic_map)).join(named, "model_id")
    return merged.join(named, "model_id"), merged_theta


def sweep_scores(topic_words: DataFrame, theta: DataFrame, pairs: DataFrame, docs: DataFrame, members: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Coherence, diversity and similarity of paired documents of every cell and list length.

    All topic scores are of the same topics, those with words on both sides. ``pairs(pair_model, pair_id, src_doc,
    tgt_doc)``, ``docs(doc_id, lang, tokens)``, ``members(pair_model, pair_id, doc_id)``.
    """
    rows = topic_words.withColumnRenamed("cluster_id", "topic_id")
    rows = store(rows.join(metrics.crosslingual_topics(rows), ["model_id", "topic_id"], "left_semi"), "sweep-topics")
    cells = store(topic_words.select("model_id", "pair_model", "n_topics", "dims").distinct(), "sweep-cells")
    members = members.join(cells.select("pair_model", "model_id"), "pair_model")
    listed = rows.select("model_id", "side", "topic_id", "lang", "word", "rank")
    counts = store(cooccurrence.topic_pair_counts(docs, listed, max(ks), members=members), "sweep-counts")
    n_docs = pairs.groupBy("pair_model").agg(F.count(F.lit(1)).alias("n_docs")).join(cells, "pair_model").select("model_id", "n_docs")
    grid = metrics.evaluation_grid(counts, n_docs, rows, ks)
    unique = metrics.unique_word_proportion(rows, ks).groupBy("model_id", "k").agg(F.min("unique_share").alias("unique_share"))
    similar = metrics.theta_jsd_cells(pairs.join(cells.select("pair_model", "model_id"), "pair_model"), theta)
    lengths = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    every = cells.select("*", lengths)
    scored = every.join(grid, ["model_id", "k"], "left").join(unique, ["model_id", "k"], "left").join(similar, "model_id", "left")
    return scored.drop("model_id")


def save_models(rows: DataFrame, path: str) -> None:
    """Write rows by model; models that are written again replace their own folder and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id").parquet(path)
