"""Topic-model evaluation. Tables carry ``model_id``, so a sweep of models is one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.functions import measures
from lingospan.functions.text import is_ascii


def with_top_k(pair_counts: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Repeat every cell for each list length ``k`` that contains it."""
    lengths = F.array(*[F.lit(k) for k in ks])
    fitting = F.filter(lengths, lambda k: (F.col("i") <= k) & (F.col("j") <= k))
    return pair_counts.withColumn("k", F.explode(fitting))


def _pair_scores(pair_counts: DataFrame, n_docs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """In-vocabulary cross-language pairs; pairs that never meet stay, with n = 0."""
    pairs = with_top_k(pair_counts, ks).join(n_docs, "model_id")
    known = (F.col("i") > 0) & (F.col("j") > 0) & (F.col("df_src") > 0) & (F.col("df_tgt") > 0)
    return pairs.withColumn("known", known)


def coherence(pair_counts: DataFrame, n_docs: DataFrame, ks: Sequence[int], method: str) -> DataFrame:
    """Mean over topics of the mean over word pairs; ``method`` is ``umass`` or ``npmi``.

    A topic without an in-vocabulary pair has no score and is left out of the mean.
    """
    n, df_src, df_tgt = F.col("n"), F.col("df_src"), F.col("df_tgt")
    if method == "umass":
        score = measures.umass(n, df_tgt)
    elif method == "npmi":
        score = measures.npmi(n, df_tgt, df_src, F.col("n_docs"))
    else:
        raise ValueError(f"unknown coherence method {method!r}")
    per_topic = (
        _pair_scores(pair_counts, n_docs, ks)
        .groupBy("model_id", "k", "topic_id")
        .agg(F.avg(F.when(F.col("known"), score)).alias("topic_score"))
    )
    return per_topic.groupBy("model_id", "k").agg(F.avg("topic_score").alias(method))


def coherence_npmi_reference(pair_counts: DataFrame, n_docs: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Against an external corpus: mean over all pairs, deviation, vocabulary coverage."""
    score = measures.npmi_reference(F.col("n"), F.col("df_tgt"), F.col("df_src"), F.col("n_docs"))
    in_vocab_src = (F.col("i") > 0) & (F.col("j") == 0) & (F.col("n") > 0)
    in_vocab_tgt = (F.col("j") > 0) & (F.col("i") == 0) & (F.col("n") > 0)
    topics = F.col("n_topics") * F.col("k")
    return (
        _pair_scores(pair_counts, n_docs, ks)
        .withColumn("score", F.when(F.col("known"), score))
        .groupBy("model_id", "k")
        .agg(
            F.avg("score").alias("npmi"),
            F.stddev_pop("score").alias("npmi_std"),
            F.count_if(in_vocab_src).alias("found_src"),
            F.count_if(in_vocab_tgt).alias("found_tgt"),
            F.count_if((F.col("i") == 0) & (F.col("j") == 0)).alias("n_topics"),
        )
        .select(
            "model_id",
            "k",
            "npmi",
            "npmi_std",
            (F.col("found_src") / topics).alias("coverage_src"),
            (F.col("found_tgt") / topics).alias("coverage_tgt"),
        )
    )


def crosslingual_proportion(topic_words: DataFrame, top_n: int = 100, criterion: float = 0.7) -> DataFrame:
    """Share of topics whose top words are not dominated by one script."""
    ascii_share = F.count_if((F.col("rank") <= top_n) & is_ascii(F.col("word"))) / F.lit(top_n)
    topics = topic_words.groupBy("model_id", "topic_id").agg(ascii_share.alias("share"))
    single = F.count_if((F.col("share") <= F.lit(1 - criterion)) | (F.col("share") >= F.lit(criterion)))
    return topics.groupBy("model_id").agg((1 - single / F.count(F.lit(1))).alias("crosslingual_share"))


def _topic_lists(topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One row per model, side, k and topic with its ranked word array (at most k words)."""
    lengths = F.array(*[F.lit(k) for k in ks])
    rows = topic_words.filter(F.col("rank") <= max(ks)).withColumn(
        "k", F.explode(F.filter(lengths, lambda k: F.col("rank") <= k))
    )
    return rows.groupBy("model_id", "side", "k", "topic_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words")
    )


def _topic_pairs(topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Topic pairs i < j of one model: a few thousand rows of k words, joined on the model."""
    lists = _topic_lists(topic_words, ks)
    a = lists.select("model_id", "side", "k", F.col("topic_id").alias("a"), F.col("words").alias("wa"))
    b = lists.select("model_id", "side", "k", F.col("topic_id").alias("b"), F.col("words").alias("wb"))
    return a.join(b, ["model_id", "side", "k"]).filter(F.col("a") < F.col("b"))


def _diversity(pairs: DataFrame, similarity: Column) -> DataFrame:
    return pairs.groupBy("model_id", "k").agg(
        (1 - F.avg(similarity)).alias("diversity"), F.stddev_pop(similarity).alias("diversity_std")
    )


def topic_diversity_positional(topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One minus the mean share of positions holding the same word, over both sides."""
    same = F.size(F.filter(F.zip_with("wa", "wb", lambda x, y: x == y), lambda e: e))
    return _diversity(_topic_pairs(topic_words, ks), same / F.size("wa"))


def topic_diversity_jaccard(topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """One minus the mean set Jaccard of the top-k lists, over both sides."""
    jaccard = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return _diversity(_topic_pairs(topic_words, ks), jaccard)


def unique_word_proportion(topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Smallest share of words a topic does not share with a later topic, per side."""
    unique = F.size(F.array_except("wa", "wb"))
    return (
        _topic_pairs(topic_words, ks)
        .groupBy("model_id", "side", "k")
        .agg(F.min(unique).alias("fewest"))
        .select("model_id", "side", "k", (F.col("fewest") / F.col("k")).alias("unique_share"))
    )


def crosslingual_topics(topic_words: DataFrame) -> DataFrame:
    """Topics with at least one word on both sides."""
    return (
        topic_words.groupBy("model_id", "topic_id")
        .agg(F.count_distinct("side").alias("n_sides"))
        .filter("n_sides = 2")
        .select("model_id", "topic_id")
    )


def theta_divergence(pairs: DataFrame, theta: DataFrame, *, skip_first: bool = False) -> DataFrame:
    """Per pair: Jensen-Shannon divergence of the two sides' topic weights."""
    if skip_first:
        pairs = pairs.filter(F.col("pair_id") > 0)
    src = theta.select("model_id", F.col("doc_id").alias("src_doc"), F.col("theta").alias("p"))
    tgt = theta.select("model_id", F.col("doc_id").alias("tgt_doc"), F.col("theta").alias("q"))
    return (
        pairs.join(src, ["model_id", "src_doc"])
        .join(tgt, ["model_id", "tgt_doc"])
        .select("model_id", "pair_id", measures.jensen_shannon(F.col("p"), F.col("q")).alias("jsd"))
    )


def theta_jsd(pairs: DataFrame, theta: DataFrame, *, skip_first: bool = False) -> DataFrame:
    """Similarity of paired documents: one minus the mean divergence, and its deviation."""
    return (
        theta_divergence(pairs, theta, skip_first=skip_first)
        .groupBy("model_id")
        .agg((1 - F.avg("jsd")).alias("similarity"), F.stddev_pop("jsd").alias("jsd_std"))
    )


def theta_jsd_by_position(src: DataFrame, tgt: DataFrame, skip_first: bool = False) -> DataFrame:
    """As ``theta_jsd``, of two files whose n-th lines belong together: ``(model_id, lang_seq, theta)`` each."""
    p = src.select("model_id", "lang_seq", F.col("theta").alias("p")).filter(F.col("lang_seq") >= int(skip_first))
    pairs = p.join(tgt.select("model_id", "lang_seq", F.col("theta").alias("q")), ["model_id", "lang_seq"])
    jsd = pairs.select("model_id", measures.jensen_shannon(F.col("p"), F.col("q")).alias("jsd"))
    return jsd.groupBy("model_id").agg((1 - F.avg("jsd")).alias("similarity"), F.stddev_pop("jsd").alias("jsd_std"))


def theta_jsd_joint(theta: DataFrame) -> DataFrame:
    """As ``theta_jsd``, of one matrix ``(model_id, row, theta)``, the target rows behind as many source rows."""
    half = theta.groupBy("model_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))
    rows = theta.join(half, "model_id")
    src = rows.filter(F.col("row") < F.col("_half")).withColumnRenamed("row", "lang_seq")
    tgt = rows.filter(F.col("row") >= F.col("_half")).withColumn("lang_seq", F.col("row") - F.col("_half"))
    return theta_jsd_by_position(src, tgt)


def theta_jsd_cells(pairs: DataFrame, theta: DataFrame) -> DataFrame:
    """As ``theta_jsd``, of weights in long form: ``theta(model_id, side, doc_id, cluster_id, weight)``.

    A topic that a document has no row of weighs nothing there; pairs of which a document has no
    row at all are left out.
    """
    keys = ["model_id", "pair_id", "cluster_id"]
    sides = []
    for side in ("src", "tgt"):
        own = theta.filter(F.col("side") == side).select("model_id", F.col("doc_id").alias(f"{side}_doc"), "cluster_id", F.col("weight").alias(side))
        sides.append(pairs.select("model_id", "pair_id", f"{side}_doc").join(own, ["model_id", f"{side}_doc"]).select(*keys, side))
    cells = sides[0].join(sides[1], keys, "full_outer").fillna(0.0, ["src", "tgt"])
    middle = (F.col("src") + F.col("tgt")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0) / 2
    whole = cells.groupBy("model_id", "pair_id").agg(F.sum(part("src") + part("tgt")).alias("jsd"), F.sum("src").alias("p"), F.sum("tgt").alias("q"))
    known = whole.filter((F.col("p") > 0) & (F.col("q") > 0))
    return known.groupBy("model_id").agg((1 - F.avg("jsd")).alias("similarity"), F.stddev_pop("jsd").alias("jsd_std"))


def mean_and_pop_stddev(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def feature_split(corpus: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """Source-language train and dev rows and target-language test rows, marked ``part``."""
    part = (
        F.when((F.col("data_type") == "train") & (F.col("lang") == src_lang), "train")
        .when((F.col("data_type") == "dev") & (F.col("lang") == src_lang), "dev")
        .when((F.col("data_type") == "test") & (F.col("lang") == tgt_lang), "test")
    )
    return corpus.withColumn("part", part).filter(F.col("part").isNotNull())


def accuracy_report(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dev_acc`` and ``test_acc`` of ``(…keys, part, label, prediction)``."""

    def share(part: str) -> Column:
        hit = (F.col("label") == F.col("prediction")).cast("double")
        return F.avg(F.when(F.col("part") == part, hit))

    return predictions.groupBy(*keys).agg(share("dev").alias("dev_acc"), share("test").alias("test_acc"))


def evaluation_grid(pair_counts: DataFrame, n_docs: DataFrame, topic_words: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Coherence and diversity of every model and list length in one table."""
    keys = ["model_id", "k"]
    return (
        coherence(pair_counts, n_docs, ks, "umass")
        .join(coherence(pair_counts, n_docs, ks, "npmi"), keys)
        .join(topic_diversity_positional(topic_words, ks), keys)
    )
