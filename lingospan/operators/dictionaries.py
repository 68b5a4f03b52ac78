"""Dictionary coverage, splitting and nested corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.operators.sequence import number_by_id, number_rows


def dictionary_ranks(bidict: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs found in both vocabularies with the mean of the two frequency ranks.

    ``ranks(…keys, side, word, freq_rank)``.
    """
    src = ranks.filter("side = 'src'").select(*keys, F.col("word").alias("src_word"), F.col("freq_rank").alias("r_src"))
    tgt = ranks.filter("side = 'tgt'").select(*keys, F.col("word").alias("tgt_word"), F.col("freq_rank").alias("r_tgt"))
    return (
        bidict.join(src, [*keys, "src_word"])
        .join(tgt, [*keys, "tgt_word"])
        .withColumn("avg_rank", (F.col("r_src") + F.col("r_tgt")) / 2)
    )


def dictionary_rank_coverage(
    bidict: DataFrame,
    ranks: DataFrame,
    keys: Sequence[str],
    *,
    positions: tuple[int, int] | None = None,
    max_avg_rank: float | None = None,
) -> DataFrame:
    """Pairs kept, and their mean rank over the size of the larger vocabulary.

    ``positions`` is a half-open slice of the matched pairs in dictionary order.
    """
    matched = dictionary_ranks(bidict, ranks, keys)
    if max_avg_rank is not None:
        matched = matched.filter(F.col("avg_rank") < max_avg_rank)
    if positions is not None:
        matched = number_by_id(matched, keys, "seq", out="_at")
        matched = matched.filter(F.col("_at").between(positions[0], positions[1] - 1))
    sizes = ranks.groupBy(*keys, "side").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy(*keys).agg(F.max("n").alias("larger_vocab"))
    return (
        matched.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("avg_rank").alias("mean_rank"))
        .join(largest, list(keys))
        .select(*keys, "n_pairs", (F.col("mean_rank") / F.col("larger_vocab")).alias("rank_coverage"))
    )


def dictionary_coverage(bidict_in_vocab: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct source words covered over all words that have a vector."""
    covered = bidict_in_vocab.groupBy(*keys).agg(F.count_distinct("src_word").alias("n_covered"))
    total = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_words"))
    return covered.join(total, list(keys)).withColumn("coverage", F.col("n_covered") / F.col("n_words"))


def split_dictionary(
    bidict: DataFrame, keys: Sequence[str] = (), ratio: float = 0.1, *, strict_count: bool = False
) -> DataFrame:
    """Mark pairs ``train`` or ``test`` in dictionary order.

    The established rule keeps one pair more than the fraction says; ``strict_count``
    gives the exact fraction.
    """
    numbered = number_by_id(bidict, keys, "seq", out="_at")
    total = F.count(F.lit(1)).alias("_n")
    if keys:
        joined = numbered.join(bidict.groupBy(*keys).agg(total), list(keys))
    else:
        joined = numbered.withColumn("_n", bidict.agg(total).scalar())
    kept = (F.col("_n") * F.lit(1 - ratio)).cast("int") + (0 if strict_count else 1)
    part = F.when(F.col("_at") < kept, "train").otherwise("test")
    return joined.withColumn("part", part).drop("_at", "_n")


def seeded_digest(seed: int, key: Column) -> Column:
    """Order key of a seeded permutation; the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def shuffle_corpus(docs: DataFrame, seed: int, doc_key: str = "doc_id") -> DataFrame:
    """Seeded permutation: ``shuffled_seq`` overall and ``lang_seq`` per language."""
    digest = docs.withColumn("_digest", seeded_digest(seed, F.col(doc_key)))
    order = [F.col("_digest"), F.col(doc_key)]
    split = F.conv(F.substring("_digest", 1, 14), 16, 10).cast("long")
    n_rows = docs.count()
    overall = number_rows(digest, [], order, split, out="shuffled_seq", scan=True, n_rows=n_rows)
    both = number_rows(overall, ["lang"], order, split, out="lang_seq", scan=True, n_rows=n_rows)
    return both.drop("_digest")


def sample_vectors(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    digest = seeded_digest(seed, F.concat_ws(":", "lang", "word"))
    return vectors.withColumn("_digest", digest).orderBy("_digest").limit(n).drop("_digest")


def nested_size_corpora(pairs: DataFrame, sizes: Sequence[int], seq: str = "pair_seq") -> DataFrame:
    """Every corpus size in one pass: a pair appears once per size it belongs to."""
    ladder = F.array(*[F.lit(s).cast("long") for s in sizes])
    fitting = F.filter(ladder, lambda s: F.col(seq) < s)
    return pairs.withColumn("corpus_size", F.explode(fitting))
