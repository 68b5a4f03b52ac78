"""From documents to tokens, bags of words and vocabularies.

A document is one row, so everything that concerns one document (tokens, term counts,
distinct terms) is computed inside the row; only vocabulary-level results are shuffled,
after a map-side partial aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lingospan.functions import text as tx
from lingospan.functions.vectors import let
from lingospan.operators.sequence import count_key, number_by_word, number_rows, word_key


def with_tokens(documents: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Add the array of letter tokens; the text itself is not carried further."""
    return documents.withColumn(out, tx.letter_tokens(F.col(text_col))).drop(text_col)


def segment_with(
    documents: DataFrame, segmenter: Callable[[str], Sequence[str]], text_col: str = "text"
) -> DataFrame:
    """Hook for a caller's own segmenter (per-language libraries), Arrow batches per task."""
    schema = documents.drop(text_col).schema.add("tokens", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [list(segmenter(t)) if t is not None else [] for t in batch[text_col]]
            yield batch.drop(columns=text_col).assign(tokens=tokens)

    return documents.mapInPandas(run, schema)


def unnest(docs: DataFrame, keep: Sequence[str], words: Column) -> DataFrame:
    """One row ``(…keep, word)`` per element.

    For a plain ``explode`` the optimizer adds a test that the array is not empty and moves
    it below the projection, where the tokeniser then runs once more per test. The outer
    form adds no test; its placeholder row for an empty array is dropped here.
    """
    return docs.select(*keep, F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())


def explode_tokens(docs: DataFrame, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One row per token with its 0-based position."""
    rows = docs.select(*keep, F.posexplode_outer(tokens).alias("pos", "word"))
    return rows.filter(F.col("word").isNotNull())


def only_if(value: Column, condition: Callable[[Column], Column]) -> Column:
    """Generator that yields ``value`` when it meets ``condition``.

    A filter on a computed column is moved below the projection and computes it twice.
    """
    return F.explode(F.filter(F.array(value), condition))


def term_counts(tokens: Column) -> Column:
    """Array of ``(word, tf)`` of one document: sort, then measure the runs."""

    def runs(words: Column) -> Column:
        last = F.size(words) - 1
        starts = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, n: F.struct(
                    F.get(words, at).alias("word"),
                    (F.coalesce(F.get(s, n + 1), F.size(words)) - at).cast("long").alias("tf"),
                ),
            ),
        )

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))


def term_positions(tokens: Column) -> Column:
    """Array of ``(word, positions)`` of one document."""

    def runs(items: Column) -> Column:
        last = F.size(items) - 1
        starts = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0) | (F.get(items, i)["word"] != F.get(items, i - 1)["word"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, n: F.struct(
                    F.get(items, at)["word"].alias("word"),
                    F.transform(
                        F.slice(items, at + 1, F.coalesce(F.get(s, n + 1), F.size(items)) - at),
                        lambda item: item["pos"],
                    ).alias("positions"),
                ),
            ),
        )

    placed = F.transform(tokens, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    return F.when(F.size(tokens) > 0, let(F.sort_array(placed), runs))


def tokens_from_positions(terms: Column) -> Column:
    """Inverse of ``term_positions`` after some of the terms were dropped or renamed."""
    placed = F.flatten(
        F.transform(
            terms,
            lambda t: F.transform(
                t["positions"], lambda p: F.struct(p.alias("pos"), t["word"].alias("word"))
            ),
        )
    )
    return F.transform(F.sort_array(placed), lambda item: item["word"])


def bag_of_words(docs: DataFrame, keep: Sequence[str] = ("doc_id", "lang"), tokens: str = "tokens") -> DataFrame:
    """``(…keep, word, tf)`` without a shuffle."""
    return docs.select(*keep, F.inline(term_counts(F.col(tokens))))


def distinct_terms(docs: DataFrame, keep: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One row per document and distinct word, without a shuffle."""
    return unnest(docs, keep, F.array_distinct(tokens))


def document_frequency(docs: DataFrame, keys: Sequence[str] = ("lang",), tokens: str = "tokens") -> DataFrame:
    """Documents containing each word."""
    return distinct_terms(docs, keys, tokens).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))


def word_counts(bow: DataFrame, keys: Sequence[str] = ("lang",)) -> DataFrame:
    """Corpus frequency and document frequency of each word."""
    return bow.groupBy(*keys, "word").agg(
        F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")
    )


def corpus_frequency(docs: DataFrame, keys: Sequence[str] = ("lang",), tokens: str = "tokens") -> DataFrame:
    """Corpus frequency alone, counted in each task before the shuffle."""
    return unnest(docs, keys, F.col(tokens)).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cf"))


def vocabulary(docs: DataFrame, keys: Sequence[str] = ("lang",), tokens: str = "tokens") -> DataFrame:
    """Distinct words."""
    return distinct_terms(docs, keys, tokens).distinct()


def count_vectorizer_vocab(docs: DataFrame, keys: Sequence[str] = ("lang",), tokens: str = "tokens", with_df: bool = False) -> DataFrame:
    """Vocabulary with 0-based ids in alphabetical order; ``with_df`` adds the documents of each word."""
    words = document_frequency(docs, keys, tokens) if with_df else vocabulary(docs, keys, tokens)
    return number_by_word(words, keys, out="word_id")


def vocab_count_export(counts: DataFrame, more_than: int = 100) -> DataFrame:
    """Words counted more often than ``more_than``, most frequent first."""
    return counts.filter(F.col("cf") > more_than).orderBy(F.desc("cf"), "lang", "word")


def rank_by_count(counts: DataFrame, keys: Sequence[str] = ("lang",), out: str = "r") -> DataFrame:
    """0-based rank by descending count, ties in word order."""
    split = count_key(F.col("cf"), word_key(F.col("word"), 6))
    return number_rows(counts, keys, [F.desc("cf"), F.col("word")], split, out=out)


def word_frequency_rank(docs: DataFrame, keys: Sequence[str] = ("lang",), tokens: str = "tokens") -> DataFrame:
    """0-based rank by descending count, ties by first appearance in document order."""
    seen = docs.select(*keys, "doc_id", F.inline(term_positions(F.col(tokens)))).select(
        *keys, "doc_id", "word", F.size("positions").alias("tf"), F.get("positions", F.lit(0)).alias("pos")
    )
    counts = seen.groupBy(*keys, "word").agg(
        F.sum("tf").alias("cf"), F.min("doc_id").alias("first_doc"), F.min_by("pos", "doc_id").alias("first_pos")
    )
    order = [F.desc("cf"), F.col("first_doc"), F.col("first_pos")]
    split = count_key(F.col("cf"), F.shiftright("first_doc", 15))
    return number_rows(counts, keys, order, split, out="freq_rank").select(*keys, "word", "cf", "freq_rank")


def corpus_descriptive(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Per language: documents, distinct words, mean tokens (an empty line counts as one)."""
    lengths = docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg(F.greatest(F.size(tokens), F.lit(1))).alias("mean_tokens"),
    )
    empty = F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(F.col(tokens))
    types = (
        unnest(docs, ["lang"], F.array_distinct(empty))
        .distinct()
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_types"))
    )
    return lengths.join(types, "lang").select("lang", "n_docs", "n_types", "mean_tokens")


def class_index(labelled: DataFrame, class_col: str = "class") -> DataFrame:
    """0-based index of each class in sorted order (a handful of classes)."""
    classes = labelled.select(class_col).distinct()
    order = F.row_number().over(W.orderBy(class_col)) - 1
    return classes.withColumn("class_id", order.cast("long"))
