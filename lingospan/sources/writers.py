"""Writers of the file formats around topic-model experiments.

Each format is a ``format_*`` function that builds the lines and a ``write_*`` function that
stores them as ordered part files; reading the parts in name order gives the whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.functions.text import is_ascii
from lingospan.operators.matching import frequent_rows, lookup_join
from lingospan.storage import store


def write_lines(lines: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """A range-partitioned sort keeps the order across part files without a single writer."""
    lines.orderBy(*order).select(line).write.text(path)


def joined(tokens: str = "tokens") -> Column:
    return F.array_join(tokens, " ")


# --- corpora ----------------------------------------------------------------------------


def format_corpus(pairs: DataFrame) -> DataFrame:
    """``(pair_id, side, line)``: one document per line."""
    return pairs.select("pair_id", "side", joined().alias("line"))


def write_interleaved_corpus(pairs: DataFrame, path: str) -> None:
    """Side 0 then side 1 of every pair."""
    write_lines(format_corpus(pairs), path, ["pair_id", "side"])


def write_two_file_corpus(pairs: DataFrame, path: str) -> None:
    """One folder per language, same document order in each."""
    lines = pairs.select("lang", "pair_id", joined().alias("line"))
    ordered = lines.repartitionByRange("lang", "pair_id").sortWithinPartitions("lang", "pair_id")
    ordered.select("lang", "line").write.partitionBy("lang").text(path)


def format_polylingual_tsv(pairs: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", F.col("pair_id").cast("string"), F.upper("lang"), joined())
    return pairs.select("lang", "pair_id", line.alias("line"))


def write_polylingual_tsv(pairs: DataFrame, path: str) -> None:
    ordered = format_polylingual_tsv(pairs).repartitionByRange("lang", "pair_id").sortWithinPartitions("lang", "pair_id")
    ordered.select("lang", "line").write.partitionBy("lang").text(path)


# --- vectors ----------------------------------------------------------------------------


def vector_text(vec: Column, sep: str = " ", *, fixed: bool = True) -> Column:
    """Numbers with six decimals, or as they print."""
    text = (lambda x: F.format_string("%.6f", x.cast("double"))) if fixed else (lambda x: x.cast("string"))
    return F.array_join(F.transform(vec, text), sep)


def format_word_vectors(vectors: DataFrame, *, fixed: bool = True, word: Column | None = None) -> DataFrame:
    """``(idx, line)`` with ``word f1 … fd``."""
    name = F.col("word") if word is None else word
    line = F.concat_ws(" ", name, vector_text(F.col("vec"), fixed=fixed))
    return vectors.select("idx", line.alias("line"))


def vector_header(vectors: DataFrame) -> DataFrame:
    """One ``n d`` line that sorts before all vectors."""
    return vectors.agg(
        F.lit(-1).cast("long").alias("idx"),
        F.format_string("%d %d", F.count(F.lit(1)), F.max(F.size("vec"))).alias("line"),
    )


def write_word_vectors(vectors: DataFrame, path: str, *, header: bool = True, fixed: bool = True) -> None:
    lines = format_word_vectors(vectors, fixed=fixed)
    if header:
        lines = vector_header(vectors).unionByName(lines)
    write_lines(lines, path, ["idx"])


def format_lang_prefixed_vectors(vectors: DataFrame, other: str = "chi") -> DataFrame:
    """Words carry ``eng:`` when ASCII and ``other:`` when not."""
    prefix = F.when(is_ascii(F.col("word")), "eng:").otherwise(f"{other}:")
    return format_word_vectors(vectors, word=F.concat(prefix, F.col("word")))


def write_lang_prefixed_vectors(vectors: DataFrame, path: str, other: str = "chi") -> None:
    lines = vector_header(vectors).unionByName(format_lang_prefixed_vectors(vectors, other))
    write_lines(lines, path, ["idx"])


def format_projector(vectors: DataFrame) -> DataFrame:
    """``(idx, line, meta)``: tab-separated numbers and ``word TAB language``."""
    return vectors.select(
        "idx",
        vector_text(F.col("vec"), "\t", fixed=False).alias("line"),
        F.concat_ws("\t", "word", "lang").alias("meta"),
    )


def write_projector_tsv(vectors: DataFrame, vector_path: str, metadata_path: str) -> None:
    lines = format_projector(vectors)
    write_lines(lines, vector_path, ["idx"])
    title = vectors.sparkSession.createDataFrame([(-1, "word\tlanguage")], "idx long, meta string")
    write_lines(title.unionByName(lines.select("idx", "meta")), metadata_path, ["idx"], "meta")


# --- sparse counts, vocabularies, dictionaries ------------------------------------------


def format_sparse_counts(doc_terms: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """``total id:count …`` per document from ``(doc, terms array<struct<word_id, tf>>)``."""
    total = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + t["tf"])
    items = F.transform(
        F.sort_array("terms"),
        lambda t: F.concat_ws(":", t["word_id"].cast("string"), t["tf"].cast("string")),
    )
    return doc_terms.select(doc_key, F.concat_ws(" ", total.cast("string"), F.array_join(items, " ")).alias("line"))


def collect_terms(docs: DataFrame, bow: DataFrame, vocab: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """Encode words by vocabulary id and gather the terms of each document, empty ones too.

    With a column ``df`` of ``vocab`` as many of the words in most documents as may be broadcast are
    encoded where the documents are, and only the other words are joined by word.
    """
    none = F.array().cast("array<struct<word_id:bigint,tf:bigint>>")
    terms = F.collect_list(F.struct("word_id", "tf"))
    frequent, others = frequent_rows(store(vocab, "vocabulary"), "df") if "df" in vocab.columns else (vocab, None)
    if others is None:
        terms = lookup_join(bow, frequent.select("lang", "word", "word_id"), ["lang", "word"], doc_key).groupBy(doc_key).agg(terms.alias("terms"))
    else:
        met = bow.join(F.broadcast(frequent.select("lang", "word", "word_id")), ["lang", "word"], "left")
        known = F.when(F.col("word_id").isNotNull(), F.struct("word_id", "tf"))
        left = F.when(F.col("word_id").isNull(), F.struct("lang", "word", "tf"))
        parts = store(met.groupBy(doc_key).agg(F.collect_list(known).alias("terms"), F.collect_list(left).alias("_left")), "document-terms")
        coded = parts.select(doc_key, F.inline("_left")).join(others.select("lang", "word", "word_id"), ["lang", "word"])
        coded = coded.groupBy(doc_key).agg(terms.alias("_more"))
        terms = parts.join(coded, doc_key, "left").select(doc_key, F.concat("terms", F.coalesce("_more", none)).alias("terms"))
    return docs.select(doc_key).join(terms, doc_key, "left").withColumn("terms", F.coalesce("terms", none))


def write_sparse_counts(doc_terms: DataFrame, path: str, doc_key: str = "doc_id") -> None:
    write_lines(format_sparse_counts(doc_terms, doc_key), path, [doc_key])


def write_vocab(vocab: DataFrame, path: str) -> None:
    write_lines(vocab, path, ["word_id"], "word")


def format_mtm_bidict(bidict: DataFrame) -> DataFrame:
    """``src,tgt`` as ``0 TAB src TAB 1 TAB tgt``."""
    return bidict.select("seq", F.format_string("0\t%s\t1\t%s", "src_word", "tgt_word").alias("line"))


def write_mtm_bidict(bidict: DataFrame, path: str) -> None:
    write_lines(format_mtm_bidict(bidict), path, ["seq"])


# --- reports and models -----------------------------------------------------------------


def topic_word_report(topic_words: DataFrame, keys: Sequence[str], top_n: int) -> DataFrame:
    """One line per topic with its best words."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return (
        topic_words.filter(F.col("rank") <= top_n)
        .groupBy(*keys)
        .agg(F.array_join(F.transform(ordered, lambda x: x["word"]), " ").alias("words"))
    )


def doc_topic_report(pairs: DataFrame, theta: DataFrame, n_docs: int) -> DataFrame:
    """The first ``n_docs`` documents with language, tokens and weights.

    Documents count interleaved: ``2·pair_id + side``.
    """
    numbered = pairs.withColumn("doc_no", F.col("pair_id") * 2 + F.col("side"))
    first = numbered.filter(F.col("doc_no") < n_docs)
    return first.join(theta, "doc_id").select("doc_no", "lang", F.array_join("tokens", ", ").alias("words"), "theta")


def save_model_bundle(topic_words: DataFrame, src_theta: DataFrame, tgt_theta: DataFrame, path: str) -> None:
    """Topic words and both theta tables, each partitioned by model.

    Saving a model again replaces its partitions; other models stay.
    """
    for name, table in (("topic_words", topic_words), ("source_theta", src_theta), ("target_theta", tgt_theta)):
        saved = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        saved.partitionBy("model_id").parquet(f"{path}/{name}")


def load_model_bundle(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("topic_words", "source_theta", "target_theta"))
