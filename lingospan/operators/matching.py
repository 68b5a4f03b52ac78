"""Vocabulary, dictionary and document joins.

Joins of vocabulary-size tables carry no hint; Catalyst and adaptive execution choose. Joins
of a token table go through ``lookup_join``, which checks the size of the other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.functions.text import is_ascii
from lingospan.operators.sequence import number_by_id
from lingospan.operators.tokens import distinct_terms, term_positions, tokens_from_positions
from lingospan.storage import store

BROADCAST_BYTES = 64 << 20
#: A Python worker holds words as Arrow columns, which take so many times less than rows and their hash table.
ARROW_SHARE = 2
PIECE_TOKENS = 1 << 18
SPREAD = 16


def table_bytes(table: DataFrame, header: int = 16) -> int:
    """About how many bytes a table takes in memory, a string or array with ``header`` bytes besides its content."""
    size = F.lit(0).cast("long")
    for field in table.schema:
        if isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + header
        elif isinstance(field.dataType, T.ArrayType):
            size = size + 8 * F.greatest(F.size(field.name), F.lit(0)) + header
        else:
            size = size + 8
    return table.agg(F.sum(size)).first()[0] or 0


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], by: str, how: str = "inner") -> DataFrame:
    """Join token rows to a table with one row per word.

    The small side is stored and measured. Up to ``BROADCAST_BYTES`` it is broadcast, so
    the tokens stay where they are. Beyond that both sides are shuffled, every key of ``big``
    split in ``SPREAD`` parts by a hash of ``by``: a word that fills a third of the rows then
    reaches many tasks, which the adaptive skew join may split further.
    """
    table = store(small, "lookup")
    if table_bytes(table) <= BROADCAST_BYTES:
        return big.join(F.broadcast(table), list(keys), how)
    part = F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    joined = big.withColumn("_part", part).join(table.withColumn("_part", copies), [*keys, "_part"], how)
    return joined.drop("_part")


def frequent_rows(table: DataFrame, weight: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the highest weights, as many as may be broadcast, and all others (None without any)."""
    size = table_bytes(table)
    if size <= BROADCAST_BYTES:
        return table, None
    share = 1 - max(0, BROADCAST_BYTES) / size
    least = table.agg(F.percentile_approx(weight, F.lit(share), F.lit(10_000))).first()[0]
    frequent = F.coalesce(F.col(weight) > F.lit(least), F.lit(False))
    return table.filter(frequent), table.filter(~frequent)


def tag_split_labels(documents: DataFrame, index_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach ``data_type`` to the documents an index line ``sub_corpus-file_name`` names.

    The second frame holds index lines that do not consist of two parts.
    """
    parts = F.split("entry", "-")
    good = F.coalesce(F.size(parts) == 2, F.lit(False))
    index = index_lines.filter(good).select(parts[0].alias("sub_corpus"), parts[1].alias("file_name"), "data_type")
    return documents.join(index, ["sub_corpus", "file_name"]), index_lines.filter(~good)


def _regroup(terms: DataFrame, doc_columns: Sequence[str], tokens: str) -> DataFrame:
    grouped = terms.groupBy(*doc_columns).agg(F.collect_list(F.struct("word", "positions")).alias("_terms"))
    return grouped.select(*doc_columns, tokens_from_positions(F.col("_terms")).alias(tokens))


def _words_by_key(table: DataFrame, keys: Sequence[str]) -> dict[tuple, pa.Table] | None:
    """The rows ``(keys…, word, …)`` of a table by key, or None if they are too many to send around.

    They are sent as Arrow columns without the keys, so that is what is measured.
    """
    if table_bytes(table.drop(*keys), 4) > ARROW_SHARE * BROADCAST_BYTES:
        return None
    rows = table.toArrow()
    if not keys:
        return {(): rows.combine_chunks()}
    found = {}
    for key in rows.select(list(keys)).group_by(list(keys)).aggregate([]).to_pylist():
        chosen = pa.array(np.ones(len(rows), bool))
        for name, value in key.items():
            chosen = pc.and_(chosen, pc.equal(rows[name], value))
        found[tuple(key.values())] = rows.filter(chosen).drop_columns(list(keys)).combine_chunks()
    return found


def _places(words: pa.Array, table: pa.Table) -> pa.Array:
    """First row of ``table`` with each of some distinct words; null without one.

    The words are few beside the table, so they are hashed and the table is looked up.
    """
    at = np.full(len(words), -1, np.int64)
    found = pc.index_in(table["word"].combine_chunks(), value_set=words, skip_nulls=True)
    row = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))[::-1]
    at[found.take(pa.array(row)).to_numpy(zero_copy_only=False)] = row
    return pa.array(at, mask=at < 0)


def _mapped_tokens(
    docs: DataFrame,
    known: dict[tuple, pa.Table],
    keys: Sequence[str],
    doc_columns: Sequence[str],
    tokens: str,
    change: Callable[[pa.Array, pa.Array, tuple, pa.Table], pa.Array],
) -> DataFrame:
    """Documents with changed tokens, whole Arrow columns at a time where the documents are.

    ``change(words, places, key, table)`` gets the distinct words of a batch and their places in the words of
    a key (null: not there); null results are dropped. Documents of other keys lose all tokens. Words are
    looked up once a batch; documents are then put together ``PIECE_TOKENS`` at a time.
    """
    docs = docs.select(*dict.fromkeys([*doc_columns, *keys]), tokens)
    schema = docs.select(*doc_columns, tokens).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[tokens]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            words, index = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            key_of, named = np.full(batch.num_rows, -1, np.int64), [pa.array([], pa.string())]
            for n, (key, table) in enumerate(known.items()):
                chosen = pa.array(np.ones(batch.num_rows, bool))
                for name, value in zip(keys, key, strict=True):
                    chosen = pc.and_(chosen, pc.equal(batch[name], value))
                key_of[pc.fill_null(chosen, False).to_numpy(zero_copy_only=False)] = n
                named.append(change(words, _places(words, table), key, table).cast(pa.string()))
            named = pa.concat_arrays(named)
            stays = named.is_valid().to_numpy(zero_copy_only=False)
            first = 0
            while first < batch.num_rows:
                begin = ends[first] - sizes[first]
                last = max(first + 1, int(np.searchsorted(ends, begin + PIECE_TOKENS, side="right")))
                own = index[begin : ends[last - 1]].astype(np.int64)
                row = np.repeat(np.arange(last - first), sizes[first:last])
                key = key_of[first:last][row]
                known_key = np.flatnonzero((key >= 0) & (own >= 0))
                at = key[known_key] * len(words) + own[known_key]
                kept = stays[at]
                counts = np.bincount(row[known_key[kept]], minlength=last - first)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                changed = pa.ListArray.from_arrays(offsets, named.take(pa.array(at[kept])))
                piece = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*(piece[c] for c in doc_columns), changed], [*doc_columns, tokens])
                first = last

    return docs.mapInArrow(run, schema)


def filter_tokens_to_vocab(
    docs: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("lang",),
    doc_columns: Sequence[str] = ("doc_id", "lang"),
    tokens: str = "tokens",
    keep_empty: bool = False,
) -> DataFrame:
    """Only tokens found in ``vocab`` stay, in order; documents left empty are dropped or kept empty.

    A vocabulary of up to twice ``BROADCAST_BYTES`` is looked up where the documents are. Beyond that, rows
    are distinct words with their positions, so the join sees each word once per document and
    the regrouping moves one row per document.
    """
    words = store(vocab.select(*keys, "word").dropna().distinct(), "vocabulary")
    known = _words_by_key(words, keys)
    if known is not None:
        kept = _mapped_tokens(docs, known, keys, doc_columns, tokens, lambda own, place, key, table: pc.if_else(place.is_valid(), own, None))
        return kept if keep_empty else kept.filter(F.size(tokens) > 0)
    terms = docs.select(*doc_columns, F.inline(term_positions(F.col(tokens))))
    kept = _regroup(lookup_join(terms, words, [*keys, "word"], doc_columns[0], "left_semi"), doc_columns, tokens)
    if not keep_empty:
        return kept
    empty = F.array().cast("array<string>")
    return docs.select(*doc_columns).join(kept, list(doc_columns), "left").withColumn(tokens, F.coalesce(tokens, empty))


def missing_words(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct corpus words absent from the vectors of every language."""
    words = distinct_terms(docs, [], tokens).distinct()
    return words.join(vocab.select("word"), "word", "left_anti").withColumn("ascii", is_ascii(F.col("word")))


def missing_word_report(missing: DataFrame) -> DataFrame:
    return missing.agg(
        F.count(F.lit(1)).alias("n_missing"), F.count_if("ascii").alias("n_missing_ascii")
    )


def remove_missing_words(
    docs: DataFrame,
    vocab: DataFrame,
    doc_columns: Sequence[str] = ("doc_id", "lang"),
    tokens: str = "tokens",
) -> DataFrame:
    """Drop words no language has a vector for; documents left empty stay, empty."""
    return filter_tokens_to_vocab(docs, vocab, [], doc_columns, tokens, keep_empty=True)


def select_word_space(vectors: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Vectors of words that occur in the corpus."""
    words = distinct_terms(docs, ["lang"], tokens).distinct()
    return vectors.join(words, ["lang", "word"], "left_semi")


def bidict_in_vocab(bidict: DataFrame, src_vocab: DataFrame, tgt_vocab: DataFrame) -> DataFrame:
    """Pairs whose two words exist in the two vocabularies."""
    src = src_vocab.select(F.col("word").alias("src_word")).distinct()
    tgt = tgt_vocab.select(F.col("word").alias("tgt_word")).distinct()
    return bidict.join(src, "src_word", "left_semi").join(tgt, "tgt_word", "left_semi")


def bidict_encoded(bidict: DataFrame, src_vocab: DataFrame, tgt_vocab: DataFrame) -> DataFrame:
    """Pairs as vocabulary ids; the source word is lower-cased, the target word is not."""
    src = src_vocab.select(F.col("word").alias("src_word"), F.col("word_id").alias("src_id"))
    tgt = tgt_vocab.select(F.col("word").alias("tgt_word"), F.col("word_id").alias("tgt_id"))
    lowered = bidict.withColumn("src_word", F.lower("src_word"))
    return lowered.join(src, "src_word").join(tgt, "tgt_word")


def words_not_in_pairs(vocab: DataFrame, bidict: DataFrame, side: str = "src_word") -> DataFrame:
    return vocab.join(bidict.select(F.col(side).alias("word")), "word", "left_anti")


def training_pair_vectors(bidict: DataFrame, src_vectors: DataFrame, tgt_vectors: DataFrame) -> DataFrame:
    """``(seq, src_word, tgt_word, x, y)``; duplicate pairs are kept."""
    src = src_vectors.select(F.col("word").alias("src_word"), F.col("vec").alias("x"))
    tgt = tgt_vectors.select(F.col("word").alias("tgt_word"), F.col("vec").alias("y"))
    return bidict.join(src, "src_word").join(tgt, "tgt_word")


def dedupe_bidict(bidict: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One target per source word (the last) and one source per target word (the first).

    Target words are lower-cased; a source word keeps the position of its first line.
    """
    last = bidict.groupBy(*keys, "src_word").agg(
        F.lower(F.max_by("tgt_word", "seq")).alias("tgt_word"), F.min("seq").alias("seq")
    )
    return last.groupBy(*keys, "tgt_word").agg(
        F.min_by("src_word", "seq").alias("src_word"), F.min("seq").alias("seq")
    )


def pair_documents(src: DataFrame, tgt: DataFrame, doc_num: int | None = None, key: str = "pair_id") -> DataFrame:
    """Pairs with both sides non-empty, the first ``doc_num`` of them by pair id."""
    left = src.filter(F.size("tokens") > 0).select(key, F.col("tokens").alias("src_tokens"))
    right = tgt.filter(F.size("tokens") > 0).select(key, F.col("tokens").alias("tgt_tokens"))
    pairs = left.join(right, key)
    return pairs if doc_num is None else pairs.orderBy(key).limit(doc_num)


def attach_theta(corpus_index: DataFrame, theta: DataFrame, *, joint_offset: Column | None = None) -> DataFrame:
    """Join documents to theta rows by position in their language file.

    Joint models store one matrix, source rows first: pass the number of source rows and
    ``theta(row, theta)``; otherwise ``theta(lang, lang_seq, theta)``.
    """
    if joint_offset is None:
        return corpus_index.join(theta, ["lang", "lang_seq"])
    row = F.col("lang_seq") + F.when(F.col("is_source"), F.lit(0)).otherwise(joint_offset)
    return corpus_index.withColumn("row", row.cast("long")).join(theta, "row")


def dict_pairs_in_topics(topic_words: DataFrame, bidict: DataFrame, keys: Sequence[str], top_n: int = 50) -> DataFrame:
    """Per topic: dictionary pairs with both words in the top N of their side, over N."""
    top = topic_words.filter(F.col("rank") <= top_n)
    topics = topic_words.select(*keys, "topic_id").distinct()
    src = top.filter("side = 'src'").select(*keys, "topic_id", F.col("word").alias("src_word")).distinct()
    tgt = top.filter("side = 'tgt'").select(*keys, "topic_id", F.col("word").alias("tgt_word")).distinct()
    hits = (
        bidict.join(src, [*keys, "src_word"])
        .join(tgt, [*keys, "topic_id", "tgt_word"])
        .groupBy(*keys, "topic_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.coalesce(F.col("n"), F.lit(0)) / F.lit(top_n)
    return topics.join(hits, [*keys, "topic_id"], "left").select(*keys, "topic_id", share.alias("proportion"))


def concept_corpus(
    docs: DataFrame,
    bidict: DataFrame,
    src_lang: str,
    tgt_lang: str,
    doc_columns: Sequence[str] = ("doc_id", "lang"),
    tokens: str = "tokens",
) -> DataFrame:
    """Replace dictionary words of both languages by shared concepts ``seq``.

    Expects one pair per word (``dedupe_bidict``). Other words become ``lang:word``.
    """
    names = bidict.select(F.lit(src_lang).alias("lang"), F.col("src_word").alias("word"), "seq").unionByName(
        bidict.select(F.lit(tgt_lang).alias("lang"), F.col("tgt_word").alias("word"), "seq")
    )
    docs = docs.filter(F.col("lang").isin(src_lang, tgt_lang))
    names = store(names, "concepts")
    known = _words_by_key(names, ["lang"])
    if known is not None:

        def renamed(own: pa.Array, place: pa.Array, key: tuple, table: pa.Table) -> pa.Array:
            number = table["seq"].combine_chunks().take(place).cast(pa.string())
            return pc.coalesce(pc.binary_join_element_wise("#", number, ""), pc.binary_join_element_wise(key[0], own, ":"))

        blank = pa.table({"word": pa.array([], pa.string()), "seq": pa.array([], pa.int64())})
        known = {(lang,): known.get((lang,), blank) for lang in (src_lang, tgt_lang)}
        return _mapped_tokens(docs, known, ["lang"], doc_columns, tokens, renamed).filter(F.size(tokens) > 0)
    terms = docs.select(*doc_columns, F.inline(term_positions(F.col(tokens))))
    own = F.concat_ws(":", "lang", "word")
    concept = F.concat(F.lit("#"), F.col("seq").cast("string"))
    named = lookup_join(terms, names, ["lang", "word"], doc_columns[0], "left").withColumn("word", F.coalesce(concept, own))
    return _regroup(named.drop("seq"), doc_columns, tokens)


def corpus_pairs(documents: DataFrame, src_lang: str) -> DataFrame:
    """Pair the n-th source document with the n-th document of every other language."""
    numbered = number_by_id(documents.select("doc_id", "lang"), ["lang"], "doc_id", out="pair_id", scan=True)
    src = numbered.filter(F.col("lang") == src_lang).select("pair_id", F.col("doc_id").alias("src_doc"))
    tgt = numbered.filter(F.col("lang") != src_lang).select(
        "pair_id", F.col("lang").alias("model_id"), F.col("doc_id").alias("tgt_doc")
    )
    return tgt.join(src, "pair_id").select("model_id", "pair_id", "src_doc", "tgt_doc")
