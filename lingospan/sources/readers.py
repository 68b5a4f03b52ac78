"""Readers of the file formats around topic-model experiments.

``parse_*`` functions take numbered lines ``(line_no, line)``, optionally with key columns, so
the same rules serve files, tables and streams. ``read_*`` functions add the file scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.functions.text import is_ascii
from lingospan.operators.sequence import number_by_id
from lingospan.sources.lines import read_lines

# The topic code list of a news item and the codes that count as a class.
TOPIC_CODE_CLASS = "bip:topics:1.0"
CLASS_CODES = ("CCAT", "ECAT", "GCAT", "MCAT")
# Line formats of topic files and training logs.
TOPIC_LINE = r"Topic\d+:\s(.*)"
TOPIC_BREAK = "-"
ITEM_SEPARATOR = "   "
PERPLEXITY_LINE = r"(-*\d+\.\d+) per-word .* (\d+\.\d+) perplexity"


def _split(sep: str) -> Column:
    return F.split("line", sep, -1)


# --- labelled documents -----------------------------------------------------------------


def parse_labelled_tsv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``class TAB content`` lines; the second frame holds lines of any other arity."""
    fields = _split("\t")
    good = F.size(fields) == 2
    rows = lines.filter(good).select("line_no", fields[0].alias("class"), fields[1].alias("content"))
    return rows, lines.filter(~good).select("line_no", "line")


def read_labelled_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_labelled_tsv(read_lines(spark, path))


def parse_news_xml(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """News items ``(sub_corpus, file_name, xml)`` to ``(sub_corpus, file_name, class, content)``.

    An item is accepted with exactly one class code and a text in every paragraph; anything
    else, malformed XML included, goes to the second frame.
    """
    xml = F.col("xml")
    parsed = F.from_xml(xml, F.lit("_corrupt_record string"), {"mode": "PERMISSIVE"})
    checked = files.withColumn(
        "well_formed", xml.isNotNull() & parsed["_corrupt_record"].isNull()
    )

    def found(path: str) -> Column:
        return F.when(F.col("well_formed"), F.xpath(xml, F.lit(path)))

    codes = found(f'//codes[@class="{TOPIC_CODE_CLASS}"]/code/@code')
    classes = F.filter(codes, lambda c: c.isin(*CLASS_CODES))
    n_paragraphs = F.when(F.col("well_formed"), F.xpath_int(xml, F.lit("count(//p)")))
    item = F.struct(
        classes.alias("classes"),
        found("//p/node()[1][self::text()]").alias("paragraphs"),
        n_paragraphs.alias("n_paragraphs"),
    )
    # Behind a generator the paths are evaluated once, however the item is tested below.
    rows = checked.select("sub_corpus", "file_name", F.explode(F.array(item)).alias("item"))
    good = F.coalesce(
        (F.size("item.classes") == 1) & (F.size("item.paragraphs") == F.col("item.n_paragraphs")), F.lit(False)
    )
    accepted = rows.filter(good).select(
        "sub_corpus",
        "file_name",
        F.col("item.classes")[0].alias("class"),
        F.array_join("item.paragraphs", " ").alias("content"),
    )
    return accepted, rows.filter(~good).select("sub_corpus", "file_name")


def read_news_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All ``<sub_corpus>/<file_name>.xml`` files below ``path``, one file per row."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.xml")
        .text(path, wholetext=True)
        .select(F.col("value").alias("xml"), F.split(F.col("_metadata.file_path"), "/").alias("parts"))
    )
    named = files.select(
        "xml",
        F.element_at("parts", -2).alias("sub_corpus"),
        F.regexp_replace(F.element_at("parts", -1), r"\.xml$", "").alias("file_name"),
    )
    return parse_news_xml(named)


# --- vectors and dictionaries -----------------------------------------------------------


def parse_word_vectors(lines: DataFrame, max_vocab_size: int | None = None) -> DataFrame:
    """``(idx, word, vec)`` from ``n d`` and ``word f1 … fd`` lines.

    Of a repeated word the later row stands. All words are read unless ``max_vocab_size``
    asks for the first so many distinct ones.
    """
    fields = _split(" ")
    header = (F.col("line_no") == 0) & (F.size(fields) == 2)
    rows = lines.filter(~header).select(
        (F.col("line_no") - 1).alias("idx"),
        fields[0].alias("word"),
        F.slice(fields, 2, F.size(fields)).alias("parts"),
    )
    numbers = F.transform(F.filter("parts", lambda x: x != ""), lambda x: x.cast("float"))
    if max_vocab_size is not None:
        first_seen = rows.groupBy("word").agg(F.min("idx").alias("first"))
        kept = first_seen.orderBy("first").limit(max_vocab_size)
        # Reading stops at the word that fills the limit, so a repeat further down is not seen.
        full = F.count(F.lit(1)) >= max_vocab_size
        end = kept.agg(F.when(full, F.max("first")).otherwise(F.lit((1 << 63) - 1)).alias("end")).scalar()
        rows = rows.filter(F.col("idx") <= end)
    return rows.groupBy("word").agg(F.max("idx").alias("idx"), F.max_by(numbers, "idx").alias("vec"))


def read_word_vectors(spark: SparkSession, path: str, max_vocab_size: int | None = None) -> DataFrame:
    return parse_word_vectors(read_lines(spark, path), max_vocab_size)


def parse_bidict(
    lines: DataFrame, sep: str = " ", *, reverse: bool = False, lower_english: bool = False, columns: tuple[int, int] = (0, 1)
) -> DataFrame:
    """``(seq, src_word, tgt_word)``; ``reverse`` swaps the sides of the file.

    ``lower_english`` lower-cases words made of ASCII characters.
    """
    fields = F.split("line", f"[{sep}]", -1)
    src, tgt = F.get(fields, F.lit(columns[0])), F.get(fields, F.lit(columns[1]))
    if reverse:
        src, tgt = tgt, src
    if lower_english:
        src, tgt = (F.when(is_ascii(w), F.lower(w)).otherwise(w) for w in (src, tgt))
    pairs = lines.select(F.col("line_no").alias("seq"), src.alias("src_word"), tgt.alias("tgt_word"))
    return pairs.filter(F.col("src_word").isNotNull() & F.col("tgt_word").isNotNull())


def read_bidict(spark: SparkSession, path: str, sep: str = " ", **options) -> DataFrame:
    return parse_bidict(read_lines(spark, path), sep, **options)


# --- topic words ------------------------------------------------------------------------


def parse_topics_lftm(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``Topic<n>: w1 w2 …`` lines to ``(topic_id, rank, word)``; topics in file order."""
    topics = lines.filter(F.col("line").rlike(TOPIC_LINE)).withColumn(
        "words", F.split(F.regexp_extract("line", TOPIC_LINE, 1), " ", -1)
    )
    numbered = number_by_id(topics, keys, "line_no", out="topic_id")
    return _ranked(numbered, keys)


def _ranked(topics: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return topics.select(*keys, "topic_id", *extra, F.posexplode("words").alias("_pos", "word")).select(
        *keys, "topic_id", *extra, (F.col("_pos") + 1).alias("rank"), "word"
    )


def parse_topics_csv_dash(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """CSV rows with the word first; a ``-`` row starts the next topic.

    A topic list is a small file, one group per ``keys``.
    """
    word = F.from_csv("line", F.lit("w string"))["w"]
    rows = lines.withColumn("word", word)
    order = W.partitionBy(*keys).orderBy("line_no")
    topic = F.sum(F.when(F.col("word") == TOPIC_BREAK, 1).otherwise(0)).over(order)
    words = rows.withColumn("topic_id", topic.cast("long")).filter(F.col("word") != TOPIC_BREAK)
    rank = F.row_number().over(W.partitionBy(*keys, "topic_id").orderBy("line_no"))
    return words.select(*keys, "topic_id", rank.alias("rank"), "word")


def parse_topics_polylingual(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``lang TAB num TAB beta TAB words`` lines; consecutive pairs form a topic."""
    fields = _split("\t")
    rows = lines.filter(F.size(fields) > 2).withColumn("words", F.split(F.rtrim(fields[3]), " ", -1))
    numbered = number_by_id(rows, keys, "line_no", out="_at")
    topics = numbered.select(
        *keys,
        F.floor(F.col("_at") / 2).cast("long").alias("topic_id"),
        F.when(F.col("_at") % 2 == 0, "src").otherwise("tgt").alias("side"),
        "words",
    )
    return _ranked(topics, keys, ["side"])


def parse_topics_mtm(lines: DataFrame, n_topics: int, keys: Sequence[str] = ()) -> DataFrame:
    """Two blocks of ``n_topics`` lines; items split by three spaces, the first is a flag."""
    items = F.split(F.rtrim("line"), ITEM_SEPARATOR, -1)
    words = F.transform(F.slice(items, 2, F.size(items)), lambda w: F.substring_index(w, ":", 1))
    topics = lines.filter(F.col("line_no") < 2 * n_topics).select(
        *keys,
        (F.col("line_no") % n_topics).alias("topic_id"),
        F.when(F.col("line_no") < n_topics, "src").otherwise("tgt").alias("side"),
        words.alias("words"),
    )
    return _ranked(topics, keys, ["side"])


def read_topics(spark: SparkSession, path: str, fmt: str, expected: int | None = None, **options) -> DataFrame:
    """Topic words of one file; ``expected`` checks the number of topics."""
    parsers = {
        "lftm": parse_topics_lftm,
        "csv_dash": parse_topics_csv_dash,
        "polylingual": parse_topics_polylingual,
        "mtm": parse_topics_mtm,
    }
    topics = parsers[fmt](read_lines(spark, path), **options)
    if expected is not None:
        found = topics.agg(F.count_distinct("topic_id")).first()[0]
        if found != expected:
            raise ValueError(f"{path} holds {found} topics, not {expected}")
    return topics


# --- weights ----------------------------------------------------------------------------


def parse_theta(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Space-separated weights with a trailing blank; the last element is dropped."""
    parts = _split(" ")
    kept = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return lines.select(*keys, F.col("line_no").alias("lang_seq"), F.transform(kept, lambda x: x.cast("double")).alias("theta"))


def read_theta(spark: SparkSession, path: str) -> DataFrame:
    return parse_theta(read_lines(spark, path))


def parse_theta_polylingual(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, lang_seq, doc_name, theta)``: a header line, then number, name and weights between tabs.

    Lines without weights are left out, as is whatever is behind a trailing tab.
    """
    parts = F.filter(F.split("line", "\t", -1), lambda x, i: (i < 2) | (x != ""))
    rows = lines.filter(F.col("line_no") > 0).select(*keys, "line_no", parts.alias("_p")).filter(F.size("_p") > 2)
    weights = F.transform(F.slice("_p", F.lit(3), F.size("_p") - 2), lambda x: x.cast("double"))
    return rows.select(*keys, (F.col("line_no") - 1).alias("lang_seq"), F.get("_p", F.lit(1)).alias("doc_name"), weights.alias("theta"))


def read_theta_polylingual(spark: SparkSession, path: str) -> DataFrame:
    return parse_theta_polylingual(read_lines(spark, path))


def parse_rho(lines: DataFrame, n_topics: int, keys: Sequence[str] = ()) -> DataFrame:
    """Skip line 0, keep ``n_topics`` rows: ``(src_topic, tgt_topic, w)``."""
    parts = F.split(F.rtrim("line"), " ", -1)
    rows = lines.filter(F.col("line_no").between(1, n_topics))
    return rows.select(
        *keys, (F.col("line_no") - 1).cast("int").alias("src_topic"), F.posexplode(parts).alias("tgt_topic", "w")
    ).withColumn("w", F.col("w").cast("double"))


def read_rho(spark: SparkSession, path: str, n_topics: int) -> DataFrame:
    return parse_rho(read_lines(spark, path), n_topics)


def parse_perplexity_log(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(iter, likelihood, perplexity)`` of the log lines that report both."""
    rows = lines.filter(F.col("line").rlike(PERPLEXITY_LINE)).select(
        *keys,
        "line_no",
        F.regexp_extract("line", PERPLEXITY_LINE, 1).try_cast("double").alias("likelihood"),
        F.regexp_extract("line", PERPLEXITY_LINE, 2).try_cast("double").alias("perplexity"),
    )
    return number_by_id(rows, keys, "line_no", out="iter").select(*keys, "iter", "likelihood", "perplexity")


# --- parallel corpora -------------------------------------------------------------------


def parse_interleaved_pairs(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Line 2k and line 2k+1 are the two sides of pair k; empty tokens are removed."""
    tokens = F.filter(_split(" "), lambda t: t != "")
    return lines.select(
        *keys,
        F.floor(F.col("line_no") / 2).cast("long").alias("pair_id"),
        (F.col("line_no") % 2).cast("int").alias("side"),
        tokens.alias("tokens"),
    )


def read_interleaved_pairs(spark: SparkSession, path: str) -> DataFrame:
    lines = read_lines(spark, path)
    if lines.count() % 2:
        raise ValueError(f"{path} holds an odd number of lines")
    return parse_interleaved_pairs(lines)


def zip_line_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two line-aligned files to one row per line number."""
    return first.select("line_no", F.col("line").alias("src_word")).join(
        second.select("line_no", F.col("line").alias("tgt_word")), "line_no"
    )


# --- incremental scan -------------------------------------------------------------------


def unprocessed_documents(documents: DataFrame, processed: DataFrame, content: str = "text") -> DataFrame:
    """Documents without a processing flag and with content, two fields only."""
    return (
        documents.filter(F.length(content) > 0)
        .join(processed.select("doc_id"), "doc_id", "left_anti")
        .select("doc_id", content)
    )
