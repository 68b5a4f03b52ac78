"""Readers and writers, run on files and lines that Spark derives from the tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lingospan.functions.text import letter_tokens
from lingospan.operators import tokens
from lingospan.operators.sequence import number_by_id
from lingospan.plans.corpus import LANGUAGES, MODELS, SOURCE, Corpus, per_model
from lingospan.plans.registry import query, six
from lingospan.sources import readers, writers
from lingospan.sources.lines import read_lines
from lingospan.storage import scratch_path, store
from lingospan.streaming import bucketed, incremental

ONE_LINE = r"regexp_replace(text, '[\t\n\r]+', ' ', 'g')"


def one_line(column: str = "text"):
    return F.regexp_replace(column, r"[\t\n\r]+", " ")


def written_lines(c: Corpus, name: str, write) -> DataFrame:
    """Run ``write(path)`` on a fresh path and read the stored lines."""
    path = scratch_path(c.spark, name)
    write(path)
    return c.spark.read.text(path).withColumnRenamed("value", "line")


# --- readers ----------------------------------------------------------------------------


def labelled_lines(c: Corpus) -> DataFrame:
    """``source TAB text`` per document; French rows get a third field and must be refused."""
    extra = F.when(F.col("lang") == "fr", F.lit("x"))
    return c.texts.select(
        F.col("doc_id").alias("line_no"), F.concat_ws("\t", "source", one_line(), extra).alias("line")
    )


@query("read_labelled_tsv", f"SELECT doc_id AS line_no, source AS class, {ONE_LINE} AS content FROM documents WHERE lang <> 'fr'")
def read_labelled_tsv(c: Corpus):
    return readers.parse_labelled_tsv(labelled_lines(c))[0]


@query("read_labelled_tsv_rejects", f"SELECT doc_id AS line_no, source || chr(9) || {ONE_LINE} || chr(9) || 'x' AS line FROM documents WHERE lang = 'fr'")
def read_labelled_tsv_rejects(c: Corpus):
    return readers.parse_labelled_tsv(labelled_lines(c))[1]


@query(
    "parse_news_xml",
    r"""SELECT source AS sub_corpus, doc_id::VARCHAR AS file_name,
      CASE lang WHEN 'de' THEN 'CCAT' WHEN 'en' THEN 'ECAT' ELSE 'GCAT' END AS class,
      array_to_string(list_transform(lines, lambda l: trim(l)), ' ') AS content
    FROM (SELECT *, list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N} \n]', '', 'g'), chr(10)),
      lambda l: trim(l) <> '') AS lines FROM documents)
    WHERE lang <> 'es' AND len(lines) % 5 <> 4""",
)
def parse_news_xml(c: Corpus):
    """Each document as a news item: Spanish ones carry two class codes, some are cut short."""
    text = F.regexp_replace("text", r"[^\p{L}\p{N} \n]", "")
    lines = F.filter(F.split(text, "\n", -1), lambda l: F.trim(l) != "")
    paragraphs = F.array_join(F.transform(lines, lambda l: F.concat(F.lit("<p>"), F.trim(l), F.lit("</p>"))), "")
    lang = F.col("lang")
    codes = (
        F.when(lang == "de", '<code code="CCAT"/><code code="C15"/>')
        .when(lang == "en", '<code code="ECAT"/>')
        .when(lang == "fr", '<code code="GCAT"/>')
        .otherwise('<code code="GCAT"/><code code="MCAT"/>')
    )
    end = F.when(F.size(lines) % 5 == 4, "</text>").otherwise("</text></newsitem>")
    xml = F.concat(
        F.lit('<newsitem><metadata><codes class="bip:countries:1.0"><code code="MCAT"/></codes>'),
        F.lit('<codes class="bip:topics:1.0">'), codes, F.lit("</codes></metadata><text>"), paragraphs, end,
    )
    files = c.texts.select(F.col("source").alias("sub_corpus"), F.col("doc_id").cast("string").alias("file_name"), xml.alias("xml"))
    return readers.parse_news_xml(files)[0]


@query(
    "read_word_vectors",
    """SELECT word, row_number() OVER (ORDER BY vec_id) - 1 AS idx, len(vec)::INTEGER AS width,
      round(list_sum(vec::DOUBLE[]), 5) + 0.0 AS total
    FROM (SELECT vec_id, lang || ':' || word AS word, vec FROM vec)""",
)
def read_word_vectors(c: Corpus):
    path = scratch_path(c.spark, "word-vectors")
    named = number_by_id(c.vectors, [], "vec_id", out="at").select(
        F.col("at").alias("idx"), F.concat_ws(":", "lang", "word").alias("word"), "vec"
    )
    writers.write_word_vectors(named, path, fixed=False)
    # The file has several parts, so its lines get their place from the parts' order.
    rows = readers.parse_word_vectors(whole_file(c, path))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("word", "idx", F.size("vec").alias("width"), (F.round(total, 5) + F.lit(0.0)).alias("total"))


def whole_file(c: Corpus, path: str) -> DataFrame:
    """Lines of an ordered folder of parts, numbered across the parts."""
    lines = read_lines(c.spark, path)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return lines.join(offsets, "file").select((F.col("line_no") + F.col("start")).alias("line_no"), "line")


@query(
    "read_bidict",
    r"""SELECT seq * 4 + m AS seq, CASE WHEN regexp_matches(tgt_word, '[^\x00-\x7F]') THEN tgt_word ELSE lower(tgt_word) END AS src_word,
      CASE WHEN regexp_matches(src_word, '[^\x00-\x7F]') THEN 'X' ELSE 'x' END || src_word AS tgt_word
    FROM (SELECT *, CASE model_id WHEN 'en-de' THEN 0 WHEN 'en-es' THEN 1 ELSE 2 END AS m FROM dict)""",
)
def read_bidict(c: Corpus):
    """Lines ``source,target`` of all models with a capital before the source word."""
    number = F.when(F.col("model_id") == "en-de", 0).when(F.col("model_id") == "en-es", 1).otherwise(2)
    line = F.concat(F.lit("X"), F.col("src_word"), F.lit(","), F.col("tgt_word"))
    lines = c.bidict.select((F.col("seq") * 4 + number).alias("line_no"), line.alias("line"))
    return readers.parse_bidict(lines, ",", reverse=True, lower_english=True)


NUMBERED_SQL = """numbered AS (SELECT lang, rank, word,
  dense_rank() OVER (PARTITION BY lang ORDER BY substr(topic_id, 4)::BIGINT) - 1 AS topic_id FROM topic),
shared AS (SELECT topic_id FROM topic WHERE lang IN ('en', 'fr') GROUP BY topic_id HAVING count(DISTINCT lang) = 2),
two_sided AS (SELECT CASE lang WHEN 'en' THEN 'src' ELSE 'tgt' END AS side, rank, word,
  dense_rank() OVER (ORDER BY substr(topic_id, 4)::BIGINT) - 1 AS topic_id
  FROM topic SEMI JOIN shared USING (topic_id) WHERE lang IN ('en', 'fr'))"""


def topic_lines(c: Corpus, topic_words: DataFrame | None = None):
    """Ranked words of every source topic as one array, topics numbered per language."""
    rows = c.topic_words if topic_words is None else topic_words
    ordered = F.sort_array(F.collect_list(F.struct("rank", "word")))
    words = F.transform(ordered, lambda x: x["word"])
    grouped = rows.groupBy("topic_id", "lang").agg(words.alias("words"))
    return number_by_id(grouped.withColumn("id", F.substring("topic_id", 4, 9).cast("long")), ["lang"], "id", out="no")


@query(
    "read_topics_lftm",
    "SELECT lang, topic_id, rank, word FROM numbered",
    views=NUMBERED_SQL,
)
def read_topics_lftm(c: Corpus):
    lines = topic_lines(c).select(
        "lang", F.col("no").alias("line_no"),
        F.concat(F.lit("Topic"), F.col("no").cast("string"), F.lit(": "), F.array_join("words", " ")).alias("line"),
    )
    rows = readers.parse_topics_lftm(lines, ["lang"])
    return rows.select("lang", "topic_id", F.col("rank").cast("long").alias("rank"), "word")


@query(
    "read_topics_csv_dash",
    "SELECT lang, topic_id, rank, word FROM numbered",
    views=NUMBERED_SQL,
)
def read_topics_csv_dash(c: Corpus):
    topics = topic_lines(c)
    rows = topics.select("lang", "no", F.posexplode("words").alias("at", "word")).select(
        "lang", (F.col("no") * 100 + F.col("at") + 1).alias("line_no"), F.concat_ws(",", "word", "at").alias("line")
    )
    dashes = topics.filter("no > 0").select("lang", (F.col("no") * 100).alias("line_no"), F.lit("-").alias("line"))
    parsed = readers.parse_topics_csv_dash(rows.unionByName(dashes), ["lang"])
    return parsed.select("lang", "topic_id", F.col("rank").cast("long").alias("rank"), "word")


def two_sided_lines(c: Corpus):
    """Topics with words on both sides of en-fr, source side 0, target side 1."""
    rows = c.topic_words.filter(F.col("lang").isin("en", "fr"))
    shared = rows.groupBy("topic_id").agg(F.count_distinct("lang").alias("n")).filter("n = 2")
    return topic_lines(c, rows.join(shared, "topic_id", "left_semi")).withColumn("side", (F.col("lang") == "fr").cast("long"))


TWO_SIDES = "SELECT side, topic_id, rank, word FROM two_sided"


@query("read_topics_polylingual", TWO_SIDES, views=NUMBERED_SQL)
def read_topics_polylingual(c: Corpus):
    lines = two_sided_lines(c)
    topics = lines.select(
        (F.col("no") * 3 + F.col("side") + 1).alias("line_no"),
        F.concat_ws("\t", "lang", F.lit("50"), F.lit("0.01"), F.array_join("words", " ")).alias("line"),
    )
    headers = lines.filter("side = 0").select((F.col("no") * 3).alias("line_no"), F.concat_ws("\t", F.col("no").cast("string"), F.lit("0.5")).alias("line"))
    rows = readers.parse_topics_polylingual(topics.unionByName(headers))
    return rows.select("side", "topic_id", F.col("rank").cast("long").alias("rank"), "word")


@query("read_topics_mtm", TWO_SIDES, views=NUMBERED_SQL)
def read_topics_mtm(c: Corpus):
    topics = two_sided_lines(c)
    n = topics.filter("side = 0").count()
    items = F.array_join(F.transform("words", lambda w: F.concat(w, F.lit(":0.25"))), "   ")
    lines = topics.select((F.col("side") * n + F.col("no")).alias("line_no"), F.concat_ws("   ", F.lit("topic"), items).alias("line"))
    rows = readers.parse_topics_mtm(lines, n)
    return rows.select("side", F.col("topic_id").cast("long").alias("topic_id"), F.col("rank").cast("long").alias("rank"), "word")


@query(
    "read_theta",
    """SELECT doc_id AS lang_seq, substr(topic_id, 4)::BIGINT AS topic_id, round(theta + 1e-9, 6) + 0.0 AS weight
    FROM theta WHERE round(theta + 1e-9, 6) > 0""",
)
def read_theta(c: Corpus):
    parts = F.transform("theta", lambda x: x.cast("string"))
    lines = c.theta.select(F.col("doc_id").alias("line_no"), F.concat(F.array_join(parts, " "), F.lit(" ")).alias("line"))
    names = F.array(*[F.lit(int(t[3:])).cast("long") for t in c.topic_ids])
    rows = readers.parse_theta(lines).select("lang_seq", F.inline(F.arrays_zip(names, "theta")).alias("topic_id", "weight"))
    return rows.withColumn("weight", six("weight")).filter("weight > 0")


@query(
    "read_rho",
    """SELECT vec_id AS src_topic, (generate_subscripts(embedding, 1) - 1)::INTEGER AS tgt_topic,
      unnest(embedding)::VARCHAR::DOUBLE AS w FROM embeddings WHERE vec_id < 64""",
)
def read_rho(c: Corpus):
    """Link weights: the first 64 vectors as a 64 x 64 matrix, the rest as surplus rows."""
    vectors = c.table("embeddings")
    rows = vectors.select((F.col("vec_id") + 1).alias("line_no"), writers.vector_text(F.col("embedding"), fixed=False).alias("line"))
    header = vectors.agg(F.lit(0).cast("long").alias("line_no"), F.lit("rho[0][1]").alias("line"))
    rho = readers.parse_rho(header.unionByName(rows), 64)
    return rho.select(F.col("src_topic").cast("long").alias("src_topic"), "tgt_topic", "w")


@query(
    "read_interleaved_pairs",
    "SELECT model_id, pair_id, side_no AS side, array_to_string(toks, ' ') AS words FROM mdocs",
)
def read_interleaved_pairs(c: Corpus):
    lines = c.pair_docs.select(
        "model_id", (F.col("pair_id") * 2 + F.col("side_no")).alias("line_no"), F.concat(F.lit(" "), F.array_join("tokens", "  ")).alias("line")
    )
    pairs = readers.parse_interleaved_pairs(lines, ["model_id"])
    return pairs.select("model_id", "pair_id", "side", F.array_join("tokens", " ").alias("words"))


def every_model(run) -> DataFrame:
    """Rows of ``run(model)`` of all models, whose files are written side by side."""
    with ThreadPoolExecutor(len(MODELS)) as pool:
        parts = list(pool.map(lambda model: run(model).withColumn("model_id", F.lit(model)), MODELS))
    return reduce(DataFrame.unionByName, parts)


@query("zip_line_files", "SELECT model_id, seq AS line_no, src_word, tgt_word FROM dict")
def zip_line_files(c: Corpus):
    """Both sides of every dictionary written to two files and read back line by line."""
    bidict = store(c.bidict, "bidict")

    def zipped(model: str) -> DataFrame:
        pairs, files = bidict.filter(F.col("model_id") == model), []
        for side in ("src_word", "tgt_word"):
            path = scratch_path(c.spark, side)
            writers.write_lines(pairs.select("seq", F.col(side).alias("line")), path, ["seq"])
            files.append(whole_file(c, path))
        return readers.zip_line_files(*files)

    return every_model(zipped)


@query(
    "unprocessed_documents",
    "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(text) > 0",
)
def unprocessed_documents(c: Corpus):
    return readers.unprocessed_documents(c.documents, c.table("labels"))


@query(
    "perplexity_log",
    """SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS iter,
      -(len(toks) + 0.5)::DOUBLE AS likelihood, (n_chars + 0.25)::DOUBLE AS perplexity
    FROM docs JOIN documents USING (doc_id, lang)""",
)
def perplexity_log(c: Corpus):
    docs = c.docs.join(c.documents.select("doc_id", "n_chars"), "doc_id")
    report = F.format_string(
        "INFO : -%d.5 per-word bound, %d.25 perplexity estimate based on a held-out corpus", F.size("tokens"), "n_chars"
    )
    report_lines = docs.select("lang", (F.col("doc_id") * 2).alias("line_no"), report.alias("line"))
    others = docs.select("lang", (F.col("doc_id") * 2 + 1).alias("line_no"), F.lit("INFO : PROGRESS: pass 0").alias("line"))
    return readers.parse_perplexity_log(report_lines.unionByName(others), ["lang"])


# --- writers ----------------------------------------------------------------------------


def interleaved(c: Corpus, model: str) -> DataFrame:
    return c.pair_docs.filter(F.col("model_id") == model).withColumnRenamed("side_no", "side")


@query("write_interleaved_corpus", "SELECT model_id, pair_id * 2 + side_no AS line_no, array_to_string(toks, ' ') AS line FROM mdocs")
def write_interleaved_corpus(c: Corpus):
    c.pairs  # Numbered once for all models.

    def lines(model: str) -> DataFrame:
        path = scratch_path(c.spark, "interleaved")
        writers.write_interleaved_corpus(interleaved(c, model), path)
        return whole_file(c, path)

    return every_model(lines)


def language_files(c: Corpus, name: str, write) -> DataFrame:
    """Numbered lines of the file of each language of every model."""
    c.pairs

    def lines(model: str) -> DataFrame:
        path = scratch_path(c.spark, name)
        write(interleaved(c, model), path)
        langs = (SOURCE, model.removeprefix(f"{SOURCE}-"))
        return reduce(DataFrame.unionByName, [whole_file(c, f"{path}/lang={lang}").withColumn("lang", F.lit(lang)) for lang in langs])

    return every_model(lines)


ORDERED_SQL = "SELECT model_id, lang, row_number() OVER (PARTITION BY model_id, lang ORDER BY pair_id) - 1 AS line_no, {} AS line FROM mdocs"


@query("write_two_file_corpus", ORDERED_SQL.format("array_to_string(toks, ' ')"))
def write_two_file_corpus(c: Corpus):
    return language_files(c, "two-files", writers.write_two_file_corpus)


@query("write_polylingual_tsv", ORDERED_SQL.format("pair_id || chr(9) || upper(lang) || chr(9) || array_to_string(toks, ' ')"))
def write_polylingual_tsv(c: Corpus):
    return language_files(c, "polylingual", writers.write_polylingual_tsv)


def indexed_vectors(c: Corpus) -> DataFrame:
    return c.vectors.select(F.col("vec_id").alias("idx"), "lang", "word", F.col("vec").cast("array<double>").alias("vec"))


VEC_TEXT = "array_to_string(list_transform(vec, lambda x: format('{:.6f}', x::DOUBLE)), ' ')"


@query(
    "write_word_vectors",
    f"""SELECT word || ' ' || {VEC_TEXT} AS line FROM vec
    UNION ALL SELECT count(*) || ' ' || max(len(vec)) FROM vec""",
)
def write_word_vectors(c: Corpus):
    return written_lines(c, "vectors", lambda p: writers.write_word_vectors(indexed_vectors(c), p))


@query(
    "write_lang_prefixed_vectors",
    rf"""SELECT CASE WHEN regexp_matches(word, '[^\x00-\x7F]') THEN 'fra:' ELSE 'eng:' END || word || ' ' || {VEC_TEXT} AS line FROM vec
    UNION ALL SELECT count(*) || ' ' || max(len(vec)) FROM vec""",
)
def write_lang_prefixed_vectors(c: Corpus):
    return written_lines(c, "prefixed", lambda p: writers.write_lang_prefixed_vectors(indexed_vectors(c), p, "fra"))


@query(
    "write_projector_tsv",
    "SELECT word || chr(9) || lang AS line, 64 AS fields FROM vec UNION ALL SELECT 'word' || chr(9) || 'language', 0",
)
def write_projector_tsv(c: Corpus):
    """Metadata lines beside the number of fields on the vector line of the same number."""
    vectors, metadata = scratch_path(c.spark, "projector"), scratch_path(c.spark, "projector-meta")
    writers.write_projector_tsv(indexed_vectors(c), vectors, metadata)
    numbers = whole_file(c, vectors).select((F.col("line_no") + 1).alias("line_no"), F.size(F.split("line", "\t")).alias("fields"))
    return whole_file(c, metadata).join(numbers, "line_no", "left").select("line", F.coalesce("fields", F.lit(0)).alias("fields"))


CODED_SQL = """ids AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS word_id FROM freq),
coded AS (SELECT doc_id, word_id, tf FROM bow JOIN ids USING (lang, word))"""


@query(
    "write_sparse_counts",
    """SELECT coalesce(line, '0 ') AS line FROM documents LEFT JOIN (
      SELECT doc_id, sum(tf)::BIGINT || ' ' || array_to_string(list(word_id || ':' || tf ORDER BY word_id), ' ') AS line
      FROM coded GROUP BY doc_id) USING (doc_id)""",
    views=CODED_SQL,
)
def write_sparse_counts(c: Corpus):
    vocab = tokens.count_vectorizer_vocab(c.docs, with_df=True)
    terms = writers.collect_terms(c.documents, c.bow, vocab)
    return written_lines(c, "sparse", lambda p: writers.write_sparse_counts(terms, p))


@query("write_vocab", "SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS line_no, word AS line FROM freq")
def write_vocab(c: Corpus):
    """The vocabulary file of every language."""
    vocab, files = store(tokens.count_vectorizer_vocab(c.docs), "vocabulary"), []
    for lang in LANGUAGES:
        path = scratch_path(c.spark, "vocab")
        writers.write_vocab(vocab.filter(F.col("lang") == lang), path)
        files.append(whole_file(c, path).withColumn("lang", F.lit(lang)))
    return reduce(DataFrame.unionByName, files)


@query("write_mtm_bidict", "SELECT 0 || chr(9) || src_word || chr(9) || 1 || chr(9) || tgt_word AS line FROM dict")
def write_mtm_bidict(c: Corpus):
    return written_lines(c, "bidict", lambda p: writers.write_mtm_bidict(c.bidict, p))


@query(
    "topic_word_report",
    "SELECT topic_id, lang, array_to_string(list(word ORDER BY rank), ' ') AS words FROM topic WHERE rank <= 20 GROUP BY ALL",
)
def topic_word_report(c: Corpus):
    return writers.topic_word_report(c.topic_words, ["topic_id", "lang"], 20)


@query(
    "doc_topic_report",
    """SELECT model_id, pair_id * 2 + side_no AS doc_no, lang, array_to_string(toks, ', ') AS words, round(top + 1e-9, 6) + 0.0 AS top
    FROM mdocs JOIN (SELECT doc_id, max(theta) AS top FROM theta GROUP BY doc_id) USING (doc_id)
    WHERE pair_id * 2 + side_no < 1000""",
)
def doc_topic_report(c: Corpus):
    """The report on the first documents of every model; only these are tokenised whole and get weights."""
    first = store(c.pair_members.filter(F.col("pair_id") * 2 + F.col("side_no") < 1000), "first-pairs")
    docs = store(c.docs_of(first), "first-docs")
    theta = store(c.theta_of(docs, c.phi_of(docs)).select("doc_id", "theta"), "theta")
    pairs = first.withColumnRenamed("side_no", "side").join(docs.select("doc_id", "lang", "tokens"), "doc_id")
    report = every_model(lambda model: writers.doc_topic_report(pairs.filter(F.col("model_id") == model), theta, 1000))
    return report.select("model_id", "doc_no", "lang", "words", six(F.array_max("theta")).alias("top"))


@query(
    "upsert_nlp_result",
    r"""SELECT doc_id, len(toks)::INTEGER AS n, CASE WHEN length(text) > 0 THEN 'done' ELSE 'error' END AS status,
      len(regexp_extract_all(lower(head), '\p{L}+'))::INTEGER AS abstract_n,
      CASE WHEN length(head) > 0 THEN 'done' ELSE 'error' END AS abstract_status
    FROM docs JOIN (SELECT doc_id, text, split_part(text, chr(10), 1) AS head FROM documents) USING (doc_id)""",
)
def upsert_nlp_result(c: Corpus):
    """Two streams into one table: results of the texts, then those of their first lines."""
    schema = T.StructType([c.documents.schema["doc_id"]])
    for prefix in ("", "abstract_"):
        schema = schema.add(f"{prefix}tokens", T.ArrayType(T.StringType())).add(f"{prefix}status", "string")
    results = bucketed.BucketedTable(c.spark, scratch_path(c.spark, "nlp-table"), schema, ["doc_id"], 16)
    fields = {"": F.col("text"), "abstract_": F.substring_index("text", "\n", 1)}
    version = 0
    for prefix, content in fields.items():
        stream = incremental.table_stream(c.spark, f"{c.path}/documents.parquet", c.documents.schema)
        work = lambda batch, p=prefix, t=content: batch.select("doc_id", *incremental.nlp_result(t, letter_tokens(t), p))
        version = bucketed.upsert_stream(stream, work, results, scratch_path(c.spark, "nlp-progress"), version)
    sizes = [F.coalesce(F.size(f"{p}tokens"), F.lit(0)).alias(f"{p}n") for p in fields]
    return results.read().select("doc_id", *sizes, "status", "abstract_status")


@query(
    "process_available_documents",
    """SELECT doc_id, len(toks)::INTEGER AS n, CASE WHEN length(text) > 0 THEN 'done' ELSE 'error' END AS status
    FROM docs JOIN documents USING (doc_id)""",
)
def process_available_documents(c: Corpus):
    """The documents as a stream, processed to the end, then read back."""
    text = F.col("text")
    stream = incremental.table_stream(c.spark, f"{c.path}/documents.parquet", c.documents.schema)
    results = scratch_path(c.spark, "nlp-results")
    incremental.process_available(
        stream,
        lambda batch: batch.select("doc_id", *incremental.nlp_result(text, letter_tokens(text))),
        results,
        scratch_path(c.spark, "nlp-progress"),
    )
    stored = incremental.latest(c.spark.read.parquet(results), ["doc_id"])
    return stored.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).alias("n"), "status")


@query(
    "save_model_bundle",
    """SELECT model_id, 'topic_words' AS part, count(*) AS n, round(sum(weight) + 1e-9, 6) + 0.0 AS total FROM mtopic GROUP BY ALL
    UNION ALL SELECT model_id, CASE side WHEN 'src' THEN 'source_theta' ELSE 'target_theta' END, count(*), round(sum(theta) + 1e-9, 6) + 0.0
    FROM theta JOIN models USING (lang) GROUP BY ALL""",
)
def save_model_bundle(c: Corpus):
    path = scratch_path(c.spark, "bundle")
    theta = per_model(c.theta_cells)
    writers.save_model_bundle(
        c.model_topic_words, theta.filter("side = 'src'").drop("side"), theta.filter("side = 'tgt'").drop("side"), path
    )
    rows = None
    for name, table in zip(("topic_words", "source_theta", "target_theta"), writers.load_model_bundle(c.spark, path)):
        part = table.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), six(F.sum("weight")).alias("total")).withColumn("part", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows
