"""Tokenising, filtering, normalising and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingospan.functions import text as tx
from lingospan.functions import vectors as vx
from lingospan.operators import embedding, metrics, tokens
from lingospan.plans.corpus import Corpus
from lingospan.plans.registry import query, six

SPACE = tx.char_class(tx.UNICODE_SPACE)
SYMBOLS = tx.char_class(tx.SPECIAL_SYMBOLS)
ENDS = tx.char_class(tx.SENTENCE_ENDS)
# A caller's character table for script normalisation.
SCRIPT_FROM = "éèêçàâôûùîïüöäñáíóúß"
SCRIPT_TO = "eeecaaouuiiuoanaious"


def sentences_sql(text: str, blanks: str) -> str:
    """The sentence rules as nested SQL calls."""
    steps = [(r"<[^\n]*?>", ""), (r"\.", "。"), (r"\n", "，"), (f"[{SYMBOLS}]+", ""), (f"[{blanks}]+", "")]
    for pattern, replacement in steps:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"list_filter(regexp_split_to_array({text}, '[{ENDS}]'), lambda s: s <> '')"


@query("strip_html", r"SELECT page_id, regexp_replace(html, '<[^\n]*?>', '', 'g') AS text FROM pages")
def strip_html(c: Corpus):
    return c.pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query(
    "segment_sentences",
    f"""SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_id
    FROM (SELECT doc_id, {sentences_sql('text', SPACE)} AS s FROM documents)""",
)
def segment_sentences(c: Corpus):
    sentences = tx.segment_sentences(F.col("text"), period_regex=r"\.")
    rows = c.texts.select("doc_id", F.posexplode(sentences).alias("sent_id", "sentence"))
    return rows.withColumn("sent_id", F.col("sent_id").cast("long"))


@query(
    "segment_sentences_no_digits",
    f"""SELECT page_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_id
    FROM (SELECT page_id, {sentences_sql('html', SPACE + r'\p{Nd}')} AS s FROM pages)""",
)
def segment_sentences_no_digits(c: Corpus):
    sentences = tx.segment_sentences(F.col("html"), period_regex=r"\.", keep_digits=False)
    rows = c.pages.select("page_id", F.posexplode(sentences).alias("sent_id", "sentence"))
    return rows.withColumn("sent_id", F.col("sent_id").cast("long"))


@query(
    "normalise_script",
    f"SELECT doc_id, translate(text, '{SCRIPT_FROM}', '{SCRIPT_TO}') AS text FROM documents",
)
def normalise_script(c: Corpus):
    return c.texts.select("doc_id", tx.normalise_script(F.col("text"), SCRIPT_FROM, SCRIPT_TO).alias("text"))


@query("tokenise", "SELECT doc_id, lang, pos, word FROM tok")
def tokenise(c: Corpus):
    rows = tokens.explode_tokens(c.docs, ["doc_id", "lang"])
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(
    "empty_sentence_placeholder",
    r"""SELECT doc_id, sent_id, CASE WHEN len(w) = 0 THEN 'there_is_no_word'
        ELSE array_to_string(w, ' ') END AS tokens
    FROM (SELECT doc_id, sent_id, regexp_extract_all(lower(sentence), '\p{L}+') AS w FROM sentence)""",
    views=f"""sentence AS (
      SELECT doc_id, unnest(s) AS sentence, (generate_subscripts(s, 1) - 1)::BIGINT AS sent_id
      FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents))""",
)
def empty_sentence_placeholder(c: Corpus):
    rows = c.texts.select("doc_id", F.posexplode(F.split("text", r"\.", -1)).alias("sent_id", "sentence"))
    words = tx.empty_sentence_placeholder(tx.letter_tokens(F.col("sentence")))
    return rows.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), F.array_join(words, " ").alias("tokens"))


@query(
    "count_vectorizer_tokens",
    """SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY word) - 1 AS word_id
    FROM (SELECT DISTINCT lang, word FROM cv)""",
    views=r"""cv AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word
      FROM documents)""",
)
def count_vectorizer_tokens(c: Corpus):
    words = c.texts.select("lang", tx.count_vectorizer_tokens(F.col("text")).alias("tokens"))
    return tokens.count_vectorizer_vocab(words)


ANNOTATED_SQL = r"""piece AS (
  SELECT doc_id, unnest(w) AS text, (generate_subscripts(w, 1) - 1)::BIGINT AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
annotated AS (
  SELECT doc_id, pos, text, lower(text) AS lemma,
    CASE WHEN text LIKE '%ing' THEN 'VERB' WHEN text LIKE '%ion' THEN 'NOUN'
         WHEN text LIKE '%re' THEN 'ADJ' ELSE 'DET' END AS upos,
    CASE WHEN regexp_matches(text, '^[A-Z]') THEN 'X_x' ELSE 'xx' END AS shape,
    regexp_full_match(text, '\p{L}+') AS is_alpha, length(text) <= 3 AS is_stop
  FROM piece)"""


def annotated_tokens(c: Corpus):
    """Token structs with marks derived from spelling, as a tagger would deliver them."""

    def mark(t):
        pos = F.when(t.endswith("ing"), "VERB").when(t.endswith("ion"), "NOUN").when(t.endswith("re"), "ADJ")
        return F.struct(
            t.alias("text"),
            F.lower(t).alias("lemma"),
            pos.otherwise("DET").alias("upos"),
            F.when(t.rlike("^[A-Z]"), "X_x").otherwise("xx").alias("shape"),
            t.rlike(r"^\p{L}+$").alias("is_alpha"),
            (F.char_length(t) <= 3).alias("is_stop"),
        )

    return c.texts.select("doc_id", F.transform(F.split("text", " ", -1), mark).alias("tokens"))


@query(
    "project_tokens",
    """SELECT doc_id, array_to_string(list(lemma ORDER BY pos), ' ') AS words FROM annotated
    WHERE (NOT is_stop AND is_alpha AND upos IN ('NOUN', 'VERB')) GROUP BY doc_id""",
    views=ANNOTATED_SQL,
)
def project_tokens(c: Corpus):
    words = tx.project_tokens(F.col("tokens"), accept_pos=["NOUN", "VERB"], use_entity=False)
    rows = annotated_tokens(c).select("doc_id", tokens.only_if(words, lambda w: F.size(w) > 0).alias("words"))
    return rows.select("doc_id", F.array_join("words", " ").alias("words"))


@query(
    "project_tokens_entities",
    """SELECT doc_id, array_to_string(list(text ORDER BY pos), ' ') AS words FROM annotated
    WHERE (is_alpha AND upos IN ('NOUN', 'PROPN', 'ADJ', 'ADV', 'VERB')) OR contains(shape, '_')
    GROUP BY doc_id""",
    views=ANNOTATED_SQL,
)
def project_tokens_entities(c: Corpus):
    words = tx.project_tokens(F.col("tokens"), want_stop=True, want_lemma=False)
    rows = annotated_tokens(c).select("doc_id", tokens.only_if(words, lambda w: F.size(w) > 0).alias("words"))
    return rows.select("doc_id", F.array_join("words", " ").alias("words"))


TAG = "CASE WHEN length(word) % 3 = 0 THEN '#NN' WHEN length(word) % 3 = 1 THEN '#VV' ELSE '#AD' END"


def tagged(word):
    n = F.char_length(word) % 3
    return F.concat(word, F.when(n == 0, "#NN").when(n == 1, "#VV").otherwise("#AD"))


@query(
    "pos_filter_tagged",
    f"""SELECT doc_id, array_to_string(list(word ORDER BY pos), ' ') AS words FROM tok
    WHERE (contains({TAG}, '#N') OR contains({TAG}, '#V')) AND length(word) >= 2
      AND regexp_matches(word, '[^\\x00-\\x7F]') GROUP BY doc_id""",
)
def pos_filter_tagged(c: Corpus):
    words = tx.pos_filter_tagged(F.transform("tokens", tagged))
    rows = c.docs.select("doc_id", tokens.only_if(words, lambda w: F.size(w) > 0).alias("words"))
    return rows.select("doc_id", F.array_join("words", " ").alias("words"))


@query(
    "parse_tagger_line",
    """SELECT doc_id, pos, word,
      word || '#' || CASE WHEN length(word) > 4 THEN 'noun' ELSE 'verb' END AS tagged FROM tok""",
)
def parse_tagger_line(c: Corpus):
    words = tokens.explode_tokens(c.docs, ["doc_id"])
    kind = F.when(F.char_length("word") > 4, "noun").otherwise("verb")
    lines = words.withColumn("line", F.concat(F.col("word"), F.lit("\t"), kind, F.lit(",general,*,x")))
    word, tag = tx.parse_tagger_line(F.col("line"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), word.alias("word"), tag.alias("tagged"))


@query(
    "word_script",
    r"""SELECT * FROM (SELECT lang, word, CASE WHEN NOT regexp_matches(word, '[^\x00-\x7F]') THEN 'en'
      WHEN regexp_matches(word, '[\x{4e00}-\x{9fff}]') THEN 'cn' END AS script FROM freq)
    WHERE script IS NOT NULL""",
)
def word_script(c: Corpus):
    words = tokens.vocabulary(c.docs).withColumn("script", tx.word_script(F.col("word")))
    return words.filter(F.col("script").isNotNull())


@query(
    "word_script_binary",
    r"""SELECT CASE WHEN regexp_matches(word, '[^\x00-\x7F]') THEN 'target' ELSE 'source' END AS script,
      count(*) AS n_words FROM freq GROUP BY 1""",
)
def word_script_binary(c: Corpus):
    return embedding.script_counts(tokens.vocabulary(c.docs))


# --- fixed-width vectors ----------------------------------------------------------------


def vector_cells(df, *keys: str):
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).select(*keys, F.col("dim").cast("long").alias("dim"), six("x").alias("x"))


CELLS = "unnest(v) AS x, (generate_subscripts(v, 1) - 1)::BIGINT AS dim"


@query(
    "l2_normalise_vec",
    f"""SELECT vec_id, dim, round(x + 1e-9, 6) + 0.0 AS x FROM (SELECT vec_id, {CELLS} FROM (
      SELECT vec_id, list_transform(d, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS v FROM (
        SELECT vec_id, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS n
        FROM (SELECT vec_id, embedding::DOUBLE[] AS d FROM embeddings))))""",
)
def l2_normalise_vec(c: Corpus):
    return vector_cells(c.table("embeddings").select("vec_id", vx.l2_normalise(F.col("embedding")).alias("vec")), "vec_id")


@query(
    "l1_normalise_theta",
    f"""SELECT vec_id, dim, round(x + 1e-9, 6) + 0.0 AS x FROM (SELECT vec_id, {CELLS} FROM (
      SELECT vec_id, list_transform(d, lambda x: x / CASE WHEN n = 0 THEN 2.220446049250313e-16 ELSE n END) AS v
      FROM (SELECT vec_id, d, list_sum(list_transform(d, lambda x: abs(x))) AS n
        FROM (SELECT vec_id, embedding::DOUBLE[] AS d FROM embeddings))))""",
)
def l1_normalise_theta(c: Corpus):
    return vector_cells(c.table("embeddings").select("vec_id", vx.l1_normalise(F.col("embedding")).alias("vec")), "vec_id")


@query(
    "cosine_similarity",
    """SELECT model_id, seq, round(list_dot_product(x, y)
        / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) + 1e-9, 6) + 0.0 AS cosine
    FROM (SELECT d.model_id, seq, s.vec::DOUBLE[] AS x, t.vec::DOUBLE[] AS y FROM dict d
      JOIN mvec s ON s.model_id = d.model_id AND s.side = 'src' AND s.word = src_word
      JOIN mvec t ON t.model_id = d.model_id AND t.side = 'tgt' AND t.word = tgt_word)""",
)
def cosine_similarity(c: Corpus):
    src = c.model_vectors.filter("side = 'src'").select("model_id", F.col("word").alias("src_word"), F.col("vec").alias("x"))
    tgt = c.model_vectors.filter("side = 'tgt'").select("model_id", F.col("word").alias("tgt_word"), F.col("vec").alias("y"))
    pairs = c.bidict.join(src, ["model_id", "src_word"]).join(tgt, ["model_id", "tgt_word"])
    return pairs.select("model_id", "seq", six(vx.cosine_similarity(F.col("x"), F.col("y"))).alias("cosine"))


@query(
    "drop_vector_dims",
    f"""SELECT vec_id, dim, round(x + 1e-9, 6) + 0.0 AS x FROM (SELECT vec_id, {CELLS} FROM (
      SELECT vec_id, list(x ORDER BY i) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x,
        generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
      WHERE i NOT IN (0, 5, 17, 63) GROUP BY vec_id))""",
)
def drop_vector_dims(c: Corpus):
    dims = F.array(*[F.lit(d) for d in (0, 5, 17, 63)])
    kept = vx.drop_dims(F.col("embedding").cast("array<double>"), dims)
    return vector_cells(c.table("embeddings").select("vec_id", kept.alias("vec")), "vec_id")


# --- aggregates -------------------------------------------------------------------------


@query(
    "corpus_descriptive",
    """SELECT n.lang, n_docs, n_types, round(mean_tokens + 1e-9, 6) + 0.0 AS mean_tokens FROM (
      SELECT lang, count(*) AS n_docs, avg(greatest(len(toks), 1)) AS mean_tokens FROM docs GROUP BY lang) n
    JOIN (SELECT lang, count(DISTINCT word) AS n_types FROM (
      SELECT lang, unnest(CASE WHEN len(toks) = 0 THEN [''] ELSE toks END) AS word FROM docs) GROUP BY lang) t
    USING (lang)""",
)
def corpus_descriptive(c: Corpus):
    return tokens.corpus_descriptive(c.docs).withColumn("mean_tokens", six("mean_tokens"))


@query("vocab_count_export", "SELECT lang, word, cf FROM freq WHERE cf > 100")
def vocab_count_export(c: Corpus):
    return tokens.vocab_count_export(tokens.corpus_frequency(c.docs)).select("lang", "word", "cf")


@query(
    "word_frequency_rank",
    """SELECT lang, word, cf, row_number() OVER (PARTITION BY lang ORDER BY cf DESC, first) - 1 AS freq_rank
    FROM (SELECT lang, word, count(*) AS cf, min(doc_id * 1000000 + pos) AS first FROM tok GROUP BY ALL)""",
)
def word_frequency_rank(c: Corpus):
    return tokens.word_frequency_rank(c.docs)


@query("bag_of_words", "SELECT doc_id, lang, word, tf FROM bow")
def bag_of_words(c: Corpus):
    return tokens.bag_of_words(c.docs)


@query("doc_frequency", "SELECT lang, word, df FROM freq")
def doc_frequency(c: Corpus):
    return tokens.document_frequency(c.docs)


@query("vocab_distinct", "SELECT DISTINCT lang, word FROM tok")
def vocab_distinct(c: Corpus):
    return tokens.vocabulary(c.docs)


@query(
    "class_index",
    "SELECT class, row_number() OVER (ORDER BY class) - 1 AS class_id FROM (SELECT DISTINCT source AS class FROM documents)",
)
def class_index(c: Corpus):
    return tokens.class_index(c.documents.withColumnRenamed("source", "class"))


@query(
    "mean_and_pop_stddev",
    """SELECT lang, source, round(avg(len(toks)) + 1e-9, 6) + 0.0 AS mean, round(stddev_pop(len(toks)) + 1e-9, 6) + 0.0 AS stddev
    FROM docs GROUP BY ALL""",
)
def mean_and_pop_stddev(c: Corpus):
    sizes = c.docs.withColumn("n", F.size("tokens"))
    stats = metrics.mean_and_pop_stddev(sizes, ["lang", "source"], "n")
    return stats.select("lang", "source", six("mean").alias("mean"), six("stddev").alias("stddev"))
