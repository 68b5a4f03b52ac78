"""Vocabulary, dictionary and document joins; ranking and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.functions.vectors import array_sum, dot, doubles
from lingospan.operators import dictionaries, matching, metrics, topics
from lingospan.operators.sequence import number_by_id
from lingospan.plans.corpus import MODELS, SOURCE, Corpus, per_model
from lingospan.plans.registry import query, six
from lingospan.storage import store

WORDS = "array_to_string(list(word ORDER BY pos), ' ') AS words"


def as_text(df, *keys: str):
    return df.select(*keys, F.array_join("tokens", " ").alias("words"))


@query(
    "tag_split_labels",
    """SELECT doc_id, CASE WHEN class = 1 THEN 'train' ELSE 'test' END AS data_type FROM split""",
)
def tag_split_labels(c: Corpus):
    documents = c.documents.select("doc_id", F.col("source").alias("sub_corpus"), F.col("doc_id").cast("string").alias("file_name"))
    named = documents.join(c.split.select("doc_id", "class"), "doc_id")
    index = named.select(
        F.concat_ws("-", "sub_corpus", "file_name").alias("entry"),
        F.when(F.col("class") == 1, "train").otherwise("test").alias("data_type"),
    )
    tagged, _ = matching.tag_split_labels(documents, index)
    return tagged.select("doc_id", "data_type")


@query(
    "filter_tokens_to_vocab",
    f"""SELECT doc_id, lang, {WORDS} FROM tok SEMI JOIN vec USING (lang, word) GROUP BY doc_id, lang""",
)
def filter_tokens_to_vocab(c: Corpus):
    return as_text(matching.filter_tokens_to_vocab(c.docs, c.vectors), "doc_id", "lang")


@query(
    "missing_words",
    r"""SELECT count(*) AS n_missing, count(*) FILTER (NOT regexp_matches(word, '[^\x00-\x7F]')) AS n_missing_ascii
    FROM (SELECT DISTINCT word FROM tok WHERE word NOT IN (SELECT word FROM vec))""",
)
def missing_words(c: Corpus):
    return matching.missing_word_report(matching.missing_words(c.docs, c.vectors))


@query(
    "remove_missing_words",
    f"""SELECT d.doc_id, d.lang, coalesce(words, '') AS words FROM documents d LEFT JOIN (
      SELECT doc_id, {WORDS} FROM tok WHERE word IN (SELECT word FROM vec) GROUP BY doc_id) USING (doc_id)""",
)
def remove_missing_words(c: Corpus):
    return as_text(matching.remove_missing_words(c.docs, c.vectors), "doc_id", "lang")


@query(
    "select_word_space",
    "SELECT lang, word, vec_id FROM vec WHERE (lang, word) IN (SELECT lang, word FROM tok JOIN labels USING (doc_id))",
)
def select_word_space(c: Corpus):
    labelled = c.docs.join(c.table("labels").select("doc_id"), "doc_id", "left_semi")
    return matching.select_word_space(c.vectors, labelled).select("lang", "word", "vec_id")




def per_side(c: Corpus, side: str):
    """Model vocabularies of one side with the model as part of the word key."""
    rows = c.model_vectors.filter(F.col("side") == side)
    return rows.select(F.concat_ws(":", "model_id", "word").alias("word"), F.col("vec_id").alias("word_id"), "vec")


def keyed_bidict(c: Corpus):
    return c.bidict.select(
        "seq",
        F.concat_ws(":", "model_id", "src_word").alias("src_word"),
        F.concat_ws(":", "model_id", "tgt_word").alias("tgt_word"),
    )


@query(
    "bidict_in_vocab",
    """SELECT seq, model_id || ':' || src_word AS src_word, model_id || ':' || tgt_word AS tgt_word FROM dict
    WHERE (model_id, src_word) IN (SELECT model_id, word FROM mvec WHERE side = 'src')
      AND (model_id, tgt_word) IN (SELECT model_id, word FROM mvec WHERE side = 'tgt')""",
)
def bidict_in_vocab(c: Corpus):
    found = matching.bidict_in_vocab(keyed_bidict(c), per_side(c, "src"), per_side(c, "tgt"))
    return found.select("seq", "src_word", "tgt_word")


@query(
    "bidict_encoded",
    """SELECT d.seq, s.vec_id AS src_id, t.vec_id AS tgt_id FROM dict d
    JOIN mvec s ON s.model_id = d.model_id AND s.side = 'src' AND s.word = d.src_word
    JOIN mvec t ON t.model_id = d.model_id AND t.side = 'tgt' AND t.word = d.tgt_word""",
)
def bidict_encoded(c: Corpus):
    upper = keyed_bidict(c).withColumn("src_word", F.upper("src_word"))
    coded = matching.bidict_encoded(upper, per_side(c, "src"), per_side(c, "tgt"))
    return coded.select("seq", "src_id", "tgt_id")


@query(
    "words_not_in_pairs",
    "SELECT word, cf FROM rnk ANTI JOIN dict ON word = src_word WHERE lang = 'en'",
)
def words_not_in_pairs(c: Corpus):
    vocab = c.ranks.filter(F.col("lang") == SOURCE).select("word", "cf")
    return matching.words_not_in_pairs(vocab, c.bidict)


@query(
    "training_pair_vectors",
    """SELECT d.seq, d.model_id || ':' || src_word AS src_word,
      round(list_sum(s.vec::DOUBLE[]) + 1e-9, 6) + 0.0 AS sum_x, round(list_dot_product(s.vec::DOUBLE[], t.vec::DOUBLE[]) + 1e-9, 6) + 0.0 AS xy
    FROM dict d
    JOIN mvec s ON s.model_id = d.model_id AND s.side = 'src' AND s.word = d.src_word
    JOIN mvec t ON t.model_id = d.model_id AND t.side = 'tgt' AND t.word = d.tgt_word""",
)
def training_pair_vectors(c: Corpus):
    pairs = matching.training_pair_vectors(keyed_bidict(c), per_side(c, "src"), per_side(c, "tgt"))
    return pairs.select(
        "seq", "src_word", six(array_sum(doubles(F.col("x")))).alias("sum_x"), six(dot(F.col("x"), F.col("y"))).alias("xy")
    )


MANY_SQL = """many AS (
  SELECT model_id, 3 * seq + k AS seq, left(src_word, 4 - k) AS src_word, 'X' || left(tgt_word, 4) AS tgt_word
  FROM dict, (SELECT unnest([0, 1, 2]) AS k))"""


def many_to_many(c: Corpus):
    """A dictionary with repeated words on both sides: prefixes of the paired words."""
    copies = c.bidict.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return copies.select(
        "model_id",
        (F.col("seq") * 3 + F.col("k")).alias("seq"),
        F.expr("left(src_word, 4 - k)").alias("src_word"),
        F.concat(F.lit("X"), F.expr("left(tgt_word, 4)")).alias("tgt_word"),
    )


@query(
    "dedupe_bidict",
    """SELECT model_id, src_word, tgt_word, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY model_id, tgt_word ORDER BY seq) AS n FROM (
        SELECT model_id, src_word, lower(arg_max(tgt_word, seq)) AS tgt_word, min(seq) AS seq
        FROM many GROUP BY ALL)) WHERE n = 1""",
    views=MANY_SQL,
)
def dedupe_bidict(c: Corpus):
    return matching.dedupe_bidict(many_to_many(c), ["model_id"])


KEPT_SQL = f"""kept AS (
  SELECT doc_id, lang, {WORDS}, count(*) AS n FROM tok SEMI JOIN vec USING (lang, word) GROUP BY doc_id, lang)"""


@query(
    "pair_documents",
    """SELECT model_id, pair_id, s.words AS src_words, t.words AS tgt_words FROM pair
    JOIN kept s ON s.doc_id = src_doc JOIN kept t ON t.doc_id = tgt_doc""",
    views=KEPT_SQL,
)
def pair_documents(c: Corpus):
    kept = store(matching.filter_tokens_to_vocab(c.docs, c.vectors).select("doc_id", "tokens"), "kept-tokens")
    keyed = c.pairs.withColumn("key", F.struct("model_id", "pair_id"))
    src = keyed.join(kept, keyed.src_doc == kept.doc_id).select("key", "tokens")
    tgt = keyed.join(kept, keyed.tgt_doc == kept.doc_id).select("key", "tokens")
    pairs = matching.pair_documents(src, tgt, key="key")
    return pairs.select(
        "key.*", F.array_join("src_tokens", " ").alias("src_words"), F.array_join("tgt_tokens", " ").alias("tgt_words")
    )


def lang_index(c: Corpus):
    """Position of each document in the file of its language."""
    return number_by_id(c.documents.select("doc_id", "lang"), ["lang"], "doc_id", out="lang_seq", scan=True)


@query(
    "attach_theta",
    """SELECT nth.doc_id, pair_id AS lang_seq, topic_id, round(theta + 1e-9, 6) + 0.0 AS weight
    FROM nth JOIN theta USING (doc_id) WHERE theta > 0""",
)
def attach_theta(c: Corpus):
    index = lang_index(c)
    rows = c.theta_cells.join(index, ["doc_id", "lang"]).drop("doc_id")
    attached = matching.attach_theta(index, rows.withColumnRenamed("weight", "theta"))
    return attached.select("doc_id", "lang_seq", "topic_id", six("theta").alias("weight"))


@query(
    "attach_theta_joint",
    """SELECT doc_id, pair_id + CASE WHEN lang = 'en' THEN 0 ELSE (SELECT count(*) FROM documents WHERE lang = 'en') END
      AS row, len(toks) AS n FROM nth JOIN docs USING (doc_id, lang) WHERE lang IN ('en', 'fr')""",
)
def attach_theta_joint(c: Corpus):
    n_source = c.documents.filter(F.col("lang") == SOURCE).count()
    index = lang_index(c).filter(F.col("lang").isin(SOURCE, "fr")).withColumn("is_source", F.col("lang") == SOURCE)
    offset = F.when(F.col("lang") == SOURCE, 0).otherwise(n_source)
    matrix = index.join(c.docs, ["doc_id", "lang"]).select(
        (F.col("lang_seq") + offset).alias("row"), F.size("tokens").cast("long").alias("n")
    )
    return matching.attach_theta(index, matrix, joint_offset=F.lit(n_source)).select("doc_id", "row", "n")


@query(
    "dict_pairs_in_topics",
    """SELECT t.model_id, t.topic_id, round(count(s.word) / 50.0 + 1e-9, 6) + 0.0 AS proportion
    FROM (SELECT DISTINCT model_id, topic_id FROM mtopic) t
    LEFT JOIN (SELECT a.model_id, a.topic_id, a.word FROM mtopic a
      JOIN dict d ON d.model_id = a.model_id AND d.src_word = a.word AND a.side = 'src'
      JOIN mtopic b ON b.model_id = a.model_id AND b.topic_id = a.topic_id AND b.word = d.tgt_word AND b.side = 'tgt') s
    ON s.model_id = t.model_id AND s.topic_id = t.topic_id GROUP BY ALL""",
)
def dict_pairs_in_topics(c: Corpus):
    shares = matching.dict_pairs_in_topics(c.model_topic_words, c.bidict, ["model_id"], 50)
    return shares.withColumn("proportion", six("proportion"))


@query(
    "concept_corpus",
    """SELECT model_id, doc_id, lang, array_to_string(list(concept ORDER BY pos), ' ') AS words FROM (
      SELECT m.model_id, doc_id, t.lang, pos, coalesce('#' || d.seq, t.lang || ':' || t.word) AS concept FROM tok t JOIN models m USING (lang)
      LEFT JOIN (SELECT model_id, 'en' AS lang, src_word AS word, seq FROM dict
        UNION ALL SELECT model_id, model_id[4:], tgt_word, seq FROM dict) d ON d.model_id = m.model_id AND d.lang = t.lang AND d.word = t.word)
    GROUP BY model_id, doc_id, lang""",
)
def concept_corpus(c: Corpus):
    """The concept form of the documents of every model."""
    bidict = store(matching.dedupe_bidict(c.bidict, ["model_id"]), "bidict")
    rows = None
    for model in MODELS:
        pairs = bidict.filter(F.col("model_id") == model)
        part = matching.concept_corpus(c.docs, pairs, SOURCE, model.removeprefix(f"{SOURCE}-"))
        part = as_text(part.withColumn("model_id", F.lit(model)), "model_id", "doc_id", "lang")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- dictionary coverage ----------------------------------------------------------------


RANKS_SQL = """ranks AS (SELECT model_id, side, word, r FROM rnk JOIN models USING (lang)),
matched AS (SELECT d.model_id, d.seq, (s.r + t.r) / 2.0 AS avg_rank FROM dict d
  JOIN ranks s ON s.model_id = d.model_id AND s.side = 'src' AND s.word = src_word
  JOIN ranks t ON t.model_id = d.model_id AND t.side = 'tgt' AND t.word = tgt_word),
larger AS (SELECT model_id, max(n) AS n FROM (SELECT model_id, side, count(*) AS n FROM ranks GROUP BY ALL) GROUP BY ALL)"""


def model_ranks(c: Corpus):
    return per_model(c.ranks).select("model_id", "side", "word", F.col("r").alias("freq_rank"))


@query(
    "dictionary_rank_coverage",
    """SELECT model_id, count(*) AS n_pairs, round(avg(avg_rank) / any_value(n) + 1e-9, 6) + 0.0 AS rank_coverage
    FROM matched JOIN larger USING (model_id) GROUP BY model_id""",
    views=RANKS_SQL,
)
def dictionary_rank_coverage(c: Corpus):
    rows = dictionaries.dictionary_rank_coverage(c.bidict, model_ranks(c), ["model_id"])
    return rows.withColumn("rank_coverage", six("rank_coverage"))


@query(
    "dictionary_rank_coverage_slice",
    """SELECT model_id, count(*) AS n_pairs, round(avg(avg_rank) / any_value(n) + 1e-9, 6) + 0.0 AS rank_coverage
    FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY seq) - 1 AS place FROM matched WHERE avg_rank < 2100)
    JOIN larger USING (model_id) WHERE place >= 800 AND place < 3800 GROUP BY model_id""",
    views=RANKS_SQL,
)
def dictionary_rank_coverage_slice(c: Corpus):
    rows = dictionaries.dictionary_rank_coverage(
        c.bidict, model_ranks(c), ["model_id"], positions=(800, 3800), max_avg_rank=2100
    )
    return rows.withColumn("rank_coverage", six("rank_coverage"))


@query(
    "dictionary_coverage",
    """SELECT model_id, n_covered, n_words, round(n_covered / n_words + 1e-9, 6) + 0.0 AS coverage FROM (
      SELECT model_id, count(DISTINCT src_word) AS n_covered FROM dict
      WHERE (model_id, src_word) IN (SELECT model_id, word FROM mvec WHERE side = 'src')
        AND (model_id, tgt_word) IN (SELECT model_id, word FROM mvec WHERE side = 'tgt') GROUP BY model_id)
    JOIN (SELECT model_id, count(*) AS n_words FROM mvec GROUP BY model_id) USING (model_id)""",
)
def dictionary_coverage(c: Corpus):
    found = matching.bidict_in_vocab(keyed_bidict(c), per_side(c, "src"), per_side(c, "tgt"))
    covered = found.withColumn("model_id", F.substring_index("src_word", ":", 1))
    rows = dictionaries.dictionary_coverage(covered, c.model_vectors, ["model_id"])
    return rows.withColumn("coverage", six("coverage"))


# --- ranking, sampling, sizes -----------------------------------------------------------


@query("top_words_per_topic", "SELECT topic_id, lang, rank, word, weight FROM topic")
def top_words_per_topic(c: Corpus):
    top = topics.top_words_per_topic(c.phi, ["topic_id", "lang"], 50)
    return top.select("topic_id", "lang", F.col("rank").cast("long").alias("rank"), "word", "weight")


@query(
    "split_topics_by_language",
    r"""SELECT model_id, topic_id, side, word,
      row_number() OVER (PARTITION BY model_id, topic_id, side ORDER BY rank) AS rank FROM (
        SELECT *, CASE WHEN regexp_matches(word, '[^\x00-\x7F]') THEN 'other' ELSE 'en' END AS side FROM mixed)""",
)
def split_topics_by_language(c: Corpus):
    split = topics.split_topics_by_language(c.mixed_topic_words, ["model_id", "topic_id"], binary=True)
    return split.select("model_id", "topic_id", "side", "word", F.col("rank").cast("long").alias("rank"))


@query(
    "split_topics_by_script",
    r"""SELECT model_id, topic_id, 'en' AS side, word,
      row_number() OVER (PARTITION BY model_id, topic_id ORDER BY rank) AS rank FROM mixed
    WHERE NOT regexp_matches(word, '[^\x00-\x7F]')""",
)
def split_topics_by_script(c: Corpus):
    split = topics.split_topics_by_language(c.mixed_topic_words, ["model_id", "topic_id"])
    return split.select("model_id", "topic_id", "side", "word", F.col("rank").cast("long").alias("rank"))


@query(
    "split_concept_topics",
    """SELECT topic_id, side, word, row_number() OVER (PARTITION BY topic_id, side ORDER BY rank) AS rank FROM (
      SELECT topic_id, rank, 'src' AS side, coalesce(s.src_word, m.word) AS word FROM ranked m
        LEFT JOIN pairs s ON s.name = m.name WHERE s.seq IS NOT NULL OR m.lang = 'en'
      UNION ALL SELECT topic_id, rank, 'tgt', coalesce(s.tgt_word, m.word) FROM ranked m
        LEFT JOIN pairs s ON s.name = m.name WHERE s.seq IS NOT NULL OR m.lang = 'fr')""",
    views="""pairs AS (SELECT seq, src_word, tgt_word, '#' || seq AS name FROM dict WHERE model_id = 'en-fr'),
    concepts AS (SELECT 'en' AS lang, src_word AS word, name FROM pairs UNION ALL SELECT 'fr', tgt_word, name FROM pairs),
    ranked AS (SELECT topic_id, lang, word, coalesce(name, lang || ':' || word) AS name,
      row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, lang, word) AS rank
      FROM topic LEFT JOIN concepts USING (lang, word) WHERE lang IN ('en', 'fr'))""",
)
def split_concept_topics(c: Corpus):
    concepts = matching.dedupe_bidict(c.bidict.filter("model_id = 'en-fr'")).withColumn(
        "concept", F.concat(F.lit("#"), F.col("seq").cast("string"))
    )
    names = concepts.select(F.lit(SOURCE).alias("lang"), F.col("src_word").alias("word"), "concept").unionByName(
        concepts.select(F.lit("fr").alias("lang"), F.col("tgt_word").alias("word"), "concept")
    )
    order = W.partitionBy("topic_id").orderBy(F.desc("weight"), "lang", "word")
    ranked = (
        c.topic_words.filter(F.col("lang").isin(SOURCE, "fr"))
        .join(names, ["lang", "word"], "left")
        .select("topic_id", F.row_number().over(order).alias("rank"), F.coalesce("concept", F.concat_ws(":", "lang", "word")).alias("word"))
    )
    split = topics.split_concept_topics(ranked, concepts, ["topic_id"], SOURCE)
    return split.select("topic_id", "side", "word", F.col("rank").cast("long").alias("rank"))


@query(
    "crosslingual_topics",
    """SELECT model_id, topic_id FROM mtopic GROUP BY ALL HAVING count(DISTINCT side) = 2""",
)
def crosslingual_topics(c: Corpus):
    return metrics.crosslingual_topics(c.model_topic_words)


SHUFFLE_SQL = """SELECT doc_id, lang,
  row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS shuffled_seq,
  row_number() OVER (PARTITION BY lang ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS lang_seq FROM documents"""


@query("shuffle_corpus", SHUFFLE_SQL.format(seed=168))
def shuffle_corpus(c: Corpus):
    return dictionaries.shuffle_corpus(c.documents.select("doc_id", "lang"), 168)


@query("shuffle_corpus_second_seed", SHUFFLE_SQL.format(seed=666))
def shuffle_corpus_second_seed(c: Corpus):
    return dictionaries.shuffle_corpus(c.documents.select("doc_id", "lang"), 666)


SPLIT_SQL = """SELECT model_id, seq, CASE WHEN row_number() OVER (PARTITION BY model_id ORDER BY seq) - 1
    < floor(count(*) OVER (PARTITION BY model_id) * (1 - 0.1::DOUBLE))::BIGINT + {extra} THEN 'train' ELSE 'test' END AS part FROM dict"""


@query("split_dictionary", SPLIT_SQL.format(extra=1))
def split_dictionary(c: Corpus):
    return dictionaries.split_dictionary(c.bidict, ["model_id"]).select("model_id", "seq", "part")


@query("split_dictionary_strict", SPLIT_SQL.format(extra=0))
def split_dictionary_strict(c: Corpus):
    return dictionaries.split_dictionary(c.bidict, ["model_id"], strict_count=True).select("model_id", "seq", "part")


@query("sample_vectors", "SELECT lang, word, vec_id FROM vec ORDER BY md5('7:' || lang || ':' || word) LIMIT 100")
def sample_vectors(c: Corpus):
    return dictionaries.sample_vectors(c.vectors, 100, 7).select("lang", "word", "vec_id")


@query(
    "nested_size_corpora",
    "SELECT model_id, corpus_size, pair_id FROM pair, (SELECT unnest([25, 50, 100, 200, 400]) AS corpus_size) WHERE pair_id < corpus_size",
)
def nested_size_corpora(c: Corpus):
    nested = dictionaries.nested_size_corpora(c.pairs, [25, 50, 100, 200, 400], "pair_id")
    return nested.select("model_id", F.col("corpus_size").cast("int").alias("corpus_size"), "pair_id")
