"""Derived views of the given tables: the inputs every operator is run on.

The tables hold no parallel pairs, dictionary, named vectors or trained models, so these are
derived from whole tables. Source language is ``en``; each other language is one model
``en-<lang>``, keyed by ``model_id``. ``PRELUDE`` states the same views for the SQL check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.operators import matching, tokens, topics
from lingospan.storage import spread_scan, store

LANGUAGES = ("de", "en", "es", "fr")
SOURCE = "en"
MODELS = tuple(f"{SOURCE}-{lang}" for lang in LANGUAGES if lang != SOURCE)
TOP_WORDS = 50

PRELUDE = r"""
WITH docs AS (
  SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS toks FROM documents),
tok AS (
  SELECT doc_id, lang, source, unnest(toks) AS word,
         (generate_subscripts(toks, 1) - 1)::BIGINT AS pos FROM docs),
bow AS (SELECT doc_id, lang, source, word, count(*) AS tf FROM tok GROUP BY ALL),
freq AS (SELECT lang, word, sum(tf)::BIGINT AS cf, count(*) AS df FROM bow GROUP BY ALL),
rnk AS (
  SELECT lang, word, cf, row_number() OVER (PARTITION BY lang ORDER BY cf DESC, word) - 1 AS r
  FROM freq),
nth AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pair_id
  FROM documents),
pair AS (
  SELECT 'en-' || t.lang AS model_id, pair_id, e.doc_id AS src_doc, t.doc_id AS tgt_doc
  FROM nth e JOIN nth t USING (pair_id) WHERE e.lang = 'en' AND t.lang <> 'en'),
vec AS (
  SELECT lang, word, r AS idx, embedding AS vec, label, vec_id FROM rnk JOIN embeddings
  ON vec_id = 4 * r + CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END),
models AS (
  SELECT lang, 'en-' || lang AS model_id, 'tgt' AS side
  FROM (SELECT unnest(['de', 'es', 'fr']) AS lang)
  UNION ALL SELECT 'en', unnest(['en-de', 'en-es', 'en-fr']), 'src'),
mvec AS (SELECT model_id, side, vec.* FROM vec JOIN models USING (lang)),
dict AS (
  SELECT 'en-' || lang AS model_id, r AS seq, src_word, word AS tgt_word FROM (
    SELECT lang, word, r, max(CASE WHEN lang = 'en' THEN word END) OVER (PARTITION BY r) AS src_word FROM rnk)
  WHERE lang <> 'en' AND src_word IS NOT NULL),
phi AS (
  SELECT source AS topic_id, lang, word, sum(tf)::DOUBLE AS weight FROM bow GROUP BY ALL),
topic AS (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY topic_id, lang ORDER BY weight DESC, word) AS rank FROM phi)
  WHERE rank <= 50),
mphi AS (SELECT model_id, side, phi.* FROM phi JOIN models USING (lang)),
mtopic AS (SELECT model_id, side, topic.* FROM topic JOIN models USING (lang)),
mixed AS (
  SELECT model_id, topic_id, lang, word,
         row_number() OVER (PARTITION BY model_id, topic_id ORDER BY rank, side, word) AS rank
  FROM mtopic),
theta AS (
  SELECT doc_id, lang, topic_id, w, w / sum(w) OVER (PARTITION BY doc_id) AS theta FROM (
    SELECT b.doc_id, b.lang, t.topic_id, sum(b.tf * t.weight) AS w
    FROM bow b JOIN phi t USING (lang, word) GROUP BY ALL)),
side_docs AS (
  SELECT model_id, pair_id, 0 AS side_no, src_doc AS doc_id FROM pair
  UNION ALL SELECT model_id, pair_id, 1, tgt_doc FROM pair),
mdocs AS (
  SELECT model_id, pair_id, side_no, doc_id, lang, toks FROM side_docs JOIN docs USING (doc_id)),
split AS (
  SELECT doc_id, lang, quality AS class,
         CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'a' THEN 'train'
              WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'd' THEN 'dev' ELSE 'test' END AS data_type
  FROM documents JOIN labels USING (doc_id))
"""


def lang_number(lang: Column) -> Column:
    return F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).otherwise(3)


def model_side(lang: Column) -> Column:
    return F.when(lang == SOURCE, "src").otherwise("tgt")


def per_model(df: DataFrame) -> DataFrame:
    """Add ``model_id`` and ``side``: source-language rows belong to every model."""
    all_models = F.array(*[F.lit(m) for m in MODELS])
    own = F.array(F.concat_ws("-", F.lit(SOURCE), "lang"))
    chosen = F.when(F.col("lang") == SOURCE, all_models).otherwise(own)
    return df.withColumn("model_id", F.explode(chosen)).withColumn("side", model_side(F.col("lang")))


class Corpus:
    """The derived views of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._built: dict[str, object] = {}

    def once(self, name: str, build):
        """The result of a training that several queries of one corpus look at."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def texts(self) -> DataFrame:
        return spread_scan(self.documents, "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return spread_scan(self.table("pages"), "page_id")

    @cached_property
    def docs(self) -> DataFrame:
        """``(doc_id, lang, source, tokens)``"""
        return tokens.with_tokens(self.texts.select("doc_id", "lang", "source", "text"))

    @cached_property
    def bow(self) -> DataFrame:
        return tokens.bag_of_words(self.docs, ["doc_id", "lang", "source"])

    @cached_property
    def ranks(self) -> DataFrame:
        """``(lang, word, cf, r)``"""
        return tokens.rank_by_count(tokens.corpus_frequency(self.docs)).select("lang", "word", "cf", "r")

    @cached_property
    def pairs(self) -> DataFrame:
        return matching.corpus_pairs(self.documents, SOURCE).withColumn(
            "model_id", F.concat_ws("-", F.lit(SOURCE), "model_id")
        )

    @cached_property
    def pair_members(self) -> DataFrame:
        """``(model_id, pair_id, side_no, doc_id)``: the documents of every pair."""
        sides = F.array(
            F.struct(F.lit(0).alias("side_no"), F.col("src_doc").alias("doc_id")),
            F.struct(F.lit(1).alias("side_no"), F.col("tgt_doc").alias("doc_id")),
        )
        return self.pairs.select("model_id", "pair_id", F.inline(sides))

    @cached_property
    def pair_docs(self) -> DataFrame:
        """``(model_id, pair_id, side_no, doc_id, lang, tokens)``: both sides of every pair."""
        return self.pair_members.join(self.docs.select("doc_id", "lang", "tokens"), "doc_id")

    @cached_property
    def n_pairs(self) -> DataFrame:
        return self.pairs.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_docs"))

    @cached_property
    def vectors(self) -> DataFrame:
        """``(lang, word, idx, vec, label, vec_id)``: a stored table, as vectors always are."""
        keyed = self.ranks.withColumn("vec_id", 4 * F.col("r") + lang_number(F.col("lang")))
        named = keyed.join(self.table("embeddings"), "vec_id").select(
            "lang", "word", F.col("r").alias("idx"), F.col("embedding").alias("vec"), "label", "vec_id"
        )
        return store(named, "vectors")

    @cached_property
    def n_vectors(self) -> int:
        return self.vectors.count()

    @cached_property
    def model_vectors(self) -> DataFrame:
        return per_model(self.vectors)

    @cached_property
    def bidict(self) -> DataFrame:
        """``(model_id, seq, src_word, tgt_word)``"""
        ranks = self.ranks
        src = ranks.filter(F.col("lang") == SOURCE).select(F.col("r").alias("seq"), F.col("word").alias("src_word"))
        tgt = ranks.filter(F.col("lang") != SOURCE).select(
            F.col("r").alias("seq"),
            F.col("word").alias("tgt_word"),
            F.concat_ws("-", F.lit(SOURCE), "lang").alias("model_id"),
        )
        return src.join(tgt, "seq").select("model_id", "seq", "src_word", "tgt_word")

    def docs_of(self, ids: DataFrame) -> DataFrame:
        """The rows of ``docs`` that ``ids(doc_id, …)`` name, chosen before a text is tokenised."""
        chosen = store(ids.select("doc_id").distinct(), "chosen")
        if matching.table_bytes(chosen) <= matching.BROADCAST_BYTES:
            chosen = F.broadcast(chosen)
        texts = self.documents.select("doc_id", "lang", "source", "text").join(chosen, "doc_id", "left_semi")
        if self.texts is not self.documents:
            texts = texts.repartition(self.spark.sparkContext.defaultParallelism, "doc_id")
        return tokens.with_tokens(texts)

    @cached_property
    def phi(self) -> DataFrame:
        """``(topic_id, lang, word, weight)``: the document source stands for the topic.

        Stored, as a trained model is: topic words and document weights are read from one count of the corpus.
        """
        return store(self._phi(tokens.corpus_frequency(self.docs, ["source", "lang"])), "phi")

    def _phi(self, counts: DataFrame) -> DataFrame:
        return counts.select(F.col("source").alias("topic_id"), "lang", "word", F.col("cf").cast("double").alias("weight"))

    def phi_of(self, docs: DataFrame) -> DataFrame:
        """The rows of ``phi`` for the words of some documents, counted over the whole corpus."""
        words = tokens.distinct_terms(docs, ["lang"]).distinct()
        rows = tokens.explode_tokens(self.docs, ["doc_id", "source", "lang"])
        met = matching.lookup_join(rows, words, ["lang", "word"], "doc_id", "left_semi")
        return self._phi(met.groupBy("source", "lang", "word").agg(F.count(F.lit(1)).alias("cf")))

    @cached_property
    def topic_ids(self) -> list[str]:
        return sorted(r[0] for r in self.documents.select("source").distinct().collect())

    @cached_property
    def topic_words(self) -> DataFrame:
        """Top words of every topic and language, stored like a saved model."""
        top = topics.top_words_per_topic(self.phi, ["topic_id", "lang"], TOP_WORDS)
        return store(top, "topic-words")

    @cached_property
    def model_topic_words(self) -> DataFrame:
        return per_model(self.topic_words)

    @cached_property
    def mixed_topic_words(self) -> DataFrame:
        """One ranked list per model and topic with the words of both languages."""
        order = W.partitionBy("model_id", "topic_id").orderBy("rank", "side", "word")
        return self.model_topic_words.withColumn("rank", F.row_number().over(order)).select(
            "model_id", "topic_id", "lang", "word", "rank"
        )

    @cached_property
    def theta(self) -> DataFrame:
        """``(doc_id, lang, theta)`` with one weight per topic id, summing to one.

        A given theta file has a row for each document that was trained on, so documents
        without any word have none here.
        """
        return self.theta_of(self.docs, self.phi)

    def theta_of(self, docs: DataFrame, phi: DataFrame) -> DataFrame:
        """The rows of ``theta`` for some documents."""
        trained = docs.filter(F.size("tokens") > 0)
        bow = tokens.bag_of_words(docs, ["doc_id", "lang", "source"])
        return topics.normalise_theta(topics.theta_from_phi(trained, bow, phi, self.topic_ids))

    @cached_property
    def theta_cells(self) -> DataFrame:
        """Long form ``(doc_id, lang, topic_id, weight)`` of the non-zero weights."""
        names = F.array(*[F.lit(t) for t in self.topic_ids])
        cells = F.arrays_zip(names.alias("topic_id"), F.col("theta").alias("weight"))
        rows = self.theta.select("doc_id", "lang", F.inline(cells).alias("topic_id", "weight"))
        return rows.filter(F.col("weight") > 0)

    @cached_property
    def split(self) -> DataFrame:
        """Labelled corpus ``(doc_id, lang, class, data_type)``."""
        digit = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
        part = F.when(digit < "a", "train").when(digit < "d", "dev").otherwise("test")
        return (
            self.documents.select("doc_id", "lang")
            .join(self.table("labels"), "doc_id")
            .select("doc_id", "lang", F.col("quality").alias("class"), part.alias("data_type"))
        )
