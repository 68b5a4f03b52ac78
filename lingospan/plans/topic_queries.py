"""Topic models and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.operators import anchors, classification, cooccurrence, gibbs, matching, metrics, polylingual, tokens, topics
from lingospan.operators.sequence import number_by_id
from lingospan.plans.corpus import LANGUAGES, MODELS, SOURCE, Corpus, per_model
from lingospan.plans.mapping import save_models, sweep_scores, topic_mapping_flow, topic_sweep
from lingospan.plans.registry import query, six
from lingospan.plans.vector_queries import WIDTH
from lingospan.sources import readers
from lingospan.storage import scratch_path, store

KS = (10, 20, 30, 40, 50)

# --- training ---------------------------------------------------------------------------


ROUNDS, SHARED_ROUNDS, SHARD_TOKENS = 4, 10, 100_000


def sampled(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One sampled model per language: phi, theta and history."""
    return c.once("sampled", lambda: gibbs.lda_gibbs(c.docs, 10, rounds=ROUNDS, shard_tokens=SHARD_TOKENS))


def shared(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One model per language pair, the documents of a pair sharing their topic weights."""
    return c.once("shared", lambda: polylingual.lda_shared(c.pair_docs, 10, rounds=SHARED_ROUNDS, shard_tokens=SHARD_TOKENS))


@query("lda_monolingual")
def lda_monolingual(c: Corpus):
    """Top words of one sampled model per language."""
    phi, _, _ = sampled(c)
    top = topics.top_words_per_topic(phi, ["lang", "topic_id"], 20)
    return top.select("lang", "topic_id", "rank", "word", "weight")


@query(
    "lda_monolingual_counts",
    f"""SELECT lang, round, count(*) AS tokens, true AS better FROM tok,
      (SELECT unnest(range(1, {ROUNDS} + 2))::INTEGER AS round) GROUP BY ALL""",
)
def lda_monolingual_counts(c: Corpus):
    """Tokens in the counts of every round, and whether they are likelier than at the random start."""
    _, _, history = sampled(c)
    first = history.filter("round = 1").select("lang", F.col("log_likelihood").alias("start"))
    better = (F.col("round") == 1) | (F.col("log_likelihood") > F.col("start"))
    return history.join(first, "lang").select("lang", "round", "tokens", better.alias("better"))


@query("lda_monolingual_theta", "SELECT doc_id, lang, 10 AS topics, 1.0::DOUBLE AS total FROM docs WHERE len(toks) > 0")
def lda_monolingual_theta(c: Corpus):
    """Topics and total weight of every document with a token."""
    _, theta, _ = sampled(c)
    total = F.aggregate("theta", F.lit(0.0), lambda a, x: a + x)
    return theta.select("doc_id", "lang", F.size("theta").alias("topics"), six(total).alias("total"))


@query("lda_polylingual")
def lda_polylingual(c: Corpus):
    """Top words per model and language; the documents of a pair share their topic weights."""
    phi, _, _, _ = shared(c)
    top = topics.top_words_per_topic(phi, ["model_id", "lang", "topic_id"], 20)
    return top.select("model_id", "lang", "topic_id", "rank", "word", "weight")


@query(
    "lda_polylingual_mass",
    """SELECT model_id, lang, sum(len(toks))::DOUBLE AS tokens, 0::BIGINT AS falls FROM mdocs
    GROUP BY ALL HAVING sum(len(toks)) > 0""",
)
def lda_polylingual_mass(c: Corpus):
    """Expected counts of every model and language, and how often its bound fell."""
    _, _, history, mass = shared(c)
    before = F.lag("bound").over(W.partitionBy("model_id").orderBy("round"))
    fell = history.withColumn("fell", F.coalesce(F.col("bound") < before - 1e-9 * F.abs(before), F.lit(False)))
    falls = fell.groupBy("model_id").agg(F.sum(F.col("fell").cast("long")).alias("falls"))
    return mass.join(falls, "model_id").select("model_id", "lang", F.round("tokens", 3).alias("tokens"), "falls")


@query("lda_polylingual_phi", """SELECT model_id, lang, topic_id, count(DISTINCT word) AS words, 1.0::DOUBLE AS total
    FROM (SELECT model_id, lang, unnest(toks) AS word FROM mdocs), (SELECT unnest(range(0, 10))::INTEGER AS topic_id) GROUP BY ALL""")
def lda_polylingual_phi(c: Corpus):
    """Words and total weight of every topic of every model and language."""
    phi, _, _, _ = shared(c)
    sums = phi.groupBy("model_id", "lang", "topic_id").agg(F.count(F.lit(1)).alias("words"), F.sum("weight").alias("total"))
    return sums.withColumn("total", six("total"))


@query("lda_joint_concept")
def lda_joint_concept(c: Corpus):
    """Top words per language of every model over shared concepts."""
    bidict = store(matching.dedupe_bidict(c.bidict, ["model_id"]), "bidict")
    docs = None
    for model in MODELS:
        part = matching.concept_corpus(c.docs, bidict.filter(F.col("model_id") == model), SOURCE, model.removeprefix(f"{SOURCE}-"))
        part = part.withColumn("model_id", F.lit(model))
        docs = part if docs is None else docs.unionByName(part)
    phi, _, _ = gibbs.lda_gibbs(docs, 10, ["model_id"], rounds=ROUNDS, shard_tokens=SHARD_TOKENS)
    top = topics.top_words_per_topic(phi, ["model_id", "topic_id"], 50)
    concepts = bidict.withColumn("concept", F.concat(F.lit("#"), F.col("seq").cast("string")))
    return topics.split_concept_topics(top, concepts, ["model_id", "topic_id"], SOURCE, ["model_id"])


# --- anchor words -----------------------------------------------------------------------


def anchor_model(c: Corpus) -> DataFrame:
    """Topics of every model from anchor pairs of its dictionary."""
    return c.once("anchors", lambda: _anchor_model(c))


def _anchor_model(c: Corpus) -> DataFrame:
    target = F.expr("substring(model_id, 4)")
    links = c.bidict.select("model_id", F.lit(SOURCE).alias("src_lang"), "src_word", target.alias("tgt_lang"), "tgt_word")
    phi, _ = anchors.anchor_topics(c.docs, links, 10, shard_tokens=SHARD_TOKENS)
    return phi


@query("anchor_topics")
def anchor_topics(c: Corpus):
    """Top words of every topic on both sides of every model."""
    top = topics.top_words_per_topic(anchor_model(c), ["model_id", "lang", "topic_id"], 20)
    return top.select("model_id", "lang", "topic_id", "rank", "word", "weight")


@query(
    "anchor_topics_phi",
    """SELECT model_id, lang, topic_id, count(DISTINCT word) AS words, 1.0::DOUBLE AS total
    FROM (SELECT lang, unnest(toks) AS word FROM docs WHERE len(toks) > 1) JOIN models USING (lang),
      (SELECT unnest(range(0, 10))::INTEGER AS topic_id) GROUP BY ALL""",
)
def anchor_topics_phi(c: Corpus):
    """Words and total weight of every topic."""
    sums = anchor_model(c).groupBy("model_id", "lang", "topic_id").agg(F.count(F.lit(1)).alias("words"), F.sum("weight").alias("total"))
    return sums.withColumn("total", six("total"))


# --- centroids, clusters, weights -------------------------------------------------------


@query(
    "topic_centroids",
    """SELECT topic_id, lang, i - 1 AS dim, round(avg(x) + 1e-9, 6) + 0.0 AS x FROM (
      SELECT topic_id, lang, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS i
      FROM topic JOIN vec USING (lang, word) WHERE rank <= 10) GROUP BY ALL""",
)
def topic_centroids(c: Corpus):
    centres = topics.topic_centroids(c.topic_words, c.vectors, ["topic_id", "lang"], 10)
    return centres.select("topic_id", "lang", F.posexplode("vec").alias("dim", "x")).select(
        "topic_id", "lang", F.col("dim").cast("long").alias("dim"), six("x").alias("x")
    )


@query("cluster_topics_crosslingual")
def cluster_topics_crosslingual(c: Corpus):
    centres = topics.topic_centroids(c.model_topic_words, c.vectors, ["model_id", "side", "topic_id"], 10)
    return topics.cluster_topics_crosslingual(centres, 20)


@query(
    "cluster_topics_partition",
    """SELECT model_id, side, topic_id, 1::BIGINT AS clusters FROM mtopic JOIN vec USING (lang, word) WHERE mtopic.rank <= 10 GROUP BY ALL""",
)
def cluster_topics_partition(c: Corpus):
    """In how many clusters every topic with a centroid is."""
    centres = topics.topic_centroids(c.model_topic_words, c.vectors, ["model_id", "side", "topic_id"], 10)
    found = topics.cluster_topics_crosslingual(centres, 20)
    return found.groupBy("model_id", "side", "topic_id").agg(F.count_distinct("cluster_id").alias("clusters"))


def given_map(c: Corpus) -> DataFrame:
    """A given grouping of topics: the last digit of the source number."""
    cluster = F.expr("cast(substring(topic_id, 4) as int) % 7")
    ids = c.spark.createDataFrame([(t,) for t in c.topic_ids], "topic_id string")
    sides = F.explode(F.array(F.lit("src"), F.lit("tgt")))
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    return ids.select(models.alias("model_id"), "topic_id", cluster.alias("cluster_id")).select("*", sides.alias("side"))


MAP_SQL = "substr(topic_id, 4)::INTEGER % 7 AS cluster_id"


@query(
    "merge_topic_words",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, cluster_id, side
      ORDER BY weight DESC, word)::INTEGER AS rank FROM (
        SELECT model_id, side, {MAP_SQL}, lang, word, sum(weight) AS weight FROM mphi GROUP BY ALL)) WHERE rank <= 20""",
)
def merge_topic_words(c: Corpus):
    return topics.merge_topic_words(per_model(c.phi), given_map(c), 20)


@query(
    "merge_theta",
    f"SELECT model_id, side, doc_id, cluster_id, round(w + 1e-9, 6) + 0.0 AS weight FROM (SELECT model_id, side, doc_id, {MAP_SQL}, sum(theta) AS w FROM theta JOIN models USING (lang) GROUP BY ALL)",
)
def merge_theta(c: Corpus):
    merged = topics.merge_theta(per_model(c.theta_cells), given_map(c))
    return merged.withColumn("weight", six("weight"))


@query("topic_mapping_flow")
def topic_mapping_flow_query(c: Corpus):
    """Merged top words of every model."""
    theta = per_model(c.theta_cells)
    phi = store(per_model(c.phi), "model-phi")
    _, words, _ = topic_mapping_flow(phi, theta, c.vectors, top_p=10, n_clusters=20, top_n=20)
    return words


@query(
    "theta_from_phi",
    """SELECT d.doc_id, d.lang, t.topic_id, coalesce(h.w, 0)::DOUBLE AS weight FROM documents d
    CROSS JOIN (SELECT DISTINCT source AS topic_id FROM documents) t
    LEFT JOIN theta h ON h.doc_id = d.doc_id AND h.topic_id = t.topic_id""",
)
def theta_from_phi(c: Corpus):
    """Every document with every topic, those without a known word included."""
    theta = topics.theta_from_phi(c.docs, c.bow, c.phi, c.topic_ids)
    names = F.array(*[F.lit(t) for t in c.topic_ids])
    return theta.select("doc_id", "lang", F.inline(F.arrays_zip(names, "theta")).alias("topic_id", "weight"))


RHO_SQL = """rho AS (SELECT s.model_id, substr(s.topic_id, 4)::INTEGER AS src_topic, substr(t.topic_id, 4)::INTEGER AS tgt_topic,
  count(*)::DOUBLE AS w FROM mtopic s JOIN mtopic t ON s.model_id = t.model_id AND s.rank = t.rank
    AND length(s.word) = length(t.word)
  WHERE s.side = 'src' AND t.side = 'tgt' GROUP BY ALL)"""


def rho(c: Corpus) -> DataFrame:
    """Given links: ranks at which two topics hold words of equal length."""
    rows = c.model_topic_words.select(
        "model_id", "side", F.expr("cast(substring(topic_id, 4) as int)").alias("topic"), "rank", F.char_length("word").alias("n")
    )
    src = rows.filter("side = 'src'").select("model_id", F.col("topic").alias("src_topic"), "rank", "n")
    tgt = rows.filter("side = 'tgt'").select("model_id", F.col("topic").alias("tgt_topic"), "rank", "n")
    linked = src.join(tgt, ["model_id", "rank", "n"]).groupBy("model_id", "src_topic", "tgt_topic")
    return linked.agg(F.count(F.lit(1)).cast("double").alias("w"))


@query(
    "align_topics_by_rho",
    "SELECT model_id, src_topic, tgt_topic FROM (SELECT *, row_number() OVER (PARTITION BY model_id, src_topic ORDER BY w DESC, tgt_topic) AS n FROM rho) WHERE n = 1",
    views=RHO_SQL,
)
def align_topics_by_rho(c: Corpus):
    return topics.align_topics_by_rho(rho(c))


@query(
    "map_theta_by_rho",
    """SELECT r.model_id, doc_id, src_topic, round(sum(w * theta) + 1e-9, 6) + 0.0 AS weight FROM rho r
    JOIN (SELECT 'en-' || lang AS model_id, doc_id, substr(topic_id, 4)::INTEGER AS tgt_topic, theta FROM theta WHERE lang <> 'en') t
    USING (model_id, tgt_topic) GROUP BY ALL""",
    views=RHO_SQL.replace("AS w FROM", "AS w FROM"),
)
def map_theta_by_rho(c: Corpus):
    theta = per_model(c.theta_cells.filter(F.col("lang") != SOURCE)).select(
        "model_id", "doc_id", F.expr("cast(substring(topic_id, 4) as int)").alias("tgt_topic"), "weight"
    )
    return topics.map_theta_by_rho(theta, rho(c)).withColumn("weight", six("weight"))


@query(
    "model_sweep",
    """SELECT model_id, k, side, count(*) AS n_words, count(DISTINCT word) AS n_types
    FROM mtopic, (SELECT unnest([10, 20, 30, 40, 50]) AS k) WHERE rank <= k GROUP BY ALL""",
)
def model_sweep(c: Corpus):
    """Vocabulary of every model at every list length."""
    models = c.model_topic_words.select("model_id").distinct()
    grid = topics.model_grid(models, k=KS)
    rows = c.model_topic_words.join(grid, "model_id").filter(F.col("rank") <= F.col("k"))
    return rows.groupBy("model_id", "k", "side").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_distinct("word").alias("n_types")
    )


SWEEP_TOPICS, SWEEP_DIMS, SWEEP_KS = (5, 10), (48, 64), (10, 20)
SWEEP_SCORES = ("umass", "npmi", "diversity", "unique_share", "similarity")


def sweep(c: Corpus) -> DataFrame:
    """Scores of topic models of two sizes, linked by vectors with all dimensions and with the first ones left out."""
    return c.once("sweep", lambda: _sweep(c))


def _sweep(c: Corpus) -> DataFrame:
    sides = per_model(c.spark.createDataFrame([(lang,) for lang in LANGUAGES], "lang string")).withColumnRenamed("model_id", "pair_model")
    dims = F.explode(F.array(*[F.lit(d) for d in SWEEP_DIMS])).alias("dims")
    spaces = c.vectors.select("lang", "word", "vec", dims)
    spaces = store(spaces.withColumn("vec", F.slice("vec", WIDTH - F.col("dims") + 1, F.col("dims"))), "spaces")
    words, theta = topic_sweep(c.docs, sides, spaces, SWEEP_TOPICS, rounds=3, shard_tokens=SHARD_TOKENS)
    path = scratch_path(c.spark, "models")
    save_models(words, path)
    words = c.spark.read.parquet(path)
    pairs, members = (df.withColumnRenamed("model_id", "pair_model") for df in (c.pairs, c.pair_members))
    return store(sweep_scores(words, store(theta, "sweep-weights"), pairs, c.docs, members, SWEEP_KS), "sweep-scores")


@query("model_sweep_scores")
def model_sweep_scores(c: Corpus):
    """Coherence, diversity and document similarity of every model, number of topics, dimensions and list length."""
    return sweep(c).select("pair_model", "n_topics", "dims", "k", *SWEEP_SCORES)


@query(
    "model_sweep_ranges",
    """SELECT pair_model, n_topics, dims, k, true AS within FROM (SELECT unnest(['en-de', 'en-es', 'en-fr']) AS pair_model),
      (SELECT unnest([5, 10])::INTEGER AS n_topics), (SELECT unnest([48, 64])::INTEGER AS dims), (SELECT unnest([10, 20])::INTEGER AS k)""",
)
def model_sweep_ranges(c: Corpus):
    """Whether the scores of every cell lie where they can: NPMI from -1 to 1, shares and similarity from 0 to 1."""
    low = {"npmi": -1.0, "diversity": 0.0, "unique_share": 0.0, "similarity": 0.0}
    within = F.lit(True)
    for name, least in low.items():
        within = within & F.coalesce(F.col(name).between(least - 1e-9, 1 + 1e-9), F.lit(True))
    return sweep(c).select("pair_model", "n_topics", "dims", "k", within.alias("within"))


# --- co-occurrence and coherence --------------------------------------------------------

PAIR_SQL = """pw AS (SELECT DISTINCT model_id, pair_id, lang, word FROM (
  SELECT model_id, pair_id, lang, unnest(toks) AS word FROM mdocs)),
scored AS (SELECT DISTINCT model_id, lang, word FROM mtopic),
hit AS (SELECT pw.* FROM pw JOIN scored USING (model_id, lang, word)),
df AS (SELECT model_id, lang, word, count(*) AS df FROM hit GROUP BY ALL),
n_docs AS (SELECT model_id, count(*) AS n_docs FROM pair GROUP BY model_id),
co AS (SELECT a.model_id, a.lang AS l1, a.word AS w1, b.lang AS l2, b.word AS w2, count(*) AS n
  FROM hit a JOIN hit b USING (model_id, pair_id) GROUP BY ALL),
cell AS (SELECT s.model_id, s.topic_id, s.rank AS i, t.rank AS j, coalesce(n, 0) AS n, ds.df AS df_src, dt.df AS df_tgt
  FROM mtopic s JOIN mtopic t ON s.model_id = t.model_id AND s.topic_id = t.topic_id AND s.side = 'src' AND t.side = 'tgt'
  JOIN df ds ON ds.model_id = s.model_id AND ds.lang = s.lang AND ds.word = s.word
  JOIN df dt ON dt.model_id = t.model_id AND dt.lang = t.lang AND dt.word = t.word
  LEFT JOIN co ON co.model_id = s.model_id AND l1 = s.lang AND w1 = s.word AND l2 = t.lang AND w2 = t.word),
kcell AS (SELECT cell.*, k, n_docs FROM cell JOIN n_docs USING (model_id), (SELECT unnest([10, 20, 30, 40, 50]) AS k)
  WHERE i <= k AND j <= k)"""
UMASS = "ln((n + 1) / df_tgt)"
NPMI = "ln((n / n_docs + 1e-12::DOUBLE) / ((df_src / n_docs) * (df_tgt / n_docs))) / -ln(n / n_docs + 1e-12::DOUBLE)"
REF_NPMI = "ln(((n + 1e-12::DOUBLE) / n_docs) / ((df_src / n_docs) * (df_tgt / n_docs))) / -ln((n + 1e-12::DOUBLE) / n_docs)"


def coherence_sql(score: str, name: str) -> str:
    return f"""SELECT model_id, k, round(avg(s) + 1e-9, 6) + 0.0 AS {name} FROM (
      SELECT model_id, k, topic_id, avg({score}) AS s FROM kcell GROUP BY ALL) GROUP BY ALL"""


def pair_counts(c: Corpus) -> DataFrame:
    return cooccurrence.topic_pair_counts(c.docs, c.model_topic_words, max(KS), members=c.pair_members)


@query(
    "cooccurrence",
    "SELECT model_id, l1 AS lang1, w1 AS word1, l2 AS lang2, w2 AS word2, n FROM co",
    views=PAIR_SQL,
)
def cooccurrence_query(c: Corpus):
    return cooccurrence.cooccurrence(c.docs, c.model_topic_words, members=c.pair_members).select("model_id", "lang1", "word1", "lang2", "word2", "n")


@query("coherence_umass", coherence_sql(UMASS, "umass"), views=PAIR_SQL)
def coherence_umass(c: Corpus):
    rows = metrics.coherence(pair_counts(c), c.n_pairs, KS, "umass")
    return rows.withColumn("umass", six("umass"))


@query("coherence_npmi", coherence_sql(NPMI, "npmi"), views=PAIR_SQL)
def coherence_npmi(c: Corpus):
    rows = metrics.coherence(pair_counts(c), c.n_pairs, KS, "npmi")
    return rows.withColumn("npmi", six("npmi"))


REFERENCE_SQL = """conv AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM conversations),
rw AS (SELECT DISTINCT conv_id, word FROM conv),
rn AS (SELECT count(DISTINCT conv_id) AS n_docs FROM conversations),
rdf AS (SELECT word, count(*) AS df FROM rw SEMI JOIN mtopic USING (word) GROUP BY word),
rhit AS (SELECT rw.* FROM rw SEMI JOIN mtopic USING (word)),
rco AS (SELECT a.word AS w1, b.word AS w2, count(*) AS n FROM rhit a JOIN rhit b USING (conv_id) GROUP BY ALL),
rcell AS (SELECT s.model_id, s.topic_id, s.rank AS i, t.rank AS j, coalesce(n, 0) AS n, ds.df AS df_src, dt.df AS df_tgt, n_docs
  FROM mtopic s JOIN mtopic t ON s.model_id = t.model_id AND s.topic_id = t.topic_id AND s.side = 'src' AND t.side = 'tgt'
  JOIN rdf ds ON ds.word = s.word JOIN rdf dt ON dt.word = t.word
  LEFT JOIN rco ON w1 = s.word AND w2 = t.word, rn),
rk AS (SELECT unnest([10, 20, 30, 40, 50]) AS k),
rcover AS (SELECT model_id, k, avg(src / k) AS coverage_src, avg(tgt / k) AS coverage_tgt FROM (
  SELECT model_id, k, topic_id, count(df) FILTER (side = 'src') AS src, count(df) FILTER (side = 'tgt') AS tgt
  FROM mtopic LEFT JOIN rdf USING (word), rk WHERE rank <= k GROUP BY ALL) GROUP BY ALL)"""


@query(
    "coherence_npmi_reference",
    f"""SELECT model_id, k, round(npmi + 1e-9, 6) + 0.0 AS npmi, round(npmi_std + 1e-9, 6) + 0.0 AS npmi_std,
      round(coverage_src + 1e-9, 6) + 0.0 AS coverage_src, round(coverage_tgt + 1e-9, 6) + 0.0 AS coverage_tgt
    FROM rcover JOIN (SELECT model_id, k, avg({REF_NPMI}) AS npmi, stddev_pop({REF_NPMI}) AS npmi_std
      FROM rcell, rk WHERE i <= k AND j <= k GROUP BY ALL) USING (model_id, k)""",
    views=REFERENCE_SQL,
)
def coherence_npmi_reference(c: Corpus):
    """Against an external corpus: the conversations, one document per conversation."""
    turns = tokens.with_tokens(c.table("conversations").select("conv_id", F.lit("").alias("lang"), "text"))
    n_docs = turns.agg(F.count_distinct("conv_id").alias("n_docs"))
    models = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    docs = turns.withColumn("model_id", models)
    sizes = n_docs.withColumn("model_id", models)
    counts = cooccurrence.topic_pair_counts(docs, c.model_topic_words, max(KS), "conv_id", ["word"])
    rows = metrics.coherence_npmi_reference(counts, sizes, KS)
    return rows.select("model_id", "k", *[six(n).alias(n) for n in ("npmi", "npmi_std", "coverage_src", "coverage_tgt")])


# --- diversity and language mix ---------------------------------------------------------


@query(
    "crosslingual_proportion",
    r"""SELECT model_id, round(1 - count(*) FILTER (share <= 1 - 0.7::DOUBLE OR share >= 0.7::DOUBLE) / count(*) + 1e-9, 6) + 0.0 AS crosslingual_share
    FROM (SELECT model_id, topic_id, count(*) FILTER (rank <= 100 AND NOT regexp_matches(word, '[^\x00-\x7F]')) / 100::DOUBLE AS share
      FROM mixed GROUP BY ALL) GROUP BY model_id""",
)
def crosslingual_proportion(c: Corpus):
    rows = metrics.crosslingual_proportion(c.mixed_topic_words)
    return rows.withColumn("crosslingual_share", six("crosslingual_share"))


LISTS_SQL = """full_topic AS (SELECT model_id, side, topic_id FROM mtopic GROUP BY ALL HAVING count(*) = 50),
lists AS (SELECT m.model_id, m.side, m.topic_id, k, list(word ORDER BY rank) AS w
  FROM mtopic m SEMI JOIN full_topic USING (model_id, side, topic_id), (SELECT unnest([10, 20, 30, 40, 50]) AS k)
  WHERE rank <= k GROUP BY ALL),
two AS (SELECT a.model_id, a.side, a.k, a.w AS wa, b.w AS wb FROM lists a JOIN lists b
  ON a.model_id = b.model_id AND a.side = b.side AND a.k = b.k AND a.topic_id < b.topic_id)"""


def full_topics(c: Corpus) -> DataFrame:
    """Topic words of the topics that have as many words as the longest list asks for."""
    enough = c.topic_words.groupBy("topic_id", "lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == max(KS))
    return per_model(c.topic_words.join(enough, ["topic_id", "lang"], "left_semi"))


def diversity_sql(similarity: str) -> str:
    return f"""SELECT model_id, k, round(1 - avg({similarity}) + 1e-9, 6) + 0.0 AS diversity,
      round(stddev_pop({similarity}) + 1e-9, 6) + 0.0 AS diversity_std FROM two GROUP BY ALL"""


POSITIONAL = "len(list_filter(range(1, len(wa) + 1), lambda i: wa[i] = wb[i])) / len(wa)"


@query("topic_diversity_positional", diversity_sql(POSITIONAL), views=LISTS_SQL)
def topic_diversity_positional(c: Corpus):
    rows = metrics.topic_diversity_positional(full_topics(c), KS)
    return rows.select("model_id", "k", six("diversity").alias("diversity"), six("diversity_std").alias("diversity_std"))


@query(
    "topic_diversity_jaccard",
    diversity_sql("len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))"),
    views=LISTS_SQL,
)
def topic_diversity_jaccard(c: Corpus):
    rows = metrics.topic_diversity_jaccard(full_topics(c), KS)
    return rows.select("model_id", "k", six("diversity").alias("diversity"), six("diversity_std").alias("diversity_std"))


@query(
    "unique_word_proportion",
    """SELECT model_id, side, k, round(fewest / k + 1e-9, 6) + 0.0 AS unique_share FROM (
      SELECT model_id, side, k, min(len(wa) - len(list_intersect(wa, wb))) AS fewest FROM two GROUP BY ALL)""",
    views=LISTS_SQL,
)
def unique_word_proportion(c: Corpus):
    return metrics.unique_word_proportion(full_topics(c), KS).withColumn("unique_share", six("unique_share"))


@query(
    "evaluation_grid",
    f"""SELECT * FROM ({coherence_sql(UMASS, 'umass')}) JOIN ({coherence_sql(NPMI, 'npmi')}) USING (model_id, k)
    JOIN ({diversity_sql(POSITIONAL)}) USING (model_id, k)""",
    views=PAIR_SQL + ",\n" + LISTS_SQL,
)
def evaluation_grid(c: Corpus):
    counts = store(pair_counts(c), "pair-counts")
    rows = metrics.evaluation_grid(counts, c.n_pairs, full_topics(c), KS)
    return rows.select("model_id", "k", *[six(n).alias(n) for n in ("umass", "npmi", "diversity", "diversity_std")])


# --- document weights -------------------------------------------------------------------

JSD_SQL = """grid AS (SELECT model_id, pair_id, src_doc, tgt_doc, topic_id FROM pair
  SEMI JOIN (SELECT doc_id AS src_doc FROM theta) USING (src_doc) SEMI JOIN (SELECT doc_id AS tgt_doc FROM theta) USING (tgt_doc),
  (SELECT DISTINCT source AS topic_id FROM documents)),
pq AS (SELECT g.model_id, pair_id, coalesce(s.theta, 0) AS p, coalesce(t.theta, 0) AS q FROM grid g
  LEFT JOIN theta s ON s.doc_id = src_doc AND s.topic_id = g.topic_id
  LEFT JOIN theta t ON t.doc_id = tgt_doc AND t.topic_id = g.topic_id),
jsd AS (SELECT model_id, pair_id, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2
  + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS d FROM pq GROUP BY ALL)"""


def model_theta(c: Corpus) -> DataFrame:
    """Document weights, stored like a model's theta file, for every model."""
    return per_model(store(c.theta, "theta")).select("model_id", "doc_id", "theta")


@query(
    "theta_jsd",
    "SELECT model_id, round(1 - avg(d) + 1e-9, 6) + 0.0 AS similarity, round(stddev_pop(d) + 1e-9, 6) + 0.0 AS jsd_std FROM jsd GROUP BY model_id",
    views=JSD_SQL,
)
def theta_jsd(c: Corpus):
    rows = metrics.theta_jsd(c.pairs, model_theta(c))
    return rows.select("model_id", six("similarity").alias("similarity"), six("jsd_std").alias("jsd_std"))


@query(
    "theta_jsd_skip_first",
    "SELECT model_id, round(1 - avg(d) + 1e-9, 6) + 0.0 AS similarity, round(stddev_pop(d) + 1e-9, 6) + 0.0 AS jsd_std FROM jsd WHERE pair_id > 0 GROUP BY model_id",
    views=JSD_SQL,
)
def theta_jsd_skip_first(c: Corpus):
    rows = metrics.theta_jsd(c.pairs, model_theta(c), skip_first=True)
    return rows.select("model_id", six("similarity").alias("similarity"), six("jsd_std").alias("jsd_std"))


JSD = "SELECT model_id, round(1 - avg(d) + 1e-9, 6) + 0.0 AS similarity, round(stddev_pop(d) + 1e-9, 6) + 0.0 AS jsd_std FROM jsd GROUP BY model_id"


def paired_theta(c: Corpus) -> DataFrame:
    """``(model_id, pair_id, p, q)``: the weights of both documents of every pair that has them."""
    theta = store(c.theta.select("doc_id", "theta"), "theta")
    src = theta.select(F.col("doc_id").alias("src_doc"), F.col("theta").alias("p"))
    tgt = theta.select(F.col("doc_id").alias("tgt_doc"), F.col("theta").alias("q"))
    return store(c.pairs.join(src, "src_doc").join(tgt, "tgt_doc").select("model_id", "pair_id", "p", "q"), "paired-theta")


@query("theta_jsd_polylingual", JSD, views=JSD_SQL)
def theta_jsd_polylingual(c: Corpus):
    """From a weight file of each side, with a header, two id columns and tabs."""
    pairs = paired_theta(c)
    header = pairs.select("model_id").distinct().select("model_id", F.lit(0).cast("long").alias("line_no"), F.lit("#doc\tname\ttopic proportion").alias("line"))
    sides = []
    for column in ("p", "q"):
        weights = F.transform(column, lambda x: x.cast("string"))
        number = F.col("pair_id").cast("string")
        line = F.concat_ws("\t", number, F.concat(F.lit("doc"), number), F.array_join(weights, "\t"), F.lit(""))
        lines = pairs.select("model_id", (F.col("pair_id") + 1).alias("line_no"), line.alias("line")).unionByName(header)
        sides.append(readers.parse_theta_polylingual(lines, ["model_id"]))
    rows = metrics.theta_jsd_by_position(*sides)
    return rows.select("model_id", six("similarity").alias("similarity"), six("jsd_std").alias("jsd_std"))


@query("theta_jsd_joint", JSD, views=JSD_SQL)
def theta_jsd_joint(c: Corpus):
    """From one matrix a model, the rows of target documents behind those of source documents."""
    pairs = number_by_id(paired_theta(c), ["model_id"], "pair_id", out="row")
    sizes = pairs.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    src = pairs.select("model_id", "row", F.col("p").alias("theta"))
    tgt = pairs.join(sizes, "model_id").select("model_id", (F.col("row") + F.col("n")).alias("row"), F.col("q").alias("theta"))
    rows = metrics.theta_jsd_joint(src.unionByName(tgt))
    return rows.select("model_id", six("similarity").alias("similarity"), six("jsd_std").alias("jsd_std"))


@query(
    "feature_split",
    """SELECT model_id, doc_id, lang, class, CASE WHEN lang = 'en' THEN data_type ELSE 'test' END AS part FROM split JOIN models USING (lang)
    WHERE (lang = 'en' AND data_type IN ('train', 'dev')) OR (lang <> 'en' AND data_type = 'test')""",
)
def feature_split(c: Corpus):
    """Train and dev rows of the source language and test rows of the other one, for every model."""
    rows = None
    for model in MODELS:
        part = metrics.feature_split(c.split, SOURCE, model.removeprefix(f"{SOURCE}-")).withColumn("model_id", F.lit(model))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("model_id", "doc_id", "lang", "class", "part")


@query(
    "accuracy_report",
    """SELECT tgt_lang, round(avg(hit) FILTER (part = 'dev') + 1e-9, 6) + 0.0 AS dev_acc, round(avg(hit) FILTER (part = 'test') + 1e-9, 6) + 0.0 AS test_acc
    FROM (SELECT m.lang AS tgt_lang, CASE WHEN s.lang = 'en' THEN data_type ELSE 'test' END AS part,
      CASE WHEN class = doc_id % 2 THEN 1.0::DOUBLE ELSE 0.0 END AS hit FROM split s, (SELECT unnest(['de', 'es', 'fr']) AS lang) m
      WHERE (s.lang = 'en' AND data_type IN ('train', 'dev')) OR (s.lang = m.lang AND data_type = 'test')) GROUP BY tgt_lang""",
)
def accuracy_report(c: Corpus):
    """Given predictions: the parity of the document id."""
    rows = None
    for lang in LANGUAGES:
        if lang == SOURCE:
            continue
        part = metrics.feature_split(c.split, SOURCE, lang).withColumn("tgt_lang", F.lit(lang))
        rows = part if rows is None else rows.unionByName(part)
    predicted = rows.select("tgt_lang", "part", F.col("class").alias("label"), (F.col("doc_id") % 2).alias("prediction"))
    report = metrics.accuracy_report(predicted, ["tgt_lang"])
    return report.select("tgt_lang", six("dev_acc").alias("dev_acc"), six("test_acc").alias("test_acc"))


MODEL_SETTING = ["model_id", "setting"]


def classification_samples(c: Corpus) -> DataFrame:
    """``(model_id, setting, part, label, features)`` of every model.

    Setting ``plain`` takes the topic weights as they are, ``rho`` maps those of target
    documents to source topics by the links of the model.
    """
    # Labelled documents that are in a part of some model; only they get topic weights.
    source = F.col("lang") == SOURCE
    used = c.split.filter((source & F.col("data_type").isin("train", "dev")) | (~source & (F.col("data_type") == "test")))
    used = store(used, "used")
    theta = c.theta_of(store(c.docs_of(used), "used-docs"), c.phi)
    labelled = store(used.join(theta.select("doc_id", "theta"), "doc_id"), "labelled")
    names = F.array(*[F.lit(t) for t in c.topic_ids])
    cells = F.inline(F.arrays_zip(names.alias("topic_id"), F.col("theta").alias("weight"))).alias("topic_id", "weight")
    given = labelled.filter(F.col("lang") != SOURCE).select(F.concat_ws("-", F.lit(SOURCE), "lang").alias("model_id"), "doc_id", cells)
    given = given.select("model_id", "doc_id", F.expr("cast(substring(topic_id, 4) as int)").alias("tgt_topic"), "weight")
    mapped = topics.map_theta_by_rho(given, rho(c)).groupBy("model_id", "doc_id")
    entries = F.struct(F.concat(F.lit("src"), F.col("src_topic").cast("string")), F.col("weight"))
    mapped = mapped.agg(F.map_from_entries(F.collect_list(entries)).alias("_by_name"))
    rows = None
    for model in MODELS:
        target = model.removeprefix(f"{SOURCE}-")
        for setting in ("plain", "rho"):
            corpus = labelled.withColumn("model_id", F.lit(model)).withColumn("setting", F.lit(setting))
            if setting == "rho":
                corpus = corpus.join(mapped, ["model_id", "doc_id"], "left")
                linked = F.transform(names, lambda t: F.coalesce(F.try_element_at("_by_name", t), F.lit(0.0)))
                corpus = corpus.withColumn("theta", F.when(F.col("lang") == SOURCE, F.col("theta")).otherwise(linked))
            part = classification.crosslingual_samples(corpus, SOURCE, target, MODEL_SETTING)
            rows = part if rows is None else rows.unionByName(part)
    return rows


@query("crosslingual_accuracy")
def crosslingual_accuracy(c: Corpus):
    """Chosen strength and accuracies of every model, with and without links."""
    best, _ = c.once("classifiers", lambda: classification.crosslingual_accuracy(classification_samples(c), MODEL_SETTING))
    return best


@query(
    "crosslingual_gradient",
    """SELECT model_id, setting, class, c, feature, 0.0::DOUBLE AS gradient
    FROM (SELECT unnest(['en-de', 'en-es', 'en-fr']) AS model_id), (SELECT unnest(['plain', 'rho']) AS setting),
      (SELECT DISTINCT class FROM split JOIN theta USING (doc_id) WHERE split.lang = 'en' AND data_type = 'train' AND class IS NOT NULL),
      (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0])::DOUBLE AS c),
      (SELECT unnest(range(0, (SELECT count(DISTINCT source) FROM documents) + 1))::INTEGER AS feature)""",
)
def crosslingual_gradient(c: Corpus):
    """Gradient of the penalised loss at the weights of every class and strength, zero at the minimum."""
    _, fitted = c.once("classifiers", lambda: classification.crosslingual_accuracy(classification_samples(c), MODEL_SETTING))
    return fitted.select(*MODEL_SETTING, "class", "c", "feature", six("gradient").alias("gradient"))
