"""Every registered query against its SQL, and properties of those SQL cannot express."""

from __future__ import annotations

import numpy as np
import pytest
from comparing import difference, duck
from pyspark.sql import functions as F

from lingospan.plans import catalog
from lingospan.plans.corpus import Corpus


@pytest.fixture(scope="module")
def con(data_dir):
    return duck(data_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(name, corpus, con):
    assert difference(catalog.BUILDERS[name](corpus), con, catalog.ORACLES[name]) is None


def rows(name, corpus):
    return catalog.BUILDERS[name](corpus).toPandas()


def test_procrustes_is_orthogonal_and_lstsq_fits_better(corpus):
    from lingospan.operators.embedding import learn_translation_lstsq, learn_translation_procrustes
    from lingospan.plans.vector_queries import training_pairs

    given = training_pairs(corpus, "en-fr")
    w, free = learn_translation_procrustes(given), learn_translation_lstsq(given)
    assert np.allclose(w @ w.T, np.eye(len(w)), atol=1e-8)
    pairs = given.toPandas()
    x, y = np.stack(pairs["x"]).astype(float), np.stack(pairs["y"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.linalg.norm(x @ w - y) <= np.linalg.norm(x - y) + 1e-9
    assert np.linalg.norm(x @ free - y) <= np.linalg.norm(x @ w - y) + 1e-9
    assert np.allclose(free, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_language_coefficients_beat_the_majority(corpus):
    got = rows("language_dim_coefficients", corpus)
    majority = 1 - corpus.vectors.filter("lang = 'en'").count() / corpus.n_vectors
    assert len(got) == 64 and got["accuracy"][0] >= majority


def test_importances_sum_to_one(corpus):
    got = rows("language_dim_importance", corpus)
    assert len(got) == 64 and abs(got["coef"].sum() - 1) < 1e-6


def test_every_word_has_one_cluster(corpus):
    got = rows("cluster_words", corpus)
    sizes = corpus.vectors.groupBy("lang").count().toPandas().set_index("lang")["count"]
    for lang, part in got.groupby("lang"):
        assert len(part) == sizes[lang] and part["word"].is_unique and part["cluster"].nunique() <= max(2, sizes[lang] // 20)


def test_topic_clusters_partition_the_topics(corpus):
    got = rows("cluster_topics_crosslingual", corpus)
    topics = corpus.model_topic_words.select("model_id", "side", "topic_id").distinct().count()
    assert len(got) <= topics and not got.duplicated(["model_id", "side", "topic_id"]).any()
    assert (got.groupby("model_id")["cluster_id"].nunique() <= 20).all()


def test_mapping_flow_keeps_theta_mass(corpus):
    from lingospan.plans.corpus import per_model
    from lingospan.plans.mapping import topic_mapping_flow

    theta = per_model(corpus.theta_cells)
    topic_map, words, merged = topic_mapping_flow(
        per_model(corpus.phi), theta, corpus.vectors, top_p=10, n_clusters=10, top_n=20
    )
    mapped = theta.join(topic_map, ["model_id", "side", "topic_id"], "left_semi")
    assert abs(merged.agg(F.sum("weight")).first()[0] - mapped.agg(F.sum("weight")).first()[0]) < 1e-6
    assert words.agg(F.max("rank")).first()[0] <= 20


@pytest.mark.parametrize("name", ["lda_monolingual", "lda_polylingual"])
def test_lda_words_are_ranked_by_weight(name, corpus):
    got = rows(name, corpus)
    keys = [k for k in ("model_id", "lang", "topic_id") if k in got.columns]
    got = got.sort_values([*keys, "rank"])
    assert (got["weight"] > 0).all() and got["topic_id"].nunique() == 10
    assert (got.groupby(keys)["weight"].diff().dropna() <= 1e-12).all()


def test_lda_is_seeded_and_theta_sums_to_one(corpus):
    from lingospan.operators.topics import fit_lda

    docs = corpus.docs.filter("lang = 'fr'")
    first, theta = fit_lda(docs, 5, max_iter=2)
    second, _ = fit_lda(docs, 5, max_iter=2)
    a, b = (p.toPandas().sort_values(["topic_id", "word"], ignore_index=True) for p in (first, second))
    assert a["word"].equals(b["word"]) and np.allclose(a["weight"], b["weight"], rtol=1e-6)
    sums = theta.select(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x).alias("s")).toPandas()["s"]
    assert np.allclose(sums, 1)
    phi = first.groupBy("topic_id").agg(F.sum("weight").alias("s")).toPandas()["s"]
    assert np.allclose(phi, 1)


def test_concept_topics_give_words_to_both_sides(corpus):
    got = rows("lda_joint_concept", corpus)
    assert set(got["side"]) == {"src", "tgt"} and not got["word"].str.contains("[#:]").any()


def test_accuracy_rows_are_in_the_grid(corpus):
    from lingospan.operators.classification import C_GRID

    got = rows("crosslingual_accuracy", corpus)
    assert len(got) == 6 and got["c"].isin(C_GRID).all()
    assert got["dev_acc"].between(0, 1).all() and got["test_acc"].between(0, 1).all()


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


# ---- work on the documents that a query returns


def small_corpus(spark, folder, n: int) -> Corpus:
    """``n`` documents each of two languages, every third one labelled; the first ids are there twice or without text."""
    docs = []
    for i in range(n):
        for at, lang in enumerate(("en", "de")):
            text = " ".join(f"{lang}{chr(97 + (i * k + at) % 23)}" for k in range(1, 4 + i % 5))
            docs.append((2 * i + at, None if i == 1 else text, lang, f"src{i % 3}"))
    docs += [docs[4], (None, "ena enb", "en", "src0")]
    labels = [(d[0], k % 2) for k, d in enumerate(docs) if d[0] is not None and d[0] % 3 == 0]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return Corpus(spark, str(folder))


def weighted_ids(monkeypatch) -> list:
    """Ids of the documents that get topic weights from now on."""
    from lingospan.operators import topics

    seen, plain = [], topics.theta_from_phi

    def watched(docs, *args, **options):
        seen.extend(r["doc_id"] for r in docs.select("doc_id").collect())
        return plain(docs, *args, **options)

    monkeypatch.setattr(topics, "theta_from_phi", watched)
    return seen


def test_report_weighs_the_first_documents_only(spark, tmp_path, monkeypatch):
    c = small_corpus(spark, tmp_path, 520)
    whole = c.docs.select("doc_id", "lang", "tokens").join(c.theta.select("doc_id", "theta"), "doc_id").collect()
    numbers = c.pair_members.filter("pair_id < 500").collect()
    expected = sorted(
        (m["model_id"], 2 * m["pair_id"] + m["side_no"], d["lang"], ", ".join(d["tokens"]), round(max(d["theta"]), 6))
        for m in numbers for d in whole if d["doc_id"] == m["doc_id"]
    )
    seen = weighted_ids(monkeypatch)
    report = catalog.BUILDERS["doc_topic_report"](Corpus(spark, str(tmp_path)))
    got = sorted((r["model_id"], r["doc_no"], r["lang"], r["words"], round(r["top"], 6)) for r in report.collect())
    assert got == expected and len({r[1] for r in got}) > 900
    assert set(seen) <= {m["doc_id"] for m in numbers}


def test_classifiers_weigh_the_rows_of_their_parts_only(spark, tmp_path, monkeypatch):
    from lingospan.plans.topic_queries import classification_samples

    c = small_corpus(spark, tmp_path, 90)
    theta = c.theta.select("doc_id", "theta").collect()
    parts = [(r, "test" if r["lang"] == "de" else r["data_type"]) for r in c.split.collect()]
    parts = [(r, p) for r, p in parts if (r["lang"] == "en" and p != "test") or (r["lang"] == "de" and r["data_type"] == "test")]
    expected = sorted((p, r["class"], tuple(np.round(t["theta"], 9))) for r, p in parts for t in theta if t["doc_id"] == r["doc_id"])
    seen, opened = weighted_ids(monkeypatch), Corpus(spark, str(tmp_path))
    got = classification_samples(opened).filter("model_id = 'en-de' and setting = 'plain'").collect()
    assert sorted((r["part"], r["label"], tuple(np.round(r["features"], 9))) for r in got) == expected and expected
    assert set(seen) <= {r["doc_id"] for r, _ in parts}
    # The corpus is counted once for weights and topic words.
    assert "Exchange" not in opened.phi._jdf.queryExecution().executedPlan().toString()


def test_word2vec_tokenises_a_document_once(spark, tmp_path):
    from lingospan.plans.corpus import LANGUAGES

    docs = [(i, lang, [f"{lang}a", f"{lang}b"] * 10) for i in range(6) for lang in LANGUAGES] + [(7, "en", []), (8, "en", None), (9, None, ["x"] * 20), (10, "it", ["x"] * 20)]
    tokenised = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def counted(tokens):
        tokenised.add(1)
        return tokens

    given = spark.createDataFrame(docs, "doc_id long, lang string, tokens array<string>")
    c = Corpus(spark, str(tmp_path))
    c.__dict__["docs"] = given.withColumn("tokens", counted("tokens"))
    got = sorted(tuple(r) for r in catalog.BUILDERS["train_word2vec"](c).collect())
    assert got == sorted((lang, f"{lang}{end}", 100) for lang in LANGUAGES for end in "ab")
    assert tokenised.value <= len(docs)
