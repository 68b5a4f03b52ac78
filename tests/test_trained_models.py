"""Trainings over shards against plain versions, planted structure and other layouts of the same data."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingospan import storage
from lingospan.functions.special import digamma, log_gamma
from lingospan.operators import anchors, classification, embedding, gibbs, negative_sampling, neighbours, polylingual, sharding
from lingospan.operators.topics import complete_linkage
from lingospan.plans import mapping


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


# ---- shards


def test_shards_hold_every_token(spark):
    rows = [("a", 1, ["x", None, "y", "x"]), ("a", 2, []), ("a", 3, None), ("b", 1, ["z"] * 25), ("a", 1, ["y"])]
    docs = spark.createDataFrame(rows, "lang string, doc long, words array<string>")
    got = sharding.packed(docs, ["lang"], "doc", "words", 10, 10).collect()
    found = []
    for r in got:
        assert sum(r["sizes"]) == len(r["ids"]) and max(r["sizes"]) <= 10 and list(r["terms"]) == sorted(set(r["terms"]))
        at = 0
        for doc, size in zip(r["docs"], r["sizes"], strict=True):
            found += [(r["lang"], doc, r["terms"][i]) for i in r["ids"][at : at + size]]
            at += size
    assert sorted(found) == sorted((lang, doc, w) for lang, doc, words in rows for w in words or [] if w is not None)


def test_a_stored_file_holds_few_shards(spark):
    docs = spark.createDataFrame([(i, "en", [f"w{j}" for j in range(10)]) for i in range(300)], "doc long, lang string, words array<string>")
    got = sharding.packed(docs, ["lang"], "doc", "words", 50, 100)
    per_file = got.groupBy(F.input_file_name()).count().toPandas()["count"]
    # 60 shards, dealt by a hash.
    assert per_file.sum() > 50 and per_file.max() <= 8


def test_groups_send_a_row_to_a_bucket(spark, monkeypatch):
    """Words of a group are summed with those of others, and a group gets the sums of its own words back."""
    monkeypatch.setattr(sharding, "GROUPS", 2)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 100)
    rng = random.Random(4)
    rows = [(i, lang, [f"w{rng.randrange(60)}" for _ in range(20)]) for lang in ("en", "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc long, lang string, words array<string>")
    groups, n_groups, n_buckets = sharding.packed_groups(docs, ["lang"], "doc", "words", 100, 1000, 8)
    members, routes = sharding.routed(groups, ["lang"], n_groups, n_buckets)
    assert groups.count() == n_groups == 2 and n_buckets > 5
    found, spans = [], {}
    for r in groups.collect():
        ids, docs_ = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["docs"], np.int64)
        spans[r["lang"], r["group"]] = r["terms"]
        for shard, entries, own in sharding.each_shard(r.asDict()):
            assert 0 <= shard < 6 and own.stop - own.start == 20 * (entries.stop - entries.start)
            found += [(int(d), r["lang"], [r["terms"][i] for i in part]) for d, part in zip(docs_[entries], ids[own].reshape(-1, 20), strict=True)]
    assert sorted(found) == sorted(rows)

    def send(batches):
        for pdf in batches:
            for m in pdf.to_dict("records"):
                n = np.bincount(np.frombuffer(m["ids"], np.int32))[:, None] * np.array([[1, 2]])
                yield sharding.to_buckets(m, values=n.astype(np.int32)).assign(lang=m["lang"], group=m["group"])

    sent = members.mapInPandas(send, "bucket int, at binary, values binary, lang string, group int")
    answers = sharding.answered(sent, ["lang"], {"values": np.int32}, 3, lambda n: n + 1).cache()
    assert answers.filter("group >= 0").count() == sent.count() <= n_groups * n_buckets
    counts = {(lang, w): sum(ws.count(w) for _, l, ws in rows if l == lang) for lang in ("en", "fr") for w in {w for _, _, ws in rows for w in ws}}
    for m in members.collect():
        own = answers.filter((F.col("lang") == m["lang"]) & (F.col("group") == m["group"])).toPandas()
        got = sharding.from_buckets(m.asDict(), own, np.int64)
        assert got.tolist() == [[counts[m["lang"], w] + 1, 2 * counts[m["lang"], w] + 1] for w in spans[m["lang"], m["group"]]]


def test_a_discarded_table_is_gone(spark):
    table = storage.store(spark.range(3), "short-lived")
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    storage.discard(table)
    assert not os.path.exists(folder)


def test_sums_of_arrays(spark):
    rows = [("a", "x", 2, [1.0, 2.0]), ("a", "x", 1, [10.0, 20.0]), ("b", "x", 1, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "lang string, term string, _order int, v array<double>")
    got = {(r["lang"], r["term"]): r["v"] for r in sharding.sum_arrays(df, ["lang", "term"], ["v"], 3).collect()}
    assert got == {("a", "x"): [11.0, 22.0], ("b", "x"): [5.0, 5.0]}


# ---- word vectors


def test_alias_table_has_the_given_shares():
    weights = np.array([5.0, 1.0, 0.0, 0.5, 30.0, 2.5])
    share, other = negative_sampling.alias_table(weights)
    out = share.copy()
    np.add.at(out, other, 1 - share)
    assert np.allclose(out / len(weights), weights / weights.sum())


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    inner, outer = rng.normal(size=(7, 4)), rng.normal(size=(7, 4))
    around = np.array([[0, 1, -1], [2, -1, -1], [0, 0, 3]])
    target, noise = np.array([4, 5, 6]), np.array([[1, 4], [5, 0], [2, 2]])

    def loss_of(mean_shift, outer):
        total = 0.0
        for i in range(3):
            words = [w for w in around[i] if w >= 0]
            mean = sum(inner[w] for w in words) / len(words) + mean_shift[i]
            total += math.log1p(math.exp(-outer[target[i]] @ mean))
            total += sum(math.log1p(math.exp(outer[w] @ mean)) for w in noise[i] if w != target[i])
        return total

    loss, to_mean, to_outer, words = negative_sampling.gradients(inner, outer, around, target, noise)
    assert math.isclose(loss, loss_of(np.zeros((3, 4)), outer))
    moved = np.zeros_like(outer)
    negative_sampling.add_rows(moved, words.ravel(), to_outer.reshape(-1, 4))
    for i, j in [(0, 0), (1, 2), (2, 3)]:
        shift = np.zeros((3, 4))
        shift[i, j] = 1e-6
        assert math.isclose(-(loss_of(shift, outer) - loss) / 1e-6, to_mean[i, j], abs_tol=1e-4)
    for w, j in [(4, 0), (1, 1), (2, 3), (0, 2)]:
        other = outer.copy()
        other[w, j] += 1e-6
        assert math.isclose(-(loss_of(np.zeros((3, 4)), other) - loss) / 1e-6, moved[w, j], abs_tol=1e-4)


@pytest.mark.parametrize("skip_gram", [True, False])
def test_contexts_stay_in_sentence_and_window(skip_gram):
    ids, sentence = np.arange(20), np.repeat([0, 1, 2], [1, 12, 7])
    seen = set()
    for seed in range(30):
        around, target = negative_sampling.contexts(ids, sentence, 3, np.random.default_rng(seed), skip_gram)
        assert around.shape[1] == (1 if skip_gram else 6)
        seen |= {(int(a), int(t)) for row, t in zip(around, target, strict=True) for a in row if a >= 0}
    assert seen == {(i, j) for i in range(20) for j in range(20) if i != j and sentence[i] == sentence[j] and abs(i - j) <= 3}


def planted_sentences():
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        topic = rng.randrange(4)
        common = [f"t{topic}w{rng.randrange(8)}" for _ in range(10)]
        common.insert(rng.randrange(10), f"t{topic}{rng.choice(['same', 'alike'])}")
        rows.append((i, "en" if i % 3 else "fr", common))
    return rows


def test_words_of_the_same_contexts_become_neighbours(spark):
    docs = spark.createDataFrame(planted_sentences(), "doc_id long, lang string, tokens array<string>")
    options = dict(vector_size=16, window=3, min_count=2, negative=4, sample=0, passes=6, rate=0.05, shard_tokens=4000, noise_draws=500)
    for skip_gram in (False, True):
        vectors, history = negative_sampling.train_word_vectors(docs, skip_gram=skip_gram, **options)
        rows = [(r["word"], np.array(r["vec"])) for r in vectors.filter("lang = 'en'").collect()]
        words, matrix = [w for w, _ in rows], np.stack([v / np.linalg.norm(v) for _, v in rows])
        for topic in range(4):
            near = matrix @ matrix[words.index(f"t{topic}same")]
            best = [words[i] for i in np.argsort(-near)[1:9]]
            assert all(w.startswith(f"t{topic}") for w in best), (skip_gram, best)
        losses = as_map(history, "lang", "pass")
        assert losses["en", 6]["loss"] < losses["en", 1]["loss"] < 5 * math.log(2)


def test_vectors_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(planted_sentences()[:300], "doc_id long, lang string, tokens array<string>")
    options = dict(vector_size=8, min_count=2, passes=2, shard_tokens=500, noise_draws=50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for partitions, frame in (("8", docs), ("3", docs.repartition(5, "lang").orderBy(F.desc("doc_id")))):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        vectors, _ = negative_sampling.train_word_vectors(frame, **options)
        results.append({(r["lang"], r["word"]): r["vec"] for r in vectors.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) > 50


def test_a_group_has_the_words_of_its_shards_and_their_noise(spark):
    rng = random.Random(8)
    cf = {f"w{i:02d}": 1 + int(40 * rng.random() ** 3) for i in range(50)}
    vocab = spark.createDataFrame([("en", w, n) for w, n in cf.items()], "lang string, term string, cf long")
    own = {s: sorted(rng.sample([*cf, "x", "y"], 4)) for s in range(11)}
    for per_group in (1, 3, 11, 40):
        shards = spark.createDataFrame([("en", s, s // per_group, w) for s, w in own.items()], "lang string, shard int, group int, terms array<string>")
        n_shards = spark.createDataFrame([("en", 11)], "lang string, _shards int")
        noise = negative_sampling._noise(vocab, n_shards, ["lang"], 20).cache()
        rows = noise.toPandas()
        numbers = [rows[n].to_numpy() for n in ("whole", "more", "first")]
        drawn = {s: negative_sampling.drawn_as_noise(s, 11, *numbers) for s in range(11)}
        assert abs(sum(d.sum() for d in drawn.values()) - 220) < 50 and rows["whole"].max() > 0
        got = {r["group"]: r for r in negative_sampling._group_words(shards, noise, n_shards, ["lang"], per_group).collect()}
        for g in range(-(-11 // per_group)):
            members = [s for s in own if s // per_group == g]
            expected = {w for s in members for w in own[s] if w in cf} | {w for s in members for w in rows["term"][drawn[s] > 0]}
            assert got[g]["terms"] == sorted(expected) and got[g]["cf"] == [cf[w] for w in sorted(expected)]
        assert len(got) == -(-11 // per_group)


def test_vectors_do_not_depend_on_groups(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, lang, [f"w{rng.randrange(30)}" for _ in range(20)]) for lang in ("en", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")
    results, left = [], []
    for groups, passes in ((24, 2), (1, 2), (24, 4)):
        monkeypatch.setattr(negative_sampling, "GROUPS", groups)
        before = set(os.listdir(storage.scratch_root(spark)))
        vectors, history = negative_sampling.train_word_vectors(docs, vector_size=8, min_count=1, passes=passes, shard_tokens=100, noise_draws=30)
        results.append(({(r["lang"], r["word"]): r["vec"] for r in vectors.collect()}, {(r["lang"], r["pass"]): r["loss"] for r in history.collect()}))
        left.append(len(set(os.listdir(storage.scratch_root(spark))) - before))
    (a, loss_a), (b, loss_b), _ = results
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)
    assert loss_a.keys() == loss_b.keys() and all(math.isclose(loss_a[k], loss_b[k], rel_tol=1e-4) for k in loss_a)
    # Tables of earlier passes are gone, so disk does not grow with the passes.
    assert left[2] == left[0]


def test_vectors_of_nothing(spark):
    docs = spark.createDataFrame([(1, "en", ["a"]), (2, "fr", []), (3, "de", None)], "doc_id long, lang string, tokens array<string>")
    vectors, history = negative_sampling.train_word_vectors(docs, min_count=2, passes=1)
    assert vectors.count() == 0 and history.count() == 0
    vectors, _ = negative_sampling.train_word_vectors(docs, min_count=1, passes=1, vector_size=3)
    assert [(r["word"], len(r["vec"])) for r in vectors.collect()] == [("a", 3)]


def test_a_model_without_examples_has_no_loss(spark):
    docs = spark.createDataFrame([(1, "en", ["a"])], "doc_id long, lang string, tokens array<string>")
    _, history = negative_sampling.train_word_vectors(docs, min_count=1, passes=1, vector_size=3)
    assert [tuple(r) for r in history.collect()] == [("en", 1, None)]


# ---- sampled topics


def test_topics_are_drawn_from_the_conditional_distribution():
    rng = np.random.default_rng(1)
    word_topics = np.array([[3, 0, 5, 0], [0, 2, 0, 7], [1, 0, 0, 0]])
    doc_topics = np.array([[4, 0, 0, 1], [0, 0, 0, 0]])
    topics, alpha, beta = word_topics.sum(axis=0), 0.3, 0.2
    n = 40_000
    for word in range(3):
        for doc in range(2):
            exact = (doc_topics[doc] + alpha) * (word_topics[word] + beta) / (topics + 3 * beta)
            z = gibbs.draw_topics(word_topics, doc_topics, topics, np.full(n, word), np.full(n, doc), alpha, beta, 3, rng)
            got = np.bincount(z, minlength=4) / n
            assert np.abs(got - exact / exact.sum()).max() < 0.015
    words, docs = rng.integers(3, size=n), rng.integers(2, size=n)
    z = gibbs.draw_topics(word_topics, doc_topics, topics, words, docs, alpha, beta, 3, rng)
    exact = (doc_topics[1] + alpha) * (word_topics[2] + beta) / (topics + 3 * beta)
    chosen = z[(words == 2) & (docs == 1)]
    assert np.abs(np.bincount(chosen, minlength=4) / len(chosen) - exact / exact.sum()).max() < 0.03


def test_a_sweep_keeps_the_counts():
    rng = np.random.default_rng(3)
    docs = np.repeat(np.arange(6), [1, 9, 30, 2, 17, 40])
    words, z = rng.integers(12, size=len(docs)), rng.integers(5, size=len(docs))
    word_topics, doc_topics = np.zeros((12, 5), np.int64), np.zeros((6, 5), np.int64)
    np.add.at(word_topics, (words, z), 1)
    np.add.at(doc_topics, (docs, z), 1)
    topics = word_topics.sum(axis=0)
    for _ in range(3):
        gibbs.sweep(words, docs, z, word_topics, doc_topics, topics, 0.1, 0.01, 12, rng, stripes=4)
    again = np.zeros_like(word_topics)
    np.add.at(again, (words, z), 1)
    assert (again == word_topics).all() and (topics == again.sum(axis=0)).all() and (doc_topics.sum(axis=1) == np.bincount(docs)).all()


def planted_topics(langs=("en",), n=240, per_doc=30):
    """Documents of three topics with ten words each; every word starts with its topic."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        main = rng.randrange(3)
        for lang in langs:
            words = [f"{main if rng.random() < 0.9 else rng.randrange(3)}{lang}{rng.randrange(10)}" for _ in range(per_doc)]
            rows.append((i, lang, words))
    return rows


def purity(phi, *keys):
    """Smallest weight of the best planted topic in the ten best words of a learned one."""
    worst = 1.0
    for _, rows in phi.groupby(list(keys)):
        best = rows.nlargest(10, "weight")["word"].str[0].value_counts()
        worst = min(worst, best.iloc[0] / 10)
    return worst


def test_sampled_topics_recover_planted_ones(spark):
    rows = planted_topics() + [(1000, "en", []), (1001, "en", None), (1002, "fr", ["x"])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, tokens array<string>")
    phi, theta, history = gibbs.lda_gibbs(docs, 3, rounds=6, sweeps=5, shard_tokens=1500, alpha_sum=0.3)
    log = as_map(history, "lang", "round")
    assert all(log["en", r]["tokens"] == 240 * 30 for r in range(1, 8))
    assert log["en", 7]["log_likelihood"] > log["en", 1]["log_likelihood"] + 0.5
    words = phi.filter("lang = 'en'").toPandas()
    assert purity(words, "topic_id") == 1.0 and words.nlargest(30, "weight")["word"].str[0].nunique() == 3
    weights = {(r["doc_id"], r["lang"]): r["theta"] for r in theta.collect()}
    assert len(weights) == 241 and all(math.isclose(sum(t), 1) for t in weights.values())
    assert words["weight"].sum() <= 3 and log["fr", 1]["tokens"] == 1


def test_sampled_topics_do_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame(planted_topics(n=60), "doc_id long, lang string, tokens array<string>")
    results = []
    for frame in (docs, docs.repartition(7).orderBy("tokens")):
        phi, _, _ = gibbs.lda_gibbs(frame, 3, rounds=2, sweeps=2, shard_tokens=400)
        results.append({(r["topic_id"], r["word"]): r["weight"] for r in phi.collect()})
    assert results[0] == results[1]


def test_sampled_topics_do_not_depend_on_groups(spark, monkeypatch):
    docs = spark.createDataFrame(planted_topics(n=60), "doc_id long, lang string, tokens array<string>")
    results = []
    for groups in (64, 1):
        monkeypatch.setattr(sharding, "GROUPS", groups)
        phi, theta, _ = gibbs.lda_gibbs(docs, 3, rounds=2, sweeps=2, shard_tokens=400)
        results.append(({(r["topic_id"], r["word"]): r["weight"] for r in phi.collect()}, {r["doc_id"]: r["theta"] for r in theta.collect()}))
    assert results[0] == results[1]


def test_a_sweep_merges_all_words_of_its_topics(spark, monkeypatch):
    """A word that is far down the lists of two topics leads the list of both together."""
    lists = {("en", 0): [f"a{i}" for i in range(6)], ("en", 1): [f"b{i}" for i in range(6)], ("fr", 0): ["c"], ("fr", 1): ["d"]}
    rows = [(lang, 2, t, w, 0.15) for (lang, t), words in lists.items() for w in words] + [("en", 2, t, "shared", 0.1) for t in (0, 1)]
    phi = spark.createDataFrame(rows, "lang string, n_topics int, topic_id int, word string, weight double")
    theta = spark.createDataFrame([(1, "en", 2, [0.5, 0.5]), (2, "fr", 2, [1.0, 0.0])], "doc_id long, lang string, n_topics int, theta array<double>")
    monkeypatch.setattr(mapping.gibbs, "lda_gibbs", lambda *args, **options: (phi, theta, None))
    vectors = [(2, lang, w, [0.0, 1.0] if w == "d" else [1.0, 0.0]) for (lang, _), words in lists.items() for w in words]
    spaces = spark.createDataFrame(vectors, "dims int, lang string, word string, vec array<double>")
    sides = spark.createDataFrame([("en-fr", "en", "src"), ("en-fr", "fr", "tgt")], "pair_model string, lang string, side string")
    docs = spark.createDataFrame([(1, "en", ["a0"])], "doc_id long, lang string, tokens array<string>")
    words, weights = mapping.topic_sweep(docs, sides, spaces, [2], top_p=3, top_n=1)
    found = {(r["side"], r["cluster_id"]): (r["word"], round(r["weight"], 9)) for r in words.collect()}
    assert found == {("src", 0): ("shared", 0.2), ("tgt", 0): ("c", 0.15), ("tgt", 1): ("d", 0.15)}
    assert {(r["doc_id"], r["cluster_id"]): r["weight"] for r in weights.collect()} == {(1, 0): 1.0, (2, 0): 1.0, (2, 1): 0.0}


# ---- shared topic weights


def test_special_functions():
    x = np.concatenate([np.geomspace(1e-4, 1e4, 200), np.arange(1, 30)])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)
    near = [(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x]
    assert np.allclose(digamma(x), near, rtol=1e-5, atol=1e-5)
    assert math.isclose(float(digamma(np.float64(1.0))), -0.5772156649015329, rel_tol=1e-12)


def test_tuples_share_their_weights_across_languages(spark):
    rows = [("m", *r) for r in planted_topics(("en", "fr", "de"), n=120)]
    rows += [("m", 500, "en", ["0en1"] * 5), ("m", 501, "fr", []), ("n", 1, "en", ["a:b", "c"]), ("n", 1, "fr", None)]
    pairs = spark.createDataFrame(rows, "model_id string, pair_id long, lang string, tokens array<string>")
    phi, theta, history, mass = polylingual.lda_shared(pairs, 3, rounds=12, shard_tokens=2000, alpha_sum=0.3)
    words = phi.filter("model_id = 'm'").toPandas()
    assert purity(words, "lang", "topic_id") == 1.0
    top = words.sort_values("weight").groupby(["topic_id", "lang"]).last()["word"].str[0]
    # The same planted topic leads in every language of a learned one.
    assert (top.groupby("topic_id").nunique() == 1).all() and top.nunique() == 3
    assert np.allclose(phi.groupBy("model_id", "lang", "topic_id").agg(F.sum("weight").alias("s")).toPandas()["s"], 1)
    log = history.toPandas().sort_values(["model_id", "round"])
    change = log.groupby("model_id")["bound"].diff().dropna()
    assert (change >= -1e-7 * log["bound"].abs().max()).all()
    counted = {(r["model_id"], r["lang"]): r["tokens"] for r in mass.collect()}
    expected = {("m", "en"): 120 * 30 + 5, ("m", "fr"): 120 * 30, ("m", "de"): 120 * 30, ("n", "en"): 2}
    assert counted.keys() == expected.keys() and all(math.isclose(counted[k], v, rel_tol=1e-9) for k, v in expected.items())
    weights = {(r["model_id"], r["pair_id"]): r["theta"] for r in theta.collect()}
    assert len(weights) == 122 and all(math.isclose(sum(t), 1) for t in weights.values())
    assert set(phi.filter("model_id = 'n'").select("word").distinct().toPandas()["word"]) == {"a:b", "c"}


def test_shared_topics_do_not_depend_on_groups_and_keep_one_round(spark, monkeypatch):
    rows = [("m", d, lang, [f"{lang}{w}" for w in words]) for d, _, words in planted_topics(n=40) for lang in ("en", "fr")]
    docs = spark.createDataFrame(rows, "model_id string, pair_id long, lang string, tokens array<string>")
    results, left = [], []
    for groups, rounds in ((64, 2), (1, 2), (64, 5)):
        monkeypatch.setattr(sharding, "GROUPS", groups)
        root = storage.scratch_root(spark)
        before = set(os.listdir(root))
        phi, theta, _, _ = polylingual.lda_shared(docs, 3, rounds=rounds, shard_tokens=400)
        results.append(({(r["lang"], r["topic_id"], r["word"]): r["weight"] for r in phi.collect()}, {r["pair_id"]: r["theta"] for r in theta.collect()}))
        left.append(len(set(os.listdir(root)) - before))
    assert results[0][0].keys() == results[1][0].keys() and results[0][1].keys() == results[1][1].keys()
    assert all(math.isclose(w, results[1][0][k], rel_tol=1e-9) for k, w in results[0][0].items())
    assert all(np.allclose(t, results[1][1][k], atol=1e-9) for k, t in results[0][1].items())
    # Tables of earlier rounds are gone, so disk does not grow with the rounds.
    assert left[2] == left[0]


def test_vectors_stay_in_single_precision():
    rng = np.random.default_rng(4)
    inner, outer = (rng.normal(size=(9, 4)).astype(np.float32) for _ in range(2))
    around, target = rng.integers(-1, 9, size=(20, 3)), rng.integers(9, size=20)
    around[:, 0] = 1
    _, to_mean, to_outer, _ = negative_sampling.gradients(inner, outer, around, target, rng.integers(9, size=(20, 2)))
    assert to_mean.dtype == to_outer.dtype == np.float32
    for n in (0, 1, 7, 300):
        rows, values = rng.integers(9, size=n), rng.normal(size=(n, 4))
        got, expected = np.zeros((9, 4)), np.zeros((9, 4))
        negative_sampling.add_rows(got, rows, values)
        np.add.at(expected, rows, values)
        assert np.allclose(got, expected)


# ---- anchor words


def test_projected_rows_are_those_of_the_cooccurrence_table():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.6, size=(40, 12))
    counts[5] = 0
    counts[5, 3] = 1
    random_rows = rng.normal(size=(12, 7))
    size = counts.sum(axis=1)
    table = np.zeros((12, 12))
    for h, n in zip(counts, size, strict=True):
        if n > 1:
            table += (np.outer(h, h) - np.diag(h)) / (n * (n - 1))
    doc, term = np.nonzero(counts)
    present, doc = np.unique(doc, return_inverse=True)
    got = anchors.project(doc, term, counts[counts > 0], random_rows)
    assert np.allclose(got[:, :7], table @ random_rows) and np.allclose(got[:, 7], table.sum(axis=1))
    assert (got[:, 8] == (counts[size > 1] > 0).sum(axis=0)).all() and len(present) <= 40


def test_rows_of_wanted_terms_are_those_of_all(monkeypatch):
    draw = np.random.default_rng(6)
    counts = draw.integers(0, 3, size=(30, 12))
    doc, term = np.nonzero(counts)
    random_rows = draw.normal(size=(12, 5))
    whole = anchors.project(doc, term, counts[counts > 0], random_rows)
    wanted = np.arange(12) % 3 == 0
    # Runs of a document or term are cut by the rows that are worked on at a time.
    monkeypatch.setattr(anchors, "CACHED", 15)
    assert np.allclose(anchors.project(doc, term, counts[counts > 0], random_rows), whole)
    some = anchors.project(doc, term, counts[counts > 0], random_rows, wanted)
    assert np.allclose(some[wanted], whole[wanted]) and not some[~wanted].any()
    assert np.array_equal(anchors.signs([f"w{i}" for i in range(9)], 4, 1), np.concatenate([anchors.signs([f"w{i}"], 4, 1) for i in range(9)]))


def test_mixtures_are_the_nearest_on_the_simplex():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(4, 9))
    exact = rng.dirichlet(np.ones(4), size=30)
    assert np.allclose(anchors.mixtures(exact @ points, points), exact, atol=1e-4)
    rows = rng.normal(size=(20, 9))
    c = anchors.mixtures(rows, points)
    assert np.allclose(c.sum(axis=1), 1) and (c >= 0).all()
    best = ((rows - c @ points) ** 2).sum(axis=1)
    for other in rng.dirichlet(np.ones(4), size=300):
        assert (((rows - other @ points) ** 2).sum(axis=1) >= best - 1e-9).all()


def test_products_are_those_of_the_rows(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, "en", [f"w{rng.randrange(40)}" for _ in range(12)]) for i in range(200)], "doc_id long, lang string, tokens array<string>")
    shards = sharding.packed(docs, ["lang"], "doc_id", "tokens", 100, 100)
    words = docs.select("lang", F.explode("tokens").alias("word")).distinct()
    rows = {r["word"]: (r["vec"], r["mass"], r["df"]) for r in anchors.cooccurrence_rows(shards, words, width=16).collect()}
    frequency = {r["word"]: r["df"] for r in anchors.document_frequency(shards).collect()}
    assert len(rows) == 40 and {w: r[2] for w, r in rows.items()} == frequency
    points = np.random.default_rng(1).normal(size=(3, 16))
    got = anchors.products(shards, {"en": points, "fr": points[:1]}, width=16).collect()
    assert len(got) == 40
    for r in got:
        assert np.allclose(r["products"], points @ np.array(rows[r["word"]][0])) and np.isclose(r["mass"], rows[r["word"]][1])
    # Only the words that are asked for get a row.
    assert anchors.cooccurrence_rows(shards, words.filter("word < 'w2'"), width=16).count() == sum(w < "w2" for w in rows)


def test_planted_anchors_are_found_in_both_languages(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        lang = ("en", "fr")[i % 2]
        share = [rng.random() ** 3 for _ in range(3)]
        words = []
        for _ in range(40):
            topic = rng.choices(range(3), share)[0]
            # Word 0 of a topic is its anchor; words 8 and 9 belong to all topics.
            k = rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9])
            words.append(f"{lang}{k}" if k >= 8 else f"{lang}{topic}{k}")
        rows.append((i, lang, words))
    docs = spark.createDataFrame([*rows, (5000, "en", ["lonely"]), (5001, "en", []), (5002, "fr", None)], "doc_id long, lang string, tokens array<string>")
    pairs = [("m", "en", f"en{t}{k}", "fr", f"fr{t}{k}") for t in range(3) for k in range(8)]
    pairs += [("m", "en", f"en{k}", "fr", f"fr{k}") for k in (8, 9)] + [("m", "en", "unknown", "fr", "fr00"), ("m", "en", "lonely", "fr", "fr8")]
    links = spark.createDataFrame(pairs, "model_id string, src_lang string, src_word string, tgt_lang string, tgt_word string")
    phi, found = anchors.anchor_topics(docs, links, 3, width=64, shard_tokens=4000)
    chosen = found[("m",)]
    assert {a["src_word"][2] for a in chosen} == {"0", "1", "2"} and all(a["src_word"][2:] == a["tgt_word"][2:] for a in chosen)
    weights = phi.toPandas()
    assert "lonely" not in set(weights["word"])
    assert np.allclose(weights.groupby(["lang", "topic_id"])["weight"].sum(), 1)
    for i, a in enumerate(chosen):
        for lang in ("en", "fr"):
            own = weights[(weights["lang"] == lang) & (weights["topic_id"] == i)].nlargest(6, "weight")["word"]
            assert (own.str[2] == a["src_word"][2]).all() or (own.str.len() == 3).sum() <= 2, list(own)


# ---- clusters


def test_chain_linkage_gives_the_labels_of_the_matrix_loop():
    rng = np.random.default_rng(0)
    for n, k in ((600, 20), (60, 1), (30, 30), (5, 9)):
        points = rng.normal(size=(n, 8))
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        distance = 1 - unit @ unit.T
        np.fill_diagonal(distance, np.inf)
        labels = np.arange(n)
        for _ in range(max(0, n - k)):
            a, b = sorted(np.unravel_index(np.argmin(distance), distance.shape))
            distance[a, :] = distance[:, a] = np.maximum(distance[a], distance[b])
            distance[a, a] = np.inf
            distance[b, :] = distance[:, b] = np.inf
            labels[labels == b] = a
        assert (complete_linkage(points, k) == np.unique(labels, return_inverse=True)[1]).all()
    same = np.repeat(np.eye(3), 4, axis=0)
    assert complete_linkage(same, 3).tolist() == [0] * 4 + [1] * 4 + [2] * 4


# ---- classification


def labelled_points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        label = int(rng.integers(3))
        x = rng.normal(size=4) * 0.8
        x[label] += 1.5
        part = ("train", "train", "dev", "test")[i % 4]
        rows.append(("a", part, label, x.tolist()))
        rows.append(("b", part, min(label, 1), x.tolist()))
    rows += [("one", "train", 7, [1.0, 0.0, 0.0, 0.0]), ("one", "dev", 7, [0.0] * 4), ("one", "test", 2, [0.0] * 4), ("none", "dev", 1, [0.0] * 4), ("a", "train", None, [0.0] * 4)]
    return spark.createDataFrame(rows, "model_id string, part string, label int, features array<double>")


def test_newton_systems_reach_the_minimum(spark):
    samples = labelled_points(spark).filter("label is not null")
    grid = [0.5, 1.0, 50.0]
    models = classification.fit_logistic(samples.filter("part = 'train'"), ["model_id"], grid)
    train = samples.filter("part = 'train' and model_id = 'a'").toPandas()
    x = np.hstack([np.stack(train["features"]), np.ones((len(train), 1))])
    systems = models[("a",)]
    for s in range(len(systems.c)):
        y = (train["label"] == systems.classes[systems.class_id[s]]).to_numpy().astype(float)

        def objective(w, y=y, c=systems.c[s]):
            score = x @ w
            return c * np.logaddexp(0, np.where(y == 1, -score, score)).sum() + 0.5 * (w[:-1] ** 2).sum()

        best = objective(systems.base[s])
        assert np.abs(systems.gradient[s]).max() < 1e-6
        for j in range(x.shape[1]):
            for step in (-1e-3, 1e-3):
                moved = systems.base[s].copy()
                moved[j] += step
                assert objective(moved) > best
    assert models[("one",)].classes == [7] and ("none",) not in models


def test_accuracy_of_every_model(spark):
    best, fitted = classification.crosslingual_accuracy(labelled_points(spark), ["model_id"])
    got = {r["model_id"]: r for r in best.collect()}
    assert set(got) == {"a", "b", "one"}
    assert got["a"]["dev_acc"] > 0.7 and got["a"]["test_acc"] > 0.7 and got["a"]["c"] in classification.C_GRID
    assert (got["one"]["c"], got["one"]["dev_acc"], got["one"]["test_acc"]) == (0.5, 1.0, 0.0)
    rows = fitted.toPandas()
    assert set(rows["model_id"]) == {"a", "b"} and len(rows) == (3 + 2) * 11 * 5
    assert rows["gradient"].abs().max() < 1e-6


def test_separable_rows_have_a_minimum_too(spark):
    rows = [("a", "train", int(v > 0), [float(v), 1000.0 * v]) for v in (-3, -2, 2, 3)] + [("a", "dev", 1, [1.0, 1.0])]
    best, fitted = classification.crosslingual_accuracy(spark.createDataFrame(rows, "model_id string, part string, label int, features array<double>"), ["model_id"])
    assert best.first()["dev_acc"] == 1.0 and np.isfinite(fitted.toPandas()["weight"]).all()


# ---- neighbours


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "softmax"])
@pytest.mark.parametrize("clustered", [True, False])
def test_pruned_search_is_exact_and_sends_less(spark, metric, clustered):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 10)) * 6
    points = (centres[rng.integers(12, size=900)] if clustered else 0) + rng.normal(size=(900, 10))
    points[5] = points[6]
    ids = [f"w{i:03d}" for i in range(900)]
    weights = rng.uniform(1, 2, size=900)
    space = spark.createDataFrame([("m", i, p.tolist()) for i, p in zip(ids, points, strict=True)] + [("n", "w1", [1.0] * 10)], "model_id string, item_id string, vec array<double>")
    queries = space.filter("item_id < 'w200'").withColumnRenamed("item_id", "query_id")
    extra = spark.createDataFrame([("m", "out", (rng.normal(size=10) * 3).tolist()), ("unknown", "x", [1.0] * 10)], queries.schema)
    queries = queries.unionByName(extra)
    offset = spark.createDataFrame([("m", i, float(w)) for i, w in zip(ids, weights, strict=True)], "model_id string, item_id string, denominator double") if metric == "softmax" else None
    got, sent = neighbours.nearest_pruned(queries, space, 5, metric=metric, offset=offset, n_pivots=24, block_rows=20)
    plain = embedding.nearest(queries, space, 5, metric=metric, offset=offset)
    rows = lambda df: sorted((r["model_id"], r["query_id"], r["rank"], r["item_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(plain)
    if clustered and metric != "softmax":
        blocks = 900 / 20
        assert sum(df.filter("model_id = 'm'").count() for df in sent) <= 201 * blocks / 3
