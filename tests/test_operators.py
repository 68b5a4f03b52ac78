"""Operators against brute force on small inputs, with hot groups and several blocks."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingospan.operators import (
    cooccurrence, dictionaries, embedding, matching, metrics, sequence, tokens, topics,
)
from lingospan.sources import writers


@pytest.fixture(params=[2_000_000, 100])
def bucket_rows(request, monkeypatch):
    monkeypatch.setattr(sequence, "ROWS_PER_BUCKET", request.param)


def test_positions_with_a_hot_group(spark, bucket_rows):
    random.seed(1)
    ids = random.sample(range(500_000), 2000) + [2**62 + i for i in range(500)]
    rows = [("hot" if i % 3 else f"g{i % 7}", v) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = {(r.g, r.id): r.seq for r in sequence.number_by_id(df, ["g"], "id").collect()}
    for g, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for at, (_, v) in enumerate(group):
            assert got[(g, v)] == at


def test_rank_by_count_matches_sorting(spark, bucket_rows):
    random.seed(2)
    counts = [1, 1, 1, 2, 3, 127, 128, 129, 255, 256, 1000, 1001]
    words = {f"{random.choice(['w', 'ww', 'é', '字'])}{random.randint(0, 10**6)}": random.choice(counts) for _ in range(700)}
    df = spark.createDataFrame([("en", w, c) for w, c in words.items()], "lang string, word string, cf long")
    got = [r.word for r in tokens.rank_by_count(df).orderBy("r").collect()]
    assert got == [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))]


def test_frequency_rank_by_first_appearance(spark, bucket_rows):
    random.seed(5)
    docs = [(i * 40_000, "en", [f"w{random.randint(0, 400)}" for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, tokens array<string>")
    order = Counter(w for _, _, ws in docs for w in ws)
    first = {}
    for _, _, ws in docs:
        for w in ws:
            first.setdefault(w, len(first))
    got = [r.word for r in tokens.word_frequency_rank(df).orderBy("freq_rank").collect()]
    assert got == sorted(order, key=lambda w: (-order[w], first[w]))


def test_seeded_shuffle_is_a_permutation(spark, bucket_rows):
    df = spark.createDataFrame([(i, "en" if i % 3 else "fr") for i in range(600)], "doc_id long, lang string")
    got = dictionaries.shuffle_corpus(df, 168).toPandas().sort_values("shuffled_seq")
    assert got["shuffled_seq"].tolist() == list(range(600)) and got["doc_id"].tolist() != list(range(600))
    for _, part in got.groupby("lang"):
        assert part["lang_seq"].tolist() == list(range(len(part)))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lookup_join_on_both_sides_of_the_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", limit)
    tokens_of = [(i, "hot" if i % 3 else f"w{i}") for i in range(300)]
    big = spark.createDataFrame(tokens_of, "doc_id long, word string")
    small = spark.createDataFrame([("hot", 1), ("w0", 2), ("w3", 3)], "word string, n int")
    joined = matching.lookup_join(big, small, ["word"], "doc_id").collect()
    expected = {"hot": 1, "w0": 2, "w3": 3}
    assert sorted((r.doc_id, r.n) for r in joined) == sorted((d, expected[w]) for d, w in tokens_of if w in expected)
    semi = matching.lookup_join(big, small.select("word"), ["word"], "doc_id", "left_semi")
    assert semi.count() == len(joined)
    assert matching.lookup_join(big, small, ["word"], "doc_id", "left").count() == 300


def test_table_bytes(spark):
    df = spark.createDataFrame([("abc", 1, [1.0, 2.0]), (None, 2, None)], "word string, n int, vec array<double>")
    assert matching.table_bytes(df) == (3 + 16) + 16 + 16 + (16 + 16) + 16
    assert matching.table_bytes(df.filter("n > 5")) == 0


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_concepts_replace_words_of_both_languages(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(
        [(1, "en", ["a", "z", "a"]), (2, "fr", ["b", "a"]), (3, "de", ["a"]), (4, "en", []), (None, "en", ["a"]), (5, "fr", None)],
        "doc_id long, lang string, tokens array<string>",
    )
    pairs = spark.createDataFrame([(7, "a", "b")], "seq long, src_word string, tgt_word string")
    got = {r.doc_id: r.tokens for r in matching.concept_corpus(docs, pairs, "en", "fr").collect()}
    assert got == {1: ["#7", "en:z", "#7"], 2: ["#7", "fr:a"], None: ["#7"]}
    none = matching.concept_corpus(docs, pairs.filter("seq < 0"), "en", "fr")
    assert {r.doc_id: r.tokens for r in none.collect()}[2] == ["fr:b", "fr:a"]


def test_pair_counts_with_documents_given_once(spark):
    docs = spark.createDataFrame(
        [(1, "en", ["a", "b"]), (2, "fr", ["x"]), (3, "en", ["a"]), (4, "fr", ["y", "x"]), (5, "de", ["a"]), (6, "fr", None)],
        "doc_id long, lang string, tokens array<string>",
    )
    members = [("m", 0, 1), ("m", 0, 2), ("m", 1, 3), ("m", 1, 4), ("m", 2, 6), ("n", 0, 3), ("n", 0, 2)]
    members = spark.createDataFrame(members, "model_id string, pair_id long, doc_id long")
    rows = [(m, "t", side, lang, r, w) for m in ("m", "n") for side, lang, words in (("src", "en", "ab"), ("tgt", "fr", "xy")) for r, w in enumerate(words, 1)]
    words = spark.createDataFrame(rows, "model_id string, topic_id string, side string, lang string, rank int, word string")
    joined = members.join(docs, "doc_id")
    plain = cooccurrence.topic_pair_counts(joined, words, 2).collect()
    given = cooccurrence.topic_pair_counts(docs, words, 2, members=members).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, given)) and plain


def test_term_counts_and_positions(spark):
    docs = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])]
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    got = {(r.doc_id, r.word): r.tf for r in tokens.bag_of_words(df, ["doc_id"]).collect()}
    assert got == {(d, w): n for d, ws in docs for w, n in Counter(ws).items()}
    back = df.select("doc_id", tokens.tokens_from_positions(tokens.term_positions(F.col("tokens"))).alias("t"))
    assert {r.doc_id: r.t for r in back.collect() if r.t is not None} == {d: ws for d, ws in docs if ws}


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_vocabulary_filter_keeps_order_and_drops_empty(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame(
        [(1, "en", ["b", "z", "a", "b"]), (2, "en", ["z"]), (3, "fr", ["a"]), (4, "en", [])],
        "doc_id long, lang string, tokens array<string>",
    )
    vocab = spark.createDataFrame([("en", "a"), ("en", "b"), ("fr", "q")], "lang string, word string")
    got = {r.doc_id: r.tokens for r in matching.filter_tokens_to_vocab(docs, vocab).collect()}
    assert got == {1: ["b", "a", "b"]}
    kept = {r.doc_id: r.tokens for r in matching.remove_missing_words(docs, vocab).collect()}
    assert kept == {1: ["b", "a", "b"], 2: [], 3: ["a"], 4: []}


def test_dedupe_order(spark):
    df = spark.createDataFrame([(0, "甲", "x"), (1, "乙", "x"), (2, "甲", "Y")], "seq long, src_word string, tgt_word string")
    assert {r.src_word: r.tgt_word for r in matching.dedupe_bidict(df).collect()} == {"甲": "y", "乙": "x"}


def test_split_counts(spark):
    df = spark.createDataFrame([(i, f"s{i}", f"t{i}") for i in range(10)], "seq long, src_word string, tgt_word string")
    assert dictionaries.split_dictionary(df).filter("part = 'test'").count() == 0
    assert dictionaries.split_dictionary(df, strict_count=True).filter("part = 'test'").count() == 1


def test_pair_limit(spark):
    side = spark.createDataFrame([(i, ["a"] if i % 2 else []) for i in range(10)], "pair_id long, tokens array<string>")
    full = spark.createDataFrame([(i, ["b"]) for i in range(10)], "pair_id long, tokens array<string>")
    assert sorted(r.pair_id for r in matching.pair_documents(side, full, 3).collect()) == [1, 3, 5]


def pair_corpus(spark, n=60, vocab=12):
    random.seed(3)
    docs = []
    for p in range(n):
        for lang, prefix in (("en", "e"), ("fr", "f")):
            docs.append(("m", p, lang, [f"{prefix}{random.randint(0, vocab - 1)}" for _ in range(5)]))
    return docs, spark.createDataFrame(docs, "model_id string, pair_id long, lang string, tokens array<string>")


def brute_cooccurrence(docs):
    seen = {}
    for _, pair, lang, words in docs:
        seen.setdefault(pair, set()).update((lang, w) for w in words)
    counts = Counter()
    for words in seen.values():
        counts.update((a, b) for a in words for b in words)
    return counts


@pytest.mark.parametrize("tile, cells", [(1024, 8_000_000), (5, 8_000_000), (7, 70)])
def test_cooccurrence_in_tiles_and_passes(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(cooccurrence, "TILE", tile)
    monkeypatch.setattr(cooccurrence, "MAX_CELLS", cells)
    docs, df = pair_corpus(spark)
    scored = df.select("model_id", "lang", F.explode("tokens").alias("word")).distinct()
    got = {((r.lang1, r.word1), (r.lang2, r.word2)): r.n for r in cooccurrence.cooccurrence(df, scored).collect()}
    assert got == dict(brute_cooccurrence(docs))


def test_topic_pairs_keep_zero_counts_and_unknown_words(spark):
    docs, df = pair_corpus(spark)
    words = [("m", "0", side, lang, rank + 1, f"{p}{rank}") for side, lang, p in (("src", "en", "e"), ("tgt", "fr", "f")) for rank in range(4)]
    words += [("m", "1", "src", "en", 1, "nowhere"), ("m", "1", "tgt", "fr", 1, "f0")]
    top = spark.createDataFrame(words, "model_id string, topic_id string, side string, lang string, rank int, word string")
    counts = brute_cooccurrence(docs)
    got = {(r.topic_id, r.i, r.j): r for r in cooccurrence.topic_pair_counts(df, top, 4).collect()}
    for i, j in itertools.product(range(1, 5), repeat=2):
        s, t = ("en", f"e{i - 1}"), ("fr", f"f{j - 1}")
        row = got[("0", i, j)]
        assert (row.n, row.df_src, row.df_tgt) == (counts[(s, t)], counts[(s, s)], counts[(t, t)])
    assert got[("1", 1, 1)].df_src == 0
    sizes = spark.createDataFrame([("m", 60)], "model_id string, n_docs long")
    scores = metrics.coherence(cooccurrence.topic_pair_counts(df, top, 4), sizes, [4], "umass").first()
    expected = np.mean([np.log((counts[(("en", f"e{i}"), ("fr", f"f{j}"))] + 1) / counts[(("fr", f"f{j}"),) * 2]) for i in range(4) for j in range(4)])
    assert scores.umass == pytest.approx(expected)


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_over_blocks(spark, monkeypatch, block, metric):
    monkeypatch.setattr(embedding, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 6))
    rows = [("m", f"w{i:02d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    space = spark.createDataFrame(rows, "model_id string, item_id string, vec array<double>")
    queries = space.filter("item_id < 'w15'").withColumnRenamed("item_id", "query_id")
    got = embedding.nearest(queries, space, 3, metric=metric).toPandas()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(15):
        if metric == "cosine":
            order = np.argsort(-(unit @ unit[q]))
        else:
            order = np.argsort(np.linalg.norm(vectors - vectors[q], axis=1))
        expected = [f"w{i:02d}" for i in order if i != q][:3]
        mine = got[got.query_id == f"w{q:02d}"].sort_values("rank")["item_id"].tolist()
        assert mine == expected


def test_precision_counts_every_hit(spark):
    near = [("m", "q", f"n{i}", i + 1) for i in range(30)]
    for i in (0, 4, 9):
        near[i] = ("m", "q", "xZiel", i + 1)
    neighbours = spark.createDataFrame(near, "model_id string, query_word string, neighbour string, rank int")
    tests = spark.createDataFrame([("m", "q", "Ziel")], "model_id string, query_word string, expected string")
    row = embedding.translation_precision(tests, neighbours).first()
    assert (row.p_at_1, row.p_at_5, row.p_at_10, row.p_at_30) == (1.0, 2.0, 3.0, 3.0)
    strict = embedding.translation_precision(tests, neighbours, exact_match=True).first()
    assert strict.p_at_30 == 0.0


def test_precision_counts_repeated_pairs(spark):
    neighbours = spark.createDataFrame([("m", "q", "yes", 1)], "model_id string, query_word string, neighbour string, rank int")
    tests = [("m", "q", "yes"), ("m", "q", "yes"), ("m", "p", "no")]
    row = embedding.translation_precision(spark.createDataFrame(tests, "model_id string, query_word string, expected string"), neighbours).first()
    assert row.n_pairs == 3 and row.p_at_1 == pytest.approx(2 / 3)


def test_neighbour_ties_go_to_the_smaller_id(spark):
    rows = [("m", f"w{i}", [1.0, 0.0] if i else [1.0, 0.1]) for i in range(9)] + [("m", "w3", [0.0, 1.0])]
    space = spark.createDataFrame(rows, "model_id string, item_id string, vec array<double>")
    queries = spark.createDataFrame([("m", "w3", [1.0, 0.0]), ("m", "x", [1.0, 0.0])], "model_id string, query_id string, vec array<double>")
    found = embedding.nearest(queries, space, 3).toPandas().sort_values(["query_id", "rank"])
    assert found["item_id"].tolist() == ["w1", "w2", "w4", "w1", "w2", "w3"]


def test_theta_has_every_document(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "en")], "doc_id long, lang string")
    bow = spark.createDataFrame([(1, "en", "a", 2), (2, "en", "nowhere", 1)], "doc_id long, lang string, word string, tf long")
    phi = spark.createDataFrame([("t0", "en", "a", 0.5)], "topic_id string, lang string, word string, weight double")
    got = {r.doc_id: r.theta for r in topics.theta_from_phi(docs, bow, phi, ["t0", "t1"]).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_index_lines_that_do_not_split_are_returned(spark):
    docs = spark.createDataFrame([(1, "s", "f")], "doc_id long, sub_corpus string, file_name string")
    index = spark.createDataFrame([("s-f", "train"), ("s-f-g", "dev"), ("sf", "dev"), (None, "dev")], "entry string, data_type string")
    tagged, rejects = matching.tag_split_labels(docs, index)
    assert [(r.doc_id, r.data_type) for r in tagged.collect()] == [(1, "train")] and rejects.count() == 3


def test_linkage_fixture():
    angles = np.deg2rad([0, 10, 90, 100])
    points = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert topics.complete_linkage(points, 2).tolist() == [0, 0, 1, 1]


def test_linkage_is_complete_not_single():
    angles = np.deg2rad([0, 20, 41, 63, 86])
    points = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    assert topics.complete_linkage(points, 2).tolist() == [0, 0, 1, 1, 1] or topics.complete_linkage(points, 2).tolist() == [0, 0, 0, 1, 1]


def topic_frame(spark, topics_by_id, side="src"):
    rows = [("m", side, t, i + 1, w) for t, ws in topics_by_id.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "model_id string, side string, topic_id string, rank int, word string")


def test_diversities(spark):
    abc = topic_frame(spark, {"0": ["a", "b", "c"], "1": ["b", "a", "c"]})
    assert metrics.topic_diversity_positional(abc, [3]).first().diversity == pytest.approx(2 / 3)
    assert metrics.topic_diversity_jaccard(abc, [3]).first().diversity == pytest.approx(0)
    two = topic_frame(spark, {"0": ["a", "b"], "1": ["b", "c"]})
    assert metrics.unique_word_proportion(two, [2]).first().unique_share == 0.5


def test_single_language_border(spark):
    words = [f"a{i}" for i in range(30)] + [f"字{i}" for i in range(70)]
    frame = topic_frame(spark, {"0": words})
    assert metrics.crosslingual_proportion(frame).first().crosslingual_share == 0.0
    frame = topic_frame(spark, {"0": [f"a{i}" for i in range(31)] + [f"字{i}" for i in range(69)]})
    assert metrics.crosslingual_proportion(frame).first().crosslingual_share == 1.0


def test_rho_ties_go_to_the_lower_topic(spark):
    rho = spark.createDataFrame([("m", 0, 0, 0.2), ("m", 0, 1, 0.5), ("m", 0, 2, 0.5)], "model_id string, src_topic int, tgt_topic int, w double")
    assert topics.align_topics_by_rho(rho).first().tgt_topic == 1


def test_segmenter_hook(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.segment_with(docs, list).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_percent_removals():
    assert embedding.removals_for_percent(300, [10, 50, 90]) == [135, 75, 15]


def test_words_are_looked_up_where_the_documents_are(spark, monkeypatch):
    """A table counts with the Arrow bytes of its words; documents leave a worker in pieces, in order."""
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 1100)
    monkeypatch.setattr(matching, "PIECE_TOKENS", 7)
    pairs = spark.createDataFrame([(n, f"a{n}", f"b{n}") for n in range(40)], "seq long, src_word string, tgt_word string")
    words = [[f"{random.Random(i * 9 + j).choice('abc')}{j}" if j % 4 else None for j in range(i % 11)] for i in range(60)]
    docs = [(i, ("en", "fr", "de")[i % 3], None if i % 13 == 0 else ws) for i, ws in enumerate(words)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, tokens array<string>").coalesce(1)
    named = matching.concept_corpus(df, pairs, "en", "fr")
    assert "MapInArrow" in named._jdf.queryExecution().toString()
    own = {"en": "a", "fr": "b"}
    expected = {i: [f"#{w[1:]}" if w[0] == own[lang] else f"{lang}:{w}" for w in ws if w] for i, lang, ws in docs if lang in own and ws}
    assert {r.doc_id: r.tokens for r in named.collect()} == {i: ws for i, ws in expected.items() if ws}
    kept = matching.remove_missing_words(df, spark.createDataFrame([("a1",), ("a1",), ("b5",)], "word string"))
    assert [(r.doc_id, r.tokens) for r in kept.collect()] == [(i, [w for w in ws or [] if w in ("a1", "b5")]) for i, _, ws in docs]


@pytest.mark.parametrize("limit", [64 << 20, 6000, 0])
def test_frequent_words_are_weighed_where_the_documents_are(spark, monkeypatch, limit):
    """Only words that may not be broadcast are joined by word; the sums are those of all words."""
    monkeypatch.setattr(matching, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    docs = [(i, rng.choice(["en", "fr"]), [f"w{min(int(rng.paretovariate(0.4)), 90)}" for _ in range(rng.randint(0, 40))]) for i in range(80)]
    df = spark.createDataFrame([*docs, (None, "en", ["w1"]), (7, docs[7][1], ["w2", "nowhere"])], "doc_id long, lang string, tokens array<string>")
    phi = [(t, lang, f"w{n}", float(97 // n + m)) for m, t in enumerate(["t0", "t1", "t2"]) for lang in ("en", "fr") for n in range(1, 80) if (n + m) % 5]
    bow = tokens.bag_of_words(df)
    theta = topics.theta_from_phi(df.select("doc_id", "lang"), bow, spark.createDataFrame(phi, "topic_id string, lang string, word string, weight double"), ["t0", "t1", "t2"])
    weight, docs[7] = {(t, lang, w): x for t, lang, w, x in phi}, (7, docs[7][1], [*docs[7][2], "w2"])
    expected = {i: [sum(weight.get((t, lang, w), 0.0) for w in ws) for t in ("t0", "t1", "t2")] for i, lang, ws in docs}
    assert {r.doc_id: list(r.theta) for r in theta.collect()} == expected | {None: [0.0, 0.0, 0.0]}
    wide = spark.createDataFrame([(f"w{n}", float(n)) for n in range(400)], "word string, n double")
    head, tail = matching.frequent_rows(wide, "n")
    held = {r.word for r in head.collect()}, {r.word for r in tail.collect()} if tail else set()
    assert len(held[0]) + len(held[1]) == 400 and (len(held[0]) == 400, 100 < len(held[0]) < 400, not held[0])[[64 << 20, 6000, 0].index(limit)]


@pytest.mark.parametrize("limit", [64 << 20, 1500, 0])
def test_terms_of_frequent_and_other_words_meet_in_a_document(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    docs = [(i, "en", [f"w{min(int(rng.paretovariate(0.4)), 60)}" for _ in range(rng.randint(0, 30))]) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, tokens array<string>")
    vocab = tokens.count_vectorizer_vocab(df, with_df=True)
    place = {w: n for n, w in enumerate(sorted({w for _, _, ws in docs for w in ws}))}
    got = {r.doc_id: sorted((t.word_id, t.tf) for t in r.terms) for r in writers.collect_terms(df, tokens.bag_of_words(df), vocab).collect()}
    assert got == {i: sorted((place[w], n) for w, n in Counter(ws).items()) for i, _, ws in docs}


def test_own_centre_is_compared_with_all_centres(spark, monkeypatch):
    monkeypatch.setattr(embedding, "QUERY_ROWS", 7)
    draw = np.random.default_rng(2)
    points, centres = draw.normal(size=(40, 3)).round(2), draw.normal(size=(6, 3)).round(2)
    rows = [(f"w{i}", int(draw.integers(6)) * 3, p.tolist()) for i, p in enumerate(points)]
    words = spark.createDataFrame(rows, "word string, own int, vec array<double>")
    middle = spark.createDataFrame([(i * 3, c.tolist()) for i, c in enumerate(centres)], "cluster int, vec array<double>")
    got = {r.word: r.near for r in embedding.own_centre_nearest(words, middle, ["word"]).collect()}
    away = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert got == {w: bool(away[i, own // 3] <= away[i].min() + 1e-6) for i, (w, own, _) in enumerate(rows)} and len(set(got.values())) == 2


def test_queries_meet_blocks_in_parts(spark, monkeypatch):
    """Blocks are cut inside a key; neither the queries of a block nor the rows sent at once grow with the queries."""
    from lingospan.operators import neighbours

    draw = np.random.default_rng(3)
    rows = [(m, f"{m}{i:03d}", draw.normal(size=4).tolist()) for m in "ab" for i in range(60)]
    space = spark.createDataFrame(rows, "model_id string, item_id string, vec array<double>")
    queries = space.withColumnRenamed("item_id", "query_id")
    assert embedding._largest(queries, "model_id") == 60 and embedding._largest(queries.filter("false"), "model_id") == 0
    pick = lambda df: sorted((r.model_id, r.query_id, r.item_id, r["rank"], round(r.score, 9)) for r in df.collect())
    plain = pick(embedding.nearest(queries, space, 3))
    monkeypatch.setattr(embedding, "QUERY_ROWS", 9)
    monkeypatch.setattr(embedding, "BLOCK_ROWS", 25)
    monkeypatch.setattr(neighbours, "ASKED_ROWS", 16)
    monkeypatch.setattr(neighbours, "SENT_ROWS", 10)
    assert pick(embedding.nearest(queries, space, 3)) == plain and len(plain) == 360
    found, _ = neighbours.nearest_pruned(queries, space, 3, n_pivots=4, block_rows=8)
    assert pick(found) == plain


def test_best_scores_of_a_row():
    draw = np.random.default_rng(5)
    for columns in (1, 7, 300, 1000):
        scores = draw.normal(size=(20, columns)).round(1) + draw.normal(size=(20, columns)) * 1e-14
        scores[draw.random(scores.shape) < 0.1] = -np.inf
        scores[3] = -np.inf
        row, column, value = embedding.top_places(scores.copy(), 5)
        expected = [(i, j, v) for i, r in enumerate(scores.round(12)) for v, j in [(v, j) for j, v in sorted(enumerate(r), key=lambda c: (-c[1], c[0]))][:5] if v > -np.inf]
        assert list(zip(row.tolist(), column.tolist(), value.tolist(), strict=True)) == expected


def test_copies_of_a_space_do_not_grow_with_its_square():
    assert [embedding._blocks(n) for n in (0, 4096, 4097, 8 * 4096)] == [1, 1, 2, 8]
    assert embedding._blocks(8 * 8 * 4096) == 8 and embedding._blocks(600_000) == 19
