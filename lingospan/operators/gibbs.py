"""Latent Dirichlet allocation by collapsed Gibbs sampling, shard by shard.

The topic of every token is the state; the counts of words and topics are recounted from it after
each round, by bucket of words. In a round a group of shards gets the counts of its own words, and each
shard samples its tokens some sweeps long against them and its own changes. A sweep goes through the
tokens in stripes that hold every so-manyth token of each document: the tokens of a stripe leave
the counts, are drawn side by side, and come back. The distribution of a token is split in
three: topics of its document (a ragged list of those that occur), topics of its word, and
the smoothing rest, which all tokens share; only the first costs work per token.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.operators.sharding import answered, each_shard, from_buckets, generator, number_by_model, packed_groups, routed, to_buckets, train_groups
from lingospan.storage import discard, store

STRIPES = 16
#: Cells of the word-topic counts of a shard.
SHARD_CELLS = 1 << 26


def _count(into: np.ndarray, rows: np.ndarray, columns: np.ndarray, sign: int) -> None:
    """Add or take away one at every given cell of a matrix."""
    np.add.at(into.reshape(-1), rows * into.shape[1] + columns, sign)


def draw_topics(word_topics, doc_topics, topics, words, docs, alpha: float, beta: float, n_words: int, rng) -> np.ndarray:
    """Topics of tokens that are in none of the counts, drawn independently of each other."""
    k = len(topics)
    scale = 1.0 / (topics + n_words * beta)
    smooth = np.cumsum(alpha * beta * scale)
    distinct, which = np.unique(words, return_inverse=True)
    word_part = np.cumsum(alpha * word_topics[distinct] * scale, axis=1)

    # The topics of each token's document, one list behind the other.
    present, place = np.unique(docs, return_inverse=True)
    row, topic = np.nonzero(doc_topics[present])
    size = np.bincount(row, minlength=len(present))
    begin = np.cumsum(size) - size
    length = size[place]
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[place] - ends + length, length)
    listed = topic[at]
    weight = doc_topics[np.repeat(docs, length), listed] * (word_topics[np.repeat(words, length), listed] + beta) * scale[listed]
    run = np.cumsum(weight)
    before = np.where(ends > length, run[np.maximum(ends - length - 1, 0)] if len(run) else 0.0, 0.0)
    doc_mass = np.where(length > 0, (run[np.maximum(ends - 1, 0)] if len(run) else 0.0) - before, 0.0)

    word_mass = word_part[which, -1]
    mark = rng.random(len(words)) * (doc_mass + word_mass + smooth[-1])
    out = np.empty(len(words), np.int64)
    by_doc = mark < doc_mass
    found = np.searchsorted(run, before[by_doc] + mark[by_doc], side="right")
    out[by_doc] = listed[np.clip(found, ends[by_doc] - length[by_doc], ends[by_doc] - 1)]
    mark = mark - doc_mass
    by_word = ~by_doc & (mark < word_mass)
    # Rows of sums behind each other rise if each starts where the one before ends.
    raised = word_part + (np.cumsum(word_part[:, -1]) - word_part[:, -1])[:, None]
    first = which[by_word] * k
    found = np.searchsorted(raised.ravel(), raised[which[by_word], 0] - word_part[which[by_word], 0] + mark[by_word], side="right")
    out[by_word] = np.clip(found, first, first + k - 1) - first
    rest = ~by_doc & ~by_word
    out[rest] = np.minimum(np.searchsorted(smooth, mark[rest] - word_mass[rest], side="right"), k - 1)
    return out


def sweep(words, docs, z, word_topics, doc_topics, topics, alpha: float, beta: float, n_words: int, rng, stripes: int = STRIPES) -> None:
    """Draw the topic of every token once; ``z`` and the counts are changed in place."""
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    position = np.arange(len(docs)) - np.repeat(starts, np.diff(starts, append=len(docs)))
    stripe = (position + rng.integers(stripes, size=len(starts)).repeat(np.diff(starts, append=len(docs)))) % stripes
    in_order = np.argsort(stripe.astype(np.min_scalar_type(stripes)), kind="stable")
    ends = np.cumsum(np.bincount(stripe, minlength=stripes))
    for s in rng.permutation(stripes):
        chosen = in_order[ends[s - 1] if s else 0 : ends[s]]
        if not len(chosen):
            continue
        w, d = words[chosen], docs[chosen]
        for sign in (-1, 1):
            if sign == 1:
                z[chosen] = draw_topics(word_topics, doc_topics, topics, w, d, alpha, beta, n_words, rng)
            _count(word_topics, w, z[chosen], sign)
            _count(doc_topics, d, z[chosen], sign)
            topics += sign * np.bincount(z[chosen], minlength=len(topics))


def log_likelihood(words, docs, word_topics, doc_topics, topics, alpha: float, beta: float, n_words: int) -> float:
    """Sum over tokens of the logarithm of their probability under the current counts."""
    theta = (doc_topics + alpha) / (doc_topics.sum(axis=1, keepdims=True) + alpha * len(topics))
    phi = (word_topics + beta) / (topics + n_words * beta)
    total = 0.0
    for at in range(0, len(words), 1 << 16):
        part = slice(at, at + (1 << 16))
        total += float(np.log((theta[docs[part]] * phi[words[part]]).sum(axis=1)).sum())
    return total


def lda_gibbs(
    docs: DataFrame,
    n_topics: int | str,
    keys: Sequence[str] = ("lang",),
    *,
    doc: str = "doc_id",
    tokens: str = "tokens",
    alpha_sum: float = 0.1,
    beta: float = 0.01,
    rounds: int = 10,
    sweeps: int = 5,
    shard_tokens: int = 500_000,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One model per value of ``keys``, all trained in the same jobs: phi, theta and history.

    ``phi(keys…, topic_id, word, weight)`` has a row for every word and topic with tokens; another word
    of the model has the weight ``beta / (tokens of the topic + words * beta)`` there.
    ``theta(keys…, doc, theta)`` has a row for every document with a token.
    ``history(keys…, round, tokens, log_likelihood)`` has the counted tokens and the mean
    logarithm of a token's probability before each round, and after the last one.

    ``n_topics`` is a number or the name of the key that holds it, so a sweep over numbers of topics is one
    training. ``alpha_sum`` is the Dirichlet mass over all topics. A document is a list of whole
    tokens in one shard, so ``shard_tokens`` is exceeded by a longer one.
    """
    keys, topics_of = list(keys), number_by_model(n_topics, keys)
    spark = docs.sparkSession
    most = n_topics if isinstance(n_topics, int) else docs.agg(F.max(n_topics)).first()[0] or 1
    shard_tokens = max(1, min(shard_tokens, SHARD_CELLS // most))
    groups, n_groups, n_buckets = packed_groups(docs, keys, doc, tokens, shard_tokens, np.iinfo(np.int32).max, 4 * most)
    members, routes = routed(groups, keys, n_groups, n_buckets)
    key_fields = [docs.schema[k] for k in keys]
    binary = [T.StructField(n, T.BinaryType()) for n in ("at", "values", "z")]
    numbers = [T.StructField(n, T.IntegerType()) for n in ("group", "bucket")]
    schema = T.StructType([*key_fields, *numbers, *binary, T.StructField("log_likelihood", T.DoubleType())])

    def with_state(member: dict, z: np.ndarray, k: int, likelihood: float, sent: bool = True) -> pd.DataFrame:
        """The topics of a group's tokens, and for every bucket the counts of its words and topics."""
        state = pd.DataFrame({"bucket": [-1], "z": [z.astype(np.int32).tobytes()], "log_likelihood": [likelihood]})
        if not sent:
            return state
        ids, n_terms = np.frombuffer(member["ids"], np.int32), len(member["order"]) // 4
        cells = np.bincount(ids * np.int64(k) + z, minlength=n_terms * k).reshape(n_terms, k)
        return pd.concat([state, to_buckets(member, values=cells.astype(np.int32))])

    def start(batches):
        for pdf in batches:
            for member in pdf.to_dict("records"):
                key = [member[k] for k in keys]
                k = topics_of(key)
                z = [generator(seed, 0, [*key, shard]).integers(k, size=own.stop - own.start) for shard, _, own in each_shard(member)]
                out = with_state(member, np.concatenate(z), k, np.nan)
                yield out.assign(group=member["group"], **dict(zip(keys, key, strict=True))).reindex(columns=schema.names)

    def sampler(step: int, totals: dict[tuple, np.ndarray], sizes: dict[tuple, int]):
        def run(key: tuple, member: dict, replies: pd.DataFrame) -> pd.DataFrame:
            k, n_words = topics_of(key), sizes[key[:-1]]
            alpha = alpha_sum / k
            counts = from_buckets(member, replies, np.int64)
            all_ids, z = np.frombuffer(member["ids"], np.int32), np.frombuffer(member["z"], np.int32).astype(np.int64)
            lengths, likelihood = np.frombuffer(member["sizes"], np.int32), 0.0
            for shard, entries, own in each_shard(member):
                rng = generator(seed, step, [*key[:-1], shard])
                used, ids = np.unique(all_ids[own], return_inverse=True)
                entry = np.repeat(np.arange(entries.stop - entries.start), lengths[entries])
                # Every shard starts from the counts of the last round.
                word_topics, topics = counts[used], totals[key[:-1]].copy()
                doc_topics = np.zeros((entries.stop - entries.start, k), np.int64)
                _count(doc_topics, entry, z[own], 1)
                likelihood += log_likelihood(ids, entry, word_topics, doc_topics, topics, alpha, beta, n_words)
                for _ in range(sweeps if step <= rounds else 0):
                    sweep(ids, entry, z[own], word_topics, doc_topics, topics, alpha, beta, n_words, rng)
            return with_state(member, z, k, likelihood, step <= rounds)

        return run

    def per_topic(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                k = topics_of([row[key] for key in keys])
                sums = np.frombuffer(row["values"], np.int64).reshape(-1, k).sum(axis=0)
                yield pd.DataFrame({**{key: row[key] for key in keys}, "topic": np.arange(k, dtype=np.int32), "n": sums})

    sums_schema = T.StructType([*key_fields, T.StructField("topic", T.IntegerType()), T.StructField("n", T.LongType())])
    sizes = {tuple(r)[:-1]: r["n"] for r in routes.filter("group = -1").groupBy(*keys).agg(F.sum(F.size("terms")).alias("n")).collect()}
    state = store(members.mapInPandas(start, schema), "topics")
    history, counts = [], None
    # The step after the last round only measures.
    for step in range(1, rounds + 2):
        sent = state.filter("bucket >= 0")
        last, counts = counts, store(answered(sent, keys, {"values": np.int32}, n_groups + n_buckets, lambda n: n), "counts")
        totals = {key: np.zeros(topics_of(key), np.int64) for key in sizes}
        whole = counts.filter("group = -1").select(*keys, "values").mapInPandas(per_topic, sums_schema)
        for r in whole.groupBy(*keys, "topic").agg(F.sum("n").alias("n")).collect():
            totals[tuple(r)[:-2]][r["topic"]] = r["n"]
        old = state
        z = old.filter("bucket = -1").select(*keys, "group", "z")
        state = store(train_groups(members, z, counts, keys, n_groups, sampler(step, totals, sizes), schema), "topics")
        for table in (last, old):
            discard(table) if table is not None else None
        for r in state.filter("bucket = -1").groupBy(*keys).agg(F.sum("log_likelihood").alias("x")).collect():
            n = int(totals[tuple(r)[:-1]].sum())
            history.append((*tuple(r)[:-1], step, n, r["x"] / n))

    def word_weights(key: tuple, rows: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        k, total = topics_of(key), totals[key[:-1]]
        n = np.frombuffer(rows["values"].iloc[0], np.int64).reshape(-1, k)
        word, topic = np.nonzero(n)
        weight = (n[word, topic] + beta) / (total[topic] + sizes[key[:-1]] * beta)
        out = pd.DataFrame({"topic_id": topic.astype(np.int32), "word": np.asarray(named["terms"].iloc[0], object)[word], "weight": weight})
        return out.assign(**dict(zip(keys, key, strict=False)))[phi_schema.names]

    by = [*keys, "bucket"]
    phi_fields = [T.StructField("topic_id", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("weight", T.DoubleType())]
    phi_schema = T.StructType([*key_fields, *phi_fields])
    whole, named = counts.filter("group = -1").select(*by, "values"), routes.filter("group = -1").select(*by, "terms")
    phi = whole.groupBy(*by).cogroup(named.groupBy(*by)).applyInPandas(word_weights, phi_schema)

    def weights(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                lengths, k = np.frombuffer(row["sizes"], np.int32), topics_of([row[key] for key in keys])
                doc_topics = np.zeros((len(lengths), k))
                _count(doc_topics, np.repeat(np.arange(len(lengths)), lengths), np.frombuffer(row["z"], np.int32), 1)
                smoothed = doc_topics + alpha_sum / k
                out = pd.DataFrame({doc: np.frombuffer(row["docs"], np.int64), "theta": list(smoothed / smoothed.sum(axis=1, keepdims=True))})
                yield out.assign(**{key: row[key] for key in keys})[theta_schema.names]

    theta_schema = T.StructType([*key_fields, T.StructField(doc, T.LongType()), T.StructField("theta", T.ArrayType(T.DoubleType()))])
    z = state.filter("bucket = -1").select(*keys, "group", "z")
    theta = groups.select(*keys, "group", "docs", "sizes").join(z, [*keys, "group"]).mapInPandas(weights, theta_schema)
    log_fields = [T.StructField("round", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType())]
    return phi, theta, spark.createDataFrame(history, T.StructType([*key_fields, *log_fields]))
