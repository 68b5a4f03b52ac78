"""Topic models of documents in several languages that share one topic distribution.

A tuple of documents has one theta, every language its own word distributions. Mean-field
variational inference in rounds: a group of shards of tuples gets the word rows it needs, fits the
theta of its tuples from where the last round left them, shard by shard, and returns expected counts of its
words; these are summed to the next word rows. The bound on the likelihood of each round
adds the part of every tuple and the part of every word row, and never falls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.functions.special import digamma, log_gamma
from lingospan.operators.sharding import answered, each_shard, first_answers, from_buckets, number_by_model, packed_groups, routed, to_buckets, train_groups
from lingospan.storage import discard, store

INNER_STEPS, ENOUGH = 30, 1e-4


def expected_log(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Expected logarithms of Dirichlet weights with these parameters and parameter sums."""
    return digamma(rows) - digamma(total)


def fit_tuples(doc, word, n, gamma, log_beta, alpha: float):
    """Theta parameters, expected counts by word and topic, and the tuples' part of the bound.

    ``doc, word, n`` are the non-zero counts, sorted by doc; ``gamma`` is the start, a row per
    tuple; ``log_beta`` the expected logarithms of the words' weights.
    """
    k = gamma.shape[1]
    # A contiguous row per topic: sums over the cells of a document run along it.
    beta = np.exp(log_beta).T[:, word].copy()
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    size = np.diff(first, append=len(doc))
    for _ in range(INNER_STEPS):
        theta = np.exp(expected_log(gamma, gamma.sum(axis=1, keepdims=True)))
        norm = np.zeros(len(doc))
        for share, row in zip(theta[doc[first]].T, beta, strict=True):
            norm += np.repeat(share, size) * row
        new = np.full_like(gamma, alpha)
        new[doc[first]] += theta[doc[first]] * np.add.reduceat(beta * (n / norm), first, axis=1).T
        change = np.abs(new - gamma).mean()
        gamma = new
        if change < ENOUGH:
            break
    log_theta = expected_log(gamma, gamma.sum(axis=1, keepdims=True))
    both = np.exp(log_theta).T[:, doc] * beta
    norm = both.sum(axis=0)
    share = both * (n / norm)
    counts = np.stack([np.bincount(word, weights, minlength=len(log_beta)) for weights in share], axis=1)
    bound = (n * np.log(norm)).sum()
    bound += len(gamma) * (log_gamma(np.float64(k * alpha)) - k * log_gamma(np.float64(alpha)))
    bound += ((alpha - gamma) * log_theta + log_gamma(gamma)).sum() - log_gamma(gamma.sum(axis=1)).sum()
    return gamma, counts, float(bound)


def lda_shared(
    tuples: DataFrame,
    n_topics: int | str,
    keys: Sequence[str] = ("model_id",),
    *,
    doc: str = "pair_id",
    tokens: str = "tokens",
    alpha_sum: float = 0.1,
    eta: float = 0.01,
    rounds: int = 20,
    shard_tokens: int = 300_000,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One model per value of ``keys``, all in the same jobs: phi, theta, history and mass.

    ``tuples(keys…, doc, lang, tokens)`` has a row per document; rows with the same keys and doc are one
    tuple, in any number of languages and whichever of them it has. ``phi(keys…, lang, topic_id, word,
    weight)`` sums to one by topic and language, ``theta(keys…, doc, theta)`` is normalised, for tuples
    with a token. ``history(keys…, round, bound)`` is the bound before the word rows of the round are
    replaced, ``mass(keys…, lang, tokens)`` the expected counts, which add up to the tokens.
    ``n_topics`` is a number or the name of the key that holds it, so a sweep over numbers of topics is one
    training. Language codes hold no colon.
    """
    keys, topics_of = list(keys), number_by_model(n_topics, keys)
    width = F.lit(n_topics) if isinstance(n_topics, int) else F.col(n_topics).cast("int")
    most = n_topics if isinstance(n_topics, int) else tuples.agg(F.max(n_topics)).first()[0] or 1
    spark = tuples.sparkSession
    named = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.concat(F.col("lang"), F.lit(":"), t))
    # The documents of a tuple meet in one row, as its languages and no more.
    whole = tuples.select(*keys, doc, named.alias("_terms")).groupBy(*keys, doc).agg(F.flatten(F.collect_list("_terms")).alias("_terms"))
    groups, n_groups, n_buckets = packed_groups(whole, keys, doc, "_terms", shard_tokens, np.iinfo(np.int32).max, 8 * most)
    n_tasks = n_groups + n_buckets
    sides = F.transform("terms", lambda t: F.substring_index(t, ":", 1))
    langs = sorted(r[0] for r in groups.select(F.explode(F.array_distinct(sides))).distinct().collect())
    numbers = F.array(*[F.lit(lang) for lang in langs])
    lang_of = F.transform(sides, lambda lang: (F.array_position(numbers, lang) - 1).cast("int")).alias("langs")
    members, routes = routed(groups.select("*", lang_of), keys, n_groups, n_buckets)
    words = routes.filter("group = -1").select(*keys, "bucket", "terms", lang_of)
    sizes = words.select(*keys, F.explode("langs").alias("lang")).groupBy(*keys, "lang").agg(F.count(F.lit(1)).alias("n"))
    n_words = {(*tuple(r)[:-2], langs[r["lang"]]): r["n"] for r in sizes.collect()}

    # Start: counts that differ a little from word to word and topic to topic.
    topics = F.sequence(F.lit(0), width - 1)
    noise = F.transform("terms", lambda t: F.transform(topics, lambda j: 1 + F.pmod(F.xxhash64(t, j, F.lit(seed)), F.lit(1000)) / 500.0))
    state = store(first_answers(routes, keys, noise, n_tasks), "word-topics")
    key_fields = [tuples.schema[key] for key in keys]
    double = T.DoubleType()

    def by_bucket(state: DataFrame) -> DataFrame:
        """The word rows of every bucket with the languages of its words."""
        return state.filter("group = -1").select(*keys, "bucket", "values").join(words.drop("terms"), [*keys, "bucket"])

    def rows_of(row: dict) -> np.ndarray:
        return np.frombuffer(row["values"]).reshape(-1, topics_of([row[key] for key in keys]))

    def per_topic(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                rows, lang = rows_of(row), np.asarray(row["langs"])
                for own in np.unique(lang):
                    sums = rows[lang == own].sum(axis=0)
                    yield pd.DataFrame({**{key: row[key] for key in keys}, "lang": langs[own], "topic": np.arange(len(sums), dtype=np.int32), "x": sums})

    sums_fields = [T.StructField("lang", T.StringType()), T.StructField("topic", T.IntegerType()), T.StructField("x", double)]

    def totals_of(state: DataFrame) -> dict[tuple, np.ndarray]:
        """Sum of the word rows by model and language: as many numbers as topics each."""
        rows = by_bucket(state).mapInPandas(per_topic, T.StructType([*key_fields, *sums_fields]))
        out = {key: np.zeros(topics_of(key)) for key in n_words}
        for r in rows.groupBy(*keys, "lang", "topic").agg(F.sum("x").alias("x")).collect():
            out[tuple(r)[:-2]][r["topic"]] = r["x"]
        return out

    def table(totals: dict[tuple, np.ndarray], key: tuple) -> np.ndarray:
        """The totals of a model, a row for every language; the model has no words of the others."""
        return np.stack([totals.get((*key, lang), np.ones(topics_of(key))) for lang in langs])

    def fitter(totals: dict[tuple, np.ndarray]):
        def run(key: tuple, member: dict, replies: pd.DataFrame) -> pd.DataFrame:
            k = topics_of(key)
            alpha = alpha_sum / k
            weights = from_buckets(member, replies, np.float64)
            all_ids, lengths = (np.frombuffer(member[name], np.int32) for name in ("ids", "sizes"))
            all_beta = expected_log(weights, table(totals, key[:-1])[np.asarray(member["langs"])])
            before = member.get("gamma")
            gammas = np.full((len(lengths), k), alpha) + (lengths.astype(np.float64) / k)[:, None] if before is None else np.frombuffer(before).reshape(-1, k).copy()
            sums, total = np.zeros(weights.shape), 0.0
            for _, entries, own in each_shard(member):
                used, ids = np.unique(all_ids[own], return_inverse=True)
                entry = np.repeat(np.arange(entries.stop - entries.start), lengths[entries])
                pairs, n = np.unique(entry * np.int64(len(used)) + ids, return_counts=True)
                gammas[entries], counts, bound = fit_tuples(*np.divmod(pairs, len(used)), n, gammas[entries], all_beta[used], alpha)
                sums[used] += counts
                total += bound
            return pd.concat([pd.DataFrame({"bucket": [-1], "gamma": [gammas.tobytes()], "bound": [total]}), to_buckets(member, values=sums)])

        return run

    fields = [T.StructField(n, T.IntegerType()) for n in ("group", "bucket")] + [T.StructField(n, T.BinaryType()) for n in ("at", "values", "gamma")]
    fitted = T.StructType([*key_fields, *fields, T.StructField("bound", double)])

    def word_part(totals: dict[tuple, np.ndarray]):
        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    weights, key = rows_of(row), tuple(row[key] for key in keys)
                    part = ((eta - weights) * expected_log(weights, table(totals, key)[np.asarray(row["langs"])]) + log_gamma(weights)).sum()
                    yield pd.DataFrame([(*key, part)], columns=[*keys, "part"])

        return run

    part_schema = T.StructType([*key_fields, T.StructField("part", double)])
    history, totals, done, gamma = [], totals_of(state), None, None
    for step in range(1, rounds + 1):
        old, done = done, store(train_groups(members, gamma, state, keys, n_groups, fitter(totals), fitted), "tuples")
        gamma = done.filter("bucket = -1").select(*keys, "group", "gamma")
        bound = {tuple(r)[:-1]: r["b"] for r in done.filter("bucket = -1").groupBy(*keys).agg(F.sum("bound").alias("b")).collect()}
        for r in by_bucket(state).mapInPandas(word_part(totals), part_schema).groupBy(*keys).agg(F.sum("part").alias("p")).collect():
            bound[tuple(r)[:-1]] += r["p"]
        for key, size in n_words.items():
            k = topics_of(key)
            fixed = k * (log_gamma(np.float64(size * eta)) - size * log_gamma(np.float64(eta)))
            bound[key[:-1]] += float(fixed - log_gamma(totals[key]).sum())
        history += [(*key, step, float(b)) for key, b in bound.items()]
        for replaced in (old, state):
            discard(replaced) if replaced is not None else None
        sent = done.filter("bucket >= 0")
        state = store(answered(sent, keys, {"values": np.float64}, n_tasks, lambda x: x + eta), "word-topics")
        totals = totals_of(state)

    mass = [(*key, float(total.sum() - len(total) * eta * n_words[key])) for key, total in totals.items()]
    mass_schema = T.StructType([*key_fields, T.StructField("lang", T.StringType()), T.StructField("tokens", double)])
    log_schema = T.StructType([*key_fields, T.StructField("round", T.IntegerType()), T.StructField("bound", double)])

    def word_weights(key: tuple, rows: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        lang = np.asarray(named["langs"].iloc[0])
        weights = np.frombuffer(rows["values"].iloc[0]).reshape(len(lang), -1)
        share = weights / table(totals, key[:-1])[lang]
        names = [t.split(":", 1)[1] for t in named["terms"].iloc[0]]
        n, k = share.shape
        out = {"lang": np.asarray(langs, object)[np.repeat(lang, k)], "topic_id": np.tile(np.arange(k, dtype=np.int32), n), "word": np.repeat(np.asarray(names, object), k)}
        return pd.DataFrame(out | {"weight": share.ravel()}).assign(**dict(zip(keys, key, strict=False)))[phi_schema.names]

    by = [*keys, "bucket"]
    phi_fields = [T.StructField("lang", T.StringType()), T.StructField("topic_id", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("weight", double)]
    phi_schema = T.StructType([*key_fields, *phi_fields])
    phi = state.filter("group = -1").groupBy(*by).cogroup(words.groupBy(*by)).applyInPandas(word_weights, phi_schema)

    def weights(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                rows = np.frombuffer(row["gamma"]).reshape(-1, topics_of([row[key] for key in keys]))
                out = pd.DataFrame({doc: np.frombuffer(row["docs"], np.int64), "theta": list(rows / rows.cumsum(axis=1)[:, -1:])})
                yield out.assign(**{key: row[key] for key in keys})[theta_schema.names]

    theta_schema = T.StructType([*key_fields, T.StructField(doc, T.LongType()), T.StructField("theta", T.ArrayType(double))])
    theta = groups.select(*keys, "group", "docs").join(gamma, [*keys, "group"]).mapInPandas(weights, theta_schema)
    return phi, theta, spark.createDataFrame(history, log_schema), spark.createDataFrame(mass, mass_schema)
