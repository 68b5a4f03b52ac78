"""Topics from anchor words, also linked across two languages by a dictionary.

A word stands for the distribution of the words it shares documents with. These rows are never
built: every document adds its random projection, a vector of fixed width, to each of its words, so a
task needs its own documents and words alone. Anchors are words whose rows span the
others: each next one is farthest from the span of those before. With linked languages a pair of
translations is chosen by the nearer of its two sides, so both sides get anchors of one topic.
Every other word is then a mixture of the anchors of its language, found by a small simplex
regression, all words side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingospan.operators.sharding import packed, sum_arrays
from lingospan.storage import store

ENTRIES, REGRESSION_STEPS = 16_384, 300
#: Numbers that are worked on at a time, so that they stay near the core.
CACHED = 1 << 16
#: Groups of shards are as many until a group has its most shards.
GROUPS = 64


def signs(terms: Sequence[str], width: int, seed: int) -> np.ndarray:
    """A row of random signs for every term, the same in every task, of length one."""
    first = [int.from_bytes(hashlib.blake2b(f"{seed}:{t}".encode(), digest_size=8).digest(), "little") for t in terms]
    first, step = np.array(first, np.uint64), np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out, one, rows = np.empty((len(first), width)), 1.0 / np.sqrt(width), max(1, CACHED // width)
    for at in range(0, len(first), rows):
        x = first[at : at + rows, None] + step
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        out[at : at + rows] = np.where(x >> np.uint64(63), one, -one)
    return out


def _add_runs(into: np.ndarray, keys: np.ndarray, rows) -> None:
    """``into[keys] += rows(part)`` for sorted keys, some rows at a time; those of a key are added up first."""
    size = max(1, CACHED // into.shape[1])
    for at in range(0, len(keys), size):
        part = slice(at, at + size)
        own = keys[part]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        into[own[first]] += np.add.reduceat(rows(part), first, axis=0)


def project(doc: np.ndarray, term: np.ndarray, n: np.ndarray, random: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Projected row, mass and documents of every term, or of ``wanted`` ones, from counts sorted by document.

    A document of N tokens spreads a mass of one over its N (N - 1) ordered pairs of tokens.
    """
    size = np.bincount(doc, n).astype(np.float64)
    width = random.shape[1]
    out = np.zeros((len(random), width + 2))
    whole = np.zeros((len(size), width))
    _add_runs(whole, doc, lambda part: n[part, None] * random[term[part]])
    useful = size[doc] > 1
    useful &= True if wanted is None else wanted[term]
    d, t, c = doc[useful], term[useful], n[useful].astype(np.float64)
    by_term = np.argsort(t, kind="stable")
    d, t, c = d[by_term], t[by_term], c[by_term]
    share = c / (size[d] * (size[d] - 1))
    _add_runs(out[:, :width], t, lambda part: share[part, None] * (whole[d[part]] - random[t[part]]))
    out[:, width] = np.bincount(t, c / size[d], minlength=len(random))
    out[:, width + 1] = np.bincount(t, minlength=len(random))
    return out


def _cells(shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of every non-zero count of a shard, sorted by document."""
    entry = np.repeat(np.arange(len(shard["sizes"])), shard["sizes"])
    cells, n = np.unique(entry * np.int64(len(shard["terms"])) + shard["ids"], return_counts=True)
    return *np.divmod(cells, len(shard["terms"])), n


def _grouped(shards: DataFrame, most: int) -> DataFrame:
    """Shards with the number of their group: a task adds up a group's rows before they are shuffled."""
    group_shards = max(1, min(most, shards.count() // GROUPS))
    return shards.withColumn("_group", F.floor(F.col("shard") / group_shards).cast("int"))


def document_frequency(shards: DataFrame, keys: Sequence[str] = ("lang",)) -> DataFrame:
    """``(keys…, word, df)``: documents with two tokens or more that hold the word."""
    keys = list(keys)
    schema = T.StructType([shards.schema[k] for k in keys] + [T.StructField("word", T.StringType()), T.StructField("df", T.LongType())])

    def run(batches):
        for pdf in batches:
            for _, shard in pdf.iterrows():
                doc, term, n = _cells(shard)
                df = np.bincount(term[np.bincount(doc, n)[doc] > 1], minlength=len(shard["terms"]))
                out = pd.DataFrame({"word": np.asarray(shard["terms"])[df > 0], "df": df[df > 0]})
                for key in keys:
                    out[key] = shard[key]
                yield out[schema.names]

    return shards.mapInPandas(run, schema).groupBy(*keys, "word").agg(F.sum("df").alias("df"))


def cooccurrence_rows(
    shards: DataFrame, words: DataFrame, keys: Sequence[str] = ("lang",), *, width: int = 256, group_shards: int = 50, seed: int = 1
) -> DataFrame:
    """``(keys…, word, vec, mass, df)``: the projected co-occurrence distribution of ``words(keys…, word)``.

    Words of documents with one token alone have no company and no row. A task holds the rows of all
    ``words`` of a model.
    """
    keys = list(keys)
    grouped = _grouped(shards, group_shards)
    by = [*keys, "_group"]
    groups = store(grouped.select(*by).distinct(), "groups")
    wanted, n_groups = words.join(groups, keys), groups.count()
    fields = [shards.schema[k] for k in keys] + [T.StructField("word", T.StringType()), T.StructField("_order", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("row", T.ArrayType(T.DoubleType()))])

    def run(key: tuple, group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = pd.Index(own["word"]).sort_values()
        rows = np.zeros((len(own), width + 2))
        for _, shard in group.sort_values("shard").iterrows():
            place = own.get_indexer(shard["terms"]) if len(own) else np.full(len(shard["terms"]), -1)
            if (place >= 0).any():
                known = place >= 0
                rows[place[known]] += project(*_cells(shard), signs(shard["terms"], width, seed), known)[known]
        kept = rows[:, -1] > 0
        out = pd.DataFrame({"word": own[kept], "_order": int(key[-1]), "row": list(rows[kept])})
        for name, value in zip(keys, key, strict=False):
            out[name] = value
        return out[schema.names]

    left, right = grouped.repartition(max(1, n_groups), *by), wanted.repartition(max(1, n_groups), *by)
    rows = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)
    summed = sum_arrays(rows, [*keys, "word"], ["row"], n_groups)
    mass, df = F.get("row", F.lit(width)), F.get("row", F.lit(width + 1))
    vec = F.transform(F.slice("row", 1, width), lambda x: x / mass)
    return store(summed.select(*keys, "word", vec.alias("vec"), mass.alias("mass"), df.cast("long").alias("df")), "rows")


def products(shards: DataFrame, directions: dict[str, np.ndarray], *, width: int, group_shards: int = 20, seed: int = 1) -> DataFrame:
    """``(lang, word, products, mass)``: inner products of every word's row with the directions of its language.

    They are linear in the row, so documents are projected on ``directions`` (a row each) at once and no row of
    ``width`` numbers is built for a word. Words of languages without directions are left out.
    """
    schema = "lang string, word string, _order int, row array<double>"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = directions[key[0]]
        place, terms = pd.factorize(np.concatenate(group["terms"].to_numpy()), sort=True)
        random = np.concatenate([signs(terms[at : at + ENTRIES], width, seed) @ points.T for at in range(0, len(terms), ENTRIES)])
        rows, done = np.zeros((len(terms), len(points) + 2)), 0
        for _, shard in group.iterrows():
            own = place[done : done + len(shard["terms"])]
            done += len(own)
            rows[own] += project(*_cells(shard), random[own])
        kept = rows[:, -1] > 0
        return pd.DataFrame({"lang": key[0], "word": terms[kept], "_order": int(key[-1]), "row": list(rows[kept])})

    grouped = _grouped(shards.filter(F.col("lang").isin(list(directions))), group_shards)
    n_groups = grouped.select("lang", "_group").distinct().count()
    ordered = grouped.repartition(max(1, n_groups), "lang", "_group").sortWithinPartitions("lang", "_group", "shard")
    rows = ordered.groupBy("lang", "_group").applyInPandas(run, schema)
    summed = sum_arrays(rows, ["lang", "word"], ["row"], n_groups)
    size, mass = F.size("row"), F.element_at("row", -2)
    found = F.transform(F.slice("row", F.lit(1), size - 2), lambda x: x / mass)
    return store(summed.select("lang", "word", found.alias("products"), mass.alias("mass")), "products")


def choose_anchors(candidates: DataFrame, keys: Sequence[str], names: Sequence[str], n_topics: int) -> dict[tuple, list[dict]]:
    """Anchors of every model in the order of choice, from ``candidates(keys…, names…, sides)``.

    ``sides`` is an array with the row of a candidate in each language; the least of its distances from the
    anchors so far counts, and of equally far candidates the one with the greatest names. One pass over the candidates
    per topic, which returns one row a model; a model of few candidates has few anchors.
    """
    keys, names = list(keys), list(names)
    candidates = store(candidates.select(*keys, *names, "sides"), "candidates")
    chosen: dict[tuple, list[dict]] = {}
    schema = T.StructType([*candidates.schema.fields, T.StructField("far", T.DoubleType())])

    def spans() -> dict[tuple, list[np.ndarray]]:
        """An orthonormal basis of the differences to the first anchor, by model and side."""
        out = {}
        for key, anchors in chosen.items():
            sides = [np.stack([a["sides"][s] for a in anchors]) for s in range(len(anchors[0]["sides"]))]
            out[key] = [(x[0], np.linalg.qr((x[1:] - x[0]).T)[0] if len(x) > 1 else np.zeros((x.shape[1], 0))) for x in sides]
        return out

    for _ in range(n_topics):
        known = spans()

        def farthest(batches):
            best: dict[tuple, tuple] = {}
            for pdf in batches:
                for key, rows in pdf.groupby(keys, sort=False):
                    far = np.full(len(rows), np.inf)
                    for s in range(len(rows["sides"].iloc[0])):
                        x = np.stack([r[s] for r in rows["sides"]]).astype(np.float64)
                        if key in known:
                            origin, basis = known[key][s]
                            x = x - origin
                            x = x - (x @ basis) @ basis.T
                        far = np.minimum(far, np.linalg.norm(x, axis=1))
                    top = rows.assign(far=far).nlargest(1, "far", keep="all").sort_values(names).iloc[-1]
                    entry = (top["far"], tuple(top[n] for n in names))
                    if key not in best or entry > best[key][0]:
                        best[key] = (entry, top)
            if best:
                yield pd.DataFrame([row for _, row in best.values()])[schema.names]

        tops = candidates.mapInPandas(farthest, schema)
        pick = F.max_by(F.struct(*names, "sides", "far"), F.struct("far", *names)).alias("top")
        for row in tops.groupBy(*keys).agg(pick).collect():
            top = row["top"].asDict()
            if top["far"] > 1e-9:
                top["sides"] = [np.array(side) for side in top["sides"]]
                chosen.setdefault(tuple(row[k] for k in keys), []).append(top)
    return chosen


def simplex_projection(x: np.ndarray) -> np.ndarray:
    """The nearest points of the simplex to the rows of a matrix."""
    ordered = -np.sort(-x, axis=1)
    excess = np.cumsum(ordered, axis=1) - 1
    places = np.arange(1, x.shape[1] + 1)
    last = (ordered - excess / places > 0).sum(axis=1)
    return np.maximum(x - (excess[np.arange(len(x)), last - 1] / last)[:, None], 0)


def mixtures(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Weights on the simplex with which the anchors come nearest to every row, by accelerated descent."""
    return nearest_mixtures(rows @ anchors.T, anchors @ anchors.T)


def nearest_mixtures(product: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The same from the inner products of rows with anchors and of the anchors with each other."""
    step = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    c = np.full(product.shape, 1 / len(gram))
    ahead, t = c, 1.0
    for _ in range(REGRESSION_STEPS):
        new = simplex_projection(ahead - step * (ahead @ gram - product))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - c)
        moved = np.abs(new - c).max() if len(c) else 0.0
        c, t = new, t_new
        if moved < 1e-7:
            break
    return c


def linked_candidates(rows: DataFrame, links: DataFrame, min_share: float, n_docs: DataFrame) -> DataFrame:
    """``(model_id, src_word, tgt_word, sides)`` of dictionary pairs with both words frequent enough.

    ``links(model_id, src_lang, src_word, tgt_lang, tgt_word)``, ``n_docs(lang, n_docs)``; a word has to be in
    ``min_share`` of the documents of its language.
    """
    frequent = rows.join(n_docs, "lang").filter(F.col("df") >= min_share * F.col("n_docs")).select("lang", "word", "vec")
    pairs = links
    for side in ("src", "tgt"):
        own = frequent.select(F.col("lang").alias(f"{side}_lang"), F.col("word").alias(f"{side}_word"), F.col("vec").alias(f"{side}_vec"))
        pairs = pairs.join(own, [f"{side}_lang", f"{side}_word"])
    return pairs.select("model_id", "src_word", "tgt_word", F.array("src_vec", "tgt_vec").alias("sides"))


def recovered_topics(shards: DataFrame, anchors: dict[tuple, list[dict]], langs: dict[tuple, Sequence[str]], *, width: int, seed: int) -> DataFrame:
    """``(model_id, lang, topic_id, word, weight)``: word weights of every topic, summing to one by language.

    ``anchors`` by ``(model_id,)`` from ``choose_anchors``, ``langs`` the language of each of their sides. Every
    word of ``shards`` that shares a document with another token has a weight in every topic.
    """
    points: dict[str, list[np.ndarray]] = {}
    wanted = []
    for key, found in anchors.items():
        for s, lang in enumerate(langs[key]):
            own = np.stack([a["sides"][s] for a in found])
            at = sum(len(x) for x in points.get(lang, []))
            points.setdefault(lang, []).append(own)
            wanted.append((key[0], lang, own @ own.T, slice(at, at + len(own))))
    schema = "model_id string, lang string, word string, weights array<double>"

    def run(batches):
        for pdf in batches:
            for model, lang, gram, columns in wanted:
                own = pdf[pdf["lang"] == lang]
                if len(own):
                    c = nearest_mixtures(np.stack(own["products"].to_numpy())[:, columns], gram) * own["mass"].to_numpy()[:, None]
                    yield pd.DataFrame({"model_id": model, "lang": lang, "word": own["word"], "weights": list(c)})

    rows = products(shards, {lang: np.concatenate(x) for lang, x in points.items()}, width=width, seed=seed)
    cells = store(rows.mapInPandas(run, schema), "mixtures")
    cells = cells.select("model_id", "lang", "word", F.posexplode("weights").alias("topic_id", "weight"))
    totals = cells.groupBy("model_id", "lang", "topic_id").agg(F.sum("weight").alias("_total"))
    joined = cells.join(F.broadcast(totals), ["model_id", "lang", "topic_id"])
    return joined.select("model_id", "lang", "topic_id", "word", (F.col("weight") / F.col("_total")).alias("weight"))


def anchor_topics(
    docs: DataFrame, links: DataFrame, n_topics: int, *, min_share: float = 0.001, width: int = 256, shard_tokens: int = 500_000, seed: int = 1
) -> tuple[DataFrame, dict[tuple, list[dict]]]:
    """Topics of every dictionary model over ``docs(doc_id, lang, tokens)``, and its anchors.

    Rows are built for words that may be anchors; of all others only their products with the anchors are.
    """
    shards = packed(docs, ["lang"], "doc_id", "tokens", shard_tokens, np.iinfo(np.int32).max)
    links = store(links, "links")
    n_docs = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = document_frequency(shards).join(n_docs, "lang").filter(F.col("df") >= min_share * F.col("n_docs"))
    sides = [links.select(F.col(f"{side}_lang").alias("lang"), F.col(f"{side}_word").alias("word")) for side in ("src", "tgt")]
    words = store(frequent.join(sides[0].unionByName(sides[1]), ["lang", "word"], "left_semi").select("lang", "word"), "frequent")
    rows = cooccurrence_rows(shards, words, width=width, seed=seed)
    anchors = choose_anchors(linked_candidates(rows, links, min_share, n_docs), ["model_id"], ["src_word", "tgt_word"], n_topics)
    langs = {(r["model_id"],): (r["src_lang"], r["tgt_lang"]) for r in links.select("model_id", "src_lang", "tgt_lang").distinct().collect()}
    return recovered_topics(shards, anchors, langs, width=width, seed=seed), anchors
