"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word is an input of two parts: an embedding of the word (hashed) and the mean embedding
of its byte trigrams (hashed), so unseen forms of a word still say something. Two gated
recurrent layers read a window of WINDOW words in both directions, attention pools their
states, and one logistic unit scores the window. A text is scored by its highest window; the
windows overlap and cover every word.

The network is trained in numpy with Adam on a bounded sample of labelled texts, about
``per_label`` of each label chosen by a hash of doc_id. Only texts are labelled, not windows:
each round trains on the highest window of every text and on a further window of each clean
one. The first choice is by the log odds of trigrams.

Defined results: a null text or one without words scores 0; rows without doc_id are scored
like all others; repeated labels of one doc_id count once, the largest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts, store

WINDOW, STRIDE = 48, 36
WORD_BUCKETS, GRAM_BUCKETS, EMBEDDING, HIDDEN, ATTENTION = 4096, 4096, 8, 12, 8
PER_LABEL = 1200
ROUNDS, EPOCHS, BATCH, LEAST_STEPS = 3, 3, 200, 100

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[c for c in range(128) if not chr(c).isalnum()]] = True


def word_inputs(column):
    """Distinct words of a block: word bucket, trigram buckets and their borders; words as indexes."""
    data, offsets = wd.text_bytes(column)
    data = wd.FOLD[data]
    starts, ends, first = wd.word_spans(data, offsets, SEPARATOR)
    hashes, example, which = np.unique(wd.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, sizes = starts[example], (ends - starts)[example]
    # A word of n bytes has n trigrams with one space on either side.
    borders = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(borders[-1]) - np.repeat(borders[:-1], sizes)
    at = np.repeat(starts, sizes) + place
    wide = data.astype(np.uint32) if len(data) else np.zeros(1, np.uint32)
    last = place == np.repeat(sizes, sizes) - 1
    left = np.where(place == 0, 32, wide[np.maximum(at - 1, 0)])
    right = np.where(last, 32, wide[np.minimum(at + 1, len(wide) - 1)])
    grams = ((left << np.uint32(16)) + (wide[at] << np.uint32(8)) + right).astype(np.uint32) * np.uint32(0x9E3779B1)
    return (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), (grams >> np.uint32(20)).astype(np.int64), borders, which, first


def windows_of(which: np.ndarray, first: np.ndarray, pad: int):
    """Word numbers of all windows, padded, and the text that each belongs to."""
    sizes = np.diff(first)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < first[text + 1][:, None]
    padded = np.append(which, pad)
    return np.where(inside, padded[np.minimum(at, len(which))], pad), text


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_network(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
    net = {"word": 0.1 * rng.standard_normal((WORD_BUCKETS, EMBEDDING)).astype(np.float32), "gram": 0.3 * rng.standard_normal((GRAM_BUCKETS, EMBEDDING)).astype(np.float32)}
    for side in "fb":
        net |= {f"x{side}": draw(2 * EMBEDDING, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
    return net | {"a": draw(2 * HIDDEN, ATTENTION), "v": draw(ATTENTION, 1)[:, 0], "o": draw(2 * HIDDEN, 1)[:, 0], "k": np.zeros(1, np.float32)}


def embedded(net, words, grams, borders) -> np.ndarray:
    """Inputs of distinct words, and a row of zeros for padding."""
    out = np.zeros((len(words) + 1, 2 * EMBEDDING), np.float32)
    if len(words):
        out[:-1, :EMBEDDING] = net["word"][words]
        out[:-1, EMBEDDING:] = np.add.reduceat(net["gram"][grams], borders[:-1]) / np.diff(borders)[:, None]
    return out


def _layer(x, hidden, steps, keep=None):
    """States of one gated recurrent layer; ``x`` gives each step's input part of the gates."""
    h = None
    states = [None] * WINDOW
    for t in steps:
        given = x(t)
        h = np.zeros((len(given), HIDDEN), np.float32) if h is None else h
        own = h @ hidden
        z = _sigmoid(given[:, :HIDDEN] + own[:, :HIDDEN])
        r = _sigmoid(given[:, HIDDEN : 2 * HIDDEN] + own[:, HIDDEN : 2 * HIDDEN])
        n = np.tanh(given[:, 2 * HIDDEN :] + r * own[:, 2 * HIDDEN :])
        if keep is not None:
            keep[t] = (h, z, r, n, own[:, 2 * HIDDEN :])
        h = n + z * (h - n)
        states[t] = h
    return states


def _pooled(net, states, filled):
    hidden = np.tanh(states @ net["a"])
    weight = np.where(filled, hidden @ net["v"], -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", weight, states)
    return hidden, weight, pooled, pooled @ net["o"] + net["k"][0]


def window_scores(net, inputs: np.ndarray, windows: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Logits of windows; the input part of the gates is a table over distinct words."""
    tables = {side: inputs @ net[f"x{side}"] + net[f"c{side}"] for side in "fb"}
    out = np.zeros(len(windows), np.float32)
    for at in range(0, len(windows), chunk):
        part = windows[at : at + chunk]
        forward = _layer(lambda t: tables["f"][part[:, t]], net["hf"], range(WINDOW))  # noqa: B023
        backward = _layer(lambda t: tables["b"][part[:, t]], net["hb"], range(WINDOW - 1, -1, -1))  # noqa: B023
        states = np.concatenate([np.stack(forward, 1), np.stack(backward, 1)], axis=2)
        out[at : at + chunk] = _pooled(net, states, part != len(inputs) - 1)[3]
    return out


def gradients(net, parts, windows, labels):
    """Gradients of the mean log loss of a batch of windows."""
    words, grams, borders = parts
    inputs = embedded(net, words, grams, borders)
    x, filled = inputs[windows], windows != len(words)
    keep, states = {"f": [None] * WINDOW, "b": [None] * WINDOW}, {}
    orders = {"f": range(WINDOW), "b": range(WINDOW - 1, -1, -1)}
    for side in "fb":
        given = x @ net[f"x{side}"] + net[f"c{side}"]
        states[side] = np.stack(_layer(lambda t: given[:, t], net[f"h{side}"], orders[side], keep[side]), 1)  # noqa: B023
    both = np.concatenate([states["f"], states["b"]], axis=2)
    hidden, weight, pooled, logit = _pooled(net, both, filled)
    d_logit = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
    grad = {"o": pooled.T @ d_logit, "k": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * net["o"]
    d_weight = np.einsum("bh,bth->bt", d_pooled, both)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    d_hidden = d_score[:, :, None] * net["v"] * (1 - hidden**2)
    grad["v"] = np.einsum("bt,bta->a", d_score, hidden)
    grad["a"] = np.einsum("bth,bta->ha", both, d_hidden)
    d_both = weight[:, :, None] * d_pooled[:, None, :] + d_hidden @ net["a"].T
    d_x = np.zeros_like(x)
    for side, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
        d_h, d_given = np.zeros_like(part[:, 0]), np.zeros((*windows.shape, 3 * HIDDEN), np.float32)
        grad[f"h{side}"] = np.zeros_like(net[f"h{side}"])
        for t in reversed(orders[side]):
            before, z, r, n, own = keep[side][t]
            d_h = d_h + part[:, t]
            d_n = d_h * (1 - z) * (1 - n**2)
            d_z = d_h * (before - n) * z * (1 - z)
            d_r = d_n * own * r * (1 - r)
            inner = np.concatenate([d_z, d_r, d_n * r], axis=1)
            grad[f"h{side}"] += before.T @ inner
            d_given[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_h = d_h * z + inner @ net[f"h{side}"].T
        grad[f"c{side}"] = d_given.sum(axis=(0, 1))
        grad[f"x{side}"] = np.einsum("bti,btg->ig", x, d_given)
        d_x += d_given @ net[f"x{side}"].T
    total = np.zeros_like(inputs)
    np.add.at(total, windows, d_x)
    grad["word"], grad["gram"] = np.zeros_like(net["word"]), np.zeros_like(net["gram"])
    np.add.at(grad["word"], words, total[:-1, :EMBEDDING])
    sizes = np.diff(borders)
    np.add.at(grad["gram"], grams, np.repeat(total[:-1, EMBEDDING:] / sizes[:, None], sizes, axis=0))
    return grad


def _subset(parts, windows):
    """The distinct words of some windows alone, and the windows in their numbers."""
    words, grams, borders = parts
    used = np.unique(windows)
    real = used[used < len(words)]
    sizes = np.diff(borders)[real]
    places = np.repeat(borders[:-1][real] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    number = np.full(len(words) + 1, len(real))
    number[real] = np.arange(len(real))
    return (words[real], grams[places], np.concatenate([[0], np.cumsum(sizes)])), number[windows]


def train(texts: list[str], labels: np.ndarray) -> dict[str, np.ndarray]:
    words, grams, borders, which, first = word_inputs(pa.array(texts, pa.string()))
    parts = (words, grams, borders)
    windows, text = windows_of(which, first, len(words))
    labels = np.asarray(labels, np.float32)
    net, rng = new_network(), np.random.default_rng(9)
    if not len(windows) or labels.min() == labels.max():
        net["k"][:] = 8.0 if len(labels) and labels.min() == 1 else -8.0
        net["o"][:] = 0
        return net
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    counts = np.zeros((2, GRAM_BUCKETS))
    sizes = np.diff(borders)
    per_word = np.zeros((2, len(words)))
    np.add.at(per_word, (labels[owner].astype(int), which), 1)
    for k in (0, 1):
        np.add.at(counts[k], grams, np.repeat(per_word[k], sizes))
    odds = np.log((counts[1] + 1) / (counts[1].sum() + GRAM_BUCKETS)) - np.log((counts[0] + 1) / (counts[0].sum() + GRAM_BUCKETS))
    net["gram"][:, 0] = np.clip(odds, -3, 3) / 3
    word_odds = np.append(np.add.reduceat(odds[grams], borders[:-1]) / sizes, -9)
    score = word_odds[windows].max(axis=1)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    for _ in range(ROUNDS):
        order = np.lexsort((score, text))
        top = order[np.flatnonzero(np.append(np.diff(text[order]) != 0, True))]
        others = np.flatnonzero(labels[text] == 0)
        others = others[rng.permutation(len(others))[: 2 * len(top)]]
        chosen = np.concatenate([top, others])
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))):
            chosen = chosen[rng.permutation(len(chosen))]
            for at in range(0, len(chosen), BATCH):
                batch = chosen[at : at + BATCH]
                small, renumbered = _subset(parts, windows[batch])
                step += 1
                for name, g in gradients(net, small, renumbered, labels[text[batch]]).items():
                    m, v = state[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        score = window_scores(net, embedded(net, *parts), windows)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict[str, np.ndarray]:
    """Train on the rows of ``docs`` that ``labels`` (doc_id, toxic) covers.

    Only the ids drawn, about three times ``per_label``, are sent to the texts, which stay where
    they are. Rows that share an id give one example.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    if not sizes:
        return train([], np.zeros(0))
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, min(1.0, per_label * (1 if k else 2) / n))])
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = store(labels.where(draw < share[F.col("toxic")]), "toxicity-sample")
    rows = ids_and_texts(docs).where("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32))


def scored(docs: DataFrame, net: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, score, n_windows`` of every row of ``docs``."""

    def run(batches):
        for block in wd.blocks(batches, limit=1 << 20):
            words, grams, borders, which, first = word_inputs(block.column(1))
            windows, text = windows_of(which, first, len(words))
            score, count = np.zeros(block.num_rows), np.bincount(text, minlength=block.num_rows)
            if len(windows):
                logits = window_scores(net, embedded(net, words, grams, borders), windows)
                has = np.flatnonzero(count)
                score[has] = _sigmoid(np.maximum.reduceat(logits.astype(float), (np.cumsum(count) - count)[has]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(score), pa.array(count, pa.int64())], ["doc_id", "score", "n_windows"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, score double, n_windows long")
