"""Language identification by hierarchical discrimination.

The family of a text is decided first, by one linear machine per family against the rest;
within the family, one-versus-one linear support vector machines vote on the language. All
machines read the same features: shares of hashed byte 1- to 3-grams of the whole lower-cased
text. Machines are trained in numpy on a bounded sample of labelled rows, at most about
``per_language`` of each language, chosen by a hash of doc_id; predictions cover every row.

A score is a sum of weights over the n-grams of a text, so a block of texts is scored by table
look-ups and one sum per text; no feature matrix is built outside training.

Defined results: a null text or one without a letter is ``und`` with score 0. With no labelled
row at all every text is ``und``. A language that FAMILIES does not list is a family of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts

FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
BUCKETS = 4096
PER_LANGUAGE = 400
UNDETERMINED = "und"
_SHIFT = np.uint32(32 - 12)


def _grams(batch: pa.RecordBatch):
    """For each gram length: bucket of the gram that begins at each byte; and text borders."""
    data, offsets = wd.text_bytes(batch.column(1))
    data = wd.FOLD[data]
    wide = np.zeros(len(data) + 2, np.uint32)
    wide[: len(data)] = data
    n = len(data)
    keys = (wide[:n] + np.uint32(1), (wide[:n] << np.uint32(8)) + wide[1 : n + 1] + np.uint32(1 << 16), (wide[:n] << np.uint32(16)) + (wide[1 : n + 1] << np.uint32(8)) + wide[2 : n + 2] + np.uint32(1 << 25))
    return [(k * np.uint32(0x9E3779B1)) >> _SHIFT for k in keys], offsets


def _features(batches):
    for block in wd.blocks(batches):
        grams, offsets = _grams(block)
        rows = []
        for i in range(block.num_rows):
            counts = sum(np.bincount(g[offsets[i] : offsets[i + 1]], minlength=BUCKETS) for g in grams)
            rows.append((counts / max(1, counts.sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([block.column(2), pa.array(rows, pa.binary())], ["lang", "features"])


@dataclass
class Machine:
    """Linear scores ``weights @ shares + bias``; ``pairs`` names what plus and minus mean."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray


def _train(x: np.ndarray, y: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated full gradient steps."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    ww, bb, rate = w.copy(), b, np.float32(1 / (2 * float((share * (x * x).sum(axis=1)).sum() + 1) + ridge))
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ww + bb))
        pull = share * slack * y
        w_new, b_new = ww + rate * (2 * (pull @ x) - ridge * ww), bb + rate * 2 * pull.sum()
        momentum = np.float32(t / (t + 3))
        ww, bb = w_new + momentum * (w_new - w), b_new + momentum * (b_new - b)
        w, b = w_new, b_new
    return w, float(b)


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Machine | None:
    """Train on ``labelled`` (doc_id, text, lang); rows without text or lang are left out."""
    rows = ids_and_texts(labelled, F.col("lang").cast("string")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).mapInArrow(_features, "lang string, features binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r[0], r[1]))
    langs = np.array([r[0] for r in sample])
    x = np.frombuffer(b"".join(r[1] for r in sample), np.float32).reshape(len(sample), BUCKETS)
    scale = 1 / (x.std(axis=0) + 1e-4)
    x = (x - (centre := x.mean(axis=0))) * scale / np.sqrt(BUCKETS)
    members: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        members.setdefault(FAMILIES.get(lang, lang), []).append(str(lang))
    families = sorted(members)
    of = np.array([FAMILIES.get(lang, lang) for lang in langs])
    pairs, fitted = [], []
    for family in families if len(families) > 1 else []:
        fitted.append(_train(x, np.where(of == family, 1, -1).astype(np.float32)))
    for family in families:
        for i, first in enumerate(members[family]):
            for second in members[family][i + 1 :]:
                use = (langs == first) | (langs == second)
                pairs.append((first, second))
                fitted.append(_train(x[use], np.where(langs[use] == first, 1, -1).astype(np.float32)))
    if not fitted:
        return Machine(families, members, pairs, np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    weights = np.stack([w for w, _ in fitted]) * scale / np.sqrt(BUCKETS)
    bias = np.array([b for _, b in fitted]) - weights @ centre
    return Machine(families, members, pairs, weights.astype(np.float32), bias)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _margins(machine: Machine, block: pa.RecordBatch) -> np.ndarray:
    grams, offsets = _grams(block)
    lengths = np.diff(offsets)
    total = np.zeros((len(machine.weights), block.num_rows))
    filled = lengths > 0
    for row, weights in enumerate(machine.weights):
        for g in grams:
            if filled.any():
                total[row, filled] += np.add.reduceat(weights[g], offsets[:-1][filled], dtype=np.float64)
    return total / np.maximum(1, 3 * lengths) + machine.bias[:, None]


def _decide(machine: Machine, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = margins.shape[1]
    sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
    own = margins[: len(machine.families)] if len(machine.families) > 1 else np.zeros((1, n))
    family = own.argmax(axis=0)
    sureness = sure(own.max(axis=0)) if len(machine.families) > 1 else np.ones(n)
    first = len(machine.families) if len(machine.families) > 1 else 0
    langs = np.empty(n, object)
    for f, name in enumerate(machine.families):
        members, rows = machine.members[name], np.flatnonzero(family == f)
        votes, strength = np.zeros((len(members), len(rows))), np.zeros((len(members), len(rows)))
        for k, (a, b) in enumerate(machine.pairs):
            if a not in members:
                continue
            m = margins[first + k, rows]
            for lang, s in ((a, m), (b, -m)):
                votes[members.index(lang)] += s > 0
                strength[members.index(lang)] += s
        won = np.lexsort((strength, votes), axis=0)[-1] if len(members) > 1 else np.zeros(len(rows), int)
        langs[rows] = np.array(members, object)[won]
        if len(members) > 1:
            sureness[rows] *= sure(strength[won, np.arange(len(rows))] / (len(members) - 1))
    return langs, sureness


def predicted(docs: DataFrame, machine: Machine | None, *more: str) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``more`` columns of every row of ``docs``."""
    if machine is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *more)
    texts = ids_and_texts(docs, has_letter(F.col("text")).alias("_letter"), *more)

    def run(batches):
        for block in wd.blocks(batches):
            langs, score = _decide(machine, _margins(machine, block))
            letter = np.array(block.column(2).to_pylist(), bool)
            langs[~letter], score[~letter] = UNDETERMINED, 0.0
            columns = [block.column(0), pa.array(langs.tolist(), pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *block.columns[3:]], ["doc_id", "lang_pred", "score", *more])

    kept = [f for f in texts.schema.fields if f.name in more]
    schema = "doc_id long, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    return texts.mapInArrow(run, schema)


def fold(column: str, n: int) -> Column:
    """Fold of a row: crc32 of its id as text; rows without id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def determined_rows(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with the columns of ``docs``."""
    if machine is None:
        return docs.where(F.lit(False))
    place, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in wd.blocks(batches, names[place]):
            block = pa.RecordBatch.from_arrays([batch.column(place), batch.column(place)], ["doc_id", "text"])
            langs, _ = _decide(machine, _margins(machine, block))
            yield batch.filter(pa.array(langs != UNDETERMINED))

    renamed = docs.where(has_letter(F.col("text"))).toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
