"""Document co-occurrence counts as partial matrix products.

Each document shrinks to the ids of the scored words it contains before anything is
shuffled. A task turns its documents into a 0/1 matrix and multiplies the columns that are
asked for, so word pairs leave a task as one summed block, never as rows per document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lingospan.storage import store

MAX_CELLS = 8_000_000
TILE = 1024
ROWS_PER_PRODUCT = 1024


@dataclass(frozen=True)
class Block:
    """Product of the document columns ``left`` and ``right`` of one model."""

    model_id: str
    block_id: str
    left: tuple[int, ...]
    right: tuple[int, ...]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.left) + 1, len(self.right) + 1


class ScoredWords:
    """The bounded list of words to score, numbered per model by ``match`` columns."""

    def __init__(self, words: DataFrame, match: Sequence[str]):
        self.match = tuple(match)
        rows = words.select("model_id", *match).distinct().collect()
        self.by_model: dict[str, list[tuple]] = {}
        for row in sorted(tuple(r) for r in rows):
            self.by_model.setdefault(row[0], []).append(row[1:])
        self.ids = {(m, k): n for m, keys in self.by_model.items() for n, k in enumerate(keys)}

    def id_of(self, row) -> int:
        return self.ids[(row["model_id"], tuple(row[c] for c in self.match))]

    def lookups(self) -> dict[tuple[str, str | None], tuple[list[str], list[int]]]:
        """Words and ids per model and language; language None serves every language."""
        found: dict[tuple[str, str | None], tuple[list[str], list[int]]] = {}
        for model, keys in self.by_model.items():
            for number, key in enumerate(keys):
                named = dict(zip(self.match, key))
                words, ids = found.setdefault((model, named.get("lang")), ([], []))
                words.append(named["word"])
                ids.append(number)
        return found


def scored_documents(docs: DataFrame, scored: ScoredWords, doc_key: str) -> DataFrame:
    """``(model_id, doc_key, ids)``: the scored words each document contains.

    ``docs(model_id, doc_key, lang, tokens)`` may hold several rows per document (its sides).
    The look-up runs over whole Arrow columns inside the task that made the tokens; only ids
    are shuffled, one short array per row.
    """
    lookups = {k: (pa.array(w), np.array(i, dtype=np.int32)) for k, (w, i) in scored.lookups().items()}
    with_lang = "lang" in scored.match
    schema = docs.select("model_id", doc_key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for (model, lang), (words, ids) in lookups.items():
                chosen = pc.equal(table["model_id"], model)
                if with_lang:
                    chosen = pc.and_(chosen, pc.equal(table["lang"], lang))
                part = table.filter(chosen).combine_chunks()
                if part.num_rows == 0:
                    continue
                tokens = part["tokens"].chunk(0)
                found = pc.index_in(tokens.flatten(), value_set=words)
                rows = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                known = found.is_valid().to_numpy(zero_copy_only=False)
                at = found.drop_null().to_numpy(zero_copy_only=False)
                cells = np.unique(rows[known].astype(np.int64) * len(ids) + at)
                sizes = np.bincount(cells // len(ids), minlength=part.num_rows)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = pa.array(ids[cells % len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["model_id"].chunk(0), part[doc_key].chunk(0), pa.ListArray.from_arrays(offsets, values)],
                    names=["model_id", doc_key, "ids"],
                )

    hits = docs.select("model_id", doc_key, "lang", "tokens").mapInArrow(run, schema)
    return hits.groupBy("model_id", doc_key).agg(F.flatten(F.collect_list("ids")).alias("ids"))


def scored_members(docs: DataFrame, members: DataFrame, scored: ScoredWords, doc_key: str) -> DataFrame:
    """``(model_id, doc_key, ids)`` of documents that several models and pairs share.

    ``docs(doc_id, lang, tokens)`` has every document once, ``members(model_id, doc_key, doc_id)`` says where it
    belongs. A task looks the tokens of a document up for all models of its language; tokens are never
    shuffled, only the ids meet the members.
    """
    lookups: dict[str | None, list] = {}
    for (model, lang), (words, ids) in scored.lookups().items():
        lookups.setdefault(lang, []).append((model, pa.array(words), np.array(ids, dtype=np.int32)))
    schema = T.StructType([members.schema["model_id"], docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang, models in lookups.items():
                part = (table if lang is None else table.filter(pc.equal(table["lang"], lang))).combine_chunks()
                if part.num_rows == 0:
                    continue
                tokens = part["tokens"].chunk(0)
                flat = tokens.flatten()
                rows = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                for model, words, ids in models:
                    found = pc.index_in(flat, value_set=words)
                    known = found.is_valid().to_numpy(zero_copy_only=False)
                    at = found.drop_null().to_numpy(zero_copy_only=False)
                    cells = np.unique(rows[known].astype(np.int64) * len(ids) + at)
                    sizes = np.bincount(cells // len(ids), minlength=part.num_rows)
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids[cells % len(ids)], pa.int32()))
                    names = pa.array([model] * part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([names, part["doc_id"].chunk(0), lists], names=schema.names)

    hits = docs.select("doc_id", "lang", "tokens").mapInArrow(run, schema)
    joined = hits.join(members.select("model_id", "doc_id", doc_key), ["model_id", "doc_id"])
    return joined.groupBy("model_id", doc_key).agg(F.flatten(F.collect_list("ids")).alias("ids"))


def block_counts(documents: DataFrame, blocks: Sequence[Block]) -> DataFrame:
    """``(model_id, block_id, i, j, n)`` with 1-based positions inside the block.

    Position 0 stands for "any": ``(i, 0)`` and ``(0, j)`` are document frequencies. Blocks
    are worked off in passes whose accumulators fit a task.
    """
    passes: list[list[Block]] = [[]]
    used = 0
    for block in blocks:
        cells = block.shape[0] * block.shape[1]
        if passes[-1] and used + cells > MAX_CELLS:
            passes.append([])
            used = 0
        passes[-1].append(block)
        used += cells
    if len(passes) > 1:
        documents = store(documents.select("model_id", "ids"), "scored-documents")
    counted = None
    for chosen in passes:
        part = documents.select("model_id", "ids").mapInArrow(
            _products(chosen), "model_id string, block_id string, width int, cells array<long>"
        )
        counted = part if counted is None else counted.unionByName(part)
    cells = counted.select("model_id", "block_id", "width", F.posexplode("cells").alias("at", "n"))
    return (
        cells.groupBy("model_id", "block_id", "width", "at")
        .agg(F.sum("n").alias("n"))
        .select(
            "model_id",
            "block_id",
            F.floor(F.col("at") / F.col("width")).cast("int").alias("i"),
            (F.col("at") % F.col("width")).alias("j"),
            "n",
        )
    )


def _products(blocks: Sequence[Block]):
    by_model: dict[str, list[Block]] = {}
    for block in blocks:
        by_model.setdefault(block.model_id, []).append(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {b: np.zeros(b.shape, dtype=np.int64) for b in blocks}
        columns = {}
        for model, chosen in by_model.items():
            used = np.unique(np.concatenate([np.array(b.left + b.right, dtype=np.int64) for b in chosen]))
            columns[model] = used
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for model, chosen in by_model.items():
                ids = table.filter(pc.equal(table["model_id"], model))["ids"].combine_chunks()
                used = columns[model]
                for start in range(0, len(ids), ROWS_PER_PRODUCT):
                    part = ids.slice(start, ROWS_PER_PRODUCT)
                    lengths = part.value_lengths().to_numpy(zero_copy_only=False)
                    flat = part.flatten().to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(used, flat), len(used) - 1)
                    known = used[at] == flat
                    rows = np.repeat(np.arange(len(part)), lengths)
                    seen = np.zeros((len(part), len(used)), dtype=np.float32)
                    seen[rows[known], at[known]] = 1.0
                    for block in chosen:
                        left = _with_any(seen, np.searchsorted(used, block.left))
                        right = _with_any(seen, np.searchsorted(used, block.right))
                        totals[block] += np.rint(left.T @ right).astype(np.int64)
        for block, total in totals.items():
            if total[0, 0]:
                yield pa.RecordBatch.from_pydict(
                    {
                        "model_id": [block.model_id],
                        "block_id": [block.block_id],
                        "width": pa.array([block.shape[1]], pa.int32()),
                        "cells": pa.array([total.ravel()], pa.list_(pa.int64())),
                    }
                )

    return run


def _with_any(seen: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Chosen columns after a column of ones, which counts documents on its own."""
    return np.hstack([np.ones((len(seen), 1), dtype=np.float32), seen[:, columns]])


def topic_pair_counts(
    docs: DataFrame,
    topic_words: DataFrame,
    max_k: int,
    doc_key: str = "pair_id",
    match: Sequence[str] = ("lang", "word"),
    members: DataFrame | None = None,
) -> DataFrame:
    """``(model_id, topic_id, i, j, n, df_src, df_tgt)`` for source rank i and target rank j.

    Row ``(0, 0)`` is kept so that topics without any word in the corpus stay visible.
    ``topic_words(model_id, topic_id, side, lang, rank, word)`` is model output: topics times
    ``max_k`` rows, the only thing gathered on the driver. With ``members`` the documents are given once,
    see ``scored_members``.
    """
    top = topic_words.filter(F.col("rank") <= max_k)
    scored = ScoredWords(top, match)
    lists: dict[tuple[str, str], dict[str, list[tuple[int, int]]]] = {}
    for row in top.select("model_id", "topic_id", "side", "lang", "rank", "word").collect():
        sides = lists.setdefault((row.model_id, str(row.topic_id)), {"src": [], "tgt": []})
        sides[row.side].append((row["rank"], scored.id_of(row)))
    blocks = [
        Block(
            model,
            topic,
            tuple(w for _, w in sorted(sides["src"])),
            tuple(w for _, w in sorted(sides["tgt"])),
        )
        for (model, topic), sides in sorted(lists.items())
    ]
    found = scored_documents(docs, scored, doc_key) if members is None else scored_members(docs, members, scored, doc_key)
    cells = block_counts(found, blocks).withColumnRenamed("block_id", "topic_id")
    row_of = W.partitionBy("model_id", "topic_id", "i")
    column_of = W.partitionBy("model_id", "topic_id", "j")
    return cells.withColumn("df_src", F.max(F.when(F.col("j") == 0, F.col("n"))).over(row_of)).withColumn(
        "df_tgt", F.max(F.when(F.col("i") == 0, F.col("n"))).over(column_of)
    )


def cooccurrence(
    docs: DataFrame,
    words: DataFrame,
    doc_key: str = "pair_id",
    match: Sequence[str] = ("lang", "word"),
    members: DataFrame | None = None,
) -> DataFrame:
    """Symmetric counts between all scored words; the diagonal is the document frequency.

    ``words`` is the bounded list of words to score. The upper triangle is worked off in
    tiles; zero cells are not returned.
    """
    scored = ScoredWords(words, match)
    blocks = []
    for model, keys in scored.by_model.items():
        for a in range(0, len(keys), TILE):
            for b in range(a, len(keys), TILE):
                left = tuple(range(a, min(a + TILE, len(keys))))
                right = tuple(range(b, min(b + TILE, len(keys))))
                blocks.append(Block(model, f"{a}:{b}", left, right))
    found = scored_documents(docs, scored, doc_key) if members is None else scored_members(docs, members, scored, doc_key)
    cells = block_counts(found, blocks).filter("i > 0 AND j > 0 AND n > 0")
    origin = F.split("block_id", ":")
    upper = cells.select(
        "model_id",
        (origin[0].cast("int") + F.col("i") - 1).alias("a"),
        (origin[1].cast("int") + F.col("j") - 1).alias("b"),
        "n",
        (origin[0] != origin[1]).alias("mirrored"),
    )
    both = F.when(
        F.col("mirrored"),
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))),
    ).otherwise(F.array(F.struct("a", "b")))
    pairs = upper.select("model_id", F.explode(both).alias("p"), "n").select("model_id", "p.a", "p.b", "n")
    named = [(m, n, *key) for m, keys in scored.by_model.items() for n, key in enumerate(keys)]
    names = docs.sparkSession.createDataFrame(
        named, "model_id string, id int, " + ", ".join(f"{c} string" for c in match)
    )
    for position, column in (("1", "a"), ("2", "b")):
        side = names.select("model_id", F.col("id").alias(column), *[F.col(c).alias(f"{c}{position}") for c in match])
        pairs = pairs.join(side, ["model_id", column])
    return pairs.drop("a", "b")
