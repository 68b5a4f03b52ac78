"""Ranked lexical search with range-maximum tables over posting lists.

The documents are indexed where they are: each task turns blocks of its documents, in the order
of doc_id, into posting lists of the terms that the items use (document, occurrences) and writes
them as rows of a shared table. Document counts, term counts and lengths are summed from it, and
give every posting its impact, the score that its term adds to its document.

A block is searched item by item, best first. A sparse table over the impacts of the posting lists
answers the maximum of any range of a list with two look-ups, and the place of it. An interval of documents
is bounded by the sum of the maxima of the item's lists in it. The intervals with the highest bounds
are taken from the frontier; one with few postings is scored whole, any other is split at the
document of its greatest impact, which is scored by itself, into the intervals on both sides.
Intervals that cannot reach the item's list any more are dropped: their bound is below the lowest
kept score, or equal to it with later documents only. Lists go on from block to block within a
task, so later blocks are mostly bounded away, and a task returns ``k`` rows an item at most.

Items are read in blocks of bounded size, with one pass over the documents for each block; only
the terms of one block of items, with their counts, are on the driver and in a task at a time.

Defined results: a null text has no term; items without a term, or whose terms are in no
document, return no row. Rows without doc_id are documents and come after others of their score;
rows that share a doc_id are documents of their own. Rows that share an item_id are items
of their own, each with its own ranks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts, store

#: Bytes of text whose postings are searched together, and characters of items worked off at a time.
BLOCK_TEXT, ITEM_TEXT = 16 << 20, 4_000_000
#: Postings of an interval that is scored whole, and intervals taken at a time.
LEAF, WAVE = 512, 128
#: Partial lists of an item are merged in so many groups first.
GROUPS = 64
NO_ID = np.iinfo(np.int64).max

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLD = bytes(wd.FOLD)


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters and all other than ASCII characters; only A-Z are lower-cased."""
    return TERM.findall(text.translate(FOLD))


def _postings(vocabulary: dict[bytes, int]):
    """Posting lists of blocks of documents, restricted to a vocabulary."""

    def write(shard: int, ids: list, lengths: list, rows: list, numbers: list):
        id_values = np.array([NO_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(id_values, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.array(lengths, np.int64)
        row, number = np.concatenate(rows), np.concatenate(numbers)
        keys, tf = np.unique(number.astype(np.int64) * len(ids) + place[row], return_counts=True)
        term, doc = np.divmod(keys, max(1, len(ids)))
        used, counts = np.unique(term, return_counts=True)
        return (
            shard,
            int((n > 0).sum()),
            int(n.sum()),
            id_values[order].tobytes(),
            n[order].tobytes(),
            used.astype(np.int32).tolist(),
            counts.astype(np.int32).tolist(),
            doc.astype(np.int32).tobytes(),
            tf.astype(np.int32).tobytes(),
        )

    names = ["shard", "n_docs", "n_terms", "doc_ids", "lengths", "terms", "counts", "docs", "occurrences"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]

    def run(batches):
        shard, held = TaskContext.get().partitionId() << 32, 0
        ids, lengths, rows, numbers = [], [], [], []

        def batch():
            row = write(shard, ids, lengths, rows, numbers)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for block in wd.blocks(batches):
            data, offsets = wd.text_bytes(block.column(1))
            raw = data.tobytes()
            for doc_id, a, b in zip(block.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found = terms(raw[a:b])
                known = [x for x in map(vocabulary.get, found) if x is not None]
                rows.append(np.full(len(known), len(ids), np.int32))
                numbers.append(np.array(known, np.int32))
                ids.append(doc_id)
                lengths.append(len(found))
            held += len(raw)
            if held >= BLOCK_TEXT:
                yield batch()
                shard, held = shard + 1, 0
                ids, lengths, rows, numbers = [], [], [], []
        if ids:
            yield batch()

    return run


class Block:
    """The posting lists of some documents with the sparse table of their impacts."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.n = len(self.ids)
        self.doc = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        tf = np.frombuffer(row["occurrences"], np.int32).astype(np.int64)
        term, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        m = 100 - 90 + (90 * np.frombuffer(row["lengths"], np.int64) * n_docs) // max(1, n_terms)
        owner = np.repeat(term, counts)
        self.impact = weights[owner] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.key = owner * self.n + self.doc
        self.first = np.zeros(len(weights), np.int64)
        self.last = np.zeros(len(weights), np.int64)
        self.last[term] = np.cumsum(counts)
        self.first[term] = self.last[term] - counts
        #: Level j holds, for every place, the place of the greatest impact of 2**j postings from there on.
        self.levels = [np.arange(len(self.doc), dtype=np.int32)]
        longest = int(counts.max()) if len(counts) else 0
        while 1 << len(self.levels) <= longest:
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            left, right = low[:-step], low[step:]
            self.levels.append(np.where(self.impact[left] >= self.impact[right], left, right))
        # Ranges shorter than a level at its end are never asked for.
        self.table = np.zeros((len(self.levels), len(self.doc) + 1), np.int32)
        for j, level in enumerate(self.levels):
            self.table[j, : len(level)] = level

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact between a and b, for many ranges of lists; 0 for empty ones."""
        size = b - a
        level = np.frexp(np.maximum(size, 1))[1] - 1
        left, right = self.table[level, a], self.table[level, np.maximum(b - (1 << level), 0)]
        if not len(self.impact):
            return left
        return np.where(self.impact[left] >= self.impact[right], left, right)


class TopList:
    """The best documents of an item so far: score first, then the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= max(1, self.least)
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self) -> int:
        """What a document has to reach at least."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def may_enter(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether documents of at most these scores and at least these ids could still be listed."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (ids < self.ids[-1]))


def best_first(block: Block, wanted: np.ndarray, top: TopList, leaf: int = LEAF, wave: int = WAVE) -> int:
    """Add the best documents of a block to an item's list; how many documents were scored."""
    wanted = wanted[block.last[wanted] > block.first[wanted]]
    if not len(wanted):
        return 0
    # One row per interval: where its part of each list begins and ends, its first document, its bound.
    a, b = block.first[wanted][None, :], block.last[wanted][None, :]
    start = np.zeros(1, np.int64)
    scored = 0

    def bounded(a, b, start):
        place = block.greatest(a, b)
        value = np.where(b > a, block.impact[place], 0)
        total = value.sum(axis=1)
        keep = top.may_enter(total, block.ids[np.minimum(start, block.n - 1)])
        which = value.argmax(axis=1)
        split = place[np.arange(len(place)), which] if len(place) else place[:, 0]
        return [x[keep] for x in (a, b, start, total, split)]

    frontier = bounded(a, b, start)
    while len(frontier[3]):
        keep = top.may_enter(frontier[3], block.ids[frontier[2]])
        frontier = [x[keep] for x in frontier]
        order = np.argsort(-frontier[3], kind="stable")
        a, b, start, _, split = (x[order[:wave]] for x in frontier)
        frontier = [x[order[wave:]] for x in frontier]
        if not len(a):
            break
        small = (b - a).sum(axis=1) <= leaf
        if small.any():
            size = (b[small] - a[small]).ravel()
            ends = np.cumsum(size)
            at = np.arange(size.sum()) + np.repeat(a[small].ravel() - ends + size, size)
            docs, where = np.unique(block.doc[at], return_inverse=True)
            # Sums of a few thousand impacts are far below 2**53.
            top.add(np.bincount(where, block.impact[at]).astype(np.int64), block.ids[docs])
            scored += len(docs)
        a, b, start, split = a[~small], b[~small], start[~small], split[~small]
        if not len(a):
            continue
        document = block.doc[split]
        keys = wanted[None, :] * block.n + document[:, None]
        cut = np.searchsorted(block.key, keys)
        held = block.key[np.minimum(cut, len(block.key) - 1)] == keys
        score = np.where(held, block.impact[np.minimum(cut, len(block.key) - 1)], 0).sum(axis=1)
        top.add(score, block.ids[document])
        scored += len(document)
        # The part before the document runs from a to cut, the one behind it from cut or the next posting to b.
        sides = bounded(np.concatenate([a, cut + held]), np.concatenate([cut, b]), np.concatenate([start, document + 1]))
        frontier = [np.concatenate([x, y]) for x, y in zip(frontier, sides, strict=True)]
    return scored


def _search(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    def run(batches):
        lists = [TopList(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, weights, n_docs, n_terms)
                for wanted, top in zip(items, lists, strict=True):
                    best_first(block, wanted, top)
        part = TaskContext.get().partitionId()
        numbers = np.repeat(np.arange(len(items)), [len(t.scores) for t in lists])
        ids = np.concatenate([t.ids for t in lists]) if lists else np.zeros(0, np.int64)
        scores = np.concatenate([t.scores for t in lists]) if lists else ids
        columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(ids), pa.int32())], ["item", "doc_id", "score", "part"])

    return run


def _best(found: DataFrame, k: int, *keys) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, set[bytes]]]]:
    """Numbers and terms of items, in blocks of so many characters."""
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row["item"], set(terms((row["text"] or "").encode()))))
        held += len(row["text"] or "")
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def _block_search(texts: DataFrame, block: list[tuple[int, set[bytes]]], k: int) -> DataFrame:
    """``item, rank, doc_id, score`` of one block of items, as a written table."""
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(found for _, found in block))))}
    schema = "shard long, n_docs long, n_terms long, doc_ids binary, lengths binary, terms array<int>, counts array<int>, docs binary, occurrences binary"
    index = store(texts.mapInArrow(_postings(vocabulary), schema), "postings")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.collect():
        weights[row["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    wanted = [np.array(sorted(vocabulary[t] for t in found), np.int64) for _, found in block]
    search = _search(wanted, weights, n_docs, n_terms, k)
    found = index.mapInArrow(search, "item long, doc_id long, score long, part int")
    found = _best(_best(found, k, "item", F.col("part") % GROUPS), k, "item")
    numbers = F.array(*[F.lit(number) for number, _ in block]) if len(block) <= 1000 else None
    if numbers is not None:
        found = found.withColumn("item", F.get(numbers, F.col("item").cast("int")))
    else:
        pairs = found.sparkSession.createDataFrame([(i, number) for i, (number, _) in enumerate(block)], "item long, number long")
        found = found.join(pairs, "item").withColumn("item", F.col("number"))
    return store(found.select("item", "rank", "doc_id", "score"), "found")


def searched(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents for the text of every item."""
    texts = ids_and_texts(docs)
    numbered = items.select("item_id", F.col("text").cast("string").alias("text"))
    numbered = store(numbered.withColumn("item", F.monotonically_increasing_id()), "items")
    parts = [_block_search(texts, block, k) for block in _item_blocks(numbered.select("item", "text"), ITEM_TEXT)]
    if not parts:
        return numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 10) -> str:
    """The ranking in SQL, by scoring every document that holds a term of the item."""
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH wanted AS (SELECT DISTINCT item_id, unnest({split}) AS term FROM benchmark),
held AS (SELECT doc_id, {split} AS terms FROM documents),
sizes AS (SELECT doc_id, len(terms)::BIGINT AS n FROM held WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
postings AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, n_docs
), impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN weights USING (term) JOIN sizes USING (doc_id), totals
), scores AS (
  SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM impacts JOIN wanted USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {k}
"""
