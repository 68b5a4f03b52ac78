"""Benchmark items inside documents, found by pigeonhole edit matching.

Texts and items are compared in lower case with white space runs as one space. An item of n
characters may differ by e = floor(error_rate * n) insertions, deletions and substitutions. It
is split into e + 1 pieces: an occurrence with at most e errors leaves one piece unchanged, so
exact hits of pieces (one Aho-Corasick automaton for all) find every place that can match.
Myers' bit-parallel distance then decides each place in a window around the hit.

The automaton is a copy in every task, so items are worked off in blocks of at most
BLOCK_CHARS characters: one pass over the documents per block, whatever the size of the
benchmark.

Defined results: null or blank items and documents match nothing; documents without a match
have no row; rows without doc_id keep a null doc_id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm.tables import ids_and_texts, store

ERROR_RATE = 0.07
BLOCK_CHARS = 4_000_000
RESULT = "doc_id long, item_id long, distance long, end_at long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, error_rate: float) -> list[tuple[int, str]]:
    """Start and text of the e + 1 pieces of an item."""
    n = len(item)
    parts = min(n, int(error_rate * n) + 1)
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def best_match(masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the item to any substring of ``text`` and its first end."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, at = n, 0
    for j, c in enumerate(text, 1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(across | plus)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1
        down = down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, at = score, j
    return best, at


def _windows(hits: list[tuple[int, int]], n: int, errors: int, length: int):
    """Merged text ranges in which an occurrence with these piece places can lie."""
    ranges = sorted({(max(0, place - start - errors), min(length, place - start + n + errors)) for place, start in hits})
    low, high = ranges[0]
    for a, b in ranges[1:]:
        if a <= high:
            high = max(high, b)
        else:
            yield low, high
            low, high = a, b
    yield low, high


def _search(items: list[tuple[int, str]], error_rate: float):
    def run(batches):
        automaton, owners = ahocorasick.Automaton(), defaultdict(list)
        budget = {}
        for k, (_, item) in enumerate(items):
            cut = pieces(item, error_rate)
            budget[k] = len(cut) - 1
            for start, piece in cut:
                owners[piece].append((k, start))
        for piece, found in owners.items():
            automaton.add_word(piece, (len(piece), found))
        automaton.make_automaton()
        masks: dict[int, dict[str, int]] = {}
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = normalise(text.as_py())
                hits = defaultdict(list)
                for end, (size, found) in automaton.iter(text):
                    for k, start in found:
                        hits[k].append((end - size + 1, start))
                for k, places in hits.items():
                    item_id, item = items[k]
                    if item in text:
                        rows.append((doc_id, item_id, 0, text.index(item) + len(item)))
                        continue
                    if k not in masks:
                        masks[k] = char_masks(item)
                    best = None
                    for low, high in _windows(places, len(item), budget[k], len(text)):
                        distance, at = best_match(masks[k], len(item), text[low:high])
                        if distance <= budget[k] and (best is None or distance < best[0]):
                            best = (distance, low + at)
                    if best:
                        rows.append((doc_id, item_id, *best))
            if rows:
                names = ["doc_id", "item_id", "distance", "end_at"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, read one after the other."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        block.append((item_id, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, end_at``: the best occurrence of each item in each document.

    ``end_at`` is the place after its last character in the normalised text.
    """
    texts, found = ids_and_texts(docs), []
    for block in _item_blocks(benchmark, block_chars):
        # What earlier blocks found is written, so no plan holds two blocks of items.
        found[-1:] = [store(earlier, "matches") for earlier in found[-1:]]
        found.append(texts.mapInArrow(_search(block, error_rate), RESULT))
    if not found:
        return docs.sparkSession.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean_rows(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, with the columns of ``docs``.

    Each row is judged where it is read: nothing is joined back, so rows without doc_id and
    rows that share one keep their own verdict.
    """
    place = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def keep(block):
        search = _search(block, error_rate)

        def run(batches):
            for batch in batches:
                numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(place)], ["doc_id", "text"])
                bad = set()
                for found in search([numbered]):
                    bad.update(found.column(0).to_pylist())
                yield batch.filter(pc.invert(pc.is_in(numbered.column(0), pa.array(sorted(bad), pa.int64())))) if bad else batch

        return run

    out = docs.toDF(*names)
    for number, block in enumerate(_item_blocks(benchmark, block_chars)):
        out = store(out, "clean") if number else out
        out = out.mapInArrow(keep(block), out.schema)
    return out.toDF(*docs.columns)
