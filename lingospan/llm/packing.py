"""Best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens. The piece lengths are summed to a
histogram, which has at most ``capacity`` rows however many documents there are; the
configuration linear program over it (which combinations of lengths fill a sequence, and how
often each is used) is solved by multiplicative weights: a length that the chosen
combinations have served less gets a higher price, and a knapsack dynamic program finds the
best combinations at these prices. The solution is rounded to whole uses as far as pieces last, the
rest is solved again, and the last few pieces are packed by filling each sequence as far as a subset sum allows. Lengths
without nearly full combinations are packed in the better of two ways: by the combinations there are, or by such
fillings alone. Every combination is used as often as pieces last, so the plan does not grow with the documents. It
is a table from (length, rank among pieces of that length) to a place, so pieces are placed
where they are; ranks are counted per task and shifted by the counts of the tasks before.

Defined results: a null text is an empty one; an empty text is its end mark alone; every row is
a document, also without doc_id or with a repeated one.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lingospan.llm import words as wd
from lingospan.llm.tables import ids_and_texts, store

CAPACITY = 2048
END_MARK = 0
MEMO_WORDS = 1_000_000
MARK, JOINED = "<|startoftext|>", 512
PRICE_STEPS = 16
BATCH = 256
FULL = 0.9985
LAST_PIECES = 3000


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN = np.zeros(256, bool)
SIGN[[c for c in range(0x21, 0x7F) if not LETTER[c] and chr(c) not in "'0123456789<|>"]] = True


class WordTokenizer:
    """Ids of texts, encoding each distinct chunk once.

    For tokenizers that lower-case, as the one of the registered query does. Chunks end at
    ASCII white space and between an ASCII letter and another ASCII sign except
    the apostrophe; the tokenizer never joins anything over these borders.
    """

    def __init__(self, path: str):
        # Spark already runs a task per core; more threads would only hold more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id = self.tokenizer.token_to_id(MARK)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all chunks, where each begins among them and how many it has.

        Many chunks are one text, with a special token between them that splits it again.
        """
        whole = [c.decode() for c in chunks]
        alone = np.array([self.mark_id is None or "<|" in c for c in whole], bool)
        joined = [whole[i] for i in np.flatnonzero(~alone)]
        texts = [MARK.join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
        ids, sizes = [], np.zeros(len(chunks), np.int64)
        out = []
        for i in range(0, len(texts), 8):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + 8], add_special_tokens=False):
                part = np.array([*e.ids, self.mark_id], np.uint32)
                ends = np.flatnonzero(part == self.mark_id)
                out.append(np.diff(ends, prepend=-1) - 1)
                ids.append(part[part != self.mark_id])
        sizes[~alone] = np.concatenate(out) if out else 0
        single = [np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(alone)]
        sizes[alone] = [len(x) for x in single]
        ids = np.concatenate([*ids, *single, np.zeros(0, np.uint32)])
        places = np.empty(len(chunks), np.int64)
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        places[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids, places, sizes

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, each text ended by END_MARK, and their borders."""
        data, offsets = wd.text_bytes(column)
        starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
        if len(data) > 1:
            letter, sign = LETTER[data], SIGN[data]
            cuts = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
            cuts = cuts[~np.isin(cuts, offsets)]
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            first = np.searchsorted(starts, offsets)
        # The tokenizer ignores case, but its special tokens do not.
        folded = data if b"<|" in (raw := data.tobytes()) else wd.FOLD[data]
        distinct, example, which = np.unique(wd.word_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > MEMO_WORDS:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, max(0, len(self.known) - 1))] != distinct)) if len(self.known) else np.arange(len(distinct))
        if len(new):
            ids, places, sizes = self.encoded([raw[starts[i] : ends[i]] for i in example[new]])
            places = places + len(self.pool)
            self.pool = np.concatenate([self.pool, ids])
            gap = at[new] if len(at) else new * 0
            self.known = np.insert(self.known, gap, distinct[new])
            self.start = np.insert(self.start, gap, places)
            self.size = np.insert(self.size, gap, sizes)
            at = np.searchsorted(self.known, distinct)
        start = np.insert(self.start[at][which], first[1:], -1)
        size = np.insert(self.size[at][which], first[1:], 1)
        borders = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(borders[-1]) - np.repeat(borders[:-1] - start, size)
        out = np.where(index < 0, np.uint32(END_MARK), self.pool[np.maximum(index, 0)] if len(self.pool) else np.uint32(0)).astype("<u4")
        return out, np.concatenate([[0], borders[first[1:] + np.arange(1, len(first))]])


def _cut(path: str, capacity: int):
    def run(batches):
        tokenizer, seen, part = WordTokenizer(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for block in wd.blocks(batches):
            ids, borders = tokenizer.ids(block.column(1))
            rows = []
            for doc_id, a, b in zip(block.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                for piece, at in enumerate(range(a, b, capacity)):
                    length = min(capacity, b - at)
                    rows.append((doc_id, piece, at - a, length, zlib.crc32(ids[at : at + length]), part, int(seen[length])))
                    seen[length] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def best_fill(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack over all capacities up to ``capacity``.

    Best total price within each capacity, the length taken last there, and the largest
    capacity not above it at which a length is taken.
    """
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = prices
    for c in range(1, capacity + 1):
        value = price[1 : c + 1] + best[c - 1 :: -1] if c > 1 else price[1:2] + best[:1]
        i = value.argmax()
        if value[i] > best[c - 1]:
            best[c], taken[c] = value[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, taken, np.maximum.accumulate(np.where(taken > 0, np.arange(capacity + 1), 0))


def combination(first: int, room: int, taken: np.ndarray, full: np.ndarray) -> tuple[int, ...]:
    found, room = [first], full[room]
    while room:
        found.append(int(taken[room]))
        room = full[room - taken[room]]
    return tuple(sorted(found, reverse=True))


def configuration_lp(lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = PRICE_STEPS, slack: float = 0.01) -> dict[tuple[int, ...], float]:
    """How often to use each combination of lengths, by multiplicative weights."""
    base = lengths / capacity
    prices, use, served = base, {}, np.zeros(len(lengths))
    place = np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    for _ in range(steps):
        best, taken, full = best_fill(lengths, prices, capacity)
        near = np.flatnonzero(prices + best[capacity - lengths] >= (1 - slack) * best[capacity])
        near = near[np.argsort(served[near] / counts[near], kind="stable")[:BATCH]]
        for i in near.tolist():
            found = combination(int(lengths[i]), int(capacity - lengths[i]), taken, full)
            share = counts[i] / found.count(int(lengths[i]))
            use[found] = use.get(found, 0.0) + share
            for size in found:
                served[place[size]] += share
        relative = served / counts
        prices = base * np.exp(-0.05 * (relative / relative.mean() - 1))
    total = sum(v * sum(k) for k, v in use.items())
    scale = float((lengths * counts).sum()) / total
    return {k: v * scale for k, v in use.items()}


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and the number of sequences that use each."""
    left = dict(sorted((k, v) for k, v in histogram.items() if v > 0))
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        plan.append(((capacity,), left.pop(capacity)))
    while (pieces := sum(left.values())) > LAST_PIECES:
        lengths, counts = np.array(sorted(left)), np.array([left[k] for k in sorted(left)], float)
        use = configuration_lp(lengths, counts, capacity)
        used, rest = whole_uses({k: v for k, v in use.items() if sum(k) >= capacity * FULL}, left)
        if sum(rest.values()) > 0.95 * pieces:
            # Too few nearly full combinations: the other ones may still be better than filling.
            others, last = whole_uses(use, left)
            ways = [others + fill_rest(last, capacity), used + fill_rest(rest, capacity)]
            return plan + min(ways, key=lambda way: sum(times for _, times in way))
        plan, left = plan + used, rest
    return plan + fill_rest(left, capacity)


def whole_uses(use: dict[tuple[int, ...], float], left: dict[int, int]) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations with their rounded uses, as far as pieces last, and the pieces that are left."""
    left, plan = dict(left), []
    for sizes, times in sorted(use.items(), key=lambda kv: (-kv[1], kv[0])):
        need = Counter(sizes)
        times = min(max(1, int(times)), *(left[s] // n for s, n in need.items()))
        if times > 0:
            plan.append((sizes, times))
            for s, n in need.items():
                left[s] -= n * times
    return plan, {k: v for k, v in left.items() if v}


def fill_rest(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest piece first; the room it leaves is filled as far as a subset sum reaches.

    A filling stays the best one until one of its lengths runs short, so it is used that often.
    """
    left, bins = dict(left), []
    while left:
        longest = max(left)
        taken = [longest]
        left[longest] -= 1  # for the search only
        room = capacity - longest
        reach, states = 1, []
        mask = (1 << (room + 1)) - 1
        for size in sorted((s for s in left if s <= room and left[s]), reverse=True):
            for _ in range(min(left[size], room // size)):
                states.append((size, reach))
                reach |= (reach << size) & mask
                if reach >> room & 1:
                    break
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        for size, before in reversed(states):
            if not before >> at & 1:
                taken.append(size)
                at -= size
        left[longest] += 1
        need = Counter(taken)
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        left = {k: v for k, v in left.items() if v}
        bins.append((tuple(taken), times))
    return bins


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """One row per combination and length in it, ordered by (length, first rank)."""
    rows, used, sequence = [], {}, 0
    for sizes, times in plan:
        at = 0
        for size in sorted(set(sizes), reverse=True):
            copies = sizes.count(size)
            rows.append((size, used.get(size, 0), copies, sequence, at))
            used[size] = used.get(size, 0) + copies * times
            at += copies * size
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "sequence", "offset"), table.T.copy(), strict=True))


def _place(slots: dict[str, np.ndarray]):
    keys = (slots["length"] << 44) + slots["rank"]

    def run(batches):
        for pdf in batches:
            row = np.searchsorted(keys, (pdf["length"].to_numpy() << 44) + pdf["rank"].to_numpy(), side="right") - 1
            ahead = pdf["rank"].to_numpy() - slots["rank"][row]
            copies = slots["copies"][row]
            pdf["sequence_id"] = slots["sequence"][row] + ahead // copies
            pdf["offset"] = slots["offset"][row] + (ahead % copies) * pdf["length"].to_numpy()
            yield pdf.drop(columns=["rank"])

    return run


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = store(ids_and_texts(docs).mapInArrow(_cut(tokenizer_path, capacity), f"{made}, part int, rank long"), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    slots = slot_table(plan_packing(histogram, capacity))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = pieces.join(shifts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("rank"))
    return ranked.mapInPandas(_place(slots), f"{made}, sequence_id long, offset long")
