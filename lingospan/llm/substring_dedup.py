"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A window is ``size`` consecutive words. Each window is placed under its lowest ``GRAM``-word
prefix key (the minimizer), so equal windows of any two documents are placed under the same
key, and suffixes under a key that lies in one document only cannot repeat: they are dropped
before any text is shuffled. What is left is split by prefix into groups of about ``GROUP``
suffixes. In each group the suffixes are sorted and the longest common prefixes of neighbours
taken; runs whose common prefix is at least ``size`` words are the suffixes below one deep
internal node of the tree. A prefix with more than ``HOT`` segments is extended to the whole
window, where a node is one key whose smallest document is found by ordinary aggregation.
The trees compare words by 64-bit keys; equal segments and hot windows by 128 bits.

A word is removed when a window that covers it also starts in a document with a smaller
doc_id. Defined results: a null text has no words; a row without doc_id neither loses words
nor takes any away; rows that share a doc_id are one document and take nothing from each
other, and each loses words by its own text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.tables import emptied, ids_and_texts, store

SIZE, GRAM = 13, 3
GROUP, HOT = 60_000, 5_000
BLOCK = 512 << 10  # bytes of text that a task works on at a time
_PLACES = wd.constants(64, 17)


def _segments(batch: pa.RecordBatch, size: int):
    """Runs of windows with one minimizer: document, first window, number of windows, key."""
    data, offsets = wd.text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
    hashes = wd.word_hashes(data, starts, ends)
    n, span = len(hashes), size - GRAM + 1
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    if n < size:
        none = np.zeros(0, np.int64)
        return data, starts, ends, first, none, none, none, np.zeros(0, np.uint64)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams += hashes[k : n - GRAM + 1 + k] * _PLACES[k]
    grams = wd.mix(grams)
    lowest = np.arange(n - size + 1) + sliding_window_view(grams, span).argmin(axis=1)
    windows = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    place = lowest[windows]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(windows) != 1) | (np.diff(doc[windows]) != 0)])) if len(windows) else np.zeros(0, np.int64)
    at = windows[new]
    count = np.diff(np.concatenate([new, [len(windows)]]))
    return data, starts, ends, first, doc[at] if len(at) else at, at, count, grams[place[new]]


def _keys(size: int):
    def run(batches):
        for block in wd.blocks(batches, limit=BLOCK):
            *_, doc, _, _, key = _segments(block, size)
            if len(doc):
                pairs = pd.DataFrame({"d": doc, "k": key.view(np.int64)}).drop_duplicates()
                take = pa.array(pairs["d"].to_numpy())
                yield pa.RecordBatch.from_arrays([block.column(0).take(take), block.column(2).take(take), pa.array(pairs["k"].to_numpy())], ["doc_id", "version", "prefix"])

    return run


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial over the words of a block, from which that of any run follows."""
    up = wd.powers("up", len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])


def _suffixes(size: int):
    def run(batches):
        for block in wd.blocks(batches, limit=BLOCK):
            data, starts, ends, first, doc, at, count, key = _segments(block, size)
            wanted = block.column(3)
            owner = pc.list_parent_indices(wanted).to_numpy().astype(np.uint64)
            wanted = pc.list_flatten(wanted).to_numpy().view(np.uint64)
            # Keys are told apart by document; a chance hit only adds a segment to the trees.
            keep = np.isin(wd.mix(key + doc.astype(np.uint64) * _PLACES[0]), wd.mix(wanted + owner * _PLACES[0]))
            doc, at, count, key = doc[keep], at[keep], count[keep], key[keep]
            raw, end = data.tobytes(), at + count + size - 1
            pieces = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[end - 1].tolist(), strict=True)]
            take = pa.array(doc)
            columns = [block.column(0).take(take), block.column(2).take(take), pa.array(key.view(np.int64)), pa.array(at - first[doc], pa.int64())]
            down = wd.powers("down", len(starts) + 1)[at]
            for hashes in (wd.word_hashes(data, starts, ends), wd.word_hashes(data, starts, ends, seed=1)):
                sums = _sums(hashes)
                columns.append(pa.array(wd.mix((sums[end] - sums[at]) * down).view(np.int64)))
            columns.append(pa.array(pieces, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "prefix", "at", "low", "high", "words"])

    return run


def _window_words(texts: list[bytes], size: int):
    """Segment, place in it and first word (as an index) of every window of the segments."""
    data, offsets = wd.text_bytes(pa.array(texts, pa.binary()))
    starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
    windows = np.diff(first) - size + 1
    segment = np.repeat(np.arange(len(texts)), windows)
    place = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    return data, starts, ends, segment, place, first[segment] + place


def _tree(size: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """For each window of a segment, the smallest document below its deep node.

        Segments without a window that a smaller document than their last has are left out.
        """
        data, starts, ends, segment, place, head = _window_words(group["words"].tolist(), size)
        codes = pd.factorize(wd.word_hashes(data, starts, ends))[0].astype(np.int32)
        suffixes = codes[head[:, None] + np.arange(size)]
        order = np.lexsort(suffixes.T[::-1])
        differs = suffixes[order][1:] != suffixes[order][:-1]
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), size)
        node = np.flatnonzero(np.concatenate([[True], common < size]))
        docs = group["doc_id"].to_numpy()[segment[order]]
        lowest = np.empty(len(docs), np.int64)
        lowest[order] = np.repeat(np.minimum.reduceat(docs, node), np.diff(np.concatenate([node, [len(docs)]])))
        cuts = np.flatnonzero(np.diff(segment)) + 1
        out = group[["low", "high"]].copy()
        out["lowest"] = np.split(lowest, cuts)
        least = np.minimum.reduceat(lowest, np.concatenate([[0], cuts]))
        return out[least < group["last"].to_numpy()]

    return run


def _whole_windows(size: int):
    def run(batches):
        for batch in batches:
            data, starts, ends, segment, place, head = _window_words(batch.column(3).to_pylist(), size)
            hashes, other = wd.word_hashes(data, starts, ends), wd.word_hashes(data, starts, ends, seed=1)
            low, high = np.zeros(len(head), np.uint64), np.zeros(len(head), np.uint64)
            for k in range(size):
                low += hashes[head + k] * _PLACES[k]
                high += other[head + k] * _PLACES[k + size]
            take = pa.array(segment)
            columns = [batch.column(i).take(take) for i in range(3)]
            columns += [pa.array(place, pa.int64()), pa.array(wd.mix(low).view(np.int64)), pa.array(wd.mix(high).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["low", "high", "doc_id", "place", "w_low", "w_high"])

    return run


def _kept(size: int):
    def run(batches):
        for block in wd.blocks(batches, limit=BLOCK):
            data, offsets = wd.text_bytes(block.column(1))
            starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
            owner = pc.list_parent_indices(block.column(2)).to_numpy()
            marks = pc.list_flatten(block.column(2))
            hits = marks.field("hit")
            mark = pc.list_parent_indices(hits).to_numpy()
            place = np.arange(len(mark)) - np.searchsorted(mark, mark)
            hit = pc.list_flatten(hits).to_numpy(zero_copy_only=False).astype(bool)
            at = (first[owner] + marks.field("at").to_numpy())[mark][hit] + place[hit]
            edge = np.zeros(len(starts) + 1, np.int64)  # windows that begin here less those that end
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + size, 1)
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)

            # A kept word stays with one byte after it, a space, unless it is the last of its text.
            text = np.repeat(np.arange(block.num_rows), np.diff(first))[stay]
            followed = np.append(text[1:] == text[:-1], np.zeros(min(1, len(text)), bool))
            a, b = starts[stay], ends[stay] + followed
            step = np.zeros(len(data) + 1, np.int8)
            step[a] += 1
            step[b] -= 1
            spaced = data.copy()
            spaced[ends[stay][followed]] = 0x20
            kept = spaced[np.cumsum(step[:-1], dtype=np.int8) > 0]
            borders = np.zeros(block.num_rows + 1, np.int64)
            borders[1:] = np.cumsum(np.bincount(text, weights=b - a, minlength=block.num_rows))
            kept = pa.Array.from_buffers(pa.large_string(), block.num_rows, [None, pa.py_buffer(borders), pa.py_buffer(kept)]).cast(pa.string())
            n_words, n_kept = np.diff(first), np.bincount(text, minlength=block.num_rows)
            columns = [block.column(0), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), kept]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=1)
    for block in wd.blocks(batches, limit=BLOCK):
        raw = [squeeze.compress((t or "").encode()) for t in block.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(raw, pa.binary()), block.column(2)], ["doc_id", "text", "version"])


def _unpacked(run):
    """``run`` over batches whose texts come compressed, as they are shuffled."""

    def unpacked(batches):
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([expand.decompress(t).decode() for t in part.column(1).to_pylist()], pa.string())
                yield from run([pa.RecordBatch.from_arrays([part.column(0), texts, *part.columns[2:]], part.schema.names)])

    return unpacked


def repeated_windows(texts: DataFrame, packed: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, version, at, hit``: which windows from word ``at`` on a smaller document has."""
    keys = texts.mapInArrow(_keys(size), "doc_id long, version int, prefix long")
    shared = keys.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = store(shared.select("prefix"), "shared-prefixes")
    wanted = keys.join(shared, "prefix").groupBy("doc_id", "version").agg(F.collect_list("prefix").alias("prefixes"))
    marked = packed.join(wanted, ["doc_id", "version"]).select("doc_id", "text", "version", "prefixes")
    schema = "doc_id long, version int, prefix long, at long, low long, high long, words binary"
    suffixes = store(marked.mapInArrow(_unpacked(_suffixes(size)), schema), "suffixes")
    emptied(shared)

    # Equal segments are one: a passage in very many documents is a few rows in the trees.
    once = suffixes.groupBy("prefix", "low", "high").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.any_value("words").alias("words"))
    once = store(once, "segments")
    # From here on the segments have the words; what is left of the suffixes is where they stand.
    spans = store(suffixes.select("doc_id", "version", "at", "low", "high"), "spans")
    emptied(suffixes)
    counts = once.groupBy("prefix").agg(F.count("*").alias("segments"))
    hot = store(counts.where(F.col("segments") > HOT).select("prefix"), "hot-prefixes")
    n_groups = max(1, 5 * once.count() // GROUP)
    cold = once.join(hot, "prefix", "left_anti").withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(n_groups)))
    found = cold.groupBy("group").applyInPandas(_tree(size), "low long, high long, lowest array<long>")
    whole = once.join(hot, "prefix", "left_semi").select("low", "high", "doc_id", "words")
    whole = whole.mapInArrow(_whole_windows(size), "low long, high long, doc_id long, place long, w_low long, w_high long")
    least = whole.groupBy("w_low", "w_high").agg(F.min("doc_id").alias("lowest"))
    whole = whole.join(least, ["w_low", "w_high"]).groupBy("low", "high").agg(F.array_sort(F.collect_list(F.struct("place", "lowest"))).alias("l"))
    found = found.unionByName(whole.select("low", "high", F.col("l.lowest").alias("lowest")))
    found = store(found, "trees")
    marks = spans.join(found, ["low", "high"])
    marks = marks.where(F.array_min("lowest") < F.col("doc_id"))
    marks = marks.select("doc_id", "version", "at", F.transform("lowest", lambda x: x < F.col("doc_id")).alias("hit"))
    marks = store(marks, "marks")
    emptied(spans, once, hot, found)
    return marks


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs`` (doc_id, text)."""
    texts = ids_and_texts(docs).withColumn("version", F.xxhash64("text").bitwiseAND(0xFFFF).cast("int"))
    packed = texts.mapInArrow(_packed, "doc_id long, text binary, version int")
    found = repeated_windows(texts.where("doc_id is not null"), packed.where("doc_id is not null"), size)
    marks = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "hit")).alias("marks"))
    rows = packed.join(marks, ["doc_id", "version"], "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(_unpacked(_kept(size)), "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
