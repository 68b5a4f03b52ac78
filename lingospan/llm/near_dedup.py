"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every text becomes its set of distinct word shingles. Equal sets are one node. A signature
of TREES x DEPTH minima is cut into TREES sorted orders; nodes whose longest common prefix in
an order is at least MIN_DEPTH minima lie in one region of it. The depth adapts to the region:
neighbours in a sorted order share the longest prefix there is, whatever the region holds, and
are the first candidates, with the pairs of each member with its region's hub. When their
confirmed links have been contracted, every pair of different components that is left in a
region and whose sizes and signatures allow a link follows; a region of more than REGION nodes is
compared in pairs of bounded blocks, and none is cut. Links are confirmed on full sets.

Two texts at the threshold of 0.85 share MIN_DEPTH = 4 minima in none of 14 orders with
probability (1 - 0.85**4)**14 = 3e-5, and fall short of the agreement that the later rounds
ask of signatures with about the same probability, however crowded their regions are.

Defined results: a null or blank text has an empty set and is linked with nothing. Rows
without doc_id are linked with nothing, keep component null and are kept. Rows that share a
doc_id are judged by their own texts; a component is named by the smallest doc_id in it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm import words as wd
from lingospan.llm.components import connected_components
from lingospan.llm.tables import ids_and_texts, store

TREES, DEPTH, MIN_DEPTH = 14, 8, 4
REGION = 1024
#: Most nodes and most shingles of a block, pairs compared at once, and candidates among them that are counted together.
BLOCK, VOLUME, TILE, DENSE = 4096, 1 << 22, 512, 2048
_SEEDS = wd.constants(TREES * DEPTH, 11)
_PLACES = wd.constants(8, 13)


def _shingle_sets(batch: pa.RecordBatch, size: int):
    """The sorted distinct shingle hashes of every text of a block."""
    data, offsets = wd.text_bytes(batch.column(1))
    data = wd.FOLD[data]
    starts, ends, first = wd.word_spans(data, offsets, wd.WHITE)
    hashes = wd.word_hashes(data, starts, ends)
    n = len(hashes)
    windows = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        windows += hashes[k : n - size + 1 + k] * _PLACES[k]
    windows = wd.mix(windows)
    for i in range(batch.num_rows):
        a, b = first[i], first[i + 1]
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:
            part = hashes[a:b] * _PLACES[: b - a]
            yield wd.mix(np.array([part.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _signature(values: np.ndarray) -> np.ndarray:
    lowest = None
    for at in range(0, len(values), 2048):
        part = ((values[at : at + 2048, None] * _SEEDS) >> np.uint64(32)).min(axis=0)
        lowest = part if lowest is None else np.minimum(lowest, part)
    return lowest.astype(np.uint32)


def _sketch(size: int):
    def run(batches):
        for block in wd.blocks(batches):
            counts, keys, signatures = [], [], []
            for values in _shingle_sets(block, size):
                counts.append(len(values))
                if len(values):
                    low, high = wd.mix(values).sum(dtype=np.uint64), wd.mix(values ^ _PLACES[7]).sum(dtype=np.uint64)
                    keys.append(low.tobytes() + high.tobytes())
                    signatures.append(_signature(values).view(np.int32))
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    return run


def _full_sets(size: int):
    def run(batches):
        for block in wd.blocks(batches):
            keys, sets = [], []
            for values in _shingle_sets(block, size):
                low, high = wd.mix(values).sum(dtype=np.uint64), wd.mix(values ^ _PLACES[7]).sum(dtype=np.uint64)
                keys.append(low.tobytes() + high.tobytes())
                sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "members"])

    return run


def _neighbours(batches):
    """Pairs of rows next to each other in an order that share MIN_DEPTH minima."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        regions, nodes = pdf["region"].to_numpy(), pdf["node"].to_numpy()
        if last is not None:
            regions, nodes = np.concatenate([[last[0]], regions]), np.concatenate([[last[1]], nodes])
        same = np.flatnonzero((regions[1:] == regions[:-1]) & (nodes[1:] != nodes[:-1]))
        yield pd.DataFrame({"a": nodes[same], "b": nodes[same + 1]})
        last = (regions[-1], nodes[-1])


def _order(depth: int):
    """The first ``depth`` minima of an order."""
    return F.slice("signature", F.col("tree") * DEPTH + 1, depth)


def _region(depth: int):
    return F.xxhash64("tree", F.lit(depth), _order(depth))


def _regions(nodes: DataFrame) -> DataFrame:
    """One row per node and order whose region there holds other nodes too.

    The hub of a region is the member that shares regions with most nodes: in a family of
    edited copies that is the text they were copied from.
    """
    orders = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    orders = orders.select("node", "tree", _order(DEPTH).alias("minima"), _region(MIN_DEPTH).alias("region"))
    crowds = orders.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    found = store(orders.join(crowds, "region"), "regions")
    weights = found.groupBy("node").agg(F.sum("size").alias("weight"))
    heaviest = F.max(F.struct("weight", (-F.col("node")).alias("least")))
    hubs = found.select("node", "region").join(weights, "node").groupBy("region").agg((-heaviest["least"]).alias("hub"))
    return store(found.join(hubs, "region"), "hubs")


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of places (place, node, component) that hold different components."""
    mixed = placed.groupBy("place").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return placed.join(mixed.select("place"), "place")


def _block_pairs(placed: DataFrame) -> DataFrame:
    """``place, x, y, side, node, component``: every crowded place as pairs of blocks.

    A component of more than BLOCK nodes has blocks of its own, which are not paired with each
    other; all other nodes of a place share blocks.
    """
    parts = placed.groupBy("place", "component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("volume"))
    parts = parts.withColumn("owner", F.when(F.col("members") > BLOCK, F.col("component")).otherwise(F.lit(-1).cast("long")))
    count = F.ceil(F.greatest(F.sum("members") / BLOCK, F.sum("volume") / VOLUME)).cast("int")
    owners = parts.groupBy("place", "owner").agg(count.alias("n_blocks"))
    number = F.pmod(F.xxhash64("node"), "n_blocks").cast("int")
    rows = placed.join(parts.select("place", "component", "owner"), ["place", "component"]).join(owners, ["place", "owner"])
    rows = rows.select("place", F.struct("owner", number.alias("number")).alias("block"), "node", "component")
    blocks = owners.select("place", "owner", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("number"))
    blocks = blocks.select("place", F.struct("owner", "number").alias("block"))
    pairs = blocks.select("place", F.col("block").alias("x")).join(blocks.select("place", F.col("block").alias("y")), "place")
    pairs = pairs.where("x <= y and (x.owner <> y.owner or x.owner = -1)")
    sides = pairs.select("place", "x", "y", F.lit(0).alias("side"), F.col("x").alias("block"))
    sides = sides.unionByName(pairs.where("x < y").select("place", "x", "y", F.lit(1).alias("side"), F.col("y").alias("block")))
    return rows.join(sides, ["place", "block"]).select("place", "x", "y", "side", "node", "component")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _all_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of another."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    out = np.zeros((len(left), len(right)), np.int64)
    held = []
    for values, rows in sides:
        at = np.searchsorted(shared, values)
        known = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(0, np.int64)
        known = known[np.argsort(at[known], kind="stable")]
        held.append((at[known], rows[known]))
    for start in range(0, len(shared), 4096):
        ones = []
        for (at, rows), sets in zip(held, (left, right), strict=True):
            a, b = np.searchsorted(at, [start, start + 4096])
            one = np.zeros((len(sets), min(4096, len(shared) - start)), np.float32)
            one[rows[a:b], at[a:b] - start] = 1
            ones.append(one)
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def _across(share: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of components of one place that a link joins, confirmed on full sets.

        Pairs are those within the first side if there is no second one, else those across.
        Sizes and signatures rule most pairs out; a pair that earlier links of the place
        already join is passed over.
        """
        group = group.drop_duplicates("node").sort_values(["side", "node"])
        component = group["component"].to_numpy()
        part = component.copy()
        sets = [np.frombuffer(m, np.uint64) for m in group["members"]]
        n = np.array([len(x) for x in sets])
        minima = np.stack(group["signature"].to_numpy())
        cut = int((group["side"] == 0).sum())
        alone = cut == len(part)
        links = []
        for i in range(0, cut, TILE):
            for j in range(i, cut, TILE) if alone else range(cut, len(part), TILE):
                x, y = slice(i, min(i + TILE, cut)), slice(j, min(j + TILE, len(part)))
                near = part[x, None] != part[None, y]
                if i == j:
                    near = np.triu(near, 1)
                near &= 100 * np.minimum(n[x, None], n[None, y]) >= share * np.maximum(n[x, None], n[None, y])
                if not near.any():
                    continue
                equal = np.zeros(near.shape, np.uint8)
                for k in range(TREES * DEPTH):
                    equal += minima[x, None, k] == minima[None, y, k]
                near &= equal >= least_agreement(share)
                if near.sum() > DENSE:
                    common = _all_common(sets[x], sets[y])
                    near &= 100 * common >= share * (n[x, None] + n[None, y] - common)
                    confirmed = True
                else:
                    confirmed = False
                for a, b in (np.argwhere(near) + [i, j]).tolist():
                    if part[a] == part[b]:
                        continue
                    if not confirmed:
                        common = _common(sets[a], sets[b])
                        if 100 * common < share * (n[a] + n[b] - common):
                            continue
                    links.append((component[a], component[b]))
                    part[part == part[b]] = part[a]
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def least_agreement(share: int) -> int:
    """Equal minima that two sets at the threshold fall short of once in 30,000 pairs."""
    n, p = TREES * DEPTH, share / 100
    return int(n * p - 4 * (n * p * (1 - p)) ** 0.5)


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs whose full sets are alike enough; ``share`` in percent of the union."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = nodes.select("node", "n_shingles")
    for side in ("a", "b"):
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}")), side)
    # The smaller set is at most the intersection, the larger one at least the union.
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b")).select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"set_{side}")), side)

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = _common(x, y)
            out.append(100 * common >= share * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return pairs.where(alike("set_a", "set_b")).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 3, share: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text)."""
    texts = ids_and_texts(docs)
    base = store(texts.mapInArrow(_sketch(size), "doc_id long, n_shingles long, set_key binary, signature array<int>"), "sketches")
    nodes = (
        base.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = store(nodes, "nodes")
    found = _regions(nodes)

    hubs = found.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    n_parts = max(nodes.sparkSession.sparkContext.defaultParallelism, found.rdd.getNumPartitions())
    ordered = found.repartitionByRange(n_parts, "tree", "minima", "node").sortWithinPartitions("tree", "minima", "node")
    near = ordered.select("region", "node").mapInPandas(_neighbours, "a long, b long")

    wanted = store(found.select("node").distinct().join(nodes, "node").select("node", "doc_id", "set_key"), "wanted")
    sets = texts.where("doc_id is not null").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = sets.mapInArrow(_full_sets(size), "set_key binary, members binary")
    sets = store(sets.join(wanted.select("set_key", "node"), "set_key").dropDuplicates(["node"]).select("node", "members"), "sets")

    links = store(_confirm(hubs.unionByName(near), nodes, sets, share), "links")
    labels = store(connected_components(links), "labels")
    component = F.coalesce("component", "node").alias("component")
    placed = found.select(F.col("region").alias("place"), "size", "node").join(labels, "node", "left")
    placed = store(_mixed(placed.select("place", "size", "node", component)), "places")
    alone = F.struct(F.lit(-1).cast("long").alias("owner"), F.lit(0).alias("number"))
    whole = placed.where(F.col("size") <= REGION).select("place", alone.alias("x"), alone.alias("y"), F.lit(0).alias("side"), "node", "component")
    crowded = placed.where(F.col("size") > REGION).drop("size").join(nodes.select("node", "n_shingles"), "node")
    blocks = whole.unionByName(_block_pairs(crowded)).join(nodes.select("node", "signature"), "node").join(sets, "node")
    more = blocks.groupBy("place", "x", "y").applyInPandas(_across(share), "a long, b long")
    joined = connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("root"))
    labels = nodes.select("node").join(labels, "node", "left").select("node", component)
    labels = labels.join(joined, "component", "left").select("node", F.coalesce("root", "component").alias("component"))

    named = nodes.select("node", "set_key", "doc_id").join(labels, "node")
    lowest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = store(named.join(lowest, "component").select("set_key", "component_id"), "components")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    out = base.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
