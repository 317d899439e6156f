"""SimHash fingerprints and exact near-duplicate groups by vantage-point trees.

Fingerprints.  Words are runs of non-white-space of the text with A-Z lowered;
every run of ``shingle`` words (all words, if fewer) is hashed by XXH64, and a bit
of the fingerprint is set if it is set in over half of the hashes.

Search.  Two fingerprints link if they differ in at most ``radius`` bits.  Equal
fingerprints are collapsed first, so a text copied a million times is one row.
A vantage-point tree over the Hamming metric is fitted on a bounded sample; its
leaves are shards.  At a node with vantage point v and bound m, a fingerprint x
lives inside if d(v, x) <= m, else outside.  By the triangle inequality a partner
within ``radius`` of x can lie across the bound only if d(v, x) is within
``radius`` of it, so x lives in one shard and visits just the shards whose region
overlaps its ball; of a pair on two sides only the inner one visits.  Each shard
then searches residents against residents and visitors exactly, by the same
recursion in memory, with whole blocks of distances at the leaves.  No link is
lost and no shard sees all rows.

A shard reports a spanning forest of its links, not the pairs, and connected
components are found by alternating large-star and small-star rounds on
DataFrames, with a checkpoint each round.

Results
-------
Null and empty texts and texts of white space only have fingerprint zero and
link like any other.  Repeated rows keep a row each.  ``component_id`` is the
smallest non-null ``doc_id`` of the component (null if all are null).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import carried, column_of, spread_join
from riskframe.session import cut_lineage

#: The tree of shards is fitted on about this many fingerprints a shard, at least and at most so many in all (32 MB).
SHARD_SAMPLE, LEAST_SAMPLE, MOST_SAMPLE = 16, 16_384, 1 << 22
#: Residents of a shard, in the mean.
SHARD_ROWS = 8_192
#: Fewest shards, so that small inputs also spread.
LEAST_SHARDS = 64
#: Residents of a block whose distances are computed outright.
LEAF_ROWS = 128
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at the six ASCII white space characters
    if not words:
        return 0
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    line, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    hashes = [hash_(line[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` (the 64 bits as a signed long) of every row; no shuffle."""
    slim, column = carried(docs, keys, text)
    schema, names = T.StructType([*(slim.schema[k] for k in keys), T.StructField("fp", T.LongType())]), list(keys)

    def run(batches):
        for batch in batches:
            marks = np.array([fingerprint(t.as_py() or "", shingle) for t in column_of(batch, column)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(marks.view(np.int64))], names=[*names, "fp"])
    return slim.mapInArrow(run, schema)


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def best_vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The point, of a few, whose distances spread most, and the bound that splits ``points`` most evenly."""
    best = None
    for i in np.linspace(0, len(points) - 1, 5).astype(int):
        d = distances(points, points[i])
        counts = np.cumsum(np.bincount(d, minlength=65))
        bound = int(np.argmin(np.abs(2 * counts - len(points))))
        if not 0 < counts[bound] < len(points):
            continue
        crossing = int(((d > bound - 2) & (d <= bound + 2)).sum())
        if best is None or crossing < best[0]:
            best = (crossing, points[i], bound)
    return best and best[1:]


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, bound, inside, outside); a child below zero is leaf -1 - child.  Node 0 is the root."""
    nodes: list[tuple[int, int, int, int]] = []
    count = 0

    def grow(points: np.ndarray, share: int) -> int:
        nonlocal count
        found = best_vantage(points) if share > 1 and len(points) > 8 else None
        if found is None:
            count += 1
            return -count
        v, bound = found
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = distances(points, v) <= bound
        nodes[at] = (int(v), bound, grow(points[near], share - share // 2), grow(points[~near], share // 2))
        return at
    root = grow(sample, leaves)
    return nodes if root == 0 else []


def route(nodes: list[tuple[int, int, int, int]], points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, resident) of every point's home and of the shards that it visits."""
    if not nodes:
        return np.zeros(len(points), np.int32), np.arange(len(points)), np.ones(len(points), bool)
    out, stack = [], [(0, np.arange(len(points)), np.zeros(0, np.int64))]
    while stack:
        at, home, guest = stack.pop()
        if at < 0:
            rows = np.concatenate((home, guest))
            out.append((np.full(len(rows), -1 - at, np.int32), rows, np.arange(len(rows)) < len(home)))
            continue
        if not len(home) and not len(guest):
            continue
        v, bound, inside, outside = nodes[at]
        dh, dg = distances(points[home], np.uint64(v)).astype(np.int16), distances(points[guest], np.uint64(v)).astype(np.int16)
        stack.append((inside, home[dh <= bound], guest[dg <= bound + radius]))
        crossing = home[(dh <= bound) & (dh > bound - radius)]
        stack.append((outside, home[dh > bound], np.concatenate((crossing, guest[dg > bound - radius]))))
    return tuple(np.concatenate(c) for c in zip(*out))


def _forest(edges: list[tuple[np.ndarray, np.ndarray]], n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest row number of each row's component under the edges (and the labels before)."""
    label = np.arange(n) if label is None else label
    if not edges:
        return label
    a, b = (np.concatenate(c) for c in zip(*edges))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        if (label == before).all():
            return label


def linked(residents: np.ndarray, guests: np.ndarray, radius: int) -> np.ndarray:
    """Component labels (smallest row number) of residents followed by guests, under all links that involve a resident."""
    points = np.concatenate((residents, guests))
    label = np.arange(len(points))
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    stack = [(np.arange(len(residents)), np.arange(len(residents), len(points)))]
    while stack:
        home, guest = stack.pop()
        if not len(home):
            continue
        found = best_vantage(points[home]) if len(home) > LEAF_ROWS else None
        if found is not None:
            v, bound = found
            dh, dg = distances(points[home], v).astype(np.int16), distances(points[guest], v).astype(np.int16)
            inside = (home[dh <= bound], guest[dg <= bound + radius])
            outside = (home[dh > bound], np.concatenate((home[(dh <= bound) & (dh > bound - radius)], guest[dg > bound - radius])))
            work = lambda h, g: len(h) * (len(h) + len(g))
            if work(*inside) + work(*outside) < 0.9 * work(home, guest):
                stack += [inside, outside]
                continue
        every = np.concatenate((home, guest))
        step = max(1, (1 << 21) // len(every))
        for i in range(0, len(home), step):
            block = home[i:i + step]
            x, y = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[every][None, :]) <= radius)
            x, y = block[x], every[y]
            keep = x != y
            edges.append((x[keep], y[keep]))
            held += int(keep.sum())
            if held > 1 << 20:
                label, edges, held = _forest(edges, len(points), label), [], 0
    return _forest(edges, len(points), label)


def sample_size(n: int) -> int:
    """How many of ``n`` fingerprints the tree is fitted on: enough that it has a shard for every ``SHARD_ROWS`` of up to 2 x 10^9."""
    return min(MOST_SAMPLE, max(LEAST_SAMPLE, SHARD_SAMPLE * n // SHARD_ROWS))


def links(points: DataFrame, radius: int, n: int) -> DataFrame:
    """Spanning links ``u``, ``v`` (fingerprints) of the distinct fingerprints ``fp``; ``n`` is their number."""
    wanted = sample_size(n)
    pick = F.pmod(F.xxhash64(F.col("fp"), F.lit(1)), F.lit(max(n, wanted)).cast("long")) < wanted
    sample = np.sort(np.array([r[0] for r in points.where(pick).collect()], dtype=np.int64)).view(np.uint64)
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    nodes = fit_tree(sample, max(LEAST_SHARDS, -(-n // SHARD_ROWS)))

    def deal(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            if len(own):
                shard, row, resident = route(nodes, own, radius)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[row].view(np.int64)), pa.array(resident)],
                                                 names=["shard", "fp", "resident"])

    def search(group: pa.Table) -> pa.Table:
        own, resident = group["fp"].to_numpy().astype(np.int64).view(np.uint64), group["resident"].to_numpy(zero_copy_only=False)
        both = np.concatenate((own[resident], own[~resident]))
        label = linked(own[resident], own[~resident], radius)
        at = np.flatnonzero(label != np.arange(len(both)))
        return pa.table({"u": both[at].view(np.int64), "v": both[label[at]].view(np.int64)})
    return points.mapInArrow(deal, "shard int, fp long, resident boolean").groupBy("shard").applyInArrow(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of the edges ``u``, ``v``."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys``, ``fp``, ``group`` (a fingerprint that names the component) and ``component_id`` of every row; ``doc_id`` is a key."""
    marks = cut_lineage(fingerprints(docs, shingle, text, keys))
    points = cut_lineage(marks.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(points.select("fp"), radius, points.count()))
    named = found.join(points, F.col("node") == F.col("fp")).select("fp", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = named.join(least, "root").select("fp", "root", "component_id")
    every = points.join(grouped, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("group"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return spread_join(marks, every, "fp", marks.count(), keys).select(*keys, "fp", "group", "component_id")
