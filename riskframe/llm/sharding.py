"""Sharding by Karmarkar-Karp differencing.

Rows are weighed, equal texts form indivisible groups, and groups are put into
``shards`` parts of nearly equal bytes.  A partial partition is a row of part
sums, largest first.  Differencing repeatedly takes the two partial partitions
with the largest spread (largest minus smallest sum) and adds them in opposite
order, largest to smallest, until one is left; walking back down the tree of
combinations gives every group its part.

It runs in rounds.  Groups are dealt by hash into blocks of bounded size and
each block is differenced in its own task; what remains of a block is one row of
``shards`` sums, and only those rows (one a block, whatever their number of
groups) are differenced with each other.  Spreads of blocks are small, so
opposite ordering cancels them almost wholly.

Equal texts are counted by a digest with map-side sums before any shuffle, so a
text that a third of all rows share is one partial row per task; when shards go back
to the rows, such a text's rows are split over several tasks.  A group larger
than the mean shard cannot be split; its shard is then that much larger.

Results
-------
One row per input row.  A null text weighs nothing but the row's one byte and
equals the empty text.  Null or repeated ids are rows of their own.  Slots number
a shard's rows from 0 without gaps.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import shuffle_partitions, spread_join
from riskframe.session import cut_lineage

#: Groups that one task differences at once (rows of numbers, a few MB).
BLOCK_GROUPS = 32_768
#: Blocks whose sums one task differences at once in the rounds above.
FAN_IN = 2_048
#: Rows of one numbering window, in the mean.
SLOT_ROWS = 65_536


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial partitions (n x parts sums) into one.

    Returns the final part of every (partial partition, own part), and the final sums.
    """
    n, parts = sums.shape
    if not n:
        return np.zeros((0, parts), np.int64), np.zeros(parts, np.int64)
    order = np.argsort(-sums, axis=1, kind="stable")
    rows = np.take_along_axis(sums, order, axis=1)
    total = 2 * n - 1
    nodes: list[np.ndarray] = [*rows] + [rows[0]] * (n - 1)
    children = np.zeros((n - 1, 2), dtype=np.int64)
    place: list[np.ndarray] = [np.zeros(0, np.int64)] * (n - 1)
    heap = [(-int(r[0] - r[-1]), i) for i, r in enumerate(rows)]
    heapq.heapify(heap)
    for made in range(n, total):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = nodes[a] + nodes[b][::-1]
        by = np.argsort(-joined, kind="stable")
        nodes[made] = joined = joined[by]
        children[made - n], place[made - n] = (a, b), by
        nodes[a] = nodes[b] = joined[:0]
        heapq.heappush(heap, (-int(joined[0] - joined[-1]), made))
    final = nodes[total - 1]
    label: list[np.ndarray] = [np.arange(parts)] * total
    for made in range(total - 1, n - 1, -1):
        slot = np.empty(parts, dtype=np.int64)  # the final part of each position before sorting
        slot[place[made - n]] = label[made]
        a, b = children[made - n].tolist()
        label[a], label[b] = slot, slot[::-1]
    out = np.empty((n, parts), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = label[i]
    return out, final


def spread_groups(groups: DataFrame, key: str, size: str, shards: int, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """``key`` and ``shard`` of every group (distinct non-null binary keys with their bytes)."""
    spark = groups.sparkSession
    blocks = max(1, -(-groups.count() // block_groups))
    rows = groups.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size"),
                         F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"))

    def local(block: pa.Table) -> pa.Table:
        order = np.lexsort((block["key"].to_numpy(zero_copy_only=False).astype(object), -block["size"].to_numpy()))
        sums = np.zeros((block.num_rows, shards), dtype=np.int64)
        sums[:, 0] = block["size"].to_numpy()[order]
        label, final = difference(sums)
        part = np.empty(block.num_rows, dtype=np.int32)
        part[order] = label[:, 0]
        return pa.table({"key": block["key"], "block": block["block"], "part": part, "part_size": final[part]})

    dealt = cut_lineage(rows.groupBy("block").applyInArrow(local, "key binary, block int, part int, part_size long"))

    def combine(table: pa.Table) -> pa.Table:
        block, part, weight = (table[c].to_numpy() for c in ("block", "part", "part_size"))
        names, at = np.unique(block, return_inverse=True)
        sums = np.zeros((len(names), shards), dtype=np.int64)
        sums[at, part] = weight
        label, final = difference(sums)
        into = label[at, part].astype(np.int32)
        return pa.table({"block": block, "part": part, "above": table["above"], "into": into, "into_size": final[into]})

    # each round turns up to FAN_IN blocks, one row of sums each, into one
    partial = dealt.groupBy("block", "part").agg(F.first("part_size").alias("part_size"))
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        step = cut_lineage(partial.withColumn("above", F.pmod("block", F.lit(blocks)).cast("int")).groupBy("above")
                           .applyInArrow(combine, "block int, part int, above int, into int, into_size long"))
        dealt = (dealt.select("key", "block", "part").join(step.select("block", "part", "above", "into"), ["block", "part"])
                 .select("key", F.col("above").alias("block"), F.col("into").alias("part")))
        partial = step.groupBy(F.col("above").alias("block"), F.col("into").alias("part")).agg(F.first("into_size").alias("part_size"))
    return dealt.select(F.col("key").alias(key), F.col("part").alias("shard"))


def number_slots(rows: DataFrame, n: int, shard: str = "shard", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within a shard of the ``n`` rows, by windows over hash cells of bounded size and their offsets."""
    cells = max(shuffle_partitions(rows.sparkSession), -(-n // slot_rows))
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(cells)).cast("int"))
    sizes = rows.groupBy(shard, "__cell").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__from", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    inside = Window.partitionBy(shard, "__cell").orderBy("doc_id", "copy")
    return (rows.withColumn("__at", F.row_number().over(inside) - 1).join(offsets, [shard, "__cell"])
            .withColumn("slot", F.col("__from") + F.col("__at")).drop("__cell", "__from", "__at"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` of every row; equal texts share a shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("copy")))
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = spread_groups(groups, "digest", "bytes", shards)
    n = slim.count()
    return number_slots(spread_join(slim, placed, "digest", n, ["copy"]).drop("digest"), n).drop("copy")
