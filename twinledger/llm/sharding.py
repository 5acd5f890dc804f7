"""Operator 2, sharding by Karmarkar-Karp differencing.

Rows of equal texts are one indivisible group; a group's size is the bytes of its rows.  A partial
partition is a tuple of `shards` sums, at first one group and zeros.  The two with the largest
spread are combined, one in ascending and one in descending order, until one is left; the tree of
combinations then tells each group's shard.

Groups are dealt by hash into blocks of about BLOCK, and each block is differenced in one task.
Groups too large for a block to even out (by their number at most 4 * shards for each block, so a
small part) are placed first, by the same rule; every block then starts from its share of their
sums as one more partial partition, whose places stay.  So no task sees more than a bounded number
of groups, and the driver sees one sum for each shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.stored import cut, small, unwrapped, wrapped

SHARDS = 24
#: Groups of a block, rows of a run of slots.
BLOCK, RUN = 20_000, 1_000


def differencing(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums): the shard that each entry of each tuple goes to, and the bytes of the shards.

    tuples: a row of non-negative sums for each partial partition. Ties fall to the earlier row.
    """
    n, shards = tuples.shape
    order = np.argsort(-tuples, axis=1, kind="stable")
    sums: list[np.ndarray | None] = list(np.take_along_axis(tuples, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        turn = np.argsort(-both, kind="stable")
        sums[a] = sums[b] = None
        sums.append(both[turn])
        made.append((a, b, turn))
        heapq.heappush(heap, (-int(both[turn[0]] - both[turn[-1]]), n + len(made) - 1))
    spots: list[np.ndarray | None] = [None] * (n + len(made))
    spots[-1] = np.arange(shards)
    for i in range(len(made) - 1, -1, -1):
        a, b, turn = made[i]
        own = np.empty(shards, dtype=np.int64)
        own[turn] = spots[n + i]
        spots[a], spots[b], spots[n + i] = own, own[::-1], None
    places = np.empty((n, shards), dtype=np.int64)
    np.put_along_axis(places, order, np.stack(spots[:n]), axis=1)
    return places, sums[-1]


def _difference(shards: int, share: list[int]):
    """Groups (block, key, bytes) of one block to (key, shard), beside a tuple share that keeps its places."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        tuples = np.zeros((len(table) + 1, shards), dtype=np.int64)
        tuples[0] = share
        tuples[1:, 0] = table.column("bytes").to_numpy()
        places, _ = differencing(tuples)
        name = np.empty(shards, dtype=np.int32)
        name[places[0]] = np.arange(shards)
        return pa.table({"key": table.column("key"), "shard": pa.array(name[places[1:, 0]])})

    return run


def place_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, shard) of groups (key binary, bytes long), each key once."""
    groups = cut(groups)
    count, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    blocks, share, done = max(1, -(-count // max(BLOCK, 16 * shards))), [0] * shards, None
    if blocks > 1:
        large = F.col("bytes") * (blocks * shards * 4) >= total
        if not (big := groups.where(large)).isEmpty():
            done = cut(place_groups(big, shards))
            sums = dict(big.join(done, "key").groupBy("shard").agg(F.sum("bytes")).collect())
            share = [sums.get(s, 0) // blocks for s in range(shards)]
            groups = groups.where(~large)
    dealt = groups.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "key", "bytes")
    placed = dealt.groupBy("block").applyInArrow(_difference(shards, share), "key binary, shard int")
    return placed if done is None else placed.union(done)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null), a row for each row.

    size: UTF-8 bytes of the text (null: none) plus 8.  Rows of equal texts share a shard; null counts
    as the empty text.  Sums of sizes are near equal, as far as single groups allow.  slot: gapless
    from 0 in each shard; rows that repeat a doc_id, or have none, get slots of their own.  Columns of
    docs with one of these names are replaced; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    sized = wrapped(docs, "doc_id", F.octet_length(text).cast("long").alias("bytes"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    sized = sized.withColumn("size", F.col("bytes") + 8).drop("bytes")
    count = docs.count()
    groups = sized.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = sized.join(place_groups(groups, shards), "key").drop("key")
    # slots: runs of a shard's rows by hash, numbered in parallel from where the runs before them end
    runs = max(1, -(-count // (shards * RUN)))
    in_run = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)))
    ends = Window.partitionBy("shard").orderBy("run")
    starts = in_run.groupBy("shard", "run").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(ends) - F.col("n"))
    starts = small(cut(starts.select("shard", "run", "start")))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = in_run.withColumn("nth", F.row_number().over(inside).cast("long") - 1).join(starts, ["shard", "run"])
    made = numbered.withColumns({"law": F.lit("bytes"), "slot": F.col("start") + F.col("nth"), "grown_shard": F.lit(None).cast("int")})
    return unwrapped(made, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
