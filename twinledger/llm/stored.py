"""What the operators share: cut lineage, size-checked broadcasts, wrapped rows, packed entries, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.plans.lineage import cut, shared_dir

__all__ = ["among", "components", "cut", "from_planes", "planes", "shared_dir", "small", "unwrapped", "wrapped"]

#: Rows of at most a few longs; a side with more is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: The same where several such sides are alive at once: three of 1,000,000 rows of two longs fill a driver's heap of 750 MB.
SHARED_ROWS = 100_000
#: Places of the bitmap of among(), and those of one of its rows.
MAP_BITS, ROW_BITS = 1 << 24, 1 << 17


def wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    """docs as one column `row` beside the columns needed, so that no name of docs meets one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *needed)


def unwrapped(rows: DataFrame, *made: str) -> DataFrame:
    """The columns of the wrapped docs, and the columns made, which replace those of docs that have their name."""
    names = [f.name for f in rows.schema["row"].dataType.fields if f.name not in made]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in names), *made)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint if a count shows that it has few rows. Give it something stored."""
    return F.broadcast(df) if df.count() <= rows else df


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """df joined with keys on a long, where few rows of df have a partner. Give keys stored.

    Too many keys for a broadcast are first sent as a bitmap of 2 MB, so that hardly more of df is shuffled than has a partner.
    """
    if keys.count() <= SHARED_ROWS:
        return df.join(F.broadcast(keys), key)
    place = lambda: F.pmod(F.xxhash64(key), F.lit(MAP_BITS))

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("place").to_numpy() % ROW_BITS
        bits = np.zeros(ROW_BITS, bool)
        bits[at] = True
        held = np.packbits(bits, bitorder="little").view("<i8")
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([held], pa.list_(pa.int64()))})

    placed = keys.select(place().alias("place")).distinct().withColumn("part", F.floor(F.col("place") / ROW_BITS))
    held = cut(placed.groupBy("part").applyInArrow(pack, "part long, bits array<long>"))
    at = F.pmod(place(), F.lit(ROW_BITS))
    known = (F.floor(place() / ROW_BITS) == F.col("part")) & (F.getbit(F.get("bits", F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return df.join(F.broadcast(held), known, "left_semi").join(keys, key)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values, all first bytes before all second ones: sorted values then compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T[::-1]).tobytes()


def from_planes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((data.size // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1)[::-1].T
    return out.view("<u8").ravel()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every id in edges (a, b longs), the smallest id that it is connected with.

    Each round takes the least root of the neighbours, then the root's root, and is checkpointed;
    a third of all ids around one hub is a skewed join, which the adaptive plan splits.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    while True:
        known = small(label, SHARED_ROWS)
        near = both.join(known.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = near.join(known, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("to"))
        jump = known.select(F.col("id").alias("to"), F.col("root").alias("far"))
        moved = cut(step.join(jump, "to", "left").select("id", "was", F.least("to", "far").alias("root")))
        label = moved.select("id", "root")
        if moved.where("was <> root").isEmpty():
            return label
