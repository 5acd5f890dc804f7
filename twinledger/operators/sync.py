"""Keyed incremental sync: delta, apply, verify, and publishing of generations behind one pointer."""

from __future__ import annotations

import fcntl
import json
import os
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators.indexes import FIELDS, digest, numbered, require_unique


def classify(source: DataFrame, existing: DataFrame) -> DataFrame:
    """(bp_id, change) of a full outer join on id: create, change, hash_only, unchanged, tombstone, deleted.

    existing has is_deleted. hash_only: the hash differs and no field does. A deleted id that comes back is a change.
    """
    s = source.select("bp_id", F.struct(*FIELDS).alias("new"), F.col("row_hash").alias("new_hash"))
    e = existing.select("bp_id", F.struct(*FIELDS).alias("old"), F.col("row_hash").alias("old_hash"), "is_deleted")
    both = s.join(e, "bp_id", "full_outer")
    change = (
        F.when(F.col("old").isNull(), "create")
        .when(F.col("new").isNull(), F.when(F.col("is_deleted"), "deleted").otherwise("tombstone"))
        .when(F.col("is_deleted"), "change")
        .when(~F.col("old").eqNullSafe(F.col("new")), "change")
        .when(F.col("old_hash") != F.col("new_hash"), "hash_only")
        .otherwise("unchanged")
    )
    return both.select("bp_id", change.alias("change"))


def tombstones(source: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.where("not is_deleted").join(source, "bp_id", "left_anti").select("bp_id")


def creates(source: DataFrame, existing: DataFrame) -> DataFrame:
    return source.join(existing, "bp_id", "left_anti").select("bp_id")


def apply(source: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (with bp_db_row) brought to source: known ids keep their row, new ones follow in id order, a
    missing id keeps its fields and row and is marked deleted."""
    payload = [c for c in (*FIELDS, "row_hash") if c != "bp_id"]
    s = source.select("bp_id", *(F.col(c).alias("new_" + c) for c in payload), F.lit(True).alias("present"))
    both = existing.join(s, "bp_id", "full_outer")
    last = existing.agg(F.coalesce(F.max("bp_db_row"), F.lit(1)).alias("last"))
    fresh = numbered(both.where("bp_db_row is null").select("bp_id"), "bp_id", first=1).withColumnRenamed("bp_db_row", "nth")
    placed = both.join(fresh, "bp_id", "left").join(F.broadcast(last))
    return placed.select("bp_id", *(F.when(F.col("present"), F.col("new_" + c)).otherwise(F.col(c)).alias(c) for c in payload), F.coalesce(F.col("bp_db_row"), F.col("last") + F.col("nth")).alias("bp_db_row"), F.col("present").isNull().alias("is_deleted"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have equal rows, repeated ones as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@contextmanager
def writer_lock(root: str):
    """One writer for each root; a second one fails at once."""
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/_LOCK", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield


def active(root: str) -> dict | None:
    """The manifest of the published generation."""
    try:
        with open(f"{root}/_ACTIVE.json") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def _summary(rows: DataFrame) -> dict:
    """What a manifest says of its rows."""
    n, low, high = digest(rows).first()
    return {"total_bp_rows": n, "source_digest": f"{n}:{low}:{high}"}


def _write(root: str, name: str, value: dict) -> None:
    with open(f"{root}/{name}.tmp", "w") as f:
        json.dump(value, f)
    os.replace(f"{root}/{name}.tmp", f"{root}/{name}")


def staged(root: str) -> dict | None:
    """The manifest of the generation that is being written, or was when its writer ended."""
    try:
        with open(f"{root}/_STAGING.json") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def read_active(spark: SparkSession, root: str, sync_id: str | None = None) -> tuple[dict, DataFrame]:
    """The published rows, checked against the manifest's state, count and digest; anything else is an error.

    sync_id: the generation that the caller began with; an error if another one is published now.
    """
    manifest = active(root)
    if not manifest or manifest.get("sync_state") != "READY":
        raise RuntimeError("no published generation")
    if sync_id is not None and manifest["sync_id"] != sync_id:
        raise RuntimeError("another generation was published meanwhile")
    rows = spark.read.parquet(f"{root}/gen={manifest['sync_id']}")
    if _summary(rows.where("not is_deleted")) != {k: manifest[k] for k in ("total_bp_rows", "source_digest")}:
        raise RuntimeError("the generation doesn't match its manifest")
    return manifest, rows


def publish(spark: SparkSession, root: str, source: DataFrame, sync_id: str) -> str:
    """Write source as a new generation, read it back, then move the pointer. 'NOOP' if nothing changed, else 'PUBLISHED'.

    The new generation is IN_PROGRESS until it is verified, and never the active one.  A failure on the
    way leaves the pointer as it was.  A manifest is written whole, so keys of an older one don't stay.
    """
    require_unique(source, "bp_id")
    with writer_lock(root):
        before, summary = active(root), _summary(source)
        if not summary["total_bp_rows"]:
            raise ValueError("the source is empty")
        if before and all(before.get(k) == v for k, v in summary.items()):
            return "NOOP"
        if before and before["sync_id"] == sync_id:
            raise ValueError("the active generation can't be written again")
        columns = (*FIELDS, "row_hash")
        if before:
            existing = read_active(spark, root)[1]
        else:
            existing = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns) + ", bp_db_row long, is_deleted boolean")
        manifest = {"sync_id": sync_id, "sync_state": "IN_PROGRESS", **summary}
        _write(root, "_STAGING.json", manifest)
        path = f"{root}/gen={sync_id}"
        apply(source.select(*columns), existing).write.parquet(path)
        back = spark.read.parquet(path)
        if not same(back.where("not is_deleted").select(*columns), source.select(*columns)):
            raise RuntimeError("read-back differs")
        if active(root) != before:
            raise RuntimeError("the pointer moved meanwhile")
        _write(root, "_ACTIVE.json", manifest | {"sync_state": "READY"})
        os.remove(f"{root}/_STAGING.json")
        return "PUBLISHED"


class Follower:
    """Follows a root's pointer: rows of a generation are checked and cached once, and given up for a newer one.

    A failure is remembered for memo_seconds, in which it is raised again without another read.
    """

    def __init__(self, spark: SparkSession, root: str, memo_seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.memo_seconds, self.clock = spark, root, memo_seconds, clock
        self.held: tuple[dict, DataFrame] | None = None
        self.failed: tuple[float, Exception] | None = None

    def rows(self) -> tuple[dict, DataFrame]:
        if self.failed and self.clock() < self.failed[0]:
            raise self.failed[1]
        self.failed = None
        manifest = active(self.root)
        if self.held and self.held[0] == manifest:
            return self.held
        try:
            found = read_active(self.spark, self.root)
        except Exception as e:
            self.failed = (self.clock() + self.memo_seconds, e)
            raise
        if self.held:
            self.held[1].unpersist()
        self.held = found[0], found[1].persist()
        return self.held
