"""Request controls: rate windows, rolling budgets with their quota state, resumable scans, percentiles."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.functions import text as T
from twinledger.operators import indexes, match
from twinledger.operators.indexes import numbered
from twinledger.plans.config import DEFAULT, Config

T_ = TypeVar("T_")


def over_rate(events: DataFrame, client: str, limit: int) -> DataFrame:
    """Events beyond the limit of their client in their minute, in the order of time and id."""
    nth = F.row_number().over(Window.partitionBy(client, F.date_trunc("minute", "ts")).orderBy("ts", "event_id"))
    return events.withColumn("nth", nth).where(F.col("nth") > limit)


def _sessions(events: DataFrame, client: str, seconds: int) -> DataFrame:
    """(event_id, client, micros, session): a gap of `seconds` or more before an event starts a new session.

    Nothing admitted before such a gap counts after it, so sessions are independent, and a client
    with many events is as many groups as it has pauses.
    """
    placed = events.select("event_id", F.col(client).cast("string").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    before = Window.partitionBy("client").orderBy("micros", "event_id")
    new = F.coalesce((F.col("micros") - F.lag("micros").over(before) >= seconds * 1_000_000).cast("int"), F.lit(1))
    return placed.withColumn("new", new).withColumn("session", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def rolling_budget(events: DataFrame, client: str, limit: int, seconds: int = 60) -> DataFrame:
    """(event_id, admitted, used, pause_seconds): at most limit admitted events of a client in any window; rejected
    ones don't count. used: admitted events in the window, this one included; pause_seconds: until the
    next one can be, 0 if it can at once.

    Admission depends on earlier admissions, so a session's events are folded in order, as a stream
    of sorted batches with only the admitted times of the last window in memory.
    """

    def fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, deque()
        for part in rows:
            out = []
            for client_, session, ts in zip(part["client"], part["session"], part["micros"]):
                if (client_, session) != key:
                    key, times = (client_, session), deque()
                while times and times[0] <= ts - seconds * 1_000_000:
                    times.popleft()
                if admitted := len(times) < limit:
                    times.append(ts)
                pause = -(-(times[0] + seconds * 1_000_000 - ts) // 1_000_000) if len(times) >= limit else 0
                out.append((admitted, len(times), pause))
            yield pd.DataFrame({"event_id": part["event_id"], **{c: [x[i] for x in out] for i, c in enumerate(("admitted", "used", "pause_seconds"))}})

    placed = _sessions(events, client, seconds)
    return placed.repartition("client", "session").sortWithinPartitions("client", "session", "micros", "event_id").mapInPandas(fold, "event_id long, admitted boolean, used long, pause_seconds long")


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.95, 1.0)) -> DataFrame:
    """(share, value) by nearest rank: the value at place floor(share * n), the last at most."""
    rows = numbered(df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")), "value", first=0)
    total = rows.agg(F.count("*").alias("n"))
    wanted = total.select(F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.least(F.col("n") - 1, F.floor(F.lit(s) * F.col("n"))).alias("place")) for s in shares))).alias("w")).select("w.*")
    return rows.join(F.broadcast(wanted), F.col("bp_db_row") == F.col("place")).select("share", "value")


def scan_plan(groups: DataFrame, text_len: int, most_rows: int) -> DataFrame:
    """Groups (len_bucket, token_count, row_start, row_end, n) in the order of a scan, with before: the rows ahead of each.

    By distance of the bucket from the request's, then by row; if they are more than most_rows, small
    groups come first.  One row for each group, of which there are as many as lengths and token counts.
    """
    over = F.sum("n").over(Window.partitionBy()) > most_rows
    distance = F.abs(F.col("len_bucket") - F.lit(text_len // 5))
    ranked = groups.withColumns({"lead": F.when(over, F.col("n")).otherwise(F.lit(0)), "distance": distance})
    order = Window.orderBy("lead", "distance", "row_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("lead")


def scan_prefix(groups: DataFrame, budget: int) -> DataFrame:
    """Groups (len_bucket, token_count, n) in scan order with the rows before each; those that begin within the budget."""
    order = Window.orderBy(F.col("n"), "len_bucket", "token_count").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < budget)


def scan_step(request: DataFrame, base: DataFrame, state: dict | None, budget: int, config: Config = DEFAULT) -> dict:
    """One bounded step of a resumable scan of base (with bp_db_row) for one request.

    At most `budget` rows in plan order, from state["scanned"] on.  decision: FAIL with the first match in
    that order; PASS only if all rows of the plan were scanned; else INCONCLUSIVE, with the state to go
    on from.  state and what is returned hold: scanned, compared, total.
    """
    q = request.select("req_id", "bp_id", "text_len").first()
    reach = request.select(T.max_len_diff(F.col("text_len"), config.tolerance_percent, config.tolerance_chars)).first()[0]
    low, high = max(0, q.text_len - reach) // 5, (q.text_len + reach) // 5
    groups = indexes.ranges(base, "len_bucket", "token_count").where(F.col("len_bucket").between(low, high))
    plan = scan_plan(groups, q.text_len, config.max_rows)
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at, compared = (state or {}).get("scanned", 0), (state or {}).get("compared", 0)
    if state and state.get("total", total) != total:
        raise ValueError("the plan has changed")
    end = min(total, at + budget)
    # the part of each group that this step covers, as rows of base
    skip, take = F.greatest(F.lit(at) - F.col("before"), F.lit(0)), F.least(F.lit(end) - F.col("before"), F.col("n"))
    wanted = plan.where((F.col("before") < end) & (F.col("before") + F.col("n") > at)).select((F.col("row_start") + skip).cast("long").alias("row_start"), (F.col("row_start") + take - 1).cast("long").alias("row_end"), "before", F.col("row_start").alias("group_start"))
    rows = indexes.in_ranges(base, wanted.select("row_start", "row_end"))
    pairs = match.pairs_in_window(request, rows, config)
    compared += pairs.count()
    found = match.matches(pairs, config).join(base.select("bp_id", "bp_db_row"), "bp_id")
    placed = found.join(F.broadcast(wanted), F.col("bp_db_row").between(F.col("row_start"), F.col("row_end"))).withColumn("position", F.col("before") + F.col("bp_db_row") - F.col("group_start"))
    first = placed.agg(F.min_by(F.struct("bp_id", "score", "rule"), "position").alias("first")).first()["first"]
    out = {"scanned": end, "compared": compared, "total": total}
    if first is not None:
        return out | {"decision": "FAIL", "bp_id": first["bp_id"], "score": first["score"], "rule": first["rule"]}
    return out | {"decision": "PASS" if end == total else "INCONCLUSIVE"}


def resume(request: DataFrame, base: DataFrame, secret: bytes, sync_id: str, cursor: str | None = None, budget: int | None = None, config: Config = DEFAULT, now: float | None = None, ttl: int = 3600) -> dict:
    """scan_step with a signed cursor, bound to the request's inputs, the settings and the generation."""
    now = time.time() if now is None else now
    texts = request.select("norm_text", "ktp", "npwp").first()
    bound = {"query": hashlib.sha256(json.dumps([*texts, str(config)]).encode()).hexdigest(), "sync_id": sync_id}
    state = verify(cursor, secret, now, bound) if cursor else None
    out = scan_step(request, base, state, budget or config.chunk_rows, config)
    if out["decision"] == "INCONCLUSIVE":
        out["cursor"] = sign(bound | {k: out[k] for k in ("scanned", "compared", "total")} | {"expires": now + ttl}, secret)
    return out


def within(spark: SparkSession, seconds: float, action: Callable[[], T_]) -> T_:
    """What action returns; its Spark jobs are cancelled after so many seconds, and that is an error, never part of a result."""
    context, group, late = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "bounded by time", interruptOnCancel=True)
    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise TimeoutError(f"no result within {seconds} s")
    return out


def sign(state: dict, secret: bytes) -> str:
    """A resumable scan's cursor: JSON with an HMAC-SHA256, base64url."""
    body = json.dumps(state, sort_keys=True, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode().rstrip("=")


def verify(cursor: str, secret: bytes, now: float, bound: dict) -> dict:
    """The cursor's state; ValueError if it was tampered with, has expired, or is of another query or generation."""
    try:
        raw = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))
    except ValueError as e:
        raise ValueError("bad cursor") from e
    if not hmac.compare_digest(hmac.new(secret, raw[32:], hashlib.sha256).digest(), raw[:32]):
        raise ValueError("bad cursor")
    state = json.loads(raw[32:])
    if state.get("expires", 0) < now or any(state.get(k) != v for k, v in bound.items()):
        raise ValueError("the cursor has expired or belongs to another query")
    return state
