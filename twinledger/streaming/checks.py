"""Checks and rate windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinledger.operators import indexes, match, sync
from twinledger.plans.config import DEFAULT, Config


def rates(events: DataFrame, client: str, limit: int) -> DataFrame:
    """Clients over the limit in a minute, final once the watermark of three minutes has passed it."""
    counted = events.withWatermark("ts", "3 minutes").groupBy(F.window("ts", "1 minute"), F.col(client)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > limit).select(F.col("window.start").alias("minute"), client, "n", (F.col("n") - limit).alias("rejected"))


def check_stream(requests: DataFrame, root: str, out: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """Decide each batch of requests against the generation that is published when the batch starts."""

    follower = sync.Follower(requests.sparkSession, root)

    def batch(rows: DataFrame, number: int) -> None:
        manifest, base = follower.rows()
        derived = indexes.derive(base.where("not is_deleted"))
        made = match.check(indexes.derive(rows).persist(), derived, config).withColumn("sync_id", F.lit(manifest["sync_id"]))
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
