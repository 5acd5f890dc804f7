"""The entry points over a published generation: a batch of JSON checks, one resumable check, health."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.operators import control, indexes, match, sync
from twinledger.plans.config import Config
from twinledger.sources import requests

VERSION = "1"


class Service:
    """settings: names and texts of Config.from_settings; secret: signs the cursors of resumable checks."""

    def __init__(self, spark: SparkSession, root: str, settings: Mapping[str, str] | None = None, secret: bytes = b""):
        self.spark, self.config, self.secret = spark, Config.from_settings(settings or {}), secret
        self.follower = sync.Follower(spark, root)

    def health(self) -> dict:
        """State of the published generation; ok only if its rows were read and agree with the manifest."""
        try:
            manifest, _ = self.follower.rows()
        except Exception as e:
            return {"ok": False, "version": VERSION, "error": str(e), "staging": sync.staged(self.follower.root)}
        return {"ok": True, "version": VERSION, **{k: manifest[k] for k in ("sync_id", "sync_state", "total_bp_rows")}}

    def _base(self) -> tuple[dict, DataFrame]:
        manifest, rows = self.follower.rows()
        return manifest, indexes.derive(rows.where("not is_deleted"))

    def check(self, bodies: DataFrame) -> DataFrame:
        """(req_id, status, body) for each (req_id, body): 200 with the decision, 400 or 413 with the error.

        The generation's id is in each answer.  A batch that takes longer than check_seconds for each
        body is a TimeoutError, and never answers in part.
        """
        manifest, base = self._base()
        parsed = requests.parse(bodies).persist()
        good = parsed.where("error is null").select("req_id", F.concat(F.lit("\x00"), "req_id").alias("bp_id"), F.lit("").alias("bp_type_id"), *indexes.FIELDS[2:])
        asked = indexes.derive(good)
        made = match.respond(asked, base, self.config).withColumns({"sync_id": F.lit(manifest["sync_id"]), "engine_version": F.lit(VERSION)})
        seconds = self.config.check_seconds * max(1, parsed.count())
        answers = control.within(self.spark, seconds, lambda: requests.responses(made).select("req_id", F.lit(200).alias("status"), "body").persist())
        control.within(self.spark, seconds, answers.count)
        status = F.when(F.col("error") == "TOO_LARGE", 413).otherwise(400)
        wrong = parsed.where("error is not null").select("req_id", status.alias("status"), F.to_json(F.struct(F.col("error"))).alias("body"))
        return answers.union(wrong)

    def scan(self, body: str, cursor: str | None = None) -> dict:
        """One step of a resumable check of one body, by similarity alone; INCONCLUSIVE answers hold the next cursor."""
        manifest, base = self._base()
        parsed = requests.parse(self.spark.createDataFrame([("0", body)], "req_id string, body string"))
        if error := parsed.first()["error"]:
            raise ValueError(error)
        asked = indexes.derive(parsed.select("req_id", F.lit("\x00").alias("bp_id"), F.lit("").alias("bp_type_id"), *indexes.FIELDS[2:]))
        if asked.first()["text_len"] < 3:
            raise ValueError("NO_TEXT")
        placed = indexes.base_table(base.drop("bp_db_row"))
        step = lambda: control.resume(asked, placed, self.secret, manifest["sync_id"], cursor, config=self.config)
        return control.within(self.spark, self.config.check_seconds, step)
