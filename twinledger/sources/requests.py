"""Requests as JSON lines: size cap, field aliases, at least one field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 65_536
_SCHEMA = "name_1 string, name1 string, address string, ktp_number string, ktp string, npwp_number string, npwp string, _corrupt_record string"


def parse(bodies: DataFrame) -> DataFrame:
    """(req_id, name_1, address, ktp_number, npwp_number, error) from (req_id, body)."""
    j = F.from_json("body", _SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    pick = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(f"j.{n}")), F.lit("")) for n in names), F.lit(""))
    rows = bodies.withColumn("j", j).withColumns({"name_1": pick("name_1", "name1"), "address": pick("address"), "ktp_number": pick("ktp_number", "ktp"), "npwp_number": pick("npwp_number", "npwp")})
    empty = F.concat("name_1", "address", F.regexp_replace(F.concat("ktp_number", "npwp_number"), "[^0-9]", "")) == ""
    error = F.when(F.octet_length("body") > MOST_BYTES, "TOO_LARGE").when(F.col("j").isNull() | F.col("j._corrupt_record").isNotNull(), "BAD_JSON").when(empty, "NO_INPUT")
    return rows.select("req_id", "name_1", "address", "ktp_number", "npwp_number", error.alias("error"))


def responses(checked: DataFrame) -> DataFrame:
    """(req_id, body): each decision as JSON."""
    return checked.select("req_id", F.to_json(F.struct(*[c for c in checked.columns if c != "req_id"])).alias("body"))
