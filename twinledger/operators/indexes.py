"""Parties with their derived columns, and the tables that are built from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.functions import text as T
from twinledger.plans.lineage import cut

FIELDS = ("bp_id", "bp_type_id", "name_1", "address", "ktp_number", "npwp_number")


def source(general: DataFrame, docs: DataFrame, taxes: DataFrame) -> DataFrame:
    """General rows with an id, completed by document and tax numbers; nulls become empty text."""
    joined = general.where("bp_id is not null").join(docs, "bp_id", "left").join(taxes, "bp_id", "left")
    return joined.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS))


def source_sql(spark: SparkSession, general: DataFrame, docs: DataFrame, taxes: DataFrame, query: str | None = None) -> DataFrame:
    """source, or what query selects from the views general, docs and taxes; no rows are an error, so that an
    empty answer never marks every party as deleted."""
    if query is None:
        rows = source(general, docs, taxes)
    else:
        rows = spark.sql(query, general=general, docs=docs, taxes=taxes).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS))
    if rows.isEmpty():
        raise ValueError("the source is empty")
    return rows


def derive(party: DataFrame) -> DataFrame:
    """party with normalised text, digits, lengths, buckets, tokens and hashes."""
    named = party.withColumns({"norm_name": T.normalize_text(F.col("name_1")), "norm_address": T.normalize_text(F.col("address")), "norm_text": T.normalize_text(F.concat_ws(" ", "name_1", "address")), "ktp": T.normalize_digits(F.col("ktp_number")), "npwp": T.normalize_digits(F.col("npwp_number")), "norm_digits": T.normalize_digits(F.concat_ws(" ", "name_1", "address"))})
    sized = named.withColumns({"text_len": F.length("norm_text"), "tokens": T.tokens(F.col("norm_text")), "chunks": T.numeric_tokens(F.col("norm_text"))})
    return sized.withColumns({"token_count": F.size("tokens"), "len_bucket": T.len_bucket(F.col("text_len")), "exact_hash": T.exact_hash(F.col("norm_name"), F.col("norm_address")), "row_hash": T.row_hash(*(F.col(c) for c in FIELDS[:4]), F.col("ktp"), F.col("npwp"))})


def numbered(df: DataFrame, *order: str, first: int = 2) -> DataFrame:
    """df with bp_db_row, gapless from first on in the order given, which should be total.

    Rows are sorted by range and numbered in each partition from where those before it end; the
    sorted rows are stored once, so both passes see the same partitions.
    """
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("bp_db_row", F.col("_start") + within + first).drop("_at", "_part", "_start")


def base_table(derived: DataFrame) -> DataFrame:
    """Parties in the physical order: bucket, token count, length, id."""
    return numbered(derived, "len_bucket", "token_count", "text_len", "bp_id")


def keyed_table(derived: DataFrame) -> DataFrame:
    """Parties in the order of the keyed index: bucket, token count, id."""
    return numbered(derived, "len_bucket", "token_count", "bp_id")


def ranges(rows: DataFrame, *keys: str) -> DataFrame:
    """First and last row and count for each key; rows are sorted by the keys, so a key is one range."""
    return rows.groupBy(*keys).agg(F.min("bp_db_row").alias("row_start"), F.max("bp_db_row").alias("row_end"), F.count("*").alias("n"))


def identity_index(base: DataFrame, column: str) -> DataFrame:
    """Rows with an identity number, in shard order, with their own row numbers and the base row as target."""
    held = base.where(F.length(column) > 0).select(F.col(column).alias("digits"), "bp_id", F.col("bp_db_row").alias("target"))
    return numbered(held.withColumn("shard", T.identity_shard(F.col("digits"))), "shard", "digits", "target")


def exact_index(base: DataFrame) -> DataFrame:
    held = base.select("exact_hash", "bp_id", F.col("bp_db_row").alias("target"))
    return numbered(held.withColumn("shard", T.exact_shard(F.col("exact_hash"))), "exact_hash", "target")


def postings(base: DataFrame) -> DataFrame:
    """(group_key, posting) of the fuzzy index: bucket and token count, and normalised text, row and id."""
    return base.select(F.concat_ws(":", "len_bucket", "token_count").alias("group_key"), T.posting(F.col("norm_text"), F.col("bp_db_row"), F.col("bp_id")).alias("posting"))


def identity_postings(base: DataFrame, column: str) -> DataFrame:
    """(digits, posting) of an identity number: row, id and both numbers."""
    return base.where(F.length(column) > 0).select(F.col(column).alias("digits"), T.posting(F.col("bp_db_row"), F.col("bp_id"), F.col("ktp"), F.col("npwp")).alias("posting"))


def read_postings(fuzzy: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of both kinds of postings read back and joined on the row number.

    rows: bp_db_row, bp_id, norm_text, ktp, npwp.  faults: (bp_db_row, fault) of postings that can't be
    read, fuzzy rows that repeat, identity postings without their row, of another id, or whose digits
    are not the number that they are filed under.
    """
    f = fuzzy.withColumn("p", T.posting_parts(F.col("posting"), 3))
    i = identity.withColumn("p", T.posting_parts(F.col("posting"), 4))
    bad = f.where("p is null").union(i.where("p is null")).select(F.lit(None).cast("long").alias("bp_db_row"), F.lit("UNREADABLE").alias("fault"))
    rows = f.where("p is not null").select(F.col("p")[1].cast("long").alias("bp_db_row"), F.col("p")[2].alias("bp_id"), F.col("p")[0].alias("norm_text"))
    held = i.where("p is not null").select(F.col("p")[0].cast("long").alias("bp_db_row"), F.col("p")[1].alias("id"), F.col("p")[2].alias("ktp"), F.col("p")[3].alias("npwp"), "digits")
    twice = duplicates(rows, "bp_db_row").select("bp_db_row", F.lit("REPEATED").alias("fault"))
    both = held.join(rows, "bp_db_row", "left")
    wrong = F.when(F.col("bp_id").isNull(), "MISSING").when(F.col("bp_id") != F.col("id"), "OTHER_ID").when(~F.col("digits").isin(F.col("ktp"), F.col("npwp")), "OTHER_DIGITS")
    faults = bad.union(twice).union(both.select("bp_db_row", wrong.alias("fault")).where("fault is not null"))
    known = held.groupBy("bp_db_row").agg(F.first("ktp").alias("ktp"), F.first("npwp").alias("npwp"))
    return rows.join(known, "bp_db_row", "left").fillna("", ["ktp", "npwp"]), faults


def fetched(hits: DataFrame, base: DataFrame) -> DataFrame:
    """hits (bp_db_row, bp_id, ...) with the party's row from the table itself, and verified: whether the row
    is there, is of that id, and its stored hash is that of its fields."""
    again = base.select("bp_db_row", F.col("bp_id").alias("row_id"), *FIELDS[1:], "row_hash", T.row_hash(*(F.col(c) for c in FIELDS[:4]), T.normalize_digits(F.col("ktp_number")), T.normalize_digits(F.col("npwp_number"))).alias("hash_now"))
    out = hits.join(again, "bp_db_row", "left")
    return out.withColumn("verified", F.coalesce((F.col("row_id") == F.col("bp_id")) & (F.col("row_hash") == F.col("hash_now")), F.lit(False))).drop("row_id", "hash_now")


def in_ranges(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose bp_db_row lies in one of the ranges (row_start, row_end) of wanted, which must not overlap.

    An equi-join on blocks of 1024 rows; a range is repeated for each block that it meets.
    """
    blocks = wanted.select("row_start", "row_end", F.explode(F.sequence(F.shiftright("row_start", 10), F.shiftright("row_end", 10))).alias("_block"))
    found = rows.withColumn("_block", F.shiftright(F.col("bp_db_row").cast("long"), 10)).join(blocks.withColumn("_block", F.col("_block").cast("long")), "_block")
    return found.where("bp_db_row between row_start and row_end").drop("_block", "row_start", "row_end")


def require_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right on key; an error if key repeats on either side or a left row has no partner."""
    joined = left.join(right, key)
    if not duplicates(left, key).isEmpty() or not duplicates(right, key).isEmpty() or not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"{key} isn't one to one")
    return joined


def gaps(ranged: DataFrame) -> DataFrame:
    """Ranges that don't start right after the one before, or the first not at row 2."""
    before = F.lag("row_end").over(Window.orderBy("row_start"))
    return ranged.withColumn("expected", F.coalesce(before + 1, F.lit(2))).where("row_start <> expected")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df; an error names the key if it repeats or is empty."""
    if not duplicates(df, key).isEmpty() or not df.where(F.coalesce(F.col(key), F.lit("")) == "").isEmpty():
        raise ValueError(f"{key} must be unique and not empty")
    return df


def ordered_digest(rows: DataFrame, key: str = "bp_id", value: str = "row_hash") -> str:
    """sha256 over key, 0x1F, value and newline of all rows in key order.

    One hash over an ordered stream is sequential by its definition: rows are sorted in parallel and
    pass the driver a partition at a time, about 100 bytes each.  digest is the parallel form.
    """
    state = hashlib.sha256()
    for k, v in rows.select(key, value).orderBy(key).toLocalIterator(prefetchPartitions=True):
        state.update(k.encode() + b"\x1f" + v.encode() + b"\n")
    return state.hexdigest()


def digest(rows: DataFrame, key: str = "bp_id", value: str = "row_hash") -> DataFrame:
    """(rows, low, high): the count and two sums over a 128-bit hash of each row's key and value, modulo 2**64.

    It compares generations in one pass without a sort, and a partial aggregate of a few bytes is all
    that a task sends.  The ordered SHA-256 of an export is ordered_digest.
    """
    hashed = F.md5(F.concat_ws("\x1f", key, value))
    half = lambda at: F.conv(F.substring(hashed, at, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.sum(half(1)).cast("string").alias("low"), F.sum(half(17)).cast("string").alias("high"))


def audit(base: DataFrame, exact: DataFrame) -> DataFrame:
    """Rows that don't have exactly one exact-index entry."""
    n = exact.groupBy(F.col("target").alias("bp_db_row")).agg(F.count("*").alias("entries"))
    return base.select("bp_id", "bp_db_row").join(n, "bp_db_row", "left").fillna(0, ["entries"]).where("entries <> 1")
