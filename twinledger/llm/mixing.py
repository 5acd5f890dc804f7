"""Operator 8, mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with n rows and target weight w gets the mean repetition rate w * total / n.  Each document
draws its count from the Poisson distribution of that mean by inversion of a uniform number that a
hash of seed, doc_id and text gives; so any task, and any retry, draws the same.  A mean above MOST_RATE
is drawn as a sum of equal parts, each with a hash of its own: the sum of Poisson counts is Poisson,
and exp of minus a part is far from the least double.  A document is repeated by its count, and the
copies are sorted by another hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.llm.stored import cut, small, unwrapped, wrapped

SEED = 17
#: Of n ** POWER, for sources without a target weight of their own.
POWER = 0.5
#: Mean of one inversion; exp(-rate) loses digits from 708 on, and is 0 from 746.
MOST_RATE = 500.0


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of seed and parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def steps(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... as far as a double can tell them from 1. rate: MOST_RATE at most."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, n_rows, rate, parts, steps) for each source, steps of one part of the rate; null is a source of its own, named ''."""
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(POWER))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(0.0), F.lit(0.0))
    n = cut(n.withColumn("weight", weight))
    share = F.round(F.col("weight") * 2**20).cast("long")
    rows, shares = n.agg(F.sum("n_rows"), F.sum(share)).first()
    rate = share / F.lit(max(1, shares or 0)) * F.lit(rows or 0) / F.col("n_rows")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    return n.select("source", "n_rows", rate.alias("rate")).withColumn("parts", parts).withColumn("steps", steps(F.col("rate") / F.col("parts")))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """docs with rate, n_copies, copy (from 0) and position (the key of the shuffle), a row for each copy.

    weights: the target share of each source (any scale; a source that isn't named gets none); without
    them shares are as the square root of the rows.  A row draws by its doc_id and text, so rows that
    repeat both draw alike and others on their own; null and empty texts count as rows, and draw as
    the empty text; a null source is a source; no rows give no rows.  Columns of docs with one of these
    four names are replaced.
    """
    rows = wrapped(docs, "doc_id", F.coalesce("source", F.lit("")).alias("of"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))
    known = small(cut(rates(docs, weights).drop("n_rows")))
    drawn = rows.join(known, rows["of"] == known["source"]).withColumn("u", uniform(F.col("doc_id"), F.col("name"), seed=seed))
    first = F.size(F.filter("steps", lambda p: p <= F.col("u"))).cast("long")
    other = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda k: uniform(F.col("doc_id"), F.col("name"), k, seed=seed))
    others = F.aggregate(other, F.lit(0).cast("long"), lambda n, v: n + F.size(F.filter("steps", lambda p: p <= v)))
    count = first + F.when(F.col("parts") > 1, others).otherwise(F.lit(0))
    drawn = drawn.withColumn("n_copies", count).where("n_copies > 0").select("row", "doc_id", "name", "rate", "n_copies")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1)))
    placed = copies.withColumn("position", uniform(F.col("doc_id"), F.col("name"), F.col("copy"), seed=seed + 1))
    return unwrapped(placed.orderBy("position", "doc_id", "name", "copy"), "rate", "n_copies", "copy", "position")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """The rows that replicate makes, with their own columns only."""
    return replicate(wrapped(docs, "doc_id", "text", "source"), weights, seed).select("row.*")
