"""Similarities of texts, token sets and digit chunks, 0 to 100, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinledger.functions.text import round2

Similarity = Callable[[Column, Column], Column]


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    score = F.greatest(F.lit(0.0), (1 - F.levenshtein(a, b) / longest) * 100)
    return F.when(a == b, F.lit(100.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(score)


def token_pair(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(100.0)).when(F.least(F.length(a), F.length(b)) < 4, F.lit(0.0)).otherwise(levenshtein_similarity(a, b))


def numeric_chunk(a: Column, b: Column) -> Column:
    held = (F.least(F.length(a), F.length(b)) >= 3) & (F.contains(a, b) | F.contains(b, a))
    return F.when(a == b, F.lit(100.0)).otherwise(F.greatest(F.when(held, F.lit(65.0)).otherwise(F.lit(0.0)), levenshtein_similarity(a, b)))


def greedy_match(a: Column, b: Column, similar: Similarity, weight: Callable[[Column], Column], least: float) -> Column:
    """struct(matched, pairs): one-to-one pairs taken by similarity, ties by place in a, then in b."""
    rows = F.transform(
        a,
        lambda x, i: F.filter(
            F.transform(b, lambda y, j: F.struct((-similar(x, y)).alias("s"), i.alias("i"), j.alias("j"), F.least(weight(x), weight(y)).alias("w"))),
            lambda p: p["s"] <= -least,
        ),
    )
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("matched"), F.lit(0).alias("pairs"), none.alias("us"), none.alias("vs"))

    def take(acc: Column, p: Column) -> Column:
        more = F.struct((acc["matched"] + p["w"] * -p["s"] / 100).alias("matched"), (acc["pairs"] + 1).alias("pairs"), F.array_append(acc["us"], p["i"]).alias("us"), F.array_append(acc["vs"], p["j"]).alias("vs"))
        return F.when(F.array_contains(acc["us"], p["i"]) | F.array_contains(acc["vs"], p["j"]), acc).otherwise(more)

    return F.aggregate(F.array_sort(F.flatten(rows)), start, take, lambda acc: F.struct(acc["matched"].alias("matched"), acc["pairs"].alias("pairs")))


def soft_jaccard(a: Column, b: Column, match: Column) -> Column:
    """match: greedy_match of a and b by token_pair."""
    score = match["matched"] / (F.size(a) + F.size(b) - match["pairs"]) * 100
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(100.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(score)


def match_tokens(a: Column, b: Column) -> Column:
    return greedy_match(a, b, token_pair, lambda x: F.lit(1.0), 75.0)


def chunk_weight(x: Column) -> Column:
    return F.least(F.greatest(F.length(x), F.lit(1)), F.lit(10)).cast("double")


def match_numbers(a: Column, b: Column) -> Column:
    return greedy_match(a, b, numeric_chunk, chunk_weight, 50.0)


def numeric_weighted(query: Column, other: Column, match: Column) -> Column:
    """Share of the query's digit weight that is matched. match: greedy_match of both by numeric_chunk."""
    total = F.aggregate(query, F.lit(0.0), lambda s, x: s + chunk_weight(x))
    return F.when((F.size(query) == 0) & (F.size(other) == 0), F.lit(100.0)).when((F.size(query) == 0) | (F.size(other) == 0), F.lit(0.0)).otherwise(match["matched"] / total * 100)


def combined(lev: Column, jac: Column, num: Column, shares: tuple[float, float, float]) -> Column:
    return round2(lev * shares[0] + jac * shares[1] + num * shares[2])


def near_tokens(a: Column, b: Column) -> Column:
    """How many of a's tokens have one in b that a token pair could count: equal, or banded edits of long ones."""

    def near(x: Column, y: Column) -> Column:
        close = F.levenshtein(x, y) <= F.floor(F.greatest(F.length(x), F.length(y)) * 0.25 + 1e-9)
        return (x == y) | ((F.least(F.length(x), F.length(y)) >= 4) & (F.abs(F.length(x) - F.length(y)) <= F.floor(F.greatest(F.length(x), F.length(y)) * 0.25 + 1e-9)) & close)

    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: near(x, y))))
