"""Operator 9, quality rules as a learned decision list. DataFrame functions only on the data.

Statistics of whole texts are Spark expressions.  A bounded sample of labelled rows (sample_rows,
those with the least hash of doc_id) comes to the driver as numbers, and sequential covering learns
rules for label 0 there: a rule grows threshold by threshold on two thirds of the sample, loses its
last thresholds while that helps on the other third, and stays if it is precise enough on it; the
rows that it covers go, and the next rule is sought.  The rules become one ordered Spark CASE.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.llm.stored import unwrapped, wrapped

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "n_words")
STATISTICS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for the row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window which the text has at least twice."""

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = _let(placed, lambda s: F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        steps = _let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and the list's features.

    Columns of docs with one of these names are replaced; any others stay, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counts = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated_words(w).alias("n_repeat_words")
        ),
    )
    dup_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = wrapped(docs, "text").select("row", counts.alias("words"), dup_lines.alias("lines"), symbols.cast("long").alias("n_symbols"), upper.alias("upper"))
    found = found.select("row", "words.*", "lines.*", "n_symbols", "upper")
    per = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    found = found.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "word_length": per("word_chars", "n_words"),
            "symbol_rate": per("n_symbols", "n_words"),
            "dup_line_rate": per("n_dup_lines", "n_lines"),
            "repeat_rate": per("n_repeat_words", "n_words"),
            "upper_rate": per("upper", "word_chars"),
        }
    )
    return unwrapped(found, *STATISTICS)


def _score(rows: list[dict], rule: Rule) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _grow(rows: list[dict]) -> Rule:
    rule: Rule = ()
    while (bad := sum(r["bad"] for r in rows)) < len(rows) and len(rule) < 4:
        best, gain = None, 0.0
        base = math.log2(bad / len(rows))
        for f in FEATURES:
            values = sorted({r[f] for r in rows})
            at_most = range(1, len(values)) if len(values) <= 64 else sorted({max(1, i * len(values) // 64) for i in range(64)})
            for at in ((values[i - 1] + values[i]) / 2 for i in at_most):
                for above in (True, False):
                    c = Condition(f, above, at)
                    p, n = _score(rows, (c,))
                    if p and p + n < len(rows) and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule += (best,)
        rows = [r for r in rows if best.holds(r)]
    return rule


def learn(rows: list[dict], precision: float = 0.95, most_rules: int = 12) -> list[Rule]:
    """Ordered rules for bad rows. rows: the features, bad (0 or 1), and fold (0, 1: grow; 2: prune)."""
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = [r for r in rows if r["fold"] < 2], [r for r in rows if r["fold"] == 2]
        if not any(r["bad"] for r in grow):
            break
        rule = _grow(grow)
        worth = lambda x: (lambda p, n: (p - n) / (p + n) if p + n else -1)(*_score(prune, x))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = _score(prune, rule)
        if not rule or p < max(3, precision * (p + n)):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, precision: float = 0.95) -> list[Rule]:
    """Rules from at most sample_rows labelled documents; none without labels of both kinds."""
    known = labels.where("quality is not null").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = [r.asDict() for r in statistics(joined).select(*FEATURES, (1 - F.col("quality")).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), "doc_id").collect()]
    return learn(sorted(rows, key=lambda r: (r["doc_id"], *(r[f] for f in FEATURES))), precision)


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression: the first rule that holds rejects, and a text that none holds for is kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """docs with the statistics and kept. Null and empty texts have no words and fail the base rule; columns
    of docs that have the name of a statistic are replaced; each repeated row is judged by its own text."""
    rules = train(docs, labels, sample_rows)
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> DataFrame:
    """The rows of docs that judge keeps, with their own columns only."""
    return judge(wrapped(docs, "doc_id", "text"), labels, sample_rows).where("kept").select("row.*")
