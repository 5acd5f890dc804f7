"""Operator 5, toxicity by a subsequence string kernel, a linear SVM and Nystroem landmarks.

The kernel of two strings sums over all common subsequences of ORDER characters, each weighted by
DECAY to the power of the length that it spans in either string; so a gap or an inserted character
costs a factor, not the match.  Strings are the words of a sentence, and runs of spelt-out letters.

A label says only that some word of some sentence is toxic.  Of the words that toxic training
documents have and others hardly, a greedy cover takes those that explain most documents still
unexplained; these and the words of SURE such documents that aren't near copies are the witnesses.  Witnesses against words of clean documents train the SVM on Nystroem
features, the kernel values with the landmarks (witnesses and clean words) times the inverse square
root of the landmarks' own kernel matrix; the clean words that score highest are added once, and it
is trained again.

A weighted sum of kernel values with fixed landmarks is one inner product with the sum of the
landmarks' subsequence vectors.  So the trained machine is a table of a weight for each
subsequence, and a word costs the number of its subsequences, with the same result.

A document's score is a logistic function, fitted on training documents, of its highest word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinledger.llm import wordhash
from twinledger.llm.stored import cut

ORDER, DECAY = 3, 0.6
#: Characters of a string; a longer word is scored in overlapping pieces.
LONGEST = 16
#: Bounds of what is learnt from: labelled documents (by least hash of doc_id), clean words, landmarks of either kind.
SAMPLE_DOCS, CLEAN_WORDS, LANDMARKS = 6_000, 20_000, 160
#: Toxic documents that make a word a witness by themselves, where clean ones hardly have it.
SURE = 6
#: Words whose subsequence vectors are held at once in training.
_BLOCK = 128
_FOLD = wordhash.byte_table(51, True)
#: Characters of the kernel: letters, bytes beyond ASCII in four classes, digits; 0 only takes room.
_CODE = np.zeros(256, dtype=np.int64)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 4
_CODE[48:58] = 31


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(length), ORDER)), dtype=np.int64).reshape(-1, ORDER)
    return places, (DECAY ** (places[:, -1] - places[:, 0] + 1)).astype(np.float64) if len(places) else np.zeros(0)


_PLACES = [_triples(n) for n in range(LONGEST + 1)]


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence, weight) matrices of strings of one length, a row each; those with a 0 weigh nothing."""
    places, weights = _PLACES[codes.shape[1]]
    parts = codes[:, places]
    name = (parts[:, :, 0] << 10) | (parts[:, :, 1] << 5) | parts[:, :, 2]
    return name, np.where((parts > 0).all(axis=2), weights, 0.0)


def _norms(name: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lengths of the strings' own vectors; a subsequence that stands in several places counts with their sum."""
    if not name.shape[1]:
        return np.zeros(len(name))
    order = np.argsort(name, axis=1, kind="stable")
    name, weight = np.take_along_axis(name, order, axis=1), np.take_along_axis(weight, order, axis=1)
    run = np.cumsum(weight, axis=1)
    last = np.ones(name.shape, dtype=bool)
    last[:, :-1] = name[:, 1:] != name[:, :-1]
    upto = np.where(last, run, 0.0)
    before = np.maximum.accumulate(upto, axis=1)
    each = np.where(last, run - np.concatenate([np.zeros((len(name), 1)), before[:, :-1]], axis=1), 0.0)
    return np.sqrt((each**2).sum(axis=1))


def _codes(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the rows and the codes of words of at most LONGEST bytes."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(min(len(w), LONGEST), []).append(i)
    return {n: (np.array(rows), np.stack([_CODE[np.frombuffer(words[i][:n], np.uint8)] for i in rows])) for n, rows in by.items() if n}


def vectors(words: list[bytes]) -> np.ndarray:
    """Normed subsequence vectors, a row for each word."""
    out = np.zeros((len(words), 1 << 15))
    for n, (rows, codes) in _codes(words).items():
        name, weight = _features(codes)
        np.add.at(out, (rows[:, None], name), weight)
    length = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1.0)


@dataclass
class Machine:
    """table: a weight for each subsequence; bias; slope and shift of the logistic function."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def words(self, codes: np.ndarray) -> np.ndarray:
        """Values of strings of one length."""
        out = np.full(len(codes), self.bias)
        step = max(1, 2_000_000 // max(1, len(_PLACES[codes.shape[1]][0])))
        for lo in range(0, len(codes), step):
            name, weight = _features(codes[lo : lo + step])
            norm = _norms(name, weight)
            out[lo : lo + step] += (self.table[name] * weight).sum(axis=1) / np.where(norm > 0, norm, 1.0)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 2_000.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, both classes weighing alike; by Newton steps on the rows inside the margin."""
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * cost
    data = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.append(np.ones(x.shape[1]), 1e-3))
    w = np.zeros(data.shape[1])
    for _ in range(rounds):
        inside = y * (data @ w) < 1
        rows, c = data[inside], weight[inside]
        new = np.linalg.solve(ridge + (rows * c[:, None]).T @ rows, rows.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def fit(witnesses: list[bytes], clean: list[bytes]) -> Machine:
    """The machine without its logistic function, from toxic and clean words."""
    wits = witnesses[:LANDMARKS]
    landmarks = vectors(wits + clean[:LANDMARKS])
    values, basis = np.linalg.eigh(landmarks @ landmarks.T)
    good = values > 1e-8
    root = basis[:, good] / np.sqrt(values[good])  # Nystroem: features are kernel values times root

    def train(negatives: list[bytes]) -> Machine:
        words, project = witnesses + negatives, landmarks.T @ root
        # 32,768 numbers a word: in blocks, so that the driver holds few of them at once
        rows = np.vstack([vectors(words[i : i + _BLOCK]) @ project for i in range(0, len(words), _BLOCK)])
        y = np.append(np.ones(len(witnesses)), -np.ones(len(negatives)))
        w, bias = _svm(rows, y)
        return Machine(landmarks.T @ (root @ w), bias, 1.0, 0.0)

    first = train(clean[:1500])
    value = np.full(len(clean), -np.inf)
    for _, (rows, codes) in _codes(clean).items():
        value[rows] = first.words(codes)
    hard = [clean[i] for i in np.argsort(-value, kind="stable")[:500]]
    return train(clean[:1000] + hard)


def _strings(found: wordhash.Words) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each string of a text: words in pieces of LONGEST bytes, and runs of single letters."""
    start, end = found.start, found.end
    size = end - start
    long = np.flatnonzero(size > LONGEST)
    pieces = [(start[size <= LONGEST], end[size <= LONGEST])]
    if len(long):
        half = LONGEST // 2
        n = -(-(size[long] - LONGEST) // half) + 1
        which = np.repeat(long, n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        s = start[which] + step * half
        pieces.append((s, np.minimum(s + LONGEST, end[which])))
    single = (size == 1) & (_CODE[found.buf[start]] > 0) if len(start) else np.zeros(0, bool)
    if single.sum() >= ORDER:
        near = np.zeros(len(start), dtype=bool)
        near[1:] = single[1:] & single[:-1] & (start[1:] - end[:-1] == 1)
        near[np.intersect1d(found.first, np.arange(len(start)))] = False
        head = np.flatnonzero(single & ~near)
        for a in head:
            b = a
            while b + 1 < len(start) and near[b + 1]:
                b += 1
            if b - a + 1 >= ORDER:
                last = max(a, b - LONGEST // 2 + 1)
                for lo in [*range(a, last, LONGEST // 4), last]:
                    hi = min(b, lo + LONGEST // 2 - 1)
                    pieces.append((start[lo : lo + 1], end[hi : hi + 1]))
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])


def highest(column: pa.Array, machine: Machine) -> np.ndarray:
    """The value of each text's highest string; bias for a text without one. Equal words are scored once a batch."""
    out = np.full(len(column), machine.bias)
    known = np.zeros(0, dtype=np.uint64), np.zeros(0)
    for row, to, buf, offs in wordhash.texts(column):
        found = wordhash.Words(buf, offs, _FOLD)
        if not len(found.hash):
            continue
        start, end = _strings(found)
        same = len(start) == len(found.start)
        hashes = found.hash if same else _hash_strings(buf, start, end)
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(known[0], values), max(0, len(known[0]) - 1))
        have = known[0][place] == values if len(known[0]) else np.zeros(len(values), bool)
        score = np.where(have, known[1][place], machine.bias) if len(known[0]) else np.full(len(values), machine.bias)
        s, size = start[first], end[first] - start[first]
        for n in np.unique(size[~have]):
            rows = np.flatnonzero(~have & (size == n))
            score[rows] = machine.words(_CODE[buf[s[rows][:, None] + np.arange(n)]])
        order = np.argsort(np.append(known[0], values[~have]), kind="stable")
        known = np.append(known[0], values[~have])[order], np.append(known[1], score[~have])[order]
        doc = np.searchsorted(offs, start, "right") - 1
        best = np.full(to - row, machine.bias)
        np.maximum.at(best, doc, score[inverse])
        out[row:to] = np.maximum(out[row:to], best)
    return out


def _hash_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, A-Z folded, of at most LONGEST bytes each."""
    out = (end - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(wordhash.seeded(LONGEST, 52)):
            at = start + j
            inside = at < end
            out += np.where(inside, _FOLD[buf[np.minimum(at, len(buf) - 1)]] * c, np.uint64(0))
    return wordhash.mix(out)


def _values(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(highest(batch.column("text"), machine))], [*names, "value"])

    return run


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _pieces(word: bytes) -> list[bytes]:
    """The strings of a word, as a text's words are cut: overlapping pieces of LONGEST bytes."""
    half = LONGEST // 2
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - half, half)]


def _cover(sets: list[frozenset[str]], counts: dict[str, tuple[int, int]]) -> list[str]:
    """Words that explain most sets, in turn; each explains three sets more at least than clean documents have it."""
    left, out = [s for s in sets if s], []
    while left and len(out) < 2 * LANDMARKS:
        n: dict[str, int] = {}
        for s in left:
            for w in s:
                n[w] = n.get(w, 0) + 1
        best = max(n, key=lambda w: (n[w] - 3 * counts[w][1], counts[w][0], w))
        if n[best] - 3 * counts[best][1] < 4:
            break
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine:
    """A machine from at most sample_docs labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_docs)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["text"]))
    word = F.lower(F.regexp_replace(F.col("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    listed = F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"))
    # near copies mostly agree in the least hash of their words, and count once
    family = sample.select("doc_id", "toxic", listed.alias("words")).withColumn("family", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    words = family.select("doc_id", "toxic", "family", F.explode("words").alias("word")).select("doc_id", "toxic", "family", word.alias("word")).where("length(word) >= 3").distinct()
    counts = cut(words.groupBy("word").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("family"))).alias("bad"), F.sum(1 - F.col("toxic")).alias("clean")))
    likely = counts.where("bad >= 4 and bad >= 20 * clean")
    held = {r[0]: (r[1], r[2]) for r in likely.collect()}
    sets: dict[int, set[str]] = {}
    for doc, w in words.where("toxic = 1").join(F.broadcast(likely.select("word")), "word").select("doc_id", "word").collect():
        sets.setdefault(doc, set()).add(w)
    covering = _cover([frozenset(sets[d]) for d in sorted(sets)], held)
    often = sorted((w for w, (bad, _) in held.items() if bad >= SURE and w not in covering), key=lambda w: (-held[w][0], w))
    witnesses = [p for w in (covering + often)[: 2 * LANDMARKS] for p in _pieces(w.encode())]
    clean = [p for r in counts.where("clean > 0").orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).select("word").collect() for p in _pieces(r[0].encode())]
    if not witnesses or not clean:
        return Machine(np.zeros(1 << 15), -1.0, 1.0, 0.0)
    machine = fit(witnesses, clean)
    found = sample.select("toxic", "text").mapInArrow(_values(machine), "toxic int, value double").collect()
    value, y = np.array([r[1] for r in found]), np.array([r[0] for r in found], dtype=float)
    return _logistic(machine, value, y)


def _logistic(machine: Machine, value: np.ndarray, y: np.ndarray) -> Machine:
    """Slope and shift by ridge Newton steps, both classes weighing alike."""
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    x, w = np.stack([value, np.ones(len(value))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-4 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), grad)
    return Machine(machine.table, machine.bias, float(max(w[0], 0.0)), float(w[1]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text; others are ignored).

    Null and empty texts score as a text without strings.  A row is scored by its text alone, so
    repeated rows score alike; a null doc_id is held out or not as the empty string is.
    """
    valued = docs.select("doc_id", "text").mapInArrow(_values(machine), "doc_id long, value double")
    z = F.lit(machine.slope) * F.col("value") + F.lit(machine.shift)
    probability = 1 / (1 + F.exp(-z))
    return valued.select("doc_id", held_out().alias("held_out"), probability.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
