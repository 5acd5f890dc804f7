"""Operator 6, benchmark decontamination with SimHash windows and a multi-index Hamming search.

For each length that a benchmark item has, the windows of that many words in a document are
fingerprinted: 64 signs of the sum of their five-word shingles' bits.  Eight tables, one
for each byte of the fingerprint, hold the items under all byte values within RADIUS // 8 bits of
their own; two fingerprints within RADIUS agree so far in some byte, so none within it is missed.
Candidates are verified by the weighted Jaccard similarity of their shingles, THRESHOLD or more.

A similarity above 0 needs a common shingle, so fingerprints are only made for windows that hold a
shingle of an item of their length.  Weights are the shingle's count times its inverse document
frequency in the whole benchmark; a shingle that the item doesn't have counts as the rarest.
Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z folded.
An item with fewer words than a shingle is one shingle, sought as such.

The benchmark is a fixed list, read by the driver: at most ITEM_LIMIT items at a time, in blocks
against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm import wordhash
from twinledger.llm.stored import cut, small, wrapped

U = np.uint64
SHINGLE, THRESHOLD, RADIUS, ITEM_LIMIT = 5, 0.8, 15, 50_000
_TABLE = wordhash.byte_table(61, True)
_BITS = U(1) << np.arange(64, dtype=U)
_NEAR = [np.array([x ^ y for y in range(256) if y.bit_count() <= RADIUS // 8], dtype=np.int64) for x in range(256)]


def _signs(hashes: np.ndarray) -> np.ndarray:
    return np.where(wordhash.mix(hashes)[:, None] & _BITS, 1.0, -1.0)


def _print(sums: np.ndarray) -> np.ndarray:
    """64 sums in each row to a fingerprint."""
    return np.where(sums > 0, _BITS, U(0)).sum(axis=1, dtype=U)


@dataclass
class Items:
    """Benchmark items of one shingle length: those with fewer words than five go by themselves."""

    words: int
    ids: np.ndarray
    size: np.ndarray
    weight: dict[int, float]
    unseen: float
    bags: list[dict[int, int]]
    prints: np.ndarray
    known: np.ndarray
    holders: dict[int, list[int]]
    tables: list[dict[int, list[int]]]


def _bags(texts: list[str]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, shingle length, words, shingle hashes) of each text with words."""
    for row, to, buf, offs in wordhash.texts(pa.array(texts, pa.string())):
        found = wordhash.Words(buf, offs, _TABLE, wordhash.NOT_ALNUM)
        for d in range(to - row):
            a, b = found.first[d], found.first[d + 1]
            if k := int(min(SHINGLE, b - a)):
                yield row + d, k, int(b - a), found.runs(k, 62)[0][a : b - k + 1]


class Frequencies:
    """In how many items of the benchmark each shingle is, by shingle length."""

    def __init__(self) -> None:
        self.items: dict[int, int] = {}
        self.of: dict[int, dict[int, int]] = {}

    def add(self, texts: list[str]) -> None:
        for _, k, _, hashes in _bags(texts):
            self.items[k] = self.items.get(k, 0) + 1
            of = self.of.setdefault(k, {})
            for v in set(hashes.tolist()):
                of[v] = of.get(v, 0) + 1

    def weight(self, k: int, shingle: int | None) -> float:
        """Inverse document frequency; None, or a shingle that no item has, counts as the rarest."""
        return float(np.log1p(self.items[k] / self.of[k].get(shingle, 1)))


def prepare(ids: list[int], texts: list[str], common: Frequencies | None = None) -> list[Items]:
    """Items of one block. common: frequencies over all blocks; without it, over these items."""
    if common is None:
        common = Frequencies()
        common.add(texts)
    by: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for row, k, words, hashes in _bags(texts):
        by.setdefault(k, []).append((ids[row], words, hashes))
    out = []
    for k, rows in by.items():
        bags = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)))) for _, _, h in rows]
        weight = {v: common.weight(k, v) for b in bags for v in b}
        prints = _print(np.stack([_signs(h).sum(axis=0) for _, _, h in rows]))
        tables: list[dict[int, list[int]]] = [{} for _ in range(8)]
        holders: dict[int, list[int]] = {}
        for i, p in enumerate(prints.tolist()):
            for t in range(8):
                for x in _NEAR[p >> (8 * t) & 255]:
                    tables[t].setdefault(int(x), []).append(i)
            for v in bags[i]:
                holders.setdefault(v, []).append(i)
        out.append(Items(k, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), weight, common.weight(k, None), bags, prints, np.sort(np.array(list(weight), dtype=U)), holders, tables))
    return out


def similarity(window: dict[int, int], item: dict[int, int], weight: dict[int, float], unseen: float) -> float:
    """Weighted Jaccard of two bags of shingles. weight: of the item's shingles; others weigh unseen."""
    low = sum(min(n, window[v]) * weight[v] for v, n in item.items() if v in window)
    high = sum(n * weight[v] for v, n in item.items()) + sum(n * (weight[v] if v in item else unseen) for v, n in window.items()) - low
    return low / high if high else 0.0


def _in_text(runs: np.ndarray, items: Items) -> list[tuple[int, int, float, int]]:
    """(item, first word, similarity, bits apart) of the best window for each item found in one text's shingles."""
    at = np.flatnonzero(items.known[np.minimum(np.searchsorted(items.known, runs), len(items.known) - 1)] == runs)
    if not len(at):
        return []
    lengths = {int(items.size[i]) for v in set(runs[at].tolist()) for i in items.holders[v]}
    best: dict[int, tuple[float, int, int]] = {}
    for n in lengths:
        m = n - items.words + 1
        if m > len(runs):
            m = len(runs)  # a text shorter than the item is one window
        of_size = [p for p in at.tolist() if any(items.size[i] == n for i in items.holders[int(runs[p])])]
        cover = np.zeros(len(runs) + 1, dtype=np.int64)
        for p in of_size:
            cover[max(0, p - m + 1)] += 1
            cover[min(p, len(runs) - m) + 1] -= 1
        starts = np.flatnonzero(np.cumsum(cover)[: len(runs) - m + 1] > 0)
        for block in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for lo in range(0, len(block), 4096):
                part = block[lo : lo + 4096]
                here = runs[part[0] : part[-1] + m]
                run = np.vstack([np.zeros(64), np.cumsum(_signs(here), axis=0)])
                prints = _print(run[m:] - run[:-m])
                for s, p in zip(part.tolist(), prints.tolist()):
                    for i in {i for t in range(8) for i in items.tables[t].get(p >> (8 * t) & 255, ())}:
                        if items.size[i] != n or (apart := (p ^ int(items.prints[i])).bit_count()) > RADIUS:
                            continue
                        values, counts = np.unique(runs[s : s + m], return_counts=True)
                        like = similarity(dict(zip(values.tolist(), counts.tolist())), items.bags[i], items.weight, items.unseen)
                        if like >= THRESHOLD and (like, -s) > (best.get(i, (0.0, 0, 0))[0], -best.get(i, (0.0, 0, 0))[1]):
                            best[i] = (like, s, apart)
    return [(int(items.ids[i]), s, like, apart) for i, (like, s, apart) in best.items()]


def _search(kinds: list[Items]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found_rows = [], []
            for row, to, buf, offs in wordhash.texts(batch.column("text")):
                found = wordhash.Words(buf, offs, _TABLE, wordhash.NOT_ALNUM)
                for items in kinds:
                    runs, left = found.runs(items.words, 62)
                    hit = (items.known[np.minimum(np.searchsorted(items.known, runs), len(items.known) - 1)] == runs) & (left >= items.words)
                    for d in np.unique(np.searchsorted(found.first, np.flatnonzero(hit), "right") - 1):
                        own = runs[found.first[d] : found.first[d + 1] - items.words + 1]
                        for x in _in_text(own, items):
                            rows.append(row + int(d))
                            found_rows.append(x)
            item, start, like, apart = zip(*found_rows) if found_rows else ((), (), (), ())
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(like, pa.float64()), pa.array(apart, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "similarity", "bits_apart"])

    return run


def _listed(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of ITEM_LIMIT items at a time."""
    ids, texts = [], []
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == ITEM_LIMIT:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, similarity, bits_apart): for each row of docs and each item that it
    holds, the best window, of equal ones the first.

    Null and empty texts hold nothing, and items without words are nowhere.  A repeated row is found
    again; repeated items are found under each id.  Other columns of either table are ignored.  Weights
    come from the whole benchmark, whatever block an item is in.
    """
    common = Frequencies()
    for _, texts in _listed(benchmark):
        common.add(texts)
    out = None
    for ids, texts in _listed(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_search(prepare(ids, texts, common)), "doc_id long, item_id long, start_word long, similarity double, bits_apart int")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.select("doc_id", *(F.lit(0).cast(t).alias(c) for c, t in (("item_id", "long"), ("start_word", "long"), ("similarity", "double"), ("bits_apart", "int")))).where("false")
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item. Rows without a doc_id are judged by their text's hash."""
    keyed = wrapped(docs, "text", F.xxhash64("doc_id", "text").alias("key"))
    found = contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), benchmark)
    gone = small(cut(found.select(F.col("doc_id").alias("key")).distinct()))
    return keyed.join(gone, "key", "left_anti").select("row.*")
