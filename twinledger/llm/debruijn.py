"""Operator 10, substring dedup by De Bruijn compaction of repeated token k-mers.

An edge is a window of `width` words, from the node of its first width - 1 words to that of its
last.  Only edges that occur more than once matter, and few do, so they are sought in steps.
Each window has a seed, the least hash among its runs of `seed` words; equal windows have equal
seeds, and neighbouring windows mostly the same one, so the seeds are a small part of the windows.
Seeds travel as packed entries with their document; documents join the seeds of theirs that occur
more than once.  Consecutive windows of one such seed are a stretch, a path of at most `width` edges.

Stretches meet by their seed.  Equal ones, by a 128-bit hash of all their words, are one path: the
first in (document, position) is the source, the others are repeats.  Where all stretches of a seed
are equal and none holds an edge twice, the path has no branch, and its edges need no comparison.
Else the path may branch, and each edge of the first of equal stretches meets those of the others,
by a 96-bit hash.  Any division into stretches gives the same repeats.

A batch settles its own repeats and sends only the first of each stretch, so a passage in a third of
all documents costs a few rows for each batch.  A repeat keeps its source coordinates.  Where the next
stretch's source is what follows in the same source, the two are on one nonbranching path:
such paths are compacted to spans, in the batch where it can be seen and then by a window over each
document, and the spans join the documents whose words they remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm import wordhash
from twinledger.llm.stored import BROADCAST_ROWS, cut, from_planes, planes

U = np.uint64
SEED = 6
_TABLE = wordhash.byte_table(31, False)


def _order(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, which orders rows that share a doc_id, and the text. Null doc_ids come first."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("crc"), "text")


def _seeds(found: wordhash.Words, width: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each start of a whole window its word and the hash of its seed; and where seeds are: word and hash."""
    runs, left = found.runs(SEED, 32)
    start = np.flatnonzero(left >= width)
    least = runs.copy()
    reach, span = 1, width - SEED + 1
    while reach < span:  # least[i]: of runs[i : i + reach]
        step = min(reach, span - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    most = np.zeros_like(least)
    most[start] = least[start]
    reach = 1
    while reach < span:  # most[i]: the greatest seed of the windows that have runs[i]
        step = min(reach, span - reach)
        most[step:] = np.maximum(most[step:], most[:-step])
        reach += step
    places = np.flatnonzero((most == runs) & (most > 0))
    return start, least[start], (places, runs[places])


#: Entries of one bucket of seeds.
BUCKET_ENTRIES = 1_000_000


def _low(seed: np.ndarray) -> np.ndarray:
    """Half of a seed, by which a row names it; one that another seed shares only adds stretches."""
    return (seed >> U(32)).astype(np.uint32)


def _seed_entries(width: int, buckets: int, owner_bytes: int):
    """Packed (low half of the seed, owner) for each bucket of seeds; a document gives each of its seeds once."""
    mask = U((1 << 8 * owner_bytes) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("owner").to_numpy().view(U) & mask
            for row, to, buf, offs in wordhash.texts(batch.column("text")):
                found = wordhash.Words(buf, offs, _TABLE)
                _, _, (at, seed) = _seeds(found, width)
                owner = names[row + np.searchsorted(found.first, at, "right") - 1]
                bucket = (seed & U(0xFFFFFFFF)) % U(buckets)
                order = np.lexsort((owner, seed, bucket))
                bucket, seed, owner = bucket[order], seed[order], owner[order]
                new = np.ones(len(seed), bool)
                new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
                # a seed that one document has twice counts as two
                twice = np.zeros(len(seed), bool)
                twice[:-1] = new[:-1] & ~new[1:]
                keep = new | np.concatenate([[False], twice[:-1]])
                bucket, seed, owner = bucket[keep], seed[keep], owner[keep]
                ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
                full = np.flatnonzero(np.diff(ends))
                blocks = [planes(_low(seed[ends[b] : ends[b + 1]]).astype(U), 4) for b in full], [planes(owner[ends[b] : ends[b + 1]], owner_bytes) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in blocks)], ["bucket", "seeds", "owners"])

    return run


def _repeated_seeds(owner_bytes: int):
    """(owner, seed) of the entries of one bucket whose seed has another one."""

    def pick(table: pa.Table) -> pa.Table:
        joined = lambda name, width: np.concatenate([from_planes(np.frombuffer(x.as_buffer(), np.uint8), width) for x in table.column(name)])
        seed, owner = joined("seeds", 4), joined("owners", owner_bytes)
        order = np.lexsort((owner, seed))
        seed, owner = seed[order], owner[order]
        again = np.zeros(len(seed), bool)
        again[1:] = seed[1:] == seed[:-1]
        again[:-1] |= again[1:]
        again[1:] &= (owner[1:] != owner[:-1]) | (seed[1:] != seed[:-1])
        return pa.table({"owner": pa.array(owner[again].view(np.int64)), "seed": pa.array(seed[again].astype(np.uint32).view(np.int32))})

    return pick


def _named(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, crc and text of the documents that hold repeated seeds, with the low halves of these."""
    own = _order(docs).withColumn("owner", F.xxhash64("doc_id", "crc"))
    count, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    owner_bytes = min(8, (max(1, count).bit_length() + 21) // 8)
    buckets = max(1, (size or 0) // 40 // BUCKET_ENTRIES)
    entries = own.select("owner", "text").mapInArrow(_seed_entries(width, buckets, owner_bytes), "bucket int, seeds binary, owners binary")
    found = entries.groupBy("bucket").applyInArrow(_repeated_seeds(owner_bytes), "owner long, seed int")
    named = found.groupBy("owner").agg(F.collect_list("seed").alias("seeds"))
    mask = (1 << 8 * owner_bytes) - 1 if owner_bytes < 8 else -1
    return own.withColumn("owner", F.col("owner").bitwiseAND(F.lit(mask))).join(named, "owner").select("doc_id", "crc", "text", "seeds")


def _stretches(width: int):
    """Stretches of the seeds that a row names: the first of equal ones with the hashes of its windows, and spans
    of those repeated here."""

    def of_row(d: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return wordhash.mix(seed.astype(U) ^ (d.astype(U) << U(32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, crcs = batch.column("doc_id"), batch.column("crc").to_numpy()
            ids = docs.fill_null(0).to_numpy(zero_copy_only=False)
            null = np.asarray(docs.is_null())
            named = batch.column("seeds")
            d = np.repeat(np.arange(len(named)), named.value_lengths().fill_null(0).to_numpy())
            known = np.sort(of_row(d, named.flatten().to_numpy().view(np.uint32)))
            parts, held = [], 0
            for row, to, buf, offs in wordhash.texts(batch.column("text")):
                found = wordhash.Words(buf, offs, _TABLE)
                start, seed, _ = _seeds(found, width)
                if not len(start) or not len(known):
                    continue
                d = np.searchsorted(found.first, start, "right") - 1
                sought = of_row(row + d, _low(seed))
                hit = known[np.minimum(np.searchsorted(known, sought), len(known) - 1)] == sought
                start, d, seed = start[hit], d[hit], seed[hit]
                one, _ = found.runs(width, 33)
                two, _ = found.runs(width, 34)
                parts.append((row + d, start - found.first[d], seed, one[start], two[start]))
                held += len(start)
                if held >= _SETTLED:
                    yield from settle(docs, crcs, ids, null, parts)
                    parts, held = [], 0
            if parts:
                yield from settle(docs, crcs, ids, null, parts)

    def settle(docs, crcs, ids, null, parts) -> Iterator[pa.RecordBatch]:
        d, pos, seed, one, two = (np.concatenate(x) for x in zip(*parts))
        if not len(d):
            return
        head, n = _runs(d, pos, seed, width)
        end = head + n - 1
        first, last = (wordhash.mix(x[head] ^ wordhash.mix(x[end] + n.astype(U))) for x in (one, two))
        packed = np.zeros(len(d), np.dtype([("one", "<u8"), ("two", "<u4")]))
        packed["one"], packed["two"] = one, (two >> U(32)).astype(np.uint32)
        d, pos = d[head], pos[head]
        order = np.lexsort((pos, crcs[d], ids[d], ~null[d], last, first))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (first[order][1:] != first[order][:-1]) | (last[order][1:] != last[order][:-1])
        group = np.empty_like(order)  # of each stretch, the first that is equal to it
        group[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        new = np.sort(order[fresh])
        same = (ids[d] == ids[d[group]]) & (null[d] == null[d[group]]) & (crcs[d] == crcs[d[group]]) & (pos == pos[group])
        # a stretch that holds an edge twice has a branch of its own
        whole = np.lexsort((one, np.repeat(np.arange(len(head)), n)))
        near = one[whole][1:] == one[whole][:-1]
        of = np.repeat(np.arange(len(head)), n)[whole]
        own = np.zeros(len(head), bool)
        own[of[1:][near & (of[1:] == of[:-1])]] = True
        yield _rows(docs, crcs, d[new], pos[new], n[new], first[new], last[new], _binary(packed, head[new], n[new]), None, None, seed[head[new]], own[new])
        # compaction of what is settled here: neighbours with neighbouring sources
        x = np.flatnonzero(~same)
        g = group[x]
        on = np.zeros(len(x), bool)
        on[1:] = (d[x][1:] == d[x][:-1]) & (pos[x][1:] == (pos + n)[x][:-1]) & (d[g][1:] == d[g][:-1]) & (pos[g][1:] == (pos + n)[g][:-1])
        path = np.flatnonzero(~on)
        size = np.add.reduceat(n[x], path) if len(x) else n[x]
        x, g = x[path], g[path]
        yield _rows(docs, crcs, d[x], pos[x], size, None, None, None, d[g], pos[g], None, None)

    return run


def _runs(d: np.ndarray, pos: np.ndarray, seed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch: consecutive windows of one seed, at most `width` of them."""
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (pos[1:] != pos[:-1] + 1) | (seed[1:] != seed[:-1])
    at = np.flatnonzero(new)
    along = np.arange(len(d)) - np.repeat(at, np.diff(np.append(at, len(d))))
    head = np.flatnonzero(along % width == 0)
    return head, np.diff(np.append(head, len(d)))


def _binary(packed: np.ndarray, head: np.ndarray, n: np.ndarray) -> pa.Array:
    """packed[h : h + k] for each h of head and k of n, as binary values."""
    ends = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(ends[-1]) - np.repeat(ends[:-1] - head, n)
    offsets = (ends * packed.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed[index].tobytes())])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches: those with windows become a row for each window, the others, spans, stay as they are."""
    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "crc", "pos", "n", "src_id", "src_pos")]
        held = np.asarray(batch.column("windows").is_valid())
        spans = [c.filter(pa.array(~held)) for c in columns]
        nothing = pa.nulls(len(spans[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([*spans[:4], nothing, nothing, *spans[4:]], _EXPANDED)
        packed = batch.column("windows").filter(pa.array(held))
        each = np.frombuffer(b"".join(packed.to_pylist()), np.dtype([("one", "<u8"), ("two", "<u4")]))
        at = np.flatnonzero(held)
        n = columns[3].to_numpy()[at]
        row = np.repeat(at, n)
        pos = columns[2].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        for i in range(0, len(row), _OUT):
            part = slice(i, i + _OUT)
            take, w = pa.array(row[part]), each[part]
            none = pa.nulls(len(take), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [columns[0].take(take), columns[1].take(take), pa.array(pos[part].astype(np.int32)), pa.array(np.ones(len(take), np.int64)), wordhash.signed(w["one"]), pa.array(w["two"].astype(np.int64)), none, none.cast(pa.int32())], _EXPANDED
            )


#: Windows that are settled together, and rows in one batch of windows: they bound a task's memory.
_SETTLED = 400_000
_OUT = 50_000
_EXPANDED = ["doc_id", "crc", "pos", "n", "one", "two", "src_id", "src_pos"]
_ROW = "doc_id long, crc long, pos int, n long, one long, two long, src_id long, src_pos int"


def _rows(docs: pa.Array, crcs: np.ndarray, d, pos, n, one, two, windows, src, src_pos, seed, loops) -> pa.RecordBatch:
    def longs(x):
        return pa.nulls(len(d), pa.int64()) if x is None else wordhash.signed(x)

    source = pa.nulls(len(d), pa.int64()) if src is None else docs.take(pa.array(src))
    at = pa.nulls(len(d), pa.int32()) if src is None else pa.array(src_pos.astype(np.int32))
    windows = pa.nulls(len(d), pa.binary()) if windows is None else windows
    columns = [docs.take(pa.array(d)), pa.array(crcs[d]), pa.array(pos.astype(np.int32)), pa.array(n), longs(one), longs(two), source, at, windows, longs(seed), pa.nulls(len(d), pa.bool_()) if loops is None else pa.array(loops)]
    return pa.RecordBatch.from_arrays(columns, [*_EXPANDED, "windows", "seed", "loops"])


def _sourced(found: DataFrame, *keys: str) -> DataFrame:
    """found with the place where the same keys come first as source, null for that place itself.

    Spans that are settled have no hash (two is null) and keep their source.
    """
    first = Window.partitionBy(*keys).orderBy("doc_id", "crc", "pos")
    met = found.withColumn("source", F.first(F.struct("doc_id", "crc", "pos")).over(first))
    own = F.col("source.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("source.crc") == F.col("crc")) & (F.col("source.pos") == F.col("pos"))
    src = {c: F.when(F.col("two").isNull(), F.col(c)).when(~own, F.col(f"source.{f}")) for c, f in (("src_id", "doc_id"), ("src_pos", "pos"))}
    return met.withColumns(src).drop("source")


def repeated_spans(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, crc, pos, n, src_id, src_pos): n consecutive repeated windows from word pos on, and where
    their words stood first. crc is a hash of the text, should rows share a doc_id."""
    # a span that is settled is dealt out by a hash of its own
    dealt = lambda c: F.coalesce(c, F.xxhash64("doc_id", "crc", "pos")).alias("key")
    found = _named(docs, width).mapInArrow(_stretches(width), f"{_ROW}, windows binary, seed long, loops boolean")
    met = found.select(dealt(F.col("seed")), *_EXPANDED, "windows", "loops")
    branch = F.col("loops") | (F.min("one").over(Window.partitionBy("key")) != F.max("one").over(Window.partitionBy("key"))) | (F.min("two").over(Window.partitionBy("key")) != F.max("two").over(Window.partitionBy("key")))
    stretches = _sourced(met.withColumn("branch", branch), "key", "one", "two").withColumn("windows", F.when(F.col("src_pos").isNull() & F.col("branch"), F.col("windows")))
    edges = stretches.where("src_pos is not null or windows is not null").select(*_EXPANDED, "windows").mapInArrow(_expand, _ROW)
    repeats = _sourced(edges.select(dealt(F.col("one")), *_EXPANDED), "key", "two").where("src_pos is not null")
    along = Window.partitionBy("doc_id", "crc").orderBy("pos", "n")
    last = F.lag(F.struct((F.col("pos") + F.col("n")).alias("pos"), "src_id", (F.col("src_pos") + F.col("n")).alias("src_pos"))).over(along)
    joins = F.coalesce((last["pos"] == F.col("pos")) & last["src_id"].eqNullSafe(F.col("src_id")) & (last["src_pos"] == F.col("src_pos")), F.lit(False))
    path = repeats.withColumn("joins", joins)
    path = path.withColumn("path", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return path.groupBy("doc_id", "crc", "path").agg(F.min("pos").alias("pos"), F.sum("n").alias("n"), F.min_by("src_id", "pos").alias("src_id"), F.min("src_pos").alias("src_pos")).drop("path")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 500):
            batch = whole.slice(i, 500)
            spans, n, gone, sha, kept = batch.column("spans").to_pylist(), [], [], [], []
            for text, cover in zip(batch.column("text").to_pylist(), spans):
                words = (text or "").encode().split()
                n.append(len(words))
                for s in sorted(cover or (), key=lambda s: s["pos"], reverse=True):
                    del words[s["pos"] : s["end"]]
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])


def covers(spans: DataFrame, width: int = 20) -> DataFrame:
    """(of, of_crc, spans): for each document the words, from pos up to end, that spans of windows cover.

    Spans that overlap or meet are one, whatever their sources.  A window over each document, as
    repeated_spans ends with, so there is no further shuffle.
    """
    along = Window.partitionBy("doc_id", "crc").orderBy("pos", "n").rowsBetween(Window.unboundedPreceding, -1)
    here = spans.select("doc_id", "crc", "pos", "n", (F.col("pos") + F.col("n") + width - 1).alias("end"))
    here = here.withColumn("apart", F.when(F.col("pos") <= F.max("end").over(along), 0).otherwise(1))
    here = here.withColumn("part", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    each = here.groupBy("doc_id", "crc", "part").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    return each.groupBy(F.col("doc_id").alias("of"), F.col("crc").alias("of_crc")).agg(F.collect_list(F.struct("pos", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text) for each row of docs (doc_id, text; others are ignored).

    Every word that a window of `width` words covers is removed if the same words also start
    earlier: in a smaller doc_id (null is smallest), or earlier in the document.  Null and empty
    texts have no words.  A row that repeats both doc_id and text stands at the same place as the
    other and gets the same result; rows that share only a doc_id follow in the order of a hash of their texts.
    """
    spans = cut(covers(repeated_spans(docs, width), width))
    if (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    own = _order(docs)
    both = own.join(spans, own.doc_id.eqNullSafe(spans["of"]) & (own.crc == spans["of_crc"]), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
