"""Operator 3, main text of web pages: structure first, and a host suffix array for what it leaves open.

A page is cut into blocks at block-level tags.  Elements that hold no text to read (menus, footers,
forms, adverts, comments, by tag or by class, id and role) are chrome; article and main are the main
region.  Blocks outside the main region, and link-only blocks inside it, are in doubt.

The tokens of doubtful blocks of a host's pages are concatenated, a separator after each page, and
their suffixes sorted by prefix doubling.  A run of suffixes with RUN_TOKENS equal first tokens that
comes from pages of two bodies or more is boilerplate for link-only blocks, of MANY bodies for open
ones: its tokens are covered.  Pages of equal bodies count once.  A large host is dealt into
parts of about PART_TOKENS; what a part leaves uncovered is compared across the host's parts by the
hash of each RUN_TOKENS tokens, so nothing that two pages share is missed.

Text: main blocks but covered link-only ones; on a page without a main region, doubtful blocks that
are mostly uncovered, the unique runs of the page.  If covered blocks hold COPIED of a page's open
characters, the page is a near copy of others and not a frame around a text: all its open blocks stay.
"""

from __future__ import annotations

import html as html_text
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm import wordhash
from twinledger.llm.stored import cut, small

RUN_TOKENS, PART_TOKENS = 8, 200_000
MANY, COPIED = 3, 0.9
MAIN, OPEN, LINKS = 0, 1, 2

_SILENT = frozenset("script style noscript template svg math iframe object canvas head title select textarea audio video".split())
_CHROME = frozenset("nav footer aside form button menu dialog label fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side-?bar|footer|ads?|advert\w*|adverts?|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|popup|modal|overlay|share|sharing|social|related|recommend\w*"
    r"|comments?|replies|disqus|newsletter|subscribe|signup|breadcrumbs?|widget|toolbar|pagination|copyright|contentinfo|complementary|search)(?:$|[\s_-])",
    re.I,
)
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")


def blocks(html: str) -> tuple[list[tuple[int, str]], bool]:
    """Blocks (zone, text) in page order, without chrome, and whether the page has a main region.

    Chrome blocks are given with zone -1: their tokens are evidence for the host.
    """
    out: list[tuple[int, str]] = []
    has_main = False
    chrome: list[str] = []  # names of open elements from the outermost chrome element on
    main = links = 0
    parts: list[str] = []
    linked = total = 0
    at, n = 0, len(html)

    def close() -> None:
        nonlocal parts, linked, total
        if parts:
            text = _SPACE.sub(" ", html_text.unescape("".join(parts))).strip()
            if text:
                zone = -1 if chrome else (LINKS if total and linked >= 0.9 * total else MAIN) if main else OPEN
                out.append((zone, text))
        parts, linked, total = [], 0, 0

    while at < n:
        m = _PART.match(html, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<":
                parts.append(m[0])
                size = len(m[0].strip())
                total += size
                linked += size if links else 0
            elif m[0] == "<":
                parts.append("<")
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if m[1] else 1))
            if not chrome and not m[1] and name not in _VOID and "=" in m[3] and _is_named(m[3]):
                close()
                chrome.append(name)
            elif chrome and name == chrome[0]:
                _step(chrome, name, bool(m[1]), close)
            continue
        if name in _SILENT:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                if name not in ("script", "style", "svg", "math"):
                    parts.append(" ")
            continue
        close()
        links = 0
        if name in _VOID:
            continue
        if chrome:
            if name == chrome[0]:
                _step(chrome, name, bool(m[1]), close)
            continue
        if name in ("article", "main"):
            main = max(0, main + (-1 if m[1] else 1))
            has_main = True
        elif not m[1] and (name in _CHROME or (name == "header" and not main) or ("=" in m[3] and name not in ("html", "body") and _is_named(m[3]))):
            if not m[3].endswith("/"):
                chrome.append(name)
    close()
    return out, has_main


def _is_named(attributes: str) -> bool:
    return any(_NAMED.search(a or b or c) for a, b, c in _NAME.findall(attributes))


def _step(chrome: list[str], name: str, ends: bool, close) -> None:
    if not ends:
        chrome.append(name)
        return
    if len(chrome) == 1:
        close()
    chrome.pop()


_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PARSED = "page_id long, url string, row_key long, host string, has_main boolean, zones array<int>, texts array<string>, n_tokens long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            hosts, mains, zones, texts, tokens = [], [], [], [], []
            for url, source in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                found, has_main = blocks(source or "")
                m = _HOST.match(url or "")
                hosts.append(m[1].lower() if m else "")
                mains.append(has_main)
                zones.append([z for z, _ in found])
                texts.append([t for _, t in found])
                tokens.append(sum(t.count(" ") + 1 for z, t in found if z != MAIN))
            columns = [part.column("page_id"), part.column("url"), part.column("row_key"), pa.array(hosts), pa.array(mains), pa.array(zones, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "row_key", "host", "has_main", "zones", "texts", "n_tokens"])


def covered(tokens: np.ndarray, page: np.ndarray, run: int = RUN_TOKENS, body: np.ndarray | None = None, many: int = 2) -> np.ndarray:
    """Tokens inside a substring of `run` tokens that pages of `many` bodies have. page: of each token, ascending; body: of each token, by default the page."""
    out = np.zeros(len(tokens), dtype=bool)
    if len(tokens) < run:
        return out
    # a separator after each page, different from all else, so that no substring spans two pages
    ends = np.append(np.flatnonzero(page[1:] != page[:-1]) + 1, len(tokens))
    text = np.insert(np.unique(tokens, return_inverse=True)[1].astype(np.int64), ends, len(tokens) + np.arange(len(ends)))
    body = page if body is None else body
    owner = np.insert(body, ends, body[ends - 1])
    own = np.insert(np.arange(len(tokens)), ends, -1)
    rank, have = text, 1
    while have < run:  # rank by the first `have` tokens, doubled until `run`
        step = min(have, run - have)
        second = np.full(len(rank), -1, dtype=np.int64)
        second[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (2 * len(text) + 2) + second + 1, return_inverse=True)[1]
        have += step
    order = np.lexsort((owner, rank))  # the suffix array, as far as `run` tokens sort it
    other = np.append(True, rank[order][1:] != rank[order][:-1])
    first = np.flatnonzero(other)
    owners = np.add.reduceat((other | np.append(True, owner[order][1:] != owner[order][:-1])).astype(np.int64), first)
    shared = np.repeat(owners >= many, np.diff(np.append(first, len(order))))
    starts = own[order[shared]]
    starts = starts[starts >= 0]
    edge = np.zeros(len(tokens) + run + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[: len(tokens)] > 0


def _token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some blocks, and the block of each."""
    hashes, of = [], []
    for row, _, buf, offs in wordhash.texts(pa.array(texts, pa.string())):
        found = wordhash.Words(buf, offs, wordhash.byte_table(41, False))
        hashes.append(found.hash)
        of.append(row + np.searchsorted(found.first, np.arange(len(found.hash)), "right") - 1)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(of) if of else np.zeros(0, np.int64)


def _host_part(table: pa.Table) -> pa.Table:
    """Rows (host, row_key, at, text, open, body) of one part of a host to (host, row_key, at, covered)."""
    table = table.sort_by([("row_key", "ascending"), ("at", "ascending")])
    hashes, of = _token_hashes(table.column("text").to_pylist())
    keys = table.column("row_key").to_numpy()
    page = np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(keys) else keys
    body, open_ = table.column("body").to_numpy(), table.column("open").to_numpy()
    cover = covered(hashes, page[of], body=body[of])
    if open_.any():
        cover = np.where(open_[of], covered(hashes, page[of], body=body[of], many=MANY), cover)
    ends = np.searchsorted(of, np.arange(len(table) + 1))
    share = [bool(2 * cover[a:b].sum() >= b - a) for a, b in zip(ends, ends[1:])]
    return pa.table({"host": table.column("host"), "row_key": table.column("row_key"), "at": table.column("at"), "covered": pa.array(share, pa.bool_())})


_GRAM = "host string, row_key long, at int, size int, low int, high int, gram long, open boolean, body long"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's doubtful blocks (host, row_key, body, ats, texts, opens) to its runs: a row for each block that a
    run touches, with the block's tokens and the first and last that the run covers."""
    for batch in batches:
        rows: list[tuple] = []
        for h, k, body, ats, texts, opens in zip(*(batch.column(c).to_pylist() for c in ("host", "row_key", "body", "ats", "texts", "opens"))):
            hashes, of = _token_hashes(texts)
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            with np.errstate(over="ignore"):
                for i in range(len(hashes) - RUN_TOKENS + 1):
                    gram = int(wordhash.mix((hashes[i : i + RUN_TOKENS] * wordhash.seeded(RUN_TOKENS, 42)).sum(keepdims=True))[0].view(np.int64))
                    for b in range(of[i], of[i + RUN_TOKENS - 1] + 1):
                        rows.append((h, k, ats[b], int(ends[b + 1] - ends[b]), max(0, i - int(ends[b])), int(min(i + RUN_TOKENS, ends[b + 1]) - ends[b]) - 1, gram, opens[b], body))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 9, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "row_key", "at", "size", "low", "high", "gram", "open", "body"])


def boilerplate(parsed: DataFrame) -> DataFrame:
    """(row_key, at): doubtful blocks that are mostly covered by what the host's pages share."""
    body = F.xxhash64(F.transform(F.filter(F.arrays_zip("zones", "texts"), lambda b: b["zones"] >= 0), lambda b: b["texts"]))
    doubtful = parsed.where("n_tokens > 0").select("host", "row_key", "has_main", body.alias("body"), F.posexplode(F.arrays_zip("zones", "texts")).alias("at", "block"))
    doubtful = doubtful.where(f"block.zones <> {MAIN}").select("host", "row_key", "at", F.col("block.texts").alias("text"), F.expr(f"block.zones = {OPEN} and not has_main").alias("open"), "body")
    parts = parsed.groupBy("host").agg(F.ceil(F.sum("n_tokens") / PART_TOKENS).cast("int").alias("parts"))
    large = cut(parts.where("parts > 1"))
    dealt = doubtful.join(small(large), "host", "left").withColumn("part", F.pmod(F.xxhash64("row_key"), F.coalesce("parts", F.lit(1))))
    seen = dealt.groupBy("host", "part").applyInArrow(_host_part, "host string, row_key long, at int, covered boolean")
    found = seen.where("covered").select("row_key", "at")
    if large.isEmpty():
        return found.distinct()
    pages = doubtful.join(small(large), "host").groupBy("host", "row_key", "body").agg(F.array_sort(F.collect_list(F.struct("at", "text", "open"))).alias("all"))
    runs = pages.select("host", "row_key", "body", F.col("all.at").alias("ats"), F.col("all.text").alias("texts"), F.col("all.open").alias("opens")).mapInArrow(_grams, _GRAM)
    shared = runs.groupBy("host", "gram").agg(F.countDistinct("body").alias("bodies")).where("bodies > 1")
    tokens = runs.join(small(cut(shared)), ["host", "gram"]).where(f"not open or bodies >= {MANY}").select("row_key", "at", "size", F.explode(F.sequence("low", "high")).alias("token")).distinct()
    across = tokens.groupBy("row_key", "at", "size").agg(F.count("*").alias("n")).where("2 * n >= size").select("row_key", "at")
    return found.union(across).distinct()


def _texts(found: DataFrame, covers: DataFrame | None) -> DataFrame:
    at = F.lit(None).cast("array<int>") if covers is None else F.col("ats")
    both = found if covers is None else found.join(covers, "row_key", "left")
    all_ = F.transform(F.arrays_zip("zones", "texts"), lambda b, i: F.struct(b["zones"].alias("zone"), b["texts"].alias("text"), F.coalesce(F.array_contains(at, i), F.lit(False)).alias("covered")))
    size = lambda kept: F.aggregate(F.filter(all_, lambda b: (b["zone"] == OPEN) & kept(b)), F.lit(0), lambda n, b: n + F.length(b["text"]))
    copied = F.lit(False) if covers is None else F.col("ats").isNotNull() & (size(lambda b: b["covered"]) >= COPIED * size(lambda b: F.lit(True)))
    wanted = F.filter(all_, lambda b: (b["zone"] == MAIN) | (b["zone"] == LINKS) & ~b["covered"] | (b["zone"] == OPEN) & (~b["covered"] | copied) & ~F.col("has_main"))
    text = F.array_join(F.transform(wanted, lambda b: b["text"]), "\n")
    return both.withColumn("text", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; other columns are ignored).

    White space inside a block is one space; blocks are joined by one newline; null and empty pages,
    and pages of chrome only, have the empty text.  A null url is a host of its own.  Repeated rows
    are one page to the host, and each gets the same text.
    """
    rows = pages.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("row_key"), "html")
    parsed = rows.mapInArrow(_parse, _PARSED)
    open_ = parsed.where(f"array_contains(zones, {LINKS}) or (not has_main and array_contains(zones, {OPEN}))").select("host").distinct()
    hosts = small(cut(open_))
    covers = cut(boilerplate(parsed.join(hosts, "host", "left_semi").dropDuplicates(["row_key"])))
    if covers.isEmpty():
        return _texts(parsed, None)
    return _texts(parsed, small(cut(covers.groupBy("row_key").agg(F.collect_list("at").alias("ats")))))
