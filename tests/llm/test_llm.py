import hashlib
import math
import random
import re
from collections import Counter
from decimal import Decimal

import pytest

pytest.importorskip("twinledger.llm.queries")
import numpy as np
import pyarrow as pa

from twinledger.llm import debruijn, decontaminate, mixing, pagetext, partenum, pii, quality, sharding, stored, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    texts = [" ".join(words[a : a + 80]) for a in (0, 0, 100, 200, 1)] + [" ".join(words[100:179] + ["Other"]), None, "", " \t\n", "one two", "ONE two", "a" * 30_000, "b b b " * 5_000, " ".join(words * 30)]
    rows = [(i, t, "en", "hot" if i < 8 else None, 0, 9, True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[3], (None, texts[0], None, "s", None, None, None)], DOCS)


def _rows(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0], x[1] or ""))


def _sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_join_is_brute_force(docs, k, percent):
    rows = _rows(docs)
    sets = [_sets(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, len(s), least.get(g)) for (i, _), s, g in zip(rows, sets, group))
    assert Counter(map(tuple, partenum.join(docs, k, percent).collect())) == want


@pytest.mark.parametrize("buckets", [1_000_000, 20])
def test_removed_repeats_are_brute_force(docs, monkeypatch, buckets):
    monkeypatch.setattr(debruijn, "BUCKET_ENTRIES", buckets)
    seen, want = {}, Counter()
    rows = [(i, t, (t or "").encode().split()) for i, t in _rows(docs)]
    for n, (i, t, w) in enumerate(rows):
        for j in range(len(w) - 19):
            seen.setdefault(tuple(w[j : j + 20]), (i, t, j))
    for i, t, w in rows:
        gone = bytearray(len(w))
        for j in range(len(w) - 19):
            if seen[tuple(w[j : j + 20])] != (i, t, j):
                gone[j : j + 20] = b"\1" * 20
        want[(i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, debruijn.remove_repeats(docs).drop("text").collect())) == want
    assert debruijn.remove_repeats(docs.limit(0)).count() == 0


def test_shards(docs):
    out = sharding.shard(docs).collect()
    assert len(out) == docs.count() and len({r.shard for r in out if r.text and r.text.startswith("w0 ")}) >= 1
    by_text = {}
    for r in out:
        by_text.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_differencing_is_tight():
    sizes = np.random.default_rng(1).integers(1, 1000, 2000)
    tuples = np.zeros((2000, 8), dtype=np.int64)
    tuples[:, 0] = sizes
    places, sums = sharding.differencing(tuples)
    assert sorted(np.bincount(places[:, 0], sizes, 8).astype(int)) == sorted(sums.tolist()) and sums.max() - sums.min() <= 2


def test_one_row_of_each_component_stays(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    x, y, z, near = (" ".join(words[a : a + b]) for a, b in ((0, 80), (100, 80), (200, 80), (0, 79)))
    rows = [(1, x), (5, x), (5, y), (None, x), (7, near), (8, z), (8, z), (8, z), (9, ""), (9, ""), (None, None), (None, "p q r s t u"), (None, "p q r s t u")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = partenum.keep_one(docs)
    assert out.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted([(1, x), (5, y), (8, z), (9, ""), (9, ""), (None, None), (None, "p q r s t u")], key=key)


def test_statistics_and_list(spark, docs):
    for r in quality.statistics(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
    rows = [{f: 0.0 for f in quality.FEATURES} | {"symbol_rate": float(i % 4 == 0), "bad": int(i % 4 == 0), "fold": i % 3} for i in range(120)]
    assert [[c.feature for c in r] for r in quality.learn(rows)] == [["symbol_rate"]]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, none).count() == docs.count()


def test_replication(docs):
    out = mixing.replicate(docs, {"hot": 1.0}).collect()
    assert {r.source for r in out} <= {"hot"} and mixing.replicate(docs.limit(0)).count() == 0
    assert [tuple(r) for r in out] == [tuple(r) for r in mixing.replicate(docs.repartition(3), {"hot": 1.0}).collect()]


def test_replication_counts(spark):
    # sources 0 to 3 have 20 rows each, and weights that give these rates; source 4 only makes up the total
    wanted, each = [0.5, 50.0, 800.0, 5000.0], 20
    total = int(sum(wanted) * each)
    docs = spark.createDataFrame([(i, "x", str(min(i // each, len(wanted)))) for i in range(total)], "doc_id long, text string, source string")
    out = mixing.replicate(docs, {str(i): r * each for i, r in enumerate(wanted)}).collect()
    got = {r.doc_id: r for r in out}
    n = Counter(r.doc_id for r in out)
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)

    def inverted(rate, u):
        p = upto = (-Decimal(rate)).exp()
        k = 0
        while upto <= u:
            k += 1
            p = p * Decimal(rate) / k
            upto += p
        return k

    for i, rate in enumerate(wanted):
        parts, counts = max(1, math.ceil(rate / mixing.MOST_RATE)), []
        for d in range(i * each, (i + 1) * each):
            text = hashlib.md5(b"x").hexdigest()
            names = [f"17|{d}|{text}"] + [f"17|{d}|{text}|{k}" for k in range(1, parts)]
            draws = [Decimal(int(hashlib.md5(x.encode()).hexdigest()[:13], 16)) / 2**52 for x in names]
            counts.append(sum(inverted(rate / parts, u) for u in draws))
            r = got.get(d)
            assert n[d] == counts[-1] and (r is None or r.n_copies == n[d] and abs(r.rate - rate) < 1e-6)
        assert abs(sum(counts) - rate * each) <= 5 * (rate * each) ** 0.5 and len(set(counts)) > 1


def test_decontamination(spark, docs):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    bench = spark.createDataFrame([(1, " ".join(words[205:245])), (2, "never seen words here at all"), (3, None), (4, "ONE, two!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert {(3, 1), (13, 1), (9, 4), (10, 4)} <= got and not {d for d, i in got if i == 2} and (0, 1) not in got
    assert decontaminate.clean(docs, bench).where("doc_id in (3, 9)").count() == 0


def test_personal_data():
    text = "a b.c@d.example.org 10.2.300.4 10.2.30.4 and 4669 7016 6030 4244 x +1 (856) 555-2524"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "b.c@d.example.org"), ("ip", "10.2.30.4"), ("card", "4669 7016 6030 4244"), ("phone", "+1 (856) 555-2524")]
    held = pii.examples(200, 99)
    found = pii.decode(pii.trained(), [t for t, _ in held])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, held))
    assert right > 0.9 * sum(len(b) for _, b in held) and right > 0.9 * sum(map(len, found))


@pytest.mark.parametrize("address", ["firstname.middlename.lastname-dept-of (at) a-host.example.org", "a.b [at] very-long-host-name-of-an-organisation.example.org", "a.b (at) long-host-name-of-some-organisation (dot) example (dot) org"])
def test_windows_hold_long_addresses(address):
    text = "some words " * 20 + address + " more words" * 20
    at = text.index(address)
    windows = pii._windows(text)
    assert all(text[lo : lo + len(w)] == w for lo, w in windows) and any(lo <= at and at + len(address) <= lo + len(w) for lo, w in windows)
    assert pii._is_cut("abcdef", 2, 4, 2, 6) and pii._is_cut("abcdef", 0, 4, 0, 4) and not pii._is_cut("ab cd", 3, 5, 3, 5)
    assert all(pii._windows(("y" * 40 + "1" + "z" * 40 + " " * k + "1" * 50)[:n]) for n in range(41, 140) for k in (0, 1, 40))
    assert [pii._windows(t) for t in ("", "no anchor")] == [[], []] and pii._windows("1" * 30_000)[-1][0] + pii.WINDOW >= 30_000


def test_string_kernel():
    def brute(a, b):
        from itertools import combinations

        def f(s):
            out = Counter()
            for p in combinations(range(len(s)), 3):
                out["".join(s[i] for i in p)] += toxicity.DECAY ** (p[-1] - p[0] + 1)
            return out

        x, y = f(a), f(b)
        dot = lambda u, v: sum(u[k] * v[k] for k in u)
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    v = toxicity.vectors([b"banana", b"bandana", b"xyz"])
    assert np.allclose(v @ v.T, [[brute(a, b) for b in ("banana", "bandana", "xyz")] for a in ("banana", "bandana", "xyz")])


@pytest.mark.parametrize("length", range(3, 21))
def test_spelt_out_runs_are_whole(length):
    text = "start " + " ".join("abcdefghijklmnopqrstuvwxyz"[:length]) + " end"
    (_, _, buf, offs), = toxicity.wordhash.texts(pa.array([text]))
    found = toxicity._strings(toxicity.wordhash.Words(buf, offs, toxicity._FOLD))
    runs = [(a, b) for a, b in zip(*(x.tolist() for x in found)) if " " in text[a:b]]
    assert len(set(runs)) == len(runs) and all(len(text[a:b].split()) == min(length, 8) for a, b in runs)
    assert {c for a, b in runs for c in text[a:b].split()} == set("abcdefghijklmnopqrstuvwxyz"[:length])
    assert min(runs)[0] == 6 and max(b for _, b in runs) == len(text) - 4


def test_pages(spark):
    page = "<html><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>one\n two<br>three<p>four</article><footer>f</footer></html>"
    pages = spark.createDataFrame([(1, "http://a/x", page), (2, None, None), (3, "http://a/y", "")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == {1: "T & U\none two three\nfour", 2: "", 3: ""}


@pytest.mark.parametrize("part", [200_000, 20])
def test_pages_without_a_main_region(spark, monkeypatch, part):
    monkeypatch.setattr(pagetext, "PART_TOKENS", part)
    many = lambda name, n=12: " ".join(f"{name}{i}" for i in range(n))
    frame, both = many("frame"), many("both")
    bodies = {
        1: [many("copy", 30)], 2: [many("copy", 30)],
        3: [many("near", 30) + " x"], 4: [many("near", 30) + " y"], 5: [many("near", 30) + " z"],
        6: [both, many("six", 20)], 7: [both, many("seven", 20)],
        8: [frame, many("eight", 30)], 9: [frame, many("nine", 30)], 10: [frame, many("ten", 30)],
    }
    rows = [(i, f"http://h/{i}", "".join(f"<p>{t}</p>" for t in b)) for i, b in bodies.items()]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(t for t in b if t != frame) for i, b in bodies.items()}


def test_warc_round_trip():
    headers, block = warc.response("http://a/", "<p>x &lt; y<a href='/z'>z</a>", "1")
    (h, b), = warc.parse(warc.serialize(list(headers.items()), block))
    made = warc.derive(h, b)
    back = warc.parse(b"".join(warc.record_bytes(r) for r in made))
    assert [x["WARC-Type"] for x, _ in back] == ["conversion", "metadata"] and all(x["WARC-Refers-To"] == headers["WARC-Record-ID"] for x, _ in back)
    assert back[0][1].decode() == "x < yz" and b"outlink: /z a" in back[1][1] and back[0][0]["WARC-Block-Digest"] == warc.digest(back[0][1])
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx")


def _components(sets, percent):
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    group = [group[a] if g == group[b] else g for g in group]
    return [group.index(g) for g in group]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_a_large_family_that_does_not_all_link(spark, monkeypatch, k, percent):
    """Near copies by 0 to 8 changed words, chains of copies of copies, sub-families, and a passage that strangers share."""
    monkeypatch.setattr(partenum, "BUCKET_ENTRIES", 2_000)
    monkeypatch.setattr(partenum, "PART_MEMBERS", 40)
    rng = random.Random(k)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(160):
        words = base[:]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        texts.append(words)
    for i in range(40):  # each is near the one before it, not the first
        words = texts[-1][:]
        words[(7 * i) % 150] = f"y{i}"
        texts.append(words if i else base[::-1])
    texts += [[f"s{i}_{j}" for j in range(rng.randint(1, 40))] + base[20:60] for i in range(40)]
    texts += [words[: rng.randint(100, 150)] for words in texts[:30]]
    docs = spark.createDataFrame([(1000 + i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    want = _components([_sets(" ".join(w), k) for w in texts], percent)
    assert {r.doc_id: r.component_id for r in partenum.join(docs, k, percent).collect()} == {1000 + i: 1000 + g for i, g in enumerate(want)}
    assert len(set(want)) > 50 and max(Counter(want).values()) > 60


def test_signatures_share_more_than_spare():
    """Sets at most k apart share more than spare signatures of one band, and those beyond spare are of both."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for size in (1, 3, 7, 15, 40, 148, 400, 900):
            own = partenum.wordhash.mix(rng.integers(1, 2**63, size).astype(np.uint64))
            for _ in range(12):
                lost = rng.integers(0, size + 1)
                other = np.concatenate([own[lost:], partenum.wordhash.mix(rng.integers(1, 2**63, rng.integers(0, size + 1)).astype(np.uint64))])
                both = size - lost
                if not len(other) or 100 * both < percent * (size + len(other) - both):
                    continue
                a, b = ([(set(s.tolist()), spare) for s, spare in partenum.signatures(np.sort(x), percent)] for x in (own, other))
                assert any(len(x & y) > max(p, q) for x, p in a for y, q in b)


CLASH = ("row", "key", "n", "n_words", "n_lines", "rate", "steps", "parts", "u", "copy", "start", "run", "size", "shard", "_key", "hub", "kept", "words", "lines", "upper", "of", "name")


def _clashing(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", s, 1, *[-7] * len(CLASH)) for i, t, s in rows], schema)


def test_stages_keep_columns_and_edge_rows(spark):
    """Clashing names, nulls, empty, very long and repeated texts, ties, no rows: each stage keeps the columns of documents."""
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    long = " ".join(f"v{i}" for i in range(20_000))
    rows = [(1, " ".join(words[:80]), "a"), (1, " ".join(words[:80]), "a"), (2, " ".join(words[:80]), None), (None, " ".join(words[100:190]), "a"), (3, None, "a"), (4, "", None), (5, long, "b"), (5, " ".join(words[200:280]), "b"), (6, " ".join(words[300:350]), "a")]
    docs = _clashing(spark, rows)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, " ".join(words[305:345])), (2, None), (3, "")], "item_id long, text string")
    whole = Counter((i, t) for i, t, _ in rows)
    stages = {
        "quality": (lambda d: quality.keep(d, labels), Counter({(i, t): n for (i, t), n in whole.items() if t and len(t.split()) >= 50})),
        "near": (partenum.keep_one, Counter({k: 1 for k in whole if k != (2, rows[0][1])})),
        "benchmark": (lambda d: decontaminate.clean(d, bench), Counter({k: n for k, n in whole.items() if k[0] != 6})),
    }
    for stage, want in stages.values():
        out = stage(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert Counter((r.doc_id, r.text) for r in got) == want and all(r[c] == -7 for r in got for c in CLASH)
        assert stage(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and all(r[c] == -7 for r in mixed.collect() for c in CLASH)
    out = sharding.shard(docs, 3)
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert set(out.columns) == set(docs.columns) | made and all(r[c] == -7 for r in out.collect() for c in CLASH if c not in made)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == whole


def test_shards_are_near_equal(spark):
    """Sizes, CRCs, gapless slots, groups whole, and bytes within the largest indivisible group of each other."""
    import zlib

    rng = random.Random(2)
    texts = ["z" * rng.randint(0, 4000) for _ in range(900)] + ["same é text"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.shard(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in out} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for i, t in enumerate(texts)}
    total, of, slots = Counter(), {}, {}
    for r in out:
        total[r.shard] += r.size
        of.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(total) == set(range(24)) and all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= 64
    assert max(total.values()) - min(total.values()) < sum(total.values()) / 24 / 100


def test_decontamination_recall(spark):
    """Near windows of weighted similarity 0.8 or more, counted by brute force over all windows: at least 0.9 are found."""
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocab) for _ in range(rng.randint(15, 59))) for _ in range(60)]
    docs, truth = [], set()
    (kind,) = decontaminate.prepare(list(range(len(items))), items)
    for d in range(240):
        i = rng.randrange(len(items))
        words = items[i].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.choice([0, 1, -1, -2, rng.randrange(len(words))])] = rng.choice(vocab)
        text = " ".join([rng.choice(vocab) for _ in range(30)] + words + [rng.choice(vocab) for _ in range(30)])
        docs.append((d, text))
        (_, _, _, h), = decontaminate._bags([text])
        m = int(kind.size[i]) - kind.words + 1
        windows = (dict(Counter(h[s : s + m].tolist())) for s in range(len(h) - m + 1))
        if max(decontaminate.similarity(w, kind.bags[i], kind.weight, kind.unseen) for w in windows) >= decontaminate.THRESHOLD:
            truth.add((d, i))
    clean = [(1000 + d, " ".join(rng.choice(vocab) for _ in range(90))) for d in range(60)]
    found = decontaminate.contaminated(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(truth) > 150 and len(got & truth) >= 0.9 * len(truth) and not {d for d, _ in got if d >= 1000}
    # a byte of a random fingerprint is near that of few items
    near = [len({i for t in range(8) for i in kind.tables[t].get(x >> (8 * t) & 255, ())}) for x in (rng.getrandbits(64) for _ in range(200))]
    assert sum(near) / len(near) < 0.3 * len(items)


def test_decontamination_in_blocks(spark, monkeypatch):
    """Whatever block an item is in, the same windows are found with the same similarity."""
    items = [(i, " ".join(f"w{(i * 13 + j) % 90}" for j in range(25))) for i in range(9)]
    docs = spark.createDataFrame([(d, "lead words " + " ".join(items[d][1].split()[: 25 - d // 3]) + " tail words") for d in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_LIMIT", 2)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole and whole


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version on its own input; rows are written and read between them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(2000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [text(rng.randint(30, 120)) for _ in range(120)]
    texts += [t + " end" for t in texts[:20]] + texts[20:30] + ["x y z " * 40, "", None]
    item = text(30)
    texts += [text(40) + " " + item + " " + text(20) for _ in range(5)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 7)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [(i, t) for i, t in enumerate(texts)]

    def passes(t):
        w = (t or "").split()
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        return len(w) >= 50 and 100 * len({j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}) <= 50 * len(w)

    def deduped(held):
        least = {}
        for (i, _), g in zip(held, _components([_sets(t, 5) for _, t in held], 80)):
            least[g] = min(i, least.get(g, i))
        return [(i, t) for i, t in held if i in least.values()]

    wants = [lambda h: [x for x in h if passes(x[1])], deduped, lambda h: [x for x in h if item not in x[1]]]
    for (name, stage), want in zip(pipeline.STAGES, wants):
        docs = stage(spark, docs, str(tmp_path))
        rows = want(rows)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
    final = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in final} <= set(rows) and len(final) > 0.5 * len(rows)
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "karmarkar_karp_sharding"]


def test_warc_encodings_and_types():
    import gzip
    import zlib

    page = "<p>x &lt; y<a href='/z'>z</a>".encode()
    chunked = b"5;a=b\r\n" + gzip.compress(page)[:5] + b"\r\n" + hex(len(gzip.compress(page)) - 5)[2:].encode() + b"\r\n" + gzip.compress(page)[5:] + b"\r\n0\r\n\r\n"
    cases = [
        ("Content-Type: text/html\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked", chunked, "x < yz", 2),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(page)[2:-4], "x < yz", 2),
        ("Content-Type: text/html\r\nContent-Encoding: deflate", zlib.compress(page), "x < yz", 2),
        ("Content-Type: text/plain; charset=latin-1", "a <b> \u00e9".encode("latin-1"), "a <b> \u00e9", 2),
        ("Content-Type: text/html; charset=none-such", page, "x < yz", 2),
        ("X: y", page, "x < yz", 2),
        ("Content-Type: image/png", b"\x89PNG\0", None, 1),
        ("Content-Type: text/html\r\nContent-Encoding: br", b"\x0b", None, 1),
        ("Content-Type: text/html\r\nTransfer-Encoding: chunked", b"no chunks", None, 1),
    ]
    for head, body, text, n in cases:
        rows = warc.derive({"WARC-Record-ID": "<r>"}, f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body)
        assert len(rows) == n and (text is None or rows[0]["block"] == text) and rows[-1]["record_type"] == "metadata" and "sourcePayloadDigest: " + warc.digest(body) in rows[-1]["block"]
    cut = warc.derive({}, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(bytes(range(65, 91)) * 500)[:-9])
    assert "decoding: gzip cut short" in cut[-1]["block"]


def test_warc_tables(spark):
    """Every column null, empty, repeated or long; other record types; clashing names; no rows."""
    headers, block = warc.response("http://a/", "<p>" + "long text " * 30_000, "1")
    rows = [("1", headers, block), ("1", headers, block), ("2", None, None), (None, {"WARC-Type": "request"}, b"x"), (None, {}, b"")]
    records = spark.createDataFrame([(*r, 7) for r in rows], "record_key string, headers map<string,string>, block binary, record_id int")
    out = warc.derivatives(records).collect()
    assert Counter((r.record_key, r.record_type) for r in out) == {("1", "conversion"): 2, ("1", "metadata"): 2, ("2", "conversion"): 1, ("2", "metadata"): 1, (None, "conversion"): 1, (None, "metadata"): 1}
    assert len({r.record_id for r in out if r.record_key == "1"}) == 2 and all(r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode()) for r in out)
    assert all(r.refers_to == headers["WARC-Record-ID"] and r.source_payload_digest == headers["WARC-Payload-Digest"] for r in out if r.record_key == "1")
    assert warc.derivatives(records.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://a/", "<b>x</b>", 1), (1, "http://a/", "<b>x</b>", 1), (None, None, None, 1)], "page_id long, url string, html string, block int")
    assert Counter((r.page_id, r.record_type, r.block if r.record_type == "conversion" else "") for r in warc.from_pages(pages).collect()) == {(1, "conversion", "x"): 2, (1, "metadata", ""): 2, (None, "conversion", ""): 1, (None, "metadata", ""): 1}


def test_personal_data_in_tables(spark):
    """Base spans as the rules say, spelt-out ones found in whole texts by the network, offsets in code points, clean text left alone."""
    held = [(t, s) for t, s in pii.examples(120, 1234) if s]
    lead = "\U0001f600 the inen of ther and on " * 30
    rows = [(i, lead + t + " " + lead, 5) for i, (t, _) in enumerate(held)] + [(900, lead * 20, 5), (901, None, 5), (902, "", 5), (None, "me@x.org", 5), (None, "me@x.org", 5), (903, "call +1 (856) 555-2524" + " word" * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = pii.find(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[900].spans == by[901].spans == by[902].spans == "" and by[None].n_email == 1 and by[903].n_phone == 1
    right = total = 0
    for i, (t, spans) in enumerate(held):
        text = rows[i][1]
        base = pii.base_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in sorted((x, y) for kind, x, y in base if kind == k))
        assert by[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        found = {tuple(x.split(":")) for x in by[i].spans.split(",") if x}
        assert {(k, str(a), str(b)) for k, a, b in base} <= found
        spelt = {(k, str(a + len(lead)), str(b + len(lead))) for k, a, b in spans} - {(k, str(a), str(b)) for k, a, b in base}
        spelt = {x for x in spelt if not any(int(x[1]) < b and a < int(x[2]) for _, a, b in base)}
        total += len(spelt)
        right += len(spelt & found)
    assert total > 40 and right >= 0.85 * total
    assert pii.find(docs.limit(0)).count() == 0


def test_toxicity_in_tables(spark):
    """Trained on labelled documents, held-out insults with inserted characters score high and clean texts low; edges are defined."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    bad = ["grubblefink", "snotwaddle", "plonkeroo"]

    def text(insult):
        words = [rng.choice(vocab) for _ in range(rng.randint(8, 40))]
        return " ".join([*words, insult, *words[:5]] if insult else words)

    spell = lambda w: rng.choice((w, w[:4] + "*" + w[4:], w[:3] + w[3] + w[3:], w.upper()))
    toxic = {i: i % 4 == 0 for i in range(600)}
    docs = spark.createDataFrame([(i, text(spell(rng.choice(bad)) if t else None), 1.0) for i, t in toxic.items()] + [(9001, None, 1.0), (9002, "", 1.0), (None, "x", 1.0), (None, "x", 1.0), (9003, "plain " * 20_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    import zlib

    assert {r.doc_id for r in held} == {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    hits = [r.predicted for r in held if toxic[r.doc_id]]
    assert sum(hits) >= 0.9 * len(hits) and sum(r.predicted for r in held if not toxic[r.doc_id]) <= 0.05 * len(held)
    assert all(r.predicted == 0 for r in out if r.doc_id not in toxic)
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels.limit(0))).count() == 0


def test_page_text_edges(spark):
    """Character references, hidden parts, comments, repeated rows, nulls and long pages."""
    long = "<article>" + "".join(f"<p>line {i}</p>" for i in range(5_000)) + "</article>"
    page = "<body><nav>Menu</nav><script>var x='<p>no</p>'</script><style>p{}</style><!-- gone --><article><p>a&nbsp;b &lt;c&gt;\n d</p><form><input value=q>send</form><p></p><p>e&#233;</p></article><aside>side</aside><footer>end</footer>"
    rows = [(1, "http://h/1", page, 3), (1, "http://h/1", page, 3), (2, "http://h/2", long, 3), (3, None, None, 3), (None, "http://h/3", "<article>x", 3)]
    out = pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = Counter({(1, "a b <c> d\ne\u00e9"): 2, (2, "\n".join(f"line {i}" for i in range(5_000))): 1, (3, ""): 1, (None, "x"): 1})
    assert Counter((r.page_id, r.text) for r in out) == want and all(r.n_chars == len(r.text) for r in out)
    assert pagetext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_join_beyond_what_is_broadcast(spark, monkeypatch):
    """with sides of over SHARED_ROWS, no broadcast grows with the sets, and the result is the same."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [[rng.choice(words) for _ in range(60)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(t[:-1] + ["x"])) for i, t in enumerate(texts[:30])] + [(200, None), (201, ""), (None, " ".join(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").persist()
    want = sorted(map(tuple, partenum.join(docs).collect()), key=str)
    asked, plain = [], stored.small
    monkeypatch.setattr(stored, "SHARED_ROWS", 5)
    monkeypatch.setattr(partenum, "SHARED_ROWS", 5)
    for module in (stored, partenum):
        monkeypatch.setattr(module, "small", lambda df, rows=stored.BROADCAST_ROWS: asked.append(rows) or plain(df, rows))
    assert sorted(map(tuple, partenum.join(docs).collect()), key=str) == want and len({w[2] for w in want}) < len(want)
    assert asked and set(asked) == {5}


def test_partners_by_a_bitmap(spark, monkeypatch):
    """more keys than are broadcast go ahead as a bitmap, and the join is that of the keys themselves."""
    monkeypatch.setattr(stored, "SHARED_ROWS", 5)
    left = spark.range(20_000).selectExpr("if(id % 9 = 0, null, cast(hash(id) as long)) AS k", "id")
    keys = stored.cut(left.where("id % 100 = 7").selectExpr("k", "id AS v"))
    got = stored.among(left, keys, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(keys, "k").collect())) and got.count() > 100
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
