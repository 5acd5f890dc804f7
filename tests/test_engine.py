import base64
import gzip
import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinledger.functions import text as T
from twinledger.operators import bounds, control, indexes, match, scores, sync
from twinledger.plans.config import Config
from twinledger.service import Service
from twinledger.sources import packed, requests, synthetic
from twinledger.streaming import checks

PARTY = "bp_id string, bp_type_id string, name_1 string, address string, ktp_number string, npwp_number string"


def parties(spark, *rows):
    return indexes.derive(spark.createDataFrame(list(rows), PARTY))


def asked(spark, *rows):
    return parties(spark, *rows).withColumn("req_id", F.col("bp_id"))


def test_config_rejects_garbage():
    with pytest.raises(ValueError):
        Config(threshold=float("nan"))
    assert not Config().weighted_can_fire and Config(threshold=70, direct=85, weights=(30, 10, 60)).weighted_can_fire


def test_normalisation(spark):
    rows = spark.createDataFrame([("Jl. Melati No.12, Café",), ("no12",), ("ﬁne ½ ｆｕｌｌ ß",), (None,), ("Łukáš Čech Đà Nẵng",), ("Ünï İstanbul",)], "s string")
    assert [r[0] for r in rows.select(T.normalize_text(F.col("s"))).collect()] == ["melati 12 cafe", "no12", "fine 1 2 full", "", "ukas cech a nang", "uni istanbul"]
    derived = parties(spark, ("1", "", "Čech", "Nẵng", "", ""))
    assert derived.first()["exact_hash"] == hashlib.sha256("cech\x1fnang".encode()).hexdigest()


def test_row_hash_and_digest(spark):
    """Values of the formats themselves: compact JSON of six texts with bare digits; lines in id order."""
    rows = parties(spark, ("B", "EN", 'a"é', "b/", "1111-0000", "9 9"), ("A", "EN", "x", "", "", ""))
    want = {r[0]: hashlib.sha256(json.dumps(list(r), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for r in (("B", "EN", 'a"é', "b/", "11110000", "99"), ("A", "EN", "x", "", "", ""))}
    assert {r.bp_id: r.row_hash for r in rows.collect()} == want
    assert indexes.ordered_digest(rows) == hashlib.sha256("".join(f"{k}\x1f{want[k]}\n" for k in sorted(want)).encode()).hexdigest()
    one = indexes.digest(rows).first()
    assert one == indexes.digest(rows.repartition(3)).first() != indexes.digest(rows.withColumn("row_hash", F.lit("x"))).first()
    assert tuple(indexes.digest(rows.limit(0)).first()) == (0, None, None)


def test_numbering_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(13)
    got = indexes.numbered(rows, "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.bp_db_row)] == sorted((r.a, r.b) for r in got) and {r.bp_db_row for r in got} == set(range(2, 1002))
    assert indexes.numbered(rows.limit(0), "a").count() == 0
    base = indexes.base_table(parties(spark, *((str(i), "EN", f"name {i}", "x" * (i % 9), "", "") for i in range(60))))
    assert indexes.gaps(indexes.ranges(base, "len_bucket", "token_count")).isEmpty() and indexes.audit(base, indexes.exact_index(base)).isEmpty()
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert indexes.require_one_to_one(keys, keys.withColumn("v", F.lit(1)), "k").count() == 2
    for left, right in ((keys.union(keys), keys), (keys, keys.limit(1))):
        with pytest.raises(ValueError):
            indexes.require_one_to_one(left, right, "k")


def test_source_override(spark):
    general = spark.createDataFrame([("A", "EN", "n", None), (None, "EN", "m", "x")], "bp_id string, bp_type_id string, name_1 string, address string")
    docs, taxes = (spark.createDataFrame([("A", "1")], f"bp_id string, {c} string") for c in ("ktp_number", "npwp_number"))
    assert [tuple(r) for r in indexes.source_sql(spark, general, docs, taxes).collect()] == [("A", "EN", "n", "", "1", "1")]
    own = "SELECT g.*, 7 AS ktp_number, NULL AS npwp_number FROM {general} g WHERE bp_id IS NOT NULL"
    assert [tuple(r) for r in indexes.source_sql(spark, general, docs, taxes, own).collect()] == [("A", "EN", "n", "", "7", "")]
    with pytest.raises(ValueError):
        indexes.source_sql(spark, general.limit(0), docs, taxes)


def test_bounds_lose_no_match(spark):
    """Perturbed synthetic parties at four settings: blocks with bounds give what full scores of all pairs give."""
    rows = synthetic.parties(spark, 240)
    made = synthetic.perturbed(synthetic.perturbed(rows.where("cast(bp_id AS bigint) % 4 = 0")), 5)
    base = indexes.derive(rows).persist()
    requests = indexes.derive(made).withColumn("req_id", F.concat("bp_id", F.lit("p"))).withColumn("bp_id", F.col("req_id")).persist()
    scored = match.metrics(match.pairs_in_window(requests, base)).persist()
    for config in (Config(), Config(threshold=60, direct=55), Config(threshold=70, direct=85, weights=(30, 10, 60)), Config(direct=100)):
        want = {tuple(r) for r in match.judged_matches(scored, config).collect()}
        assert {tuple(r) for r in match.find(requests, base, config).collect()} == want
        assert want or config.direct == 100
    for most in (3, 7):
        small = {(int(p), int(r)) for p, r in zip(*bounds.possible([b"toko satu", b"x", b"satu toko jaya"], [b"toko satu", b"y"], Config(direct=10 * most))[:2])}
        assert (0, 0) in small and (1, 0) not in small
    assert match.find(requests.limit(0), base).count() == match.find(requests, base.limit(0)).count() == 0


def odd_parties(spark):
    """Texts of many lengths, tokens near to several others, repeated and nested numbers, and none of any."""
    rng = random.Random(5)
    words = "toko tokoo otoko raya rayaa araya https http 1234 1235 12 2 2 345 12345 x ab abcd abce abde html".split()
    texts = ["", "x", "7", "toko tokoo raya", "tokoo toko araya rayaa", "12 2 2", "2 12 2", "a" * 70, "a" * 69 + "b", " ".join(["toko raya 12"] * 30)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 40]))) for _ in range(50)]
    return parties(spark, *((f"{i:03d}", "", t, "", "", "") for i, t in enumerate(texts)))


def test_block_scores_are_those_of_the_columns(spark):
    """F8: every score of every pair of odd texts, to the last bit; texts of over 64 characters take more words of bits."""
    base = odd_parties(spark).persist()
    requests = base.withColumn("req_id", F.col("bp_id"))
    columns = ["req_id", "bp_id", "levenshtein", "jaccard", "numeric", "combined"]
    want = {tuple(r) for r in match.metrics(match.pairs_in_window(requests, base)).select(columns).collect()}
    got = bounds.scored(requests, base).select(columns).collect()
    assert len(want) == len(got) > 500 and {tuple(r) for r in got} == want
    rng = random.Random(2)
    a = ["".join(rng.choice("ab 1") for _ in range(n)).encode() for n in (0, 1, 63, 64, 65, 128, 130, 300)]
    i, j = (x.ravel() for x in np.indices((8, 8)))
    assert scores.edits(a, a, i, j).tolist() == [scores._long_edits(a[x], a[y]) for x, y in zip(i, j)]


def test_direct_rules_lose_no_pair(spark):
    """trigrams of all pairs as matrices leave what the two direct rules accept, at several settings; far pairs end there."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdetho") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["12", "1234"]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 20, 60]))) for _ in range(50)] + ["a", "7 7 7", "a b c"]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, len(t) // 4 + 1)):
            t[rng.randrange(len(t)) : rng.randrange(len(t)) + 1] = rng.choice(["", "x", "ab"])
            t = t or ["a"]
        return " ".join("".join(t).split()) or "a"

    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in base]
    texts, asked_ = ([t.encode() for t in x] for x in (base + [changed(t) for t in base * 2], base[:20] + shuffled + [changed(t) for t in shuffled]))
    near = bounds.window(texts, asked_, Config())
    block = scores.Block(texts, asked_, bounds._near)
    lev, jac = block.levenshtein(*near), block.jaccard(*near)
    for direct in (50, 60, 80, 90, 100):
        want = {(a, b, max(x * (x >= direct), y * (x < direct)), 0 if x >= direct else 1) for a, b, x, y in zip(*(v.tolist() for v in (*near, lev, jac))) if max(x, y) >= direct}
        got = [tuple(x) for x in zip(*(v.tolist() for v in bounds._direct(texts, asked_, Config(direct=direct, threshold=100))))]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert (bounds._overlap(bounds._trigrams([[b"toko satu"]]), bounds._trigrams([[b"xyz"], [b"toko satu"]])) == [[0, 11]]).all()
    few = bounds._counts(texts[:40])
    assert (bounds._far(few, few[:9]) == bounds._apart(few, few[:9])).all()


def test_far_pairs_end_early(monkeypatch):
    """edit distances up to most are exact, others beyond it after a part of the steps; rare tokens are asked before all, and lose no near one."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).encode()
    a = [text(n) for n in (1, 63, 64, 65, 130, 300, 300, 700)]
    b = [text(rng.randint(1, 700)) for _ in range(40)] + [t[:k] + b"x" + t[k + 2 :] for t in a for k in (0, 20, 60)] + [t[10:] + t[:10] for t in a]
    i, j = (np.repeat(x.ravel(), 20) for x in np.indices((len(a), len(b))))  # enough pairs for the vectors
    want = scores.edits(a, b, i, j)
    for share in (0, 0.05, 0.2, 0.5, 1):
        most = np.floor(share * np.maximum([len(a[x]) for x in i], [len(b[y]) for y in j])).astype(np.int64)
        got = scores.edits(a, b, i, j, most)
        assert ((got == want) | ((want > most) & (got > most))).all() and (want <= most).any()
    steps, plain = [], scores._least
    monkeypatch.setattr(scores, "_least", lambda up, *rest: steps.append(up.shape[1]) or plain(up, *rest))
    far = np.arange(600) % 30
    scores.edits([text(700) for _ in range(30)], [text(700) for _ in range(30)], far, far[::-1].copy(), np.full(600, 140))
    assert steps[0] == 600 and len(steps) < 14

    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 9))).encode() for _ in range(80)]
    mine, theirs = ([rng.sample(words, rng.randint(0, 30)) for _ in range(n)] for n in (25, 30))
    near = bounds._near(words, words)
    place = {t: x for x, t in enumerate(words)}
    count = lambda p, r: sum(any(near[place[t], place[u]] for u in r) for t in p)
    monkeypatch.setattr(bounds, "NEAR_ROWS", 7)
    assert bounds._near_counts(mine, theirs).tolist() == [[count(p, r) for r in theirs] for p in mine]
    some = bounds._rarest(mine, theirs)
    assert all(set(x) <= set(y) and len(x) == min(len(y), len(y) // 5 + 1) for x, y in zip(some, mine))
    assert (bounds._near_counts(some, theirs) + np.array([len(y) - len(x) for x, y in zip(some, mine)])[:, None] >= bounds._near_counts(mine, theirs)).all()


def test_nearest_are_the_best_of_all(spark):
    """the five best of bounded scores are those of all scores, ties by id."""
    base = odd_parties(spark).persist()
    requests = base.withColumn("req_id", F.col("bp_id"))
    every = match.top(bounds.scored(requests, base), 5, "combined").select("req_id", "bp_id", "combined", "place")
    assert sorted(map(tuple, match.top(bounds.nearest(requests, base), 5, "combined").select("req_id", "bp_id", "combined", "place").collect())) == sorted(map(tuple, every.collect()))


def test_parity_of_bounds_and_full_scores(spark):
    """full scores and bounded ones meet in the block; a bound that loses matches shows."""
    base = odd_parties(spark).persist()
    requests = base.withColumn("req_id", F.col("bp_id"))
    configs = (Config(), Config(threshold=70, direct=60), Config(threshold=70, direct=85, weights=(30, 10, 60)))
    every = match.metrics(match.pairs_in_window(requests, base)).persist()
    want = [(i, match.judged_matches(every, c).count(), 0) for i, c in enumerate(configs)]
    assert sorted(map(tuple, bounds.parity(requests, base, configs).collect())) == want and want[2][1] > 5


def test_weighted_rule_asks_for_digits_first(spark):
    """pairs whose digits can't bring the weighted rule to its threshold are no candidates."""
    loose = Config(threshold=70, direct=85, weights=(30, 10, 60))
    base = parties(spark, *((str(i), "", f"toko raya {i:05d}", "", "", "") for i in range(0, 40_000, 999)))
    requests = base.withColumn("req_id", F.col("bp_id"))
    n = base.count()
    want = {tuple(r) for r in match.judged_matches(match.metrics(match.pairs_in_window(requests, base), loose), loose).collect()}
    assert {tuple(r) for r in match.find(requests, base, loose).collect()} == want
    assert bounds.candidates(requests, base, loose).count() < n * (n - 1) / 2


def test_groups_of_duplicates(spark):
    base = parties(spark, *((i, "", n, a, k, "") for i, n, a, k in (("A", "warung delapan", "jalan teratai 8", "1"), ("B", "warung delapa", "jalan teratai 8", ""), ("C", "quite other", "elsewhere", "1"), ("D", "nothing like", "the rest 77", ""))))
    assert {r.bp_id: r.group_id for r in match.duplicate_groups(base).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D"}


def test_groups_need_no_row_for_each_match(spark):
    """groups are those of all matches, and matches of two blocks leave no more links than connect them."""
    base = odd_parties(spark).union(parties(spark, *((f"u{i:03d}", "", "https blog example", f"com fr {i * 37 % 1000}", str(i % 50), "") for i in range(90)))).persist()
    requests = base.withColumn("req_id", F.col("bp_id"))
    found = match.judged_matches(match.metrics(match.pairs_in_window(requests.where("text_len >= 3"), base))).collect()
    root = {r.bp_id: r.bp_id for r in base.collect()}
    held = {}
    for r in base.collect():
        for key in [(0, r.ktp)] * bool(r.ktp) + [(2, r.exact_hash)]:
            held.setdefault(key, []).append(r.bp_id)
    edges = [(r.req_id, r.bp_id) for r in found] + [(x[0], y) for x in held.values() for y in x]
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.bp_id: r.group_id for r in match.duplicate_groups(base).collect()} == root and len(set(root.values())) > 5
    assert bounds.links(requests, base).count() < len(found) / 2


def test_checks_store_parties_once(spark, monkeypatch):
    """no checkpoint holds the parties of the blocks, and parties without a key that is asked for aren't shuffled for the exact lookups."""
    rows = synthetic.parties(spark, 300)
    base = indexes.derive(rows).persist()
    requests = indexes.derive(synthetic.perturbed(rows.where("cast(bp_id AS bigint) % 10 = 0")).withColumn("bp_id", F.concat("bp_id", F.lit("p")))).withColumn("req_id", F.col("bp_id")).persist()
    stored, plain = [], bounds.cut
    monkeypatch.setattr(bounds, "cut", lambda df: stored.append(df.columns) or plain(df))
    hits, close = match.all_hits(requests, base), match.find(requests, base)
    got = [sorted(map(tuple, x.collect())) for x in (hits, close)]
    assert stored and not any({"parties", "asked"} & set(c) for c in stored)
    assert "LeftSemi" in hits._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(match, "KEY_ROWS", 0)
    assert got[0] == sorted(map(tuple, match.all_hits(requests, base).collect())) and len(got[0]) > 30
    assert got[1] == sorted(map(tuple, match.matches_brute(match.pairs_in_window(requests, base)).collect())) and got[1]


def test_bigrams_of_long_texts(spark):
    """Bigrams don't cross texts, and a text of a million characters costs no square of its length."""
    rows = spark.createDataFrame([("ab" * 500_000,), ("b a",), ("", ), (None,), ("z",), ("zz9",)], "norm_text string")
    began = time.time()
    assert {tuple(r) for r in bounds.bigrams(rows).collect()} == {("ab", 500_000), ("ba", 499_999), ("b ", 1), (" a", 1), ("zz", 1), ("z9", 1)}
    assert time.time() - began < 60


def test_bounded_scans_resume(spark):
    base = indexes.base_table(parties(spark, *((str(i), "", f"alpha beta {i:03d}", "gamma delta", "", "") for i in range(50)), ("Z", "", "alpha beta 999", "gamma delte", "", ""))).persist()
    request = asked(spark, ("q", "", "alpha beta 999", "gamma delta", "", ""))
    state, config = None, Config(direct=97)
    seen = 0
    while True:
        state = control.scan_step(request, base, state, 20, config)
        seen += 1
        if state["decision"] != "INCONCLUSIVE":
            break
    assert state["decision"] == "FAIL" and seen == -(-state["scanned"] // 20)
    other = asked(spark, ("q", "", "zzzz yyyy 000", "xxxx wwwww", "", ""))
    first = control.resume(other, base, b"k", "s1", budget=40, now=0)
    assert first["decision"] == "INCONCLUSIVE" and first["compared"] == 40
    last = control.resume(other, base, b"k", "s1", first["cursor"], budget=40, now=1)
    assert (last["decision"], last["scanned"], last["compared"]) == ("PASS", 51, 51)
    for bad in (dict(sync_id="s2", now=1), dict(sync_id="s1", now=4000)):
        with pytest.raises(ValueError):
            control.resume(other, base, b"k", cursor=first["cursor"], **bad)


def test_rolling_budget_is_a_fold(spark):
    import datetime

    rng = random.Random(3)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.choice([0.5, 7, 30, 61]) * i), rng.choice("ab")) for i in range(200)]
    want, held = {}, {"a": [], "b": []}
    for i, t, c in sorted(rows, key=lambda r: (r[1], r[0])):
        times = [x for x in held[c] if (t - x).total_seconds() < 60]
        want[i] = len(times) < 3
        held[c] = times + [t] * want[i]
    for kind in ("timestamp", "timestamp_ntz"):
        events = spark.createDataFrame(rows, f"event_id long, ts {kind}, client string")
        got = control.rolling_budget(events, "client", 3).collect()
        assert {r.event_id: r.admitted for r in got} == want and all((r.pause_seconds > 0) == (r.used == 3) for r in got)


def test_follower_keeps_and_gives_up(spark, tmp_path):
    root, now = str(tmp_path / "gen"), [0.0]
    follower = sync.Follower(spark, root, 60, lambda: now[0])
    with pytest.raises(RuntimeError):
        follower.rows()
    v1 = parties(spark, ("A", "EN", "a", "b", "", ""))
    sync.publish(spark, root, v1, "s1")
    with pytest.raises(RuntimeError):
        follower.rows()  # the failure is remembered
    now[0] = 61.0
    first = follower.rows()
    assert follower.rows() is first and first[0]["sync_id"] == "s1" and sync.staged(root) is None
    sync.publish(spark, root, parties(spark, ("A", "EN", "a", "c", "", "")), "s2")
    assert follower.rows()[0]["sync_id"] == "s2"
    with pytest.raises(RuntimeError):
        sync.read_active(spark, root, "s1")
    with pytest.raises(ValueError):
        sync.publish(spark, root, v1.limit(0), "s3")
    with sync.writer_lock(root), pytest.raises(OSError):
        sync.publish(spark, root, v1, "s4")


def test_streams(spark, tmp_path):
    root, out = str(tmp_path / "gen"), str(tmp_path / "out")
    sync.publish(spark, root, parties(spark, ("A", "EN", "warung delapan", "jalan teratai 8", "1", "")), "s1")
    (tmp_path / "in").mkdir()
    asked(spark, ("q", "", "warung delapam", "jalan teratai 8", "", "")).select("req_id", *indexes.FIELDS).write.parquet(str(tmp_path / "in" / "one"))
    stream = spark.readStream.schema("req_id string, " + PARTY).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = checks.check_stream(stream, root, out, str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(out).collect()
    assert [(r.req_id, r.decision, r.sync_id) for r in got] == [("q", "FAIL", "s1")]


def test_decisions(spark):
    base = parties(
        spark,
        ("P1", "EN", "Toko Satu Jaya", "Jl Melati No 10 RT 001 RW 002", "1111000011110000", "9999000099990000"),
        ("P2", "EN", "Warung Delapan", "Jl Teratai 8 RT 003", "", ""),
        ("P3", "EN", "PT", "No", "", ""),
    )
    requests = asked(
        spark,
        ("a", "", "WARUNG DELAPAN", "jl. teratai 8 rt 003", "", ""),
        ("b", "", "", "", "1111-0000-1111-0000", ""),
        ("c", "", "", "", "9999000099990000", ""),
        ("d", "", "Warung Delapan", "Jl Teratai 8 RT 003", "1111000011110000", ""),
        ("e", "", "Toko Sutu Jaya", "Jl Melati No 10 RT 001 RW 002", "", ""),
        ("f", "", "Completely different", "elsewhere 99 xyz", "", ""),
        ("g", "", "x", "", "", ""),
        ("h", "", "x", "", "5", ""),
        ("i", "", "", "", "", ""),
        ("j", "", "Toko", "Gg", "", ""),
    )
    got = {r.req_id: (r.decision, r.rule) for r in match.check(requests, base).collect()}
    assert got == {
        "a": ("FAIL", "NAME_ADDRESS"), "b": ("FAIL", "KTP"), "c": ("PASS", "IDENTITY_ONLY"), "d": ("FAIL", "IDENTITY_CONFLICT"), "e": ("FAIL", "LEVENSHTEIN"),
        "f": ("PASS", "FULL_COVERAGE"), "g": ("INCONCLUSIVE", "SHORT_TEXT"), "h": ("PASS", "IDENTITY_ONLY"), "i": ("REJECTED", "NO_INPUT"), "j": ("FAIL", "NAME_ADDRESS"),
    }


def test_generations(spark, tmp_path):
    root = str(tmp_path / "gen")
    v1 = parties(spark, ("A", "EN", "a", "b", "", ""), ("B", "EN", "c", "d", "", ""))
    v2 = parties(spark, ("A", "EN", "a", "b", "", ""), ("C", "EN", "e", "f", "", ""))
    assert sync.publish(spark, root, v1, "s1") == "PUBLISHED" and sync.publish(spark, root, v1, "s2") == "NOOP"
    assert sync.publish(spark, root, v2, "s3") == "PUBLISHED"
    rows = {r.bp_id: (r.bp_db_row, r.is_deleted) for r in sync.read_active(spark, root)[1].collect()}
    assert rows == {"A": (2, False), "B": (3, True), "C": (4, False)}
    with pytest.raises(ValueError):
        sync.publish(spark, root, v1.union(v1), "s4")
    manifest = sync.active(root)
    (tmp_path / "gen" / "_ACTIVE.json").write_text(json.dumps(manifest | {"source_digest": "x"}))
    with pytest.raises(RuntimeError):
        sync.read_active(spark, root)


def test_packed_rejects_torn_snapshots(spark):
    rows = parties(spark, ("A", "EN", "a\tb", "c\nd", "1-2", ""), ("B", "EN", "x", "y", "", "3"))
    parts, manifest = packed.pack(rows, "s1")
    assert [tuple(r) for r in packed.unpack(spark, parts, manifest).collect()] == [("A", "EN", "a b", "c d", "12", ""), ("B", "EN", "x", "y", "", "3")]
    for bad in ([], [parts[0] | {"sync_id": "s2"}], [parts[0] | {"part_count": 2}]):
        with pytest.raises(Exception):
            packed.unpack(spark, bad, manifest)
    with pytest.raises(ValueError):
        packed.unpack(spark, parts, manifest | {"sha256": "0"})
    old = b"bp_id\tbp_type_id\tname_1\taddress\tktp_digits\nA\tEN\tn\ta\t1-2\n"
    part = {"part_no": 0, "part_count": 1, "sync_id": "s0", "data": base64.b64encode(gzip.compress(old)).decode()}
    rows = packed.unpack(spark, [part], {"sync_id": "s0", "rows": 1, "sha256": hashlib.sha256(old).hexdigest()})
    assert [tuple(r) for r in rows.collect()] == [("A", "EN", "n", "a", "12", "")]


def test_packed_snapshot_streams(spark, tmp_path, monkeypatch):
    """the same parts through files, a few bytes at a time; torn ones are refused and leave no rows."""
    monkeypatch.setattr(packed, "HELD_BYTES", 1_000)
    monkeypatch.setattr(packed, "PART_CHARS", 400)
    rows = parties(spark, *((f"{i:03d}", "EN", hashlib.sha256(b"%d" % i).hexdigest(), "é\n" * i, str(i), "") for i in range(60)))
    parts, manifest = packed.pack(rows, "s1")
    at, out = str(tmp_path / "parts"), str(tmp_path / "rows")
    assert packed.store(rows, "s1", at) == manifest and len(parts) > 5
    stored = spark.read.parquet(at)
    assert sorted((r.asDict() for r in stored.collect()), key=lambda p: p["part_no"]) == parts
    assert sorted(map(tuple, packed.load(spark, at, manifest, out).collect())) == sorted(map(tuple, packed.unpack(spark, parts, manifest).collect()))
    stored.where("part_no <> 3").write.parquet(at + "1")
    stored.where("part_no < 4").withColumn("part_count", F.lit(4).cast("long")).write.parquet(at + "2")
    for path, named in ((at + "1", manifest), (at + "2", manifest), (at, manifest | {"sha256": "0"}), (at, manifest | {"sync_id": "s2"})):
        with pytest.raises(ValueError):
            packed.load(spark, path, named, out + "x")
        assert not (tmp_path / "rowsx").exists()


def test_requests_and_responses(spark):
    base = parties(spark, ("P1", "EN", "Toko Satu Jaya", "Jl Melati 10", "1111", ""), ("P2", "EN", "Warung Satu", "elsewhere", "1111", ""), ("P3", "EN", "Toko Satu Jayo", "Jl Melati 10", "", ""))
    made = match.respond(asked(spark, ("a", "", "", "", "1111", ""), ("b", "", "Toko Satu Jaya", "Jl Melati 11", "", ""), ("c", "", "zzz", "yyyy", "", "")), base)
    got = {r.req_id: r for r in made.collect()}
    assert [c.bp_id for c in got["a"].candidates] == ["P2"] and {c.bp_id for c in got["b"].candidates} == {"P1", "P3"} and got["c"].candidates is None
    assert got["c"].pass_basis == "ALL_PARTIES_EVALUATED" and "1111" not in str(got["a"].candidates) and got["a"].reason == match.REASONS["KTP"]
    body = json.loads({r.req_id: r.body for r in requests.responses(made).collect()}["b"])
    assert body["decision"] == "FAIL" and body["candidates"][0]["score"] >= 80
    assert T.posting_parts(F.lit('["a","b"]'), 2) is not None
    rows = spark.range(1).select(*(T.posting_parts(F.lit(x), 2).alias(f"c{i}") for i, x in enumerate(('["a","b"]', '["a"]', "[", '["a",null]'))))
    assert list(rows.first()) == [["a", "b"], None, None, None]


def test_cursor():
    cursor = control.sign({"at": 3, "expires": 10, "query": "q"}, b"k")
    assert control.verify(cursor, b"k", 5, {"query": "q"})["at"] == 3
    for secret, now, bound in ((b"x", 5, {}), (b"k", 11, {}), (b"k", 5, {"query": "r"})):
        with pytest.raises(ValueError):
            control.verify(cursor, secret, now, bound)


def test_service(spark, tmp_path):
    root = str(tmp_path / "gen")
    settings = {"SIMILARITY_THRESHOLD": "92", "FULL_SCOPE_CHUNK_ROWS": "2", "SIMILARITY_WEIGHT_NUMERIC": ""}
    service = Service(spark, root, settings, b"k")
    assert not service.health()["ok"]
    sync.publish(spark, root, parties(spark, *((str(i), "EN", f"Warung {w}", f"Jl Teratai {i}", str(i) * 8, "") for i, w in enumerate(("Satu", "Dua", "Tiga", "Empat", "Lima")))), "s1")
    service = Service(spark, root, settings, b"k")
    assert service.health() == {"ok": True, "version": "1", "sync_id": "s1", "sync_state": "READY", "total_bp_rows": 5}
    bodies = spark.createDataFrame([("a", '{"ktp":"1111-1111"}'), ("b", "{"), ("c", '{"name1":"Warung Tigo","address":"Jl Teratai 2"}'), ("d", "x" * 70_000)], "req_id string, body string")
    got = {r.req_id: (r.status, json.loads(r.body)) for r in service.check(bodies).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 200, "b": 400, "c": 200, "d": 413}
    assert got["a"][1]["best_bp_id"] == "1" and got["c"][1]["rule"] == "LEVENSHTEIN" and got["c"][1]["sync_id"] == "s1" and "11111111" not in str(got)
    body, cursor, steps = '{"name1":"qqqqq zzzzz","address":"xxxxx 99"}', None, 0
    while (out := service.scan(body, cursor))["decision"] == "INCONCLUSIVE":
        cursor, steps = out["cursor"], steps + 1
    assert out["decision"] == "PASS" and steps == 2
    with pytest.raises(ValueError):
        service.scan('{"ktp":"1"}')


def test_settings_and_time_limits(spark):
    got = Config.from_settings({"SIMILARITY_THRESHOLD": "70", "SIMILARITY_WEIGHT_JACCARD": "0", "LENGTH_TOLERANCE_MIN_CHARS": "5"})
    assert (got.threshold, got.weights, got.tolerance_chars, got.direct) == (70.0, (60.0, 0.0, 10.0), 5, 80.0)
    for bad in ({"SIMILARITY_THRESHOLD": "nan"}, {"SIMILARITY_THRESHOLD": "x"}, {"RATE_LIMIT_PER_MIN": "-1"}):
        with pytest.raises(ValueError):
            Config.from_settings(bad)
    assert control.within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(TimeoutError):
        control.within(spark, 0.5, lambda: spark.range(8, numPartitions=8).select(F.expr("aggregate(sequence(1, 200000000), 0L, (a, x) -> a + x)")).collect())
    assert spark.range(3).count() == 3
