"""Requests against parties: exact lookups, blocked fuzzy join under lossless bounds, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.functions import similarity as S
from twinledger.functions import text as T
from twinledger.functions.text import round2
from twinledger.operators.bounds import candidates, found, links, neighbour_links
from twinledger.plans.config import DEFAULT, Config
from twinledger.plans.lineage import cut

EPS = 0.005
#: Tokens of a party that are compared before all of them are.
FIRST_TOKENS = 4
#: Exact lookups, in the order in which they decide.
KINDS = ("ktp", "npwp", "exact_hash")
#: Hashes of keys, 8 bytes each, that are broadcast.
KEY_ROWS = 100_000


def _keys(rows: DataFrame, id_: str, given: bool) -> DataFrame:
    """(id, own, kind, key, norm): the exact keys of each row; a hash only where both raw fields are given, if given."""
    both = (F.trim("name_1") != "") & (F.trim("address") != "") if given else F.lit(True)
    norm = F.concat_ws("\x1f", "norm_name", "norm_address")
    keys = [F.when(F.length("ktp") > 0, F.col("ktp")), F.when(F.length("npwp") > 0, F.col("npwp")), F.when(both, F.col("exact_hash"))]
    pairs = F.array(*(F.struct(F.lit(i).alias("kind"), k.alias("key"), F.when(F.lit(i == 2), norm).otherwise("").alias("norm")) for i, k in enumerate(keys)))
    return rows.select(F.col(id_).alias("id"), F.col("bp_id").alias("own"), F.explode(pairs).alias("k")).select("id", "own", "k.*").where("key is not null")


def all_hits(requests: DataFrame, base: DataFrame) -> DataFrame:
    """(req_id, kind, bp_id) of all exact lookups, by one join on kind and key.

    kind: the place in KINDS. Equal hashes are checked by the normalised fields themselves. Where the requests' keys are few,
    only parties that have one of them are shuffled.
    """
    left = _keys(requests, "req_id", True).select(F.col("id").alias("req_id"), "own", "kind", "key", F.col("norm").alias("asked"))
    right = _keys(base, "bp_id", False).select(F.col("id").alias("bp_id"), "kind", "key", "norm")
    known = cut(left.select(F.xxhash64("kind", "key").alias("name")).distinct())
    if known.count() <= KEY_ROWS:
        right = right.join(F.broadcast(known), F.xxhash64("kind", "key") == F.col("name"), "left_semi")
    return left.join(right, ["kind", "key"]).where("bp_id <> own and asked = norm").select("req_id", "kind", "bp_id")


def exact_hits(requests: DataFrame, base: DataFrame, column: str) -> DataFrame:
    """(req_id, bp_id) of equal, non-empty identity numbers, or of equal hashes where both raw fields are given."""
    return all_hits(requests, base).where(F.col("kind") == KINDS.index(column)).select("req_id", "bp_id")


def by_text(requests: DataFrame, base: DataFrame) -> DataFrame:
    """(req_id, bp_id) of equal name and address, sought by the normalised text and then held against the hash."""
    left = requests.where((F.trim("name_1") != "") & (F.trim("address") != "")).select("req_id", F.col("bp_id").alias("own"), "norm_text", F.col("exact_hash").alias("asked"))
    return left.join(base.select("bp_id", "norm_text", "exact_hash"), "norm_text").where("asked = exact_hash and bp_id <> own").select("req_id", "bp_id")


def conflicts_of(hits: DataFrame) -> DataFrame:
    """(req_id, n_ids) from all_hits: exact checks that name different parties; of an identity number's hits the first counts."""
    first = hits.where("kind < 2").groupBy("req_id", "kind").agg(F.min("bp_id").alias("bp_id")).select("req_id", "bp_id")
    return first.union(hits.where("kind = 2").select("req_id", "bp_id")).groupBy("req_id").agg(F.count_distinct("bp_id").alias("n_ids")).where("n_ids > 1")


def conflicts(requests: DataFrame, base: DataFrame) -> DataFrame:
    return conflicts_of(all_hits(requests, base))


def previews(requests: DataFrame, base: DataFrame, most: int = 5) -> DataFrame:
    """(req_id, place, kind, bp_id): the hits after the first of each kind, in the order of kinds, at most five."""
    nth = F.row_number().over(Window.partitionBy("req_id", "kind").orderBy("bp_id"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("kind", "bp_id"))
    rest = all_hits(requests, base).withColumn("nth", nth).where("nth > 1")
    return rest.withColumn("place", place).where(F.col("place") <= most).select("req_id", "place", "kind", "bp_id")


def distinct_first(hits: DataFrame, most: int = 5) -> DataFrame:
    """(req_id, place, bp_id): of hits that may repeat an id, distinct ids first, then repeats."""
    repeat = F.row_number().over(Window.partitionBy("req_id", "bp_id").orderBy("bp_db_row"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("repeat", "bp_db_row"))
    return hits.withColumn("repeat", (repeat > 1).cast("int")).withColumn("place", place).where(F.col("place") <= most)


def pairs_in_window(requests: DataFrame, base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of a request and a party within the length tolerance, by an equi-join on length buckets.

    Features of the request have the prefix q_. A request's row is repeated for each bucket in its
    reach, a party's row never is.
    """
    q = requests.where("text_len > 0").select("req_id", F.col("bp_id").alias("own"), *(F.col(c).alias("q_" + c) for c in ("norm_text", "text_len", "tokens", "chunks")))
    q = q.withColumn("reach", T.max_len_diff(F.col("q_text_len"), config.tolerance_percent, config.tolerance_chars))
    low, high = T.len_bucket(F.greatest(F.col("q_text_len") - F.col("reach"), F.lit(0))), T.len_bucket(F.col("q_text_len") + F.col("reach"))
    q = q.withColumn("len_bucket", F.explode(F.sequence(low, high)))
    held = base.where("norm_text <> ''").select("bp_id", "norm_text", "text_len", "tokens", "token_count", "chunks", "len_bucket")
    return held.join(q, "len_bucket").where("abs(text_len - q_text_len) <= reach and bp_id <> own")


def _edits(a: Column, b: Column, longest: Column, config: Config) -> Column:
    """Edits of two texts; -1 beyond those that the direct rule allows."""
    band = F.floor(longest * (1 - (config.direct - EPS) / 100) + 1e-9)
    return F.call_function("levenshtein", a, b, band.cast("int"))


def find(requests: DataFrame, base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(req_id, bp_id, score, rule) of matching pairs: bounds over blocks first, then the metrics of the few pairs that are left, in the block."""
    return found(requests, base, config).select("req_id", "bp_id", "score", "rule")


def bounded_groups(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs whose lengths and token counts let a score reach a rule."""
    lev, jac, num = config.shares
    most_lev = 100 * F.least("text_len", "q_text_len") / F.greatest("text_len", "q_text_len")
    a, b = F.size("tokens"), F.size("q_tokens")
    most_jac = F.when((a == 0) & (b == 0), 100.0).otherwise(100 * F.least(a, b) / F.greatest(a, b))
    rule = most_lev * lev + most_jac * jac + 100 * num >= config.threshold - 5 * EPS
    return pairs.where((most_lev >= config.direct - 5 * EPS) | (most_jac >= config.direct - 5 * EPS) | rule)


def metrics(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs with levenshtein, jaccard, numeric and combined, all of them computed and rounded."""
    out = pairs.withColumns({"levenshtein": round2(S.levenshtein_similarity(F.col("q_norm_text"), F.col("norm_text"))), "_jm": S.match_tokens(F.col("q_tokens"), F.col("tokens")), "_nm": S.match_numbers(F.col("q_chunks"), F.col("chunks"))})
    out = out.withColumns({"jaccard": round2(S.soft_jaccard(F.col("q_tokens"), F.col("tokens"), F.col("_jm"))), "numeric": round2(S.numeric_weighted(F.col("q_chunks"), F.col("chunks"), F.col("_nm")))}).drop("_jm", "_nm")
    return out.withColumn("combined", S.combined(F.col("levenshtein"), F.col("jaccard"), F.col("numeric"), config.shares))


def _judged(scored: DataFrame, config: Config) -> DataFrame:
    direct_lev, direct_jac = F.col("levenshtein") >= config.direct, F.col("jaccard") >= config.direct
    rule = F.when(direct_lev, "LEVENSHTEIN").when(direct_jac, "JACCARD").when(F.col("combined") >= config.threshold, "WEIGHTED")
    score = F.when(direct_lev, F.col("levenshtein")).when(direct_jac, F.col("jaccard")).otherwise(F.col("combined"))
    return scored.withColumns({"rule": rule, "score": score})


def matches_brute(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(req_id, bp_id, score, rule) of matching pairs, every pair fully scored."""
    return judged_matches(metrics(pairs, config), config)


def judged_matches(scored: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Matching pairs of those with all metrics; combined is taken anew from the three others."""
    weighed = scored.withColumn("combined", S.combined(F.col("levenshtein"), F.col("jaccard"), F.col("numeric"), config.shares))
    return _judged(weighed, config).where("rule is not null").select("req_id", "bp_id", "score", "rule")


def matches(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The same as matches_brute, by bounds first: a banded edit distance, then the Jaccard bound of near tokens;
    soft Jaccard and digits are only computed where a rule can still fire."""
    longest = F.greatest("text_len", "q_text_len")
    pairs = bounded_groups(pairs, config)
    if config.weighted_can_fire:
        staged = pairs.withColumn("levenshtein", round2(S.levenshtein_similarity(F.col("q_norm_text"), F.col("norm_text"))))
    else:
        counted = pairs.withColumn("edits", _edits(F.col("q_norm_text"), F.col("norm_text"), longest, config))
        staged = counted.withColumn("levenshtein", F.when(F.col("edits") < 0, F.lit(0.0)).otherwise(round2((1 - F.col("edits") / longest) * 100)))
    sure = F.col("levenshtein") >= config.direct
    if "most_jaccard" in pairs.columns:
        bound = F.col("most_jaccard")
    else:
        a, b = F.size("q_tokens"), F.size("tokens")
        if not config.weighted_can_fire:
            # all but the first few tokens are taken as near: most pairs end here, at a fraction of the comparisons
            some = S.near_tokens(F.slice("tokens", 1, FIRST_TOKENS), F.col("q_tokens")) + F.greatest(b - FIRST_TOKENS, F.lit(0))
            least = config.direct - 2 * EPS
            staged = staged.where(sure | ((a == 0) & (b == 0)) | ((100 + least) * F.least(a, some) >= least * (a + b) - 1e-6))
        near = F.least(a, S.near_tokens(F.col("tokens"), F.col("q_tokens")))
        bound = F.when((a == 0) & (b == 0), 100.0).when((a == 0) | (b == 0), 0.0).otherwise(100 * near / (a + b - near))
    staged = staged.withColumn("most", F.when(sure, F.lit(100.0)).otherwise(bound))
    lev, jac, num = config.shares
    alive = sure | (F.col("most") >= config.direct - 2 * EPS)
    if config.weighted_can_fire:
        alive = alive | (F.col("levenshtein") * lev + F.least(F.col("most"), F.lit(config.direct)) * jac + 100 * num >= config.threshold - 5 * EPS)
    staged = staged.where(alive)
    matched = S.match_tokens(F.col("q_tokens"), F.col("tokens"))
    staged = staged.withColumn("_jm", F.when(~sure, matched)).withColumn("jaccard", F.when(~sure, round2(S.soft_jaccard(F.col("q_tokens"), F.col("tokens"), F.col("_jm")))))
    if config.weighted_can_fire:
        open_ = ~sure & (F.col("jaccard") < config.direct)
        staged = staged.withColumn("_nm", F.when(open_, S.match_numbers(F.col("q_chunks"), F.col("chunks"))))
        numeric = F.when(open_, round2(S.numeric_weighted(F.col("q_chunks"), F.col("chunks"), F.col("_nm"))))
        staged = staged.withColumn("numeric", numeric).withColumn("combined", F.when(open_, S.combined(F.col("levenshtein"), F.col("jaccard"), F.col("numeric"), config.shares)))
    else:
        staged = staged.withColumn("combined", F.lit(None).cast("double"))
    return _judged(staged, config).where("rule is not null").select("req_id", "bp_id", "score", "rule")


def top(rows: DataFrame, most: int = 5, score: str = "score") -> DataFrame:
    place = F.row_number().over(Window.partitionBy("req_id").orderBy(F.desc(score), "bp_id"))
    return rows.withColumn("place", place).where(F.col("place") <= most)


#: What a rule says to the caller.
REASONS = {
    "NO_INPUT": "Supply at least one field.",
    "IDENTITY_CONFLICT": "Exact checks identify different parties. Review all records.",
    "KTP": "KTP exact match found.",
    "NPWP": "NPWP exact match found.",
    "NAME_ADDRESS": "Exact name and address match found.",
    "IDENTITY_ONLY": "No matching identity number; insufficient text for a similarity check.",
    "SHORT_TEXT": "Provide more name or address to check text similarity.",
    "LEVENSHTEIN": "LEVENSHTEIN direct reject.",
    "JACCARD": "JACCARD direct reject.",
    "WEIGHTED": "Weighted name and address similarity.",
    "FULL_COVERAGE": "No duplicate: every party within the length tolerance was scored or excluded by a proven bound.",
}


def _decided(requests: DataFrame, base: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, hits, matches) of requests; hits and matches are stored, for what is built on them."""
    hits = cut(all_hits(requests, base))
    first = hits.groupBy("req_id").pivot("kind", [0, 1, 2]).agg(F.count("bp_id").alias("n"), F.min("bp_id").alias("first"))
    state = requests.select("req_id", "text_len", (F.length("ktp") + F.length("npwp") > 0).alias("has_identity"), ((F.trim("name_1") != "") | (F.trim("address") != "")).alias("has_text"))
    state = state.join(first, "req_id", "left").join(conflicts_of(hits), "req_id", "left").fillna(0, ["0_n", "1_n", "2_n", "n_ids"])
    ktp, npwp, same = (F.col(f"{i}_n") > 0 for i in range(3))
    exact = ktp | npwp | same
    close = cut(find(requests.where("text_len >= 3").join(hits.select("req_id").distinct(), "req_id", "left_anti"), base, config))
    best = top(close, 1).select("req_id", F.col("bp_id").alias("fuzzy_id"), "score", "rule").join(close.groupBy("req_id").agg(F.count("*").alias("match_count")), "req_id")
    state = state.join(best, "req_id", "left")
    rule = (
        F.when(~F.col("has_identity") & ~F.col("has_text"), "NO_INPUT")
        .when(exact, F.when(F.col("n_ids") > 1, "IDENTITY_CONFLICT").when(ktp, "KTP").when(npwp, "NPWP").otherwise("NAME_ADDRESS"))
        .when(F.col("text_len") < 3, F.when(F.col("has_identity"), "IDENTITY_ONLY").otherwise("SHORT_TEXT"))
        .when(F.col("rule").isNotNull(), F.col("rule"))
        .otherwise("FULL_COVERAGE")
    )
    decision = F.when(rule == "NO_INPUT", "REJECTED").when(rule == "SHORT_TEXT", "INCONCLUSIVE").when(rule.isin("IDENTITY_ONLY", "FULL_COVERAGE"), "PASS").otherwise("FAIL")
    decided = state.select(
        "req_id", decision.alias("decision"), rule.alias("rule"), (F.col("n_ids") > 1).alias("identity_conflict"), F.col("2_n").alias("exact_count"),
        F.when(exact, F.coalesce("0_first", "1_first", "2_first")).otherwise(F.col("fuzzy_id")).alias("best_bp_id"), F.when(exact, F.lit(100.0)).otherwise(F.col("score")).alias("score"),
        F.when(exact, F.lit(0)).otherwise(F.coalesce("match_count", F.lit(0))).cast("long").alias("match_count"),
    )
    return decided, hits, close


def check(requests: DataFrame, base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(req_id, decision, rule, identity_conflict, exact_count, best_bp_id, score, match_count) for each request.

    An exact hit is FAIL and runs no fuzzy search; text under three characters is PASS with an
    identity number and INCONCLUSIVE without; a match is FAIL; else PASS.  Without any field: REJECTED.
    """
    return _decided(requests, base, config)[0]


def scan_counts(requests: DataFrame, base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(req_id, eligible, excluded_by_length, scored) of a full scan: parties in the length window, out of it, and
    those that the bounds leave for the exact metrics.

    The window is counted on the length histogram, a row for each length, not on pairs.
    """
    lengths = base.where("norm_text <> ''").groupBy(F.col("text_len").alias("len")).agg(F.count("*").alias("n"))
    own = base.where("norm_text <> ''").select(F.col("bp_id"), F.lit(1).alias("self"))
    asked = requests.where("text_len >= 3").select("req_id", "bp_id", "text_len", T.max_len_diff(F.col("text_len"), config.tolerance_percent, config.tolerance_chars).alias("reach"))
    reached = asked.select("req_id", F.explode(F.sequence(F.greatest(F.col("text_len") - F.col("reach"), F.lit(1)), F.col("text_len") + F.col("reach"))).alias("len"))
    eligible = reached.join(lengths, "len").groupBy("req_id").agg(F.sum("n").alias("within"))
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    scored = candidates(asked.join(requests.select("req_id", "norm_text"), "req_id"), base, config).groupBy("req_id").agg(F.count("*").alias("scored"))
    out = asked.join(eligible, "req_id", "left").join(own, "bp_id", "left").join(scored, "req_id", "left").join(F.broadcast(total)).fillna(0, ["within", "self", "scored"])
    return out.select("req_id", (F.col("within") - F.col("self")).alias("eligible"), (F.col("total") - F.col("within")).alias("excluded_by_length"), "scored")


def respond(requests: DataFrame, base: DataFrame, config: Config = DEFAULT, most: int = 5) -> DataFrame:
    """check, with reason, pass_basis, and candidates: up to five parties without their identity numbers.

    After an exact hit these are the other hits, by kind; else the matches, best first.
    """
    decided, hits, close = _decided(requests, base, config)
    nth = F.row_number().over(Window.partitionBy("req_id", "kind").orderBy("bp_id"))
    exact = hits.withColumn("nth", nth).where("nth > 1").select("req_id", F.col("kind").cast("double").alias("lead"), "bp_id", F.lit(100.0).alias("score"), F.lit("Exact match").alias("reason"))
    fuzzy = close.select("req_id", (-F.col("score")).alias("lead"), "bp_id", "score", F.when(F.col("rule") == "WEIGHTED", REASONS["WEIGHTED"]).otherwise(F.concat("rule", F.lit(" direct reject."))).alias("reason"))
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("lead", "bp_id"))
    shown = exact.union(fuzzy).withColumn("place", place).where(F.col("place") <= most)
    rows = shown.join(base.select("bp_id", "bp_type_id", "name_1", "address"), "bp_id").select("req_id", F.struct("place", T.sanitized(F.col("score"), F.col("reason")).alias("row")).alias("x"))
    listed = rows.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]).alias("candidates"))
    reason = F.element_at(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair)), F.col("rule"))
    basis = F.when(F.col("rule") == "IDENTITY_ONLY", "IDENTITY_EXACT_INDEX_COMPLETE").when(F.col("rule") == "FULL_COVERAGE", "ALL_PARTIES_EVALUATED")
    return decided.join(listed, "req_id", "left").withColumns({"reason": reason, "pass_basis": basis})


def _connected(edges: DataFrame) -> DataFrame:
    """(bp_id, group_id) of all ids in edges (a, b): the least id connected. Each round takes the least of the neighbours', then that one's own."""
    edges = edges.where("a <> b")
    edges = cut(edges.union(edges.select("b", "a")).distinct())
    label = cut(edges.groupBy(F.col("a").alias("bp_id")).agg(F.least(F.first("a"), F.min("b")).alias("group_id")))
    while True:
        near = edges.join(label.select(F.col("bp_id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("bp_id")).agg(F.min("group_id").alias("near"))
        step = label.join(near, "bp_id").select("bp_id", F.col("group_id").alias("was"), F.least("group_id", "near").alias("to"))
        jump = label.select(F.col("bp_id").alias("to"), F.col("group_id").alias("far"))
        moved = cut(step.join(jump, "to", "left").select("bp_id", "was", F.least("to", "far").alias("group_id")))
        label = moved.select("bp_id", "group_id")
        if moved.where("was <> group_id").isEmpty():
            return label


def duplicate_groups(base: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(bp_id, group_id): all parties against all, by exact keys and matches; group_id is the least id connected.

    Parties that share an exact key link with the least of its holders, not with each other. Matches of neighbours in the order
    of texts come next. A pair that could still connect two groups has a party outside the largest one: only those meet
    all others, in either role, and of the matches of two blocks only as many stay as connect them.
    """
    base = cut(base.select("bp_id", "norm_name", "norm_address", "ktp", "npwp", "exact_hash", "norm_text", "text_len"))
    keys = _keys(base.withColumns({"name_1": F.lit(""), "address": F.lit("")}), "bp_id", False)
    least = keys.groupBy("kind", "key").agg(F.min("id").alias("least"))
    same = keys.join(least, ["kind", "key"]).where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    edges = cut(same.union(neighbour_links(base, config)))
    label = _connected(edges)
    held = cut(base.join(label, "bp_id", "left").withColumn("group_id", F.coalesce("group_id", "bp_id")).withColumn("req_id", F.col("bp_id")))
    most = held.groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id").first()
    if most is None:
        return held.select("bp_id", "group_id")
    out = F.col("group_id") != most["group_id"]
    rest, asked = held.where(out), held.where("text_len >= 3")
    close = links(asked.where(out), held, config).union(links(asked.where(~out), rest, config))
    # groups so far are edges of their own
    label = _connected(cut(close.union(label.select(F.col("bp_id").alias("a"), F.col("group_id").alias("b")))))
    return base.select("bp_id").join(label, "bp_id", "left").select("bp_id", F.coalesce("group_id", "bp_id").alias("group_id"))
