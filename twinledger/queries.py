"""The engine's operators as queries over the test tables, with their SQL for DuckDB.

Every document is a party: its first three words are the name, all others the address, and identity
numbers come from its other columns.  For scores, whose cost is the square of a text's length, the
parties are the pages' whole addresses on the web: the host is the name, the rest the address.  Rows
whose id is divisible by 20 are the requests, against all others, with two literal requests for the
short-text rules.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.functions import text as T
from twinledger.operators import bounds, control, indexes, match, sync
from twinledger.plans.config import DEFAULT, Config
from twinledger.plans.lineage import delete, shared_dir
from twinledger.sources import packed, requests, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def party(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("w", F.split(F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")), " "))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("bp_id"), F.concat(F.lit("99"), F.lpad((F.col("doc_id") % 97).cast("string"), 13, "0")).alias("npwp_number"))
    number = F.when(F.col("doc_id") % 3 != 2, F.concat(F.lit("31"), F.lpad(F.col("n_chars").cast("string"), 14, "0")))
    general = docs.select(F.col("doc_id").cast("string").alias("bp_id"), F.upper("lang").alias("bp_type_id"), F.array_join(F.slice("w", 1, 3), " ").alias("name_1"), F.array_join(F.slice("w", F.lit(4), F.greatest(F.size("w") - 3, F.lit(0))), " ").alias("address"))
    numbers = docs.select(F.col("doc_id").cast("string").alias("bp_id"), number.alias("ktp_number"))
    return indexes.source(general, numbers, labels)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, id_ = table(spark, sf_dir, "pages"), F.col("page_id").cast("string").alias("bp_id")
    host = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    general = pages.select(id_, F.lit("WEB").alias("bp_type_id"), host.alias("name_1"), F.substring(F.col("url"), F.length(host) + 1, F.length("url")).alias("address"))
    numbers = pages.select(id_, F.when(F.col("page_id") % 3 != 2, F.concat(F.lit("31"), F.lpad(F.length("html").cast("string"), 14, "0"))).alias("ktp_number"))
    taxes = pages.where("page_id % 5 = 0").select(id_, F.concat(F.lit("99"), F.lpad((F.col("page_id") % 97).cast("string"), 13, "0")).alias("npwp_number"))
    return indexes.source(general, numbers, taxes)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.derive(party(spark, sf_dir))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.derive(links(spark, sf_dir))


def _requests(rows: DataFrame) -> DataFrame:
    literal = rows.sparkSession.createDataFrame([("X1", "EN", "a", "", "", ""), ("X2", "EN", "a", "", "0000000000000000", "")], rows.schema)
    return indexes.derive(rows.where(F.expr("try_cast(bp_id AS bigint) % 20 = 0")).union(literal)).withColumn("req_id", F.col("bp_id"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(party(spark, sf_dir))


def asked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(links(spark, sf_dir))


_STOP = T.STOPWORDS.replace(" ", "|")


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({c})),'[^a-z0-9 ]+',' ','g'),'\b({_STOP})\b',' ','g'),' +',' ','g'))"


def _toks(c: str) -> str:
    return f"list_filter(string_split({c},' '), lambda t: length(t)>=2)"


# array_distinct keeps first places in Spark; here by the first position of each token
def _distinct(c: str) -> str:
    return f"list_filter({c}, lambda t, i: list_position({c}, t) = i)"


PARTY = r"""
w0 AS (SELECT *, string_split(trim(regexp_replace(text,'[ \t\n\x0B\f\r]+',' ','g')),' ') AS w FROM documents),
party AS (SELECT CAST(d.doc_id AS VARCHAR) AS bp_id, upper(lang) AS bp_type_id, array_to_string(w[1:3],' ') AS name_1, array_to_string(w[4:],' ') AS address,
 CASE WHEN d.doc_id%3<>2 THEN '31'||lpad(CAST(n_chars AS VARCHAR),14,'0') ELSE '' END AS ktp_number,
 CASE WHEN l.doc_id IS NOT NULL THEN '99'||lpad(CAST(l.doc_id%97 AS VARCHAR),13,'0') ELSE '' END AS npwp_number
 FROM w0 d LEFT JOIN labels l ON l.doc_id=d.doc_id)"""
LINKS = r"""
u0 AS (SELECT page_id, url, length(html) AS n, regexp_extract(url,'^[a-z]+://[^/]*') AS host FROM pages),
party AS (SELECT CAST(page_id AS VARCHAR) AS bp_id, 'WEB' AS bp_type_id, coalesce(host,'') AS name_1, coalesce(substring(url,length(host)+1),'') AS address,
 CASE WHEN page_id%3<>2 THEN coalesce('31'||lpad(CAST(n AS VARCHAR),14,'0'),'') ELSE '' END AS ktp_number,
 CASE WHEN page_id%5=0 THEN '99'||lpad(CAST(page_id%97 AS VARCHAR),13,'0') ELSE '' END AS npwp_number FROM u0)"""


def _derived(of: str, name: str) -> str:
    return f"""
{name}0 AS (SELECT *, {_norm("name_1")} AS norm_name, {_norm("address")} AS norm_address, {_norm("name_1||' '||address")} AS norm_text, regexp_replace(ktp_number,'[^0-9]+','','g') AS ktp, regexp_replace(npwp_number,'[^0-9]+','','g') AS npwp FROM {of}),
{name}1 AS (SELECT *, CAST(length(norm_text) AS INT) AS text_len, {_toks("norm_text")} AS tk, regexp_extract_all(norm_text,'[0-9]+') AS chunks FROM {name}0),
{name} AS (SELECT *, {_distinct("tk")} AS tokens, CAST(len({_distinct("tk")}) AS INT) AS token_count, CAST(text_len//5 AS INT) AS len_bucket, sha256(norm_name||chr(31)||norm_address) AS exact_hash,
 sha256(CAST(to_json([bp_id,bp_type_id,name_1,address,ktp,npwp]) AS VARCHAR)) AS row_hash FROM {name}1)"""


def _asked(of: str) -> str:
    return (
        of
        + ", reqs AS (SELECT * FROM party WHERE CAST(bp_id AS BIGINT)%20=0 UNION ALL VALUES ('X1','EN','a','','',''),('X2','EN','a','','0000000000000000',''))"
        + ","
        + _derived("reqs", "asked")
        + """,
hit AS (SELECT a.bp_id AS req_id, b.bp_id, 0 AS kind FROM asked a JOIN base b ON a.ktp=b.ktp WHERE a.ktp<>'' AND a.bp_id<>b.bp_id
 UNION ALL SELECT a.bp_id, b.bp_id, 1 FROM asked a JOIN base b ON a.npwp=b.npwp WHERE a.npwp<>'' AND a.bp_id<>b.bp_id
 UNION ALL SELECT a.bp_id, b.bp_id, 2 FROM asked a JOIN base b ON a.norm_name=b.norm_name AND a.norm_address=b.norm_address WHERE trim(a.name_1)<>'' AND trim(a.address)<>'' AND a.bp_id<>b.bp_id)"""
    )


BASE = "WITH " + PARTY + "," + _derived("party", "base")
LINKED = "WITH " + LINKS + "," + _derived("party", "base")
ROWS = BASE + ", db AS (SELECT *, row_number() OVER (ORDER BY len_bucket,token_count,text_len,bp_id)+1 AS bp_db_row FROM base)"
ASKED, ASKED_LINKS = _asked(BASE), _asked(LINKED)
PAIRS = (
    ASKED_LINKS
    + """,
pairs AS (SELECT a.bp_id AS req_id, b.bp_id, a.norm_text AS qt, b.norm_text AS ct, a.tokens AS qk, b.tokens AS ck, a.chunks AS qn, b.chunks AS cn, a.text_len AS ql, b.text_len AS cl, a.token_count AS qc, b.token_count AS cc
 FROM asked a JOIN base b ON abs(a.text_len-b.text_len) <= greatest(12, CAST(floor(a.text_len*0.3+0.5) AS INT)) AND a.bp_id<>b.bp_id WHERE a.norm_text<>'' AND b.norm_text<>'')"""
)


def _lev(a: str, b: str) -> str:
    return f"(CASE WHEN {a}={b} THEN 100.0::DOUBLE WHEN {a}='' OR {b}='' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE,(1-levenshtein({a},{b})::DOUBLE/greatest(length({a}),length({b})))*100) END)"


def _greedy(a: str, b: str, sim: str, weight: str, least: int) -> str:
    """sim and weight are over x and y."""
    cand = f"list_filter(flatten(list_transform({a}, lambda x, i: list_transform({b}, lambda y, j: {{'s': -({sim}), 'i': i, 'j': j, 'w': {weight}}}))), lambda p: p.s <= -{least})"
    start = "{'s': 0.0::DOUBLE, 'i': 0::BIGINT, 'j': 0::BIGINT, 'w': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'n': 0, 'us': []::BIGINT[], 'vs': []::BIGINT[]}"
    items = f"list_transform(list_sort({cand}), lambda p: {{'s': p.s::DOUBLE, 'i': p.i::BIGINT, 'j': p.j::BIGINT, 'w': p.w::DOUBLE, 'm': 0.0::DOUBLE, 'n': 0, 'us': []::BIGINT[], 'vs': []::BIGINT[]}})"
    step = "lambda a, e: CASE WHEN list_contains(a.us, e.i) OR list_contains(a.vs, e.j) THEN a ELSE {'s': e.s, 'i': e.i, 'j': e.j, 'w': e.w, 'm': a.m + e.w*-e.s/100, 'n': a.n+1, 'us': list_append(a.us, e.i), 'vs': list_append(a.vs, e.j)} END"
    return f"list_reduce({items}, {step}, {start})"


_PAIR = f"(CASE WHEN x=y THEN 100.0::DOUBLE WHEN least(length(x),length(y))<4 THEN 0.0::DOUBLE ELSE {_lev('x', 'y')} END)"
_CHUNK = f"(CASE WHEN x=y THEN 100.0::DOUBLE ELSE greatest(CASE WHEN least(length(x),length(y))>=3 AND (contains(x,y) OR contains(y,x)) THEN 65.0::DOUBLE ELSE 0.0::DOUBLE END, {_lev('x', 'y')}) END)"
_W = "least(greatest(length({0}),1),10)::DOUBLE"
_R2 = "floor(({0})*100+0.5)/100"


def _scored(config: Config = DEFAULT) -> str:
    lev, jac, num = config.shares
    return (
        PAIRS
        + f""",
s1 AS (SELECT *, {_R2.format(_lev("qt", "ct"))} AS levenshtein, {_greedy("qk", "ck", _PAIR, "1.0::DOUBLE", 75)} AS jm, {_greedy("qn", "cn", _CHUNK, f"least({_W.format('x')},{_W.format('y')})", 50)} AS nm FROM pairs),
s2 AS (SELECT *, {_R2.format("CASE WHEN len(qk)=0 AND len(ck)=0 THEN 100.0 WHEN len(qk)=0 OR len(ck)=0 THEN 0.0 ELSE jm.m/(len(qk)+len(ck)-jm.n)*100 END")} AS jaccard,
 {_R2.format(f"CASE WHEN len(qn)=0 AND len(cn)=0 THEN 100.0 WHEN len(qn)=0 OR len(cn)=0 THEN 0.0 ELSE nm.m/list_sum(list_transform(qn, lambda c: {_W.format('c')}))*100 END")} AS numeric FROM s1),
s3 AS (SELECT *, {_R2.format(f"levenshtein*{lev!r}::DOUBLE+jaccard*{jac!r}::DOUBLE+numeric*{num!r}::DOUBLE")} AS combined FROM s2),
found AS (SELECT req_id, bp_id, CASE WHEN levenshtein>={config.direct} THEN levenshtein WHEN jaccard>={config.direct} THEN jaccard ELSE combined END AS score,
 CASE WHEN levenshtein>={config.direct} THEN 'LEVENSHTEIN' WHEN jaccard>={config.direct} THEN 'JACCARD' ELSE 'WEIGHTED' END AS rule FROM s3 WHERE levenshtein>={config.direct} OR jaccard>={config.direct} OR combined>={config.threshold})"""
    )


SCORED = _scored()
LOOSE = Config(threshold=70.0, direct=85.0, weights=(30.0, 10.0, 60.0))

# --- source, normalisation, keys -------------------------------------------------------------------


@query("WITH " + PARTY + " SELECT * FROM party")
def source_denormalize(spark, sf_dir):
    return party(spark, sf_dir)


@query(f"SELECT doc_id, sha256({_norm('text')}) AS norm_hash, length({_norm('text')}) AS norm_len FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("n", T.normalize_text(F.col("text"))).select("doc_id", F.sha2("n", 256).alias("norm_hash"), F.length("n").cast("long").alias("norm_len"))


# Text whose letters decompose by compatibility, and what the normalisation makes of it.
_BEYOND, _BEYOND_NORM = "Łukáš Čech ﬁne Ｆｕｌｌ Đà Nẵng ½ İx", "ukas cech fine full a nang 1 2 ix"


@query(f"SELECT doc_id, sha256(trim({_norm('text')}||' {_BEYOND_NORM}')) AS norm_hash FROM documents")
def normalize_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.concat(F.col("text"), F.lit(" " + _BEYOND))), 256).alias("norm_hash"))


@query("SELECT doc_id, sha256(regexp_replace(text,'[^0-9]+','','g')) AS digits_hash FROM documents")
def normalize_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_digits(F.col("text")), 256).alias("digits_hash"))


@query(BASE + " SELECT bp_id, norm_text, text_len, token_count, array_to_string(tokens,' ') AS tokens, regexp_replace(name_1||' '||address,'[^0-9]+','','g') AS norm_digits FROM base")
def token_features(spark, sf_dir):
    return base(spark, sf_dir).select("bp_id", "norm_text", "text_len", "token_count", F.array_join("tokens", " ").alias("tokens"), "norm_digits")


@query(f"SELECT c_custkey, array_to_string(regexp_extract_all({_norm('c_name')},'[0-9]+'),' ') AS chunks FROM customer")
def numeric_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.numeric_tokens(T.normalize_text(F.col("c_name"))), " ").alias("chunks"))


@query("SELECT doc_id, CAST(n_chars//5 AS INT) AS bucket, CASE WHEN n_chars//5<1000 THEN lpad(CAST(n_chars//5 AS VARCHAR),3,'0') ELSE CAST(n_chars//5 AS VARCHAR) END AS bucket_name, greatest(0,n_chars-greatest(12,CAST(floor(n_chars*0.3+0.5) AS BIGINT)))//5 AS low, (n_chars+greatest(12,CAST(floor(n_chars*0.3+0.5) AS BIGINT)))//5 AS high FROM documents")
def len_bucket(spark, sf_dir):
    n, reach = F.col("n_chars"), F.greatest(F.lit(12), F.floor(F.col("n_chars") * 0.3 + 0.5))
    return table(spark, sf_dir, "documents").select("doc_id", T.len_bucket(n).alias("bucket"), T.bucket_name(T.len_bucket(n)).alias("bucket_name"), F.floor(F.greatest(n - reach, F.lit(0)) / 5).alias("low"), F.floor((n + reach) / 5).alias("high"))


@query("WITH " + PARTY + " SELECT bp_id, CASE WHEN length(ktp_number)<=6 THEN repeat('*',length(ktp_number)) ELSE left(ktp_number,4)||repeat('*',greatest(length(ktp_number)-8,0))||right(ktp_number,4) END AS masked FROM party")
def mask_identity(spark, sf_dir):
    return party(spark, sf_dir).select("bp_id", T.mask(F.col("ktp_number")).alias("masked"))


@query("SELECT doc_id, CASE WHEN length(text)>120 THEN substring(text,1,120)||'...' ELSE text END AS preview FROM documents")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(BASE + " SELECT bp_id, exact_hash, substring(exact_hash,1,2) AS exact_shard, lpad(right(ktp,2),2,'0') AS ktp_shard FROM base")
def exact_hash(spark, sf_dir):
    return base(spark, sf_dir).select("bp_id", "exact_hash", T.exact_shard(F.col("exact_hash")).alias("exact_shard"), T.identity_shard(F.col("ktp")).alias("ktp_shard"))


@query(BASE + " SELECT bp_id, row_hash FROM base")
def row_hash(spark, sf_dir):
    return base(spark, sf_dir).select("bp_id", "row_hash")


@query(BASE + " SELECT sha256(string_agg(bp_id||chr(31)||row_hash||chr(10),'' ORDER BY bp_id)) AS source_digest FROM base")
def source_digest(spark, sf_dir):
    return spark.createDataFrame([(indexes.ordered_digest(base(spark, sf_dir)),)], "source_digest string")


@query(LINKED + " SELECT bp_id, sha256(to_json({'p0':norm_text,'p1':ktp,'p2':'92.0'})::VARCHAR) AS fingerprint, list_filter(tokens, lambda t: length(t)>=3 AND t NOT IN ('jl','jalan','rt','rw','no'))[1] AS first_token FROM base")
def query_fingerprint(spark, sf_dir):
    stop = ("jl", "jalan", "rt", "rw", "no")
    return linked(spark, sf_dir).select("bp_id", T.fingerprint(F.col("norm_text"), F.col("ktp"), F.lit(str(DEFAULT.threshold))).alias("fingerprint"), T.first_useful_token(F.col("tokens"), stop).alias("first_token"))


# --- derived tables --------------------------------------------------------------------------------


@query(ROWS + " SELECT bp_id, bp_db_row FROM db")
def base_sort(spark, sf_dir):
    return indexes.base_table(base(spark, sf_dir)).select("bp_id", F.col("bp_db_row").cast("long"))


@query(BASE + " SELECT bp_id, row_number() OVER (ORDER BY len_bucket,token_count,bp_id)+1 AS bp_db_row FROM base")
def keyed_sort(spark, sf_dir):
    return indexes.keyed_table(base(spark, sf_dir)).select("bp_id", F.col("bp_db_row").cast("long"))


@query(ROWS + " SELECT len_bucket, min(bp_db_row) AS row_start, max(bp_db_row) AS row_end, count(*) AS n FROM db GROUP BY 1")
def index_len(spark, sf_dir):
    return indexes.ranges(indexes.base_table(base(spark, sf_dir)), "len_bucket")


@query(ROWS + " SELECT len_bucket, token_count, min(bp_db_row) AS row_start, max(bp_db_row) AS row_end, count(*) AS n FROM db GROUP BY 1,2")
def index_len_token(spark, sf_dir):
    return indexes.ranges(indexes.base_table(base(spark, sf_dir)), "len_bucket", "token_count")


@query(ROWS + " SELECT len_bucket||':'||token_count AS group_key, to_json([norm_text, CAST(bp_db_row AS VARCHAR), bp_id])::VARCHAR AS posting FROM db")
def postings(spark, sf_dir):
    return indexes.postings(indexes.base_table(base(spark, sf_dir)))


@query(ROWS + " SELECT bp_db_row, CASE WHEN CAST(bp_id AS BIGINT)%10=7 THEN 'MISSING' ELSE 'OTHER_ID' END AS fault FROM db WHERE ktp<>'' AND CAST(bp_id AS BIGINT)%10 IN (3,7) UNION ALL SELECT NULL, 'UNREADABLE' FROM db WHERE ktp<>'' AND CAST(bp_id AS BIGINT)%10=5")
def postings_read(spark, sf_dir):
    """Postings with faults put in, read back: rows without their text, of another id, and cut JSON."""
    rows = indexes.base_table(base(spark, sf_dir))
    digit = lambda c: F.col(c).cast("long") % 10
    fuzzy = indexes.postings(rows.where(digit("bp_id") != 7))
    held = rows.withColumn("was", F.col("bp_id")).withColumn("bp_id", F.when(digit("bp_id") == 3, F.concat("bp_id", F.lit("x"))).otherwise(F.col("bp_id")))
    good = indexes.identity_postings(held.where(digit("was") != 5), "ktp")
    torn = indexes.identity_postings(held.where(digit("was") == 5), "ktp").withColumn("posting", F.expr("substring(posting, 1, length(posting) - 3)"))
    return indexes.read_postings(fuzzy, good.union(torn))[1]


@query(ROWS + " SELECT bp_id||CASE WHEN CAST(bp_id AS BIGINT)%4=0 THEN 'x' ELSE '' END AS bp_id, bp_db_row, CAST(bp_id AS BIGINT)%4<>0 AS verified FROM db")
def row_fetch(spark, sf_dir):
    rows = indexes.base_table(base(spark, sf_dir))
    hits = rows.select(F.when(F.col("bp_id").cast("long") % 4 == 0, F.concat("bp_id", F.lit("x"))).otherwise(F.col("bp_id")).alias("bp_id"), "bp_db_row")
    return indexes.fetched(hits, rows).select("bp_id", F.col("bp_db_row").cast("long"), "verified")


@query(ROWS + " SELECT len_bucket, count(*) AS n, min(bp_db_row) AS least FROM db WHERE len_bucket%3=0 GROUP BY 1")
def range_rows(spark, sf_dir):
    rows = indexes.base_table(base(spark, sf_dir))
    wanted = indexes.ranges(rows, "len_bucket").where("len_bucket % 3 = 0").select("row_start", "row_end")
    return indexes.in_ranges(rows, wanted).groupBy("len_bucket").agg(F.count("*").alias("n"), F.min("bp_db_row").cast("long").alias("least"))


def _shards(column: str, shard: str, order: str) -> str:
    return ROWS + f", held AS (SELECT {shard} AS shard, row_number() OVER (ORDER BY {order})+1 AS r FROM db WHERE {column}<>'') SELECT shard, min(r) AS row_start, max(r) AS row_end, count(*) AS n FROM held GROUP BY 1"


@query(_shards("ktp", "lpad(right(ktp,2),2,'0')", "lpad(right(ktp,2),2,'0'),ktp,bp_db_row"))
def shard_map_ktp(spark, sf_dir):
    return indexes.ranges(indexes.identity_index(indexes.base_table(base(spark, sf_dir)), "ktp"), "shard")


@query(_shards("npwp", "lpad(right(npwp,2),2,'0')", "lpad(right(npwp,2),2,'0'),npwp,bp_db_row"))
def shard_map_npwp(spark, sf_dir):
    return indexes.ranges(indexes.identity_index(indexes.base_table(base(spark, sf_dir)), "npwp"), "shard")


@query(_shards("exact_hash", "substring(exact_hash,1,2)", "exact_hash,bp_db_row"))
def shard_map_exact(spark, sf_dir):
    return indexes.ranges(indexes.exact_index(indexes.base_table(base(spark, sf_dir))), "shard")


@query(ROWS + " SELECT count(*) AS n_rows, sum(n)::BIGINT AS covered, count(*) FILTER (n<>m) AS bad FROM (SELECT len_bucket, count(*) AS n FROM db GROUP BY 1) JOIN (SELECT len_bucket, sum(c)::BIGINT AS m FROM (SELECT len_bucket, token_count, count(*) AS c FROM db GROUP BY 1,2) GROUP BY 1) USING (len_bucket)")
def coverage_check(spark, sf_dir):
    rows = indexes.base_table(base(spark, sf_dir))
    whole, split = indexes.ranges(rows, "len_bucket"), indexes.ranges(rows, "len_bucket", "token_count")
    both = whole.join(split.groupBy("len_bucket").agg(F.sum("n").alias("m")), "len_bucket")
    return both.agg(F.count("*").alias("n_rows"), F.sum("n").alias("covered"), F.count_if(F.col("n") != F.col("m")).alias("bad"))


@query(ROWS + ", g AS (SELECT min(bp_db_row) AS row_start, max(bp_db_row) AS row_end FROM db WHERE bp_db_row%10<>3 GROUP BY len_bucket, token_count), p AS (SELECT row_start, coalesce(lag(row_end) OVER (ORDER BY row_start)+1,2) AS expected FROM g) SELECT * FROM p WHERE row_start<>expected")
def contiguity_check(spark, sf_dir):
    """Gaps in the ranges of rows of which every tenth is gone; whole ranges have none (a test)."""
    rows = indexes.base_table(base(spark, sf_dir)).where("bp_db_row % 10 <> 3")
    return indexes.gaps(indexes.ranges(rows, "len_bucket", "token_count")).select(F.col("row_start").cast("long"), F.col("expected").cast("long"))


@query(BASE + " SELECT exact_hash, count(*) AS n FROM base GROUP BY 1 HAVING count(*)>1")
def duplicate_keys(spark, sf_dir):
    return indexes.duplicates(base(spark, sf_dir), "exact_hash")


@query(ROWS + " SELECT bp_id, bp_db_row, CASE WHEN CAST(bp_id AS BIGINT)%10=3 THEN 0 ELSE 2 END::BIGINT AS entries FROM db WHERE CAST(bp_id AS BIGINT)%10 IN (3,7)")
def index_audit(spark, sf_dir):
    """An exact index that lacks some entries and has some twice; a whole one has no findings (a test)."""
    rows, digit = indexes.base_table(base(spark, sf_dir)), F.col("bp_id").cast("long") % 10
    exact = indexes.exact_index(rows)
    return indexes.audit(rows, exact.where(digit != 3).union(exact.where(digit == 7))).select("bp_id", F.col("bp_db_row").cast("long"), "entries")


_TABLES = ("documents", "labels", "customer", "pages")


@query("SELECT sum(greatest(n,100)*c)::BIGINT AS cells FROM (" + " UNION ALL ".join(f"SELECT (SELECT count(*) FROM {t}) AS n, (SELECT count(*) FROM information_schema.columns WHERE table_name='{t}') AS c" for t in _TABLES) + ")")
def capacity(spark, sf_dir):
    out = None
    for name in _TABLES:
        rows = table(spark, sf_dir, name)
        size = rows.agg(F.count("*").alias("n")).withColumn("c", F.lit(len(rows.columns)))
        out = size if out is None else out.union(size)
    return out.agg(F.sum(F.greatest("n", F.lit(100)) * F.col("c")).alias("cells"))


# --- exact joins, conflicts ------------------------------------------------------------------------


@query(ASKED + " SELECT req_id, bp_id FROM hit WHERE kind=0")
def exact_ktp_join(spark, sf_dir):
    return match.exact_hits(asked(spark, sf_dir), base(spark, sf_dir), "ktp")


@query(ASKED + " SELECT req_id, bp_id FROM hit WHERE kind=1")
def exact_npwp_join(spark, sf_dir):
    return match.exact_hits(asked(spark, sf_dir), base(spark, sf_dir), "npwp")


@query(ASKED + " SELECT req_id, bp_id FROM hit WHERE kind=2")
def exact_name_address_join(spark, sf_dir):
    return match.exact_hits(asked(spark, sf_dir), base(spark, sf_dir), "exact_hash")


@query(ASKED + " SELECT a.bp_id AS req_id, b.bp_id FROM asked a JOIN base b ON a.norm_text=b.norm_text AND a.exact_hash=b.exact_hash WHERE trim(a.name_1)<>'' AND trim(a.address)<>'' AND a.bp_id<>b.bp_id")
def exact_by_text(spark, sf_dir):
    return match.by_text(asked(spark, sf_dir), base(spark, sf_dir))


_TWICE = ", h AS (SELECT exact_hash AS req_id, bp_id, bp_db_row FROM db WHERE exact_hash IN (SELECT exact_hash FROM db GROUP BY 1 HAVING count(*)>1)), t AS (SELECT * FROM h UNION ALL SELECT req_id, bp_id, bp_db_row+1000000 FROM h WHERE CAST(bp_id AS BIGINT)%2=1)"


@query(ROWS + _TWICE + ", r AS (SELECT *, row_number() OVER (PARTITION BY req_id,bp_id ORDER BY bp_db_row)>1 AS again FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY again,bp_db_row) AS place FROM r) SELECT req_id, CAST(place AS INT) AS place, bp_id FROM p WHERE place<=5")
def distinct_preview(spark, sf_dir):
    """Previews of exact hits of which some ids come twice: distinct ids first, then repeats."""
    rows = indexes.base_table(base(spark, sf_dir)).select(F.col("exact_hash").alias("req_id"), "bp_id", F.col("bp_db_row").cast("long").alias("bp_db_row"))
    hits = rows.join(rows.groupBy("req_id").count().where("count > 1"), "req_id", "left_semi")
    twice = hits.union(hits.where("cast(bp_id AS bigint) % 2 = 1").withColumn("bp_db_row", F.col("bp_db_row") + 1_000_000))
    return match.distinct_first(twice).select("req_id", "place", "bp_id")


@query(ASKED + ", r AS (SELECT *, row_number() OVER (PARTITION BY req_id,kind ORDER BY bp_id) AS nth FROM hit), p AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY kind,bp_id) AS place FROM r WHERE nth>1) SELECT req_id, CAST(place AS INT) AS place, kind, bp_id FROM p WHERE place<=5")
def exact_preview(spark, sf_dir):
    return match.previews(asked(spark, sf_dir), base(spark, sf_dir))


_CONFLICT = "SELECT req_id, count(DISTINCT bp_id) AS n_ids FROM (SELECT req_id, min(bp_id) AS bp_id FROM hit WHERE kind<2 GROUP BY req_id, kind UNION ALL SELECT req_id, bp_id FROM hit WHERE kind=2) GROUP BY 1 HAVING count(DISTINCT bp_id)>1"


@query(ASKED + " " + _CONFLICT)
def identity_conflict(spark, sf_dir):
    return match.conflicts(asked(spark, sf_dir), base(spark, sf_dir))


# --- fuzzy -----------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    return match.pairs_in_window(asked_links(spark, sf_dir), linked(spark, sf_dir))


def _found(spark, sf_dir, config=DEFAULT):
    return match.find(asked_links(spark, sf_dir), linked(spark, sf_dir), config)


@query(PAIRS + " SELECT req_id, count(*) AS eligible, sum(cl)::BIGINT AS chars FROM pairs GROUP BY 1")
def length_window_join(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("req_id").agg(F.count("*").alias("eligible"), F.sum("text_len").alias("chars"))


@query(PAIRS + " SELECT req_id, count(*) AS kept FROM pairs WHERE 100.0::DOUBLE*least(cl,ql)/greatest(cl,ql)>=79.975 OR (CASE WHEN qc=0 AND cc=0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE*least(qc,cc)/greatest(qc,cc) END)>=79.975 OR (100.0::DOUBLE*least(cl,ql)/greatest(cl,ql))*0.6+(CASE WHEN qc=0 AND cc=0 THEN 100.0::DOUBLE ELSE 100.0::DOUBLE*least(qc,cc)/greatest(qc,cc) END)*0.3+100*0.1>=91.975 GROUP BY 1")
def group_bound_prune(spark, sf_dir):
    return match.bounded_groups(_pairs(spark, sf_dir)).groupBy("req_id").agg(F.count("*").alias("kept"))


@query(SCORED + " SELECT req_id, bp_id, levenshtein, jaccard, numeric, combined FROM s3")
def combined_score(spark, sf_dir):
    return bounds.scored(asked_links(spark, sf_dir), linked(spark, sf_dir))


_SC = "WITH p AS (SELECT s_suppkey, c_custkey, regexp_extract_all(lower(s_name)||' '||lower(n.n_name),'[0-9]+') AS qn, regexp_extract_all(lower(c_name)||' '||lower(m.n_name),'[0-9]+') AS cn FROM supplier JOIN nation n ON s_nationkey=n.n_nationkey JOIN customer ON c_custkey//15=s_suppkey JOIN nation m ON c_nationkey=m.n_nationkey),"


@query(_SC + f" s AS (SELECT *, {_greedy('qn', 'cn', _CHUNK, f'least({_W.format("x")},{_W.format("y")})', 50)} AS nm FROM p) SELECT s_suppkey, c_custkey, {_R2.format(f'nm.m/list_sum(list_transform(qn, lambda c: {_W.format("c")}))*100')} AS numeric FROM s")
def numeric_weighted(spark, sf_dir):
    from twinledger.functions import similarity as S

    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    chunks = lambda name: T.numeric_tokens(F.concat_ws(" ", F.lower(name), F.lower("n_name")))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", chunks("s_name").alias("qn"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.floor(F.col("c_custkey") / 15).alias("of"), chunks("c_name").alias("cn"))
    both = s.join(c, s.s_suppkey == c.of).withColumn("nm", S.match_numbers(F.col("qn"), F.col("cn")))
    return both.select("s_suppkey", "c_custkey", T.round2(S.numeric_weighted(F.col("qn"), F.col("cn"), F.col("nm"))).alias("numeric"))


_TOP = ", r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, bp_id) AS place FROM found) SELECT req_id, bp_id, score, rule, CAST(place AS INT) AS place FROM r WHERE place<="


@query(SCORED + _TOP + "5")
def fuzzy_top5(spark, sf_dir):
    return match.top(_found(spark, sf_dir)).select("req_id", "bp_id", "score", "rule", "place")


@query(SCORED + _TOP + "1")
def best_match(spark, sf_dir):
    return match.top(_found(spark, sf_dir), 1).select("req_id", "bp_id", "score", "rule", "place")


@query(_scored(LOOSE) + " SELECT req_id, bp_id, score, rule FROM found")
def weighted_rule(spark, sf_dir):
    return _found(spark, sf_dir, LOOSE)


@query(SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY combined DESC, bp_id) AS place FROM s3) SELECT req_id, bp_id, combined, CAST(place AS INT) AS place FROM r WHERE place<=5")
def nearest5(spark, sf_dir):
    return match.top(bounds.nearest(asked_links(spark, sf_dir), linked(spark, sf_dir)), 5, "combined").select("req_id", "bp_id", "combined", "place")


_SETTINGS = (DEFAULT, Config(threshold=70.0, direct=60.0), LOOSE)


def _found_sql(config: Config, name: str) -> str:
    """The rows found at one setting, of the scores of SCORED."""
    lev, jac, num = config.shares
    combined = _R2.format(f"levenshtein*{lev!r}::DOUBLE+jaccard*{jac!r}::DOUBLE+numeric*{num!r}::DOUBLE")
    return f"SELECT '{name}' AS setting, count(*) AS matches, 0::BIGINT AS differing FROM s3 WHERE levenshtein>={config.direct} OR jaccard>={config.direct} OR {combined}>={config.threshold}"


@query(SCORED + " " + " UNION ALL ".join(_found_sql(c, f"s{i}") for i, c in enumerate(_SETTINGS)))
def bound_parity(spark, sf_dir):
    """For three settings, the matches found by bounds over blocks, and in how many they differ from brute force."""
    found = bounds.parity(asked_links(spark, sf_dir), linked(spark, sf_dir), _SETTINGS)
    return found.select(F.concat(F.lit("s"), "setting").alias("setting"), "matches", "differing")


@query(PAIRS + ", e AS (SELECT req_id, count(*) AS eligible FROM pairs GROUP BY 1), w AS (SELECT a.bp_id AS req_id, count(*) AS outside FROM asked a JOIN base b ON abs(a.text_len-b.text_len) > greatest(12, CAST(floor(a.text_len*0.3+0.5) AS INT)) AND b.norm_text<>'' GROUP BY 1) SELECT a.bp_id AS req_id, coalesce(eligible,0) AS eligible, coalesce(outside,0) AS excluded_by_length FROM asked a LEFT JOIN e ON e.req_id=a.bp_id LEFT JOIN w ON w.req_id=a.bp_id WHERE a.text_len>=3")
def scan_counters(spark, sf_dir):
    return match.scan_counts(asked_links(spark, sf_dir), linked(spark, sf_dir)).select("req_id", "eligible", "excluded_by_length")


_CHECK = (
    SCORED
    + f""",
conf AS ({_CONFLICT}),
h AS (SELECT req_id, min(bp_id) FILTER (kind=0) AS k, min(bp_id) FILTER (kind=1) AS n, min(bp_id) FILTER (kind=2) AS e, count(*) FILTER (kind=2) AS ne FROM hit GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, bp_id) AS place, count(*) OVER (PARTITION BY req_id) AS mc FROM found),
st AS (SELECT a.bp_id AS req_id, a.text_len, length(a.ktp)+length(a.npwp)>0 AS ident, trim(a.name_1)<>'' OR trim(a.address)<>'' AS txt, h.req_id IS NOT NULL AS exact, h.k, h.n, h.e, coalesce(h.ne,0) AS ne, conf.req_id IS NOT NULL AS conflict,
 CASE WHEN a.text_len>=3 AND h.req_id IS NULL THEN r.bp_id END AS fid, r.score, r.rule AS frule, r.mc FROM asked a LEFT JOIN h ON h.req_id=a.bp_id LEFT JOIN conf ON conf.req_id=a.bp_id LEFT JOIN r ON r.req_id=a.bp_id AND r.place=1),
d AS (SELECT *, CASE WHEN NOT ident AND NOT txt THEN 'NO_INPUT' WHEN exact THEN CASE WHEN conflict THEN 'IDENTITY_CONFLICT' WHEN k IS NOT NULL THEN 'KTP' WHEN n IS NOT NULL THEN 'NPWP' ELSE 'NAME_ADDRESS' END
 WHEN text_len<3 THEN CASE WHEN ident THEN 'IDENTITY_ONLY' ELSE 'SHORT_TEXT' END WHEN fid IS NOT NULL THEN frule ELSE 'FULL_COVERAGE' END AS rule FROM st)
SELECT req_id, CASE WHEN rule='NO_INPUT' THEN 'REJECTED' WHEN rule='SHORT_TEXT' THEN 'INCONCLUSIVE' WHEN rule IN ('IDENTITY_ONLY','FULL_COVERAGE') THEN 'PASS' ELSE 'FAIL' END AS decision, rule, conflict AS identity_conflict, ne AS exact_count,
 CASE WHEN exact THEN coalesce(k,n,e) ELSE fid END AS best_bp_id, CASE WHEN exact THEN 100.0::DOUBLE WHEN fid IS NOT NULL THEN score END AS score, CASE WHEN exact OR fid IS NULL THEN 0 ELSE mc END::BIGINT AS match_count FROM d"""
)


@query(_CHECK)
def check_batch(spark, sf_dir):
    return match.check(asked_links(spark, sf_dir), linked(spark, sf_dir))


_REASON = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in match.REASONS.items()) + " END"


@query(
    _CHECK.rsplit("\nSELECT req_id, CASE WHEN rule", 1)[0]
    + """,
xs AS (SELECT req_id, kind::DOUBLE AS lead, bp_id FROM (SELECT *, row_number() OVER (PARTITION BY req_id,kind ORDER BY bp_id) AS nth FROM hit) WHERE nth>1 UNION ALL SELECT f.req_id, -f.score, f.bp_id FROM found f JOIN d ON d.req_id=f.req_id WHERE NOT d.exact AND d.text_len>=3),
ys AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY lead,bp_id) AS place FROM xs),
zs AS (SELECT req_id, string_agg(bp_id,',' ORDER BY place) AS candidate_ids FROM ys WHERE place<=5 GROUP BY 1)
SELECT d.req_id, """
    + _REASON
    + """ AS reason, CASE rule WHEN 'IDENTITY_ONLY' THEN 'IDENTITY_EXACT_INDEX_COMPLETE' WHEN 'FULL_COVERAGE' THEN 'ALL_PARTIES_EVALUATED' END AS pass_basis, candidate_ids FROM d LEFT JOIN zs ON zs.req_id=d.req_id"""
)
def check_response(spark, sf_dir):
    made = match.respond(asked_links(spark, sf_dir), linked(spark, sf_dir))
    return made.select("req_id", "reason", "pass_basis", F.array_join(F.transform("candidates", lambda c: c["bp_id"]), ",").alias("candidate_ids"))


@query()
def duplicate_groups(spark, sf_dir):
    """All links against all: the least id that each is connected with. Tested on a small fixture."""
    return match.duplicate_groups(linked(spark, sf_dir))


@query()
def check_lines(spark, sf_dir):
    """Every line of every document is a party, and those of documents divisible by 20 are requests.

    SQL scores every pair of the length window, which doesn't end on these; tested on a small fixture.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where("trim(line) <> ''")
    rows = lines.select(F.concat_ws(":", "doc_id", "at").alias("bp_id"), F.lit("LINE").alias("bp_type_id"), F.lit("").alias("name_1"), F.col("line").alias("address"), F.lit("").alias("ktp_number"), F.lit("").alias("npwp_number"), "doc_id")
    held = indexes.derive(rows)
    return match.check(held.where("doc_id % 20 = 0").withColumn("req_id", F.col("bp_id")), held)


@query()
def synthetic_check(spark, sf_dir):
    """As many synthetic parties as there are orders, and one of a hundred of them perturbed as requests: the engine at size."""
    rows = synthetic.parties(spark, table(spark, sf_dir, "orders").count())
    made = synthetic.perturbed(rows.where("cast(bp_id AS bigint) % 100 = 0")).withColumns({"bp_id": F.concat("bp_id", F.lit("p")), "ktp_number": F.lit(""), "npwp_number": F.lit("")})
    return match.check(indexes.derive(made).withColumn("req_id", F.col("bp_id")), indexes.derive(rows))


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS req_id, CASE doc_id%6 WHEN 0 THEN source WHEN 1 THEN lang ELSE '' END AS name_1, CASE WHEN doc_id%6=5 THEN repeat('a',70000) ELSE '' END AS address,"
    " CASE WHEN doc_id%6=2 THEN CAST(n_chars AS VARCHAR) WHEN doc_id%6=3 THEN '-' ELSE '' END AS ktp_number, '' AS npwp_number, CASE doc_id%6 WHEN 3 THEN 'NO_INPUT' WHEN 4 THEN 'BAD_JSON' WHEN 5 THEN 'TOO_LARGE' END AS error FROM documents"
)
def request_parse(spark, sf_dir):
    """A body for each document, of six kinds: both aliases of the name, digits, no input, cut JSON, too many bytes."""
    json = lambda **fields: F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    kinds = [
        json(name_1=F.concat(F.lit("  "), "source"), name1=F.lit("other")), json(name_1=F.lit(" "), name1=F.col("lang")), json(ktp=F.col("n_chars").cast("string")),
        json(ktp=F.lit("-")), F.lit('{"name_1": "x"'), json(address=F.repeat(F.lit("a"), 70_000)),
    ]
    body = F.coalesce(*(F.when(F.col("doc_id") % 6 == i, k) for i, k in enumerate(kinds)))
    return requests.parse(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("req_id"), body.alias("body")))


# --- delta -----------------------------------------------------------------------------------------

_V = (
    "WITH "
    + PARTY
    + ", v2p AS (SELECT bp_id,bp_type_id,name_1,CASE WHEN CAST(bp_id AS BIGINT)%11=0 THEN address||' rev' ELSE address END AS address,ktp_number,npwp_number FROM party WHERE CAST(bp_id AS BIGINT)%13<>0), v1p AS (SELECT * FROM party WHERE CAST(bp_id AS BIGINT)%7<>0),"
    + _derived("v1p", "v1")
    + ","
    + _derived("v2p", "v2")
    + ", e AS (SELECT *, row_number() OVER (ORDER BY len_bucket,token_count,text_len,bp_id)+1 AS bp_db_row FROM v1)"
)


def _versions(spark, sf_dir):
    """An older state (with rows and deletion marks) and the source that follows it."""
    rows, key = party(spark, sf_dir), F.col("bp_id").cast("long")
    new = rows.where(key % 13 != 0).withColumn("address", F.when(key % 11 == 0, F.concat("address", F.lit(" rev"))).otherwise(F.col("address")))
    old = indexes.base_table(indexes.derive(rows.where(key % 7 != 0))).withColumn("is_deleted", F.lit(False))
    columns = [*indexes.FIELDS, "row_hash"]
    return old.select(*columns, F.col("bp_db_row").cast("long").alias("bp_db_row"), "is_deleted"), indexes.derive(new).select(*columns)


@query(_V + " SELECT coalesce(v2.bp_id,e.bp_id) AS bp_id, CASE WHEN e.bp_id IS NULL THEN 'create' WHEN v2.bp_id IS NULL THEN 'tombstone' WHEN v2.address<>e.address THEN 'change' ELSE 'unchanged' END AS change FROM v2 FULL JOIN e ON v2.bp_id=e.bp_id")
def delta_classify(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.classify(new, old)


@query(_V + " SELECT bp_id FROM e WHERE bp_id NOT IN (SELECT bp_id FROM v2)")
def tombstones(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.tombstones(new, old)


@query(_V + " SELECT bp_id FROM v2 WHERE bp_id NOT IN (SELECT bp_id FROM e)")
def creates(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.creates(new, old)


@query(_V + ", f AS (SELECT bp_id, row_number() OVER (ORDER BY bp_id)+(SELECT max(bp_db_row) FROM e) AS r FROM v2 WHERE bp_id NOT IN (SELECT bp_id FROM e)) SELECT coalesce(v2.bp_id,e.bp_id) AS bp_id, coalesce(v2.address,e.address) AS address, coalesce(v2.row_hash,e.row_hash) AS row_hash, coalesce(e.bp_db_row,f.r) AS bp_db_row, v2.bp_id IS NULL AS is_deleted FROM v2 FULL JOIN e ON v2.bp_id=e.bp_id LEFT JOIN f ON f.bp_id=v2.bp_id")
def apply_delta(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.apply(new, old).select("bp_id", "address", "row_hash", F.col("bp_db_row").cast("long"), "is_deleted")


@query(_V + " SELECT bp_id, CASE WHEN CAST(bp_id AS BIGINT)%5=0 THEN 'hash_only' ELSE 'unchanged' END AS change FROM v1")
def hash_only(spark, sf_dir):
    old, _ = _versions(spark, sf_dir)
    source = old.select(*indexes.FIELDS, F.when(F.col("bp_id").cast("long") % 5 == 0, F.lit("x")).otherwise(F.col("row_hash")).alias("row_hash"))
    return sync.classify(source, old)


# --- dictionaries and histograms -------------------------------------------------------------------


@query(BASE + " SELECT token, CAST(length(token) AS INT) AS len, count(*) AS parties FROM (SELECT unnest(tokens) AS token FROM base) GROUP BY 1")
def token_dictionary(spark, sf_dir):
    return base(spark, sf_dir).select(F.explode("tokens").alias("token")).groupBy("token", F.length("token").alias("len")).agg(F.count("*").alias("parties"))


@query(BASE + " SELECT text_len, count(*) AS n, (sum(count(*)) OVER (ORDER BY text_len))::BIGINT AS upto FROM base GROUP BY 1")
def length_histogram(spark, sf_dir):
    from pyspark.sql import Window

    return base(spark, sf_dir).groupBy("text_len").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("text_len")))


_BINS = " 0123456789abcdefghijklmnopqrstuvwxyz"


@query(BASE + f" SELECT bp_id, array_to_string(list_transform(string_split('{_BINS}',''), lambda c: length(norm_text)-length(replace(norm_text,c,''))),',') AS bins FROM base")
def char_histogram(spark, sf_dir):
    """Counts of space, ten digits and 26 letters."""
    bins = [F.length("norm_text") - F.length(F.translate("norm_text", c, "")) for c in _BINS]
    return base(spark, sf_dir).select("bp_id", F.concat_ws(",", *(x.cast("string") for x in bins)).alias("bins"))


_CODE = f"(strpos('{_BINS}',substring(norm_text,i,1))-1)*37+strpos('{_BINS}',substring(norm_text,i+1,1))-1"


@query(LINKED + f" SELECT bp_id, CAST(place AS INT) AS place, count(*) AS n FROM (SELECT bp_id, unnest(list_transform(range(1,length(norm_text)), lambda i: ({_CODE})%256)) AS place FROM base) GROUP BY 1,2")
def party_bigrams(spark, sf_dir):
    """Bigram counts of each link in 256 places, as the bounds use them."""
    chars = linked(spark, sf_dir).where("length(norm_text) >= 2").select("bp_id", F.posexplode(F.split("norm_text", "")).alias("at", "c")).where("c <> ''")
    number = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(_BINS) for x in (c, i))), F.col("c"))
    pairs = chars.select("bp_id", "at", number.alias("code"))
    nxt = pairs.select("bp_id", (F.col("at") - 1).alias("at"), F.col("code").alias("after"))
    return pairs.join(nxt, ["bp_id", "at"]).groupBy("bp_id", ((F.col("code") * 37 + F.col("after")) % 256).alias("place")).agg(F.count("*").alias("n"))


@query(BASE + " SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1,length(norm_text)), lambda i: substring(norm_text,i,2))) AS bigram FROM base) GROUP BY 1")
def bigram_profile(spark, sf_dir):
    return bounds.bigrams(base(spark, sf_dir).select("norm_text"))


# --- controls --------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute',ts) ORDER BY ts,event_id) AS nth FROM events) WHERE nth>1")
def rate_limit_fixed(spark, sf_dir):
    return control.over_rate(table(spark, sf_dir, "events"), "event_type", 1).select("event_id", "event_type", "nth")


# next: of each moment, the first event a minute or more later; an admitted event leads to that one
_ROLLING = """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1,2),
nx AS (SELECT a.user_id, a.ts, a.event_id, b.ts AS nts FROM e a ASOF LEFT JOIN e b ON a.user_id=b.user_id AND a.ts + INTERVAL 60 SECOND <= b.ts),
ad AS (SELECT nx.* FROM nx JOIN (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1) f USING (user_id, ts) UNION ALL SELECT nx.* FROM ad JOIN nx ON nx.user_id=ad.user_id AND nx.ts=ad.nts)
SELECT v.event_id, ad.event_id=v.event_id AS admitted, 1::BIGINT AS used, CAST(ceil((epoch_us(ad.ts)+60000000-epoch_us(v.ts))/1000000.0) AS BIGINT) AS pause_seconds FROM events v ASOF JOIN ad ON v.user_id=ad.user_id AND v.ts >= ad.ts"""


@query(_ROLLING)
def rate_budget_rolling(spark, sf_dir):
    return control.rolling_budget(table(spark, sf_dir, "events"), "user_id", 1)


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value)-1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT s AS share, value FROM r JOIN (VALUES (0.5::DOUBLE),(0.95::DOUBLE),(1.0::DOUBLE)) t(s) ON place=least(n-1,CAST(floor(s*n) AS BIGINT))")
def latency_percentiles(spark, sf_dir):
    return control.percentiles(table(spark, sf_dir, "events"), "value")


@query(BASE + ", g AS (SELECT len_bucket, token_count, count(*) AS n FROM base GROUP BY 1,2), o AS (SELECT *, (sum(n) OVER (ORDER BY n,len_bucket,token_count ROWS UNBOUNDED PRECEDING))::BIGINT-n AS before FROM g) SELECT * FROM o WHERE before<300")
def scan_budget_prefix(spark, sf_dir):
    return control.scan_prefix(base(spark, sf_dir).groupBy("len_bucket", "token_count").agg(F.count("*").alias("n")), 300)


@query(BASE + ", m AS (SELECT 'total_bp_rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM base UNION ALL SELECT 'total_ktp_rows', CAST(count(*) FILTER (ktp<>'') AS VARCHAR) FROM base UNION ALL SELECT 'source_digest', sha256(string_agg(bp_id||chr(31)||row_hash||chr(10),'' ORDER BY bp_id)) FROM base UNION ALL SELECT 'sync_state','READY') SELECT key, value FROM m")
def meta_map(spark, sf_dir):
    rows = base(spark, sf_dir)
    counts = rows.agg(F.count("*").cast("string").alias("total_bp_rows"), F.count_if(F.col("ktp") != "").cast("string").alias("total_ktp_rows"))
    listed = counts.select(F.explode(F.create_map(F.lit("total_bp_rows"), "total_bp_rows", F.lit("total_ktp_rows"), "total_ktp_rows", F.lit("sync_state"), F.lit("READY"))).alias("key", "value"))
    return listed.union(spark.createDataFrame([("source_digest", indexes.ordered_digest(rows))], "key string, value string"))


@query("WITH " + PARTY + r" SELECT bp_id, bp_type_id, translate(name_1,chr(9)||chr(13)||chr(10),'   ') AS name_1, translate(address,chr(9)||chr(13)||chr(10),'   ') AS address, ktp_number AS ktp_digits, npwp_number AS npwp_digits FROM party")
def packed_roundtrip(spark, sf_dir):
    at = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    manifest = packed.store(party(spark, sf_dir), "20240101T000000-000000000000", at)
    rows = packed.load(spark, at, manifest, at + "-rows")
    delete(spark, at)
    return rows
