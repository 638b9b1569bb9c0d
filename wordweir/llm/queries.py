"""One query per corpus operator, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, line_dedup, near_dedup, packing, sharding, token_counts, topk, url_filter, warc
from .common import table

#: Documents with occurring windows of at least so many items are contaminated.
CONTAMINATED_ITEMS = 2
TOKEN_LIMIT = 4096
TOP, QUERY_STEP, VECTOR_SCALE = 20, 20, 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), (F.col("n_items") >= CONTAMINATED_ITEMS).alias("contaminated")
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("id"), topk.integer_vector(F.col("embedding"), VECTOR_SCALE).alias("v")
    )
    found = topk.top_k(rows, rows.where(F.col("id") % QUERY_STEP == 0), TOP)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (~language_id.learnable("doc_id")).alias("held_out"), "lang_pred", "score", "familiarity", "accepted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.col("record.text")
    return sharded.select(
        "record.doc_id", sharding.record_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can express: all but the shuffled places and the checksum."""
    return op5_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "grown_shard")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("record.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    read = warc.read_archives(warc.archive_files(spark, warc.write_archives(pages)))
    kind = pages.schema["page_id"].dataType
    return read.select(
        F.expr("nullif(record_id, '')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_near_dedup, op3_topk, op4_language_id, op5_sharding,
        op6_line_dedup, op7_url_filter, op8_warc, op9_packing, op10_token_counts, shard_law,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text,''),{_AZ}),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w),8) n, array_to_string(w[p:p+7],' ') g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w)-7,1)+1)) p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () r, {_WORDS} w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, p, array_to_string(w[p:p+n-1],' ') g
      FROM (SELECT r, w, n, unnest(range(1, len(w)-n+2)) p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.r, g.p, g.n, win.item FROM g JOIN win ON g.n = win.n AND g.g = win.g),
pos AS (SELECT r, count(DISTINCT q) n_hit FROM (SELECT r, unnest(range(p, p+n)) q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit,0) AS BIGINT) n_hit, CAST(coalesce(n_items,0) AS BIGINT) n_items,
       sha256(coalesce(items,'')) items_sha256, coalesce(n_items,0) >= 2 contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)""",
    "op2_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text,'') txt, {_WORDS} w FROM documents),
sh AS (SELECT doc_id, array_to_string(w[p:p+4],' ') g, len(w) k
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4,1)+1)) p FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, g, count(*) n FROM sh GROUP BY doc_id, g, (CASE WHEN k < 5 THEN k END)),
t AS (SELECT doc_id, sum(n) n FROM c GROUP BY doc_id),
pairs AS (SELECT a.doc_id x, b.doc_id y, sum(least(a.n,b.n)) same FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM pairs JOIN t p ON p.doc_id = x JOIN t q ON q.doc_id = y WHERE same*10 >= (p.n+q.n-same)*8
      UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.txt = b.txt AND a.doc_id < b.doc_id WHERE len(a.w) = 0 AND len(b.w) = 0),
u AS (SELECT x a, y b FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, low) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, reach.low FROM reach JOIN u ON u.a = reach.doc_id WHERE reach.low < u.b),
cls AS (SELECT doc_id, min(low) class_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(t.n,0) AS BIGINT) n_shingles, class_id, count(*) OVER (PARTITION BY class_id) class_size
FROM cls LEFT JOIN t USING (doc_id)""",
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 64)) v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "shard_law": f"""
WITH r AS (SELECT doc_id, text, list_transform(range(0, 9), lambda s: {{'h': md5(concat(coalesce(CAST(doc_id AS VARCHAR), '~'), ':{sharding.SEED}:', s)), 's': s}}) r FROM documents)
SELECT doc_id, CAST(strlen(coalesce(text,'')) + 1 AS BIGINT) size, 'key' law, CAST(list_reverse_sort(r[1:8])[1].s AS INTEGER) shard,
       CAST(list_reverse_sort(r)[1].s AS INTEGER) grown_shard
FROM r""",
    "op6_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text,''), chr(10))) line, generate_subscripts(string_split(coalesce(text,''), chr(10)),1) p FROM documents),
k AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),{_AZ}) key FROM l),
h AS (SELECT key, max(doc_id) owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, h.owner IS NOT NULL AND h.owner <> doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) kept_sha256
FROM m GROUP BY doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html,'') html, upper(sha1(coalesce(html,''))) h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_transform(range(0,8), lambda i: CAST('0x' || substr(h, CAST(i*5+1 AS INTEGER), 5) AS BIGINT)) n FROM f)
SELECT page_id, CAST(strlen(html) AS BIGINT) payload_bytes,
       array_to_string(list_transform(range(0,32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((n[j//4+1] >> CAST(15-5*(j%4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END record_type,
       CASE WHEN page_id <> first_id THEN first_id END refers_to
FROM b""",
}
