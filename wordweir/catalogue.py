"""Every query over the text tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import prefix_compare, prefix_key, prefix_tail, prefix_word, size_bytes
from .operators import profile as P
from .operators.offsets import order
from .operators.scan import words, words_by_window
from .plans.merge_plan import plan_of
from .sources.store import Run, manifest, read_profile, write_profile
from .sources.tables import TEXTS, read
from .session import scratch
from .streaming.incremental import follow_to_table, latest, running_profile

SEGMENT_BYTES = 65536
TOP = 10
#: Inputs of the size parser (fixed values).
SIZES = (
    "4096", "4096b", "64k", "64KB", "512m", "512MB", "1g", "2GB", "3t", "0", "k", "1.5g", "12 k", "-1", "1kk", "", "4096\n", "9999999t", "17179869184g",
    "99999999999999999999", "9223372036854775807", "9223372036854775808", "8388607t", "8388608t",
)

Query = Callable[[SparkSession, str], DataFrame]


def _profile(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    t = TEXTS[name]
    return P.profile(read(spark, folder, name), t.key, t.text)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return P.segment_profiles(read(spark, folder, "documents"), SEGMENT_BYTES)


def word_scan(spark: SparkSession, folder: str) -> DataFrame:
    return words(read(spark, folder, "documents"))


def word_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder).select(*P.SMALL)


def singular_words(spark: SparkSession, folder: str) -> DataFrame:
    return P.singular(_profile(spark, folder)).select("word", "occur")


def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    return P.repeated(_profile(spark, folder)).select("word")


def find_first(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_words(_profile(spark, folder))


def find_first_none(spark: SparkSession, folder: str) -> DataFrame:
    """A profile merged with itself has no word left that does not repeat."""
    p = _profile(spark, folder)
    return P.first_words(P.merge(p, p))


def find_top_n(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_words(_profile(spark, folder), TOP)


def singular_list(spark: SparkSession, folder: str) -> DataFrame:
    return P.in_order(_profile(spark, folder))


def word_count(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder).select("word", "n")


def first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder).select("word", "first_off")


def segment_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).select("segment_id", *P.SMALL)


def segment_stats(spark: SparkSession, folder: str) -> DataFrame:
    return P.segment_statistics(_segments(spark, folder))


def segment_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """First and last byte of each segment, and the size of its profile."""
    docs = read(spark, folder, "documents")
    total = P.virtual_size(docs)
    start = F.col("segment_id") * SEGMENT_BYTES
    end = F.least(start + SEGMENT_BYTES, F.lit(total)) - 1
    return segment_stats(spark, folder).select("segment_id", start.alias("start"), end.alias("end"), F.col("profile_bytes").alias("size"))


def _halves(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The profiles of the first half of the segments and of the rest: together the whole table, each text scanned for one of them."""
    docs = read(spark, folder, "documents")
    middle = P.virtual_size(docs) // SEGMENT_BYTES // 2 * SEGMENT_BYTES
    table = order(docs, ("doc_id",), "text", SEGMENT_BYTES)
    halves = (P.ordered_segments(table, SEGMENT_BYTES, end=middle), P.ordered_segments(table, SEGMENT_BYTES, start=middle))
    return [P.merge(h.select(*P.SMALL)) for h in halves]


def merge_two(spark: SparkSession, folder: str) -> DataFrame:
    return P.merge(*_halves(spark, folder))


def merge_all(spark: SparkSession, folder: str) -> DataFrame:
    return P.merge(_segments(spark, folder).select(*P.SMALL))


def merge_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    return P.merge_outer(*_halves(spark, folder))


def stored_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The profile written as a sorted table, and read back."""
    path = scratch(spark, "profile")
    write_profile(_profile(spark, folder).select(*P.SMALL), path)
    return read_profile(spark, path)


def _run(spark: SparkSession, folder: str) -> tuple[Run, int, int]:
    """A run over the table in four waves of segments, with the number of segments and bytes."""
    docs = read(spark, folder, "documents")
    size = P.virtual_size(docs)
    run = Run(spark, scratch(spark, "run"), folder, wave=max(1, -(-size // SEGMENT_BYTES // 4)))
    table = order(docs, ("doc_id",), "text", SEGMENT_BYTES)
    n = run.store_segments(lambda a, b: P.ordered_segments(table, SEGMENT_BYTES, a, b), size, SEGMENT_BYTES)
    return run, n, size


def run_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The merge of a run's stored segments, which are deleted after it."""
    run, n, _ = _run(spark, folder)
    return run.merge(n).select(*P.SMALL)


def run_manifest(spark: SparkSession, folder: str) -> DataFrame:
    run, _, size = _run(spark, folder)
    return manifest(run.segments(), SEGMENT_BYTES, size)


def word_profile_by_sort(spark: SparkSession, folder: str) -> DataFrame:
    """The same profile from built-in functions only, which sort every word."""
    return P.profile_words(words_by_window(read(spark, folder, "documents"))).select(*P.SMALL)


def profile_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return P.profile_bytes(_profile(spark, folder))


def prefix_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _profile(spark, folder).select("word", prefix_key(F.col("word")).alias("prefix_hex"))


def prefix_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Each word from its prefix and tail, and how it compares with the least word of the same prefix."""
    words = _profile(spark, folder).select("word", prefix_key(F.col("word")).alias("prefix_hex"), prefix_tail(F.col("word")).alias("tail_hex"))
    least = words.groupBy("prefix_hex").agg(F.min("word").alias("least"))
    both = words.join(least, "prefix_hex")
    return both.select("word", "tail_hex", prefix_word(F.col("prefix_hex"), F.col("tail_hex")).alias("rebuilt"), prefix_compare(F.col("word"), F.col("least")).alias("compared"))


def memory_size_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SIZES], "text string")
    return rows.select("text", size_bytes(F.col("text")).alias("bytes"))


def merge_plan_dp(spark: SparkSession, folder: str) -> DataFrame:
    return plan_of(spark, segment_stats(spark, folder))


def merge_plan_simple(spark: SparkSession, folder: str) -> DataFrame:
    return plan_of(spark, segment_stats(spark, folder), "pairwise")


def incremental_count(spark: SparkSession, folder: str) -> DataFrame:
    """What the streaming profile holds after all rows, computed as a batch by the same function."""
    return running_profile(read(spark, folder, "documents")).select("word", "n", "repeated")


def streamed_count(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming profile itself: the table is read as a stream to its end, and the newest row of each word read back."""
    place = scratch(spark, "stream")
    docs = read(spark, folder, "documents")
    # as a pattern, so that a table of one file may be followed like a folder
    follow_to_table(spark, f"{folder}/documents.parque[t]", docs.schema, f"{place}/checkpoint", f"{place}/out").awaitTermination()
    return latest(spark, f"{place}/out").select("word", "n", "repeated")


def find_first_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    by_lang = P.profile(read(spark, folder, "documents"), by=["lang"])
    return P.first_word_by(by_lang, ["lang"]).select("lang", "word", "occur")


def top_n_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    by_lang = P.profile(read(spark, folder, "documents"), by=["lang"])
    return P.ranked_words_by(by_lang, ["lang"], TOP)


def _first_of(name: str) -> Query:
    return lambda spark, folder: P.first_words(_profile(spark, folder, name), TOP)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        word_scan, word_profile, singular_words, repeated_words, find_first, find_first_none, find_top_n, singular_list, word_count,
        first_occurrence, segment_profile, segment_stats, segment_manifest, merge_two, merge_all, merge_full_outer,
        stored_profile, run_profile, run_manifest, word_profile_by_sort, profile_bytes, prefix_round_trip, memory_size_parse, merge_plan_dp, merge_plan_simple, incremental_count, streamed_count,
        find_first_by_lang, top_n_by_lang,
    )
} | {"prefix_key": prefix_keys} | {f"first_words_{t}": _first_of(t) for t in TEXTS if t != "documents"}


def _words_sql(name: str = "documents", more: str = "") -> str:
    """CTE w(word, off): tokens, empty ones included until their delimiters are summed."""
    t = TEXTS[name]
    key, text = ", ".join(t.key), f"coalesce({t.text}, '')"
    split = "string_split_regex(txt, '[ \\t\\n\\r]')"
    return f"""
WITH b AS (SELECT {key}{more}, {text} txt, coalesce(sum(strlen({text}) + 1) OVER (ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) base FROM {name}),
t AS (SELECT {key}{more}, base, unnest({split}) word, generate_subscripts({split}, 1) pos FROM b),
w AS (SELECT * FROM (SELECT {key}{more}, word, CAST(base + coalesce(sum(strlen(word) + 1) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM t) WHERE word <> ''),
p AS (SELECT word, count(*) n, min(off) first_off, count(*) > 1 repeated, CASE WHEN count(*) = 1 THEN min(off) END occur FROM w GROUP BY word),
seg AS (SELECT CAST(off // {SEGMENT_BYTES} AS BIGINT) segment_id, word, count(*) > 1 repeated, CASE WHEN count(*) = 1 THEN min(off) END occur FROM w GROUP BY 1, 2)"""


_W = _words_sql()
_SIZE = "strlen(word) + 2 + if(repeated, 0, 8)"
_UNIT = "lower(regexp_extract(text, '^([0-9]+)([kKmMgGtT])?[bB]?$', 2))"
_LANG = "SELECT lang, word, min(off) occur, row_number() OVER (PARTITION BY lang ORDER BY min(off)) AS rank FROM w GROUP BY lang, word HAVING count(*) = 1"

_STATS = f"{_W}, st AS (SELECT segment_id, CAST(sum({_SIZE}) AS BIGINT) size FROM seg GROUP BY 1)"
#: Level by level: ids of the level, the next new id.
_PAIRS = f"""{_STATS.replace("WITH b AS", "WITH RECURSIVE b AS", 1)},
r(ids, fresh) AS (SELECT list(segment_id ORDER BY segment_id), max(segment_id) + 1 FROM st
  UNION ALL SELECT list_concat(range(fresh, fresh + len(ids) // 2), ids[len(ids) - len(ids) % 2 + 1:]), fresh + len(ids) // 2 FROM r WHERE len(ids) > 1),
u AS (SELECT ids, fresh, unnest(range(0, len(ids) // 2)) i FROM r WHERE len(ids) > 1)
SELECT fresh + i - (SELECT max(segment_id) + 1 FROM st) step, ids[2 * i + 1] AS "left", ids[2 * i + 2] AS "right", fresh + i id FROM u"""
#: The cheapest plan by widths: c[w][a] is the cost of w segments from the a-th, k[w][a] how many go left (the fewest of equal costs).
_COSTS = "list_transform(range(1, w + 1), lambda m: c[m][a] + c[w + 1 - m][a + m])"
_CHEAPEST = f"""{_STATS.replace("WITH b AS", "WITH RECURSIVE b AS", 1)},
x AS (SELECT list(segment_id ORDER BY segment_id) ids, list(size ORDER BY segment_id) sz FROM st),
y AS (SELECT ids, len(ids) n, list_transform(range(0, len(ids) + 1), lambda i: CAST(coalesce(list_sum(sz[1:i]), 0) AS BIGINT)) sums FROM x),
r AS (SELECT ids, n, sums, 1 AS w, [list_transform(range(0, n), lambda i: CAST(0 AS BIGINT))] c, [list_transform(range(0, n), lambda i: CAST(0 AS BIGINT))] k FROM y
  UNION ALL SELECT ids, n, sums, w + 1,
    list_append(c, list_transform(range(1, n - w + 1), lambda a: list_min({_COSTS}) + 2 * (sums[a + w + 1] - sums[a]))),
    list_append(k, list_transform(range(1, n - w + 1), lambda a: CAST(list_position({_COSTS}, list_min({_COSTS})) AS BIGINT)))
  FROM r WHERE w < n),
z AS (SELECT * FROM r WHERE w = n),
tree(a, w, d) AS (SELECT CAST(1 AS BIGINT), CAST(n AS BIGINT), 0 FROM z
  UNION ALL SELECT CASE WHEN s = 0 THEN a ELSE a + m END, CASE WHEN s = 0 THEN m ELSE w - m END, d + 1
  FROM (SELECT tree.a, tree.w, tree.d, k[tree.w][tree.a] m, unnest([0, 1]) s FROM tree, z WHERE tree.w > 1)),
v AS (SELECT a, w, d, count(*) OVER () - row_number() OVER (ORDER BY d, a) step FROM tree WHERE w > 1),
name AS (SELECT a, w, (SELECT max(segment_id) + 1 FROM st) + step id FROM v UNION ALL SELECT tree.a, tree.w, ids[tree.a] FROM tree, z WHERE tree.w = 1)
SELECT v.step, p.id AS "left", q.id AS "right", o.id FROM v JOIN z ON true JOIN name o ON o.a = v.a AND o.w = v.w
  JOIN name p ON p.a = v.a AND p.w = k[v.w][v.a] JOIN name q ON q.a = v.a + k[v.w][v.a] AND q.w = v.w - k[v.w][v.a]"""

ORACLE_SQL: dict[str, str] = {
    "word_scan": f"{_W} SELECT word, off FROM w",
    "word_profile": f"{_W} SELECT word, repeated, occur FROM p",
    "singular_words": f"{_W} SELECT word, occur FROM p WHERE NOT repeated",
    "repeated_words": f"{_W} SELECT word FROM p WHERE repeated",
    "find_first": f"{_W} SELECT word, occur FROM p WHERE NOT repeated ORDER BY occur LIMIT 1",
    "find_first_none": f"{_W} SELECT word, min(off) occur FROM (SELECT * FROM w UNION ALL SELECT * FROM w) GROUP BY word HAVING count(*) = 1 ORDER BY occur LIMIT 1",
    "find_top_n": f"{_W} SELECT word, occur FROM p WHERE NOT repeated ORDER BY occur LIMIT {TOP}",
    "singular_list": f"{_W} SELECT word, occur FROM p WHERE NOT repeated ORDER BY occur",
    "word_count": f"{_W} SELECT word, n FROM p",
    "first_occurrence": f"{_W} SELECT word, first_off FROM p",
    "segment_profile": f"{_W} SELECT * FROM seg",
    "segment_stats": f"{_W} SELECT segment_id, count(*) words, CAST(sum({_SIZE}) AS BIGINT) profile_bytes FROM seg GROUP BY 1",
    "segment_manifest": f"""{_W} SELECT segment_id, segment_id * {SEGMENT_BYTES} AS start, least((segment_id + 1) * {SEGMENT_BYTES}, total) - 1 AS "end", size
FROM (SELECT segment_id, CAST(sum({_SIZE}) AS BIGINT) size FROM seg GROUP BY 1), (SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) total FROM documents)""",
    "run_manifest": f"""{_W} SELECT segment_id, segment_id * {SEGMENT_BYTES} AS start, least((segment_id + 1) * {SEGMENT_BYTES}, total) - 1 AS "end", words, profile_bytes
FROM (SELECT segment_id, count(*) words, CAST(sum({_SIZE}) AS BIGINT) profile_bytes FROM seg GROUP BY 1), (SELECT CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) total FROM documents)""",
    **dict.fromkeys(("merge_two", "merge_full_outer", "merge_all", "stored_profile", "run_profile", "word_profile_by_sort"), f"{_W} SELECT word, repeated, occur FROM p"),
    "merge_plan_simple": _PAIRS,
    "merge_plan_dp": _CHEAPEST,
    "profile_bytes": f"{_W} SELECT CAST(coalesce(sum({_SIZE}), 0) AS BIGINT) bytes FROM p",
    "prefix_key": f"{_W} SELECT word, rpad(left(hex(encode(word)), 16), 16, '0') prefix_hex FROM p",
    "prefix_round_trip": f"""{_W} SELECT word, substr(hex(encode(word)), 17) tail_hex, word AS rebuilt,
  CAST(CASE WHEN word > min(word) OVER (PARTITION BY substr(hex(encode(word)), 1, 16)) THEN 1 ELSE 0 END AS INTEGER) compared FROM p""",
    "memory_size_parse": f"""
SELECT text, CAST(CASE WHEN regexp_full_match(text, '([0-9]+)([kKmMgGtT])?[bB]?') AND number * unit < 9223372036854775808 THEN number * unit END AS BIGINT) bytes
FROM (SELECT text, TRY_CAST(regexp_extract(text, '^[0-9]+') AS HUGEINT) number,
  CASE {_UNIT} WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 WHEN 't' THEN 1099511627776 ELSE 1 END unit
  FROM (VALUES {", ".join("(" + " || chr(10) || ".join(f"'{p}'" for p in s.split(chr(10))) + ")" for s in SIZES)}) v(text))""",
    **dict.fromkeys(("incremental_count", "streamed_count"), f"{_W} SELECT word, n, repeated FROM p"),
    "find_first_by_lang": f"{_words_sql(more=', lang')} SELECT lang, word, occur FROM ({_LANG}) WHERE rank = 1",
    "top_n_by_lang": f"{_words_sql(more=', lang')} SELECT lang, CAST(rank AS INTEGER) AS rank, word, occur FROM ({_LANG}) WHERE rank <= {TOP}",
} | {f"first_words_{t}": f"{_words_sql(t)} SELECT word, occur FROM p WHERE NOT repeated ORDER BY occur LIMIT {TOP}" for t in TEXTS if t != "documents"}
