"""Scan, profiles, segments and merges against an independent byte tokenizer and the SQL."""

import functools
import itertools
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from wordweir import catalogue
from wordweir.operators import offsets, profile, scan
from wordweir.sources.tables import TEXTS

F1 = [
    (0, "a b\ta  c\r\nd"), (1, ""), (2, "  lead trail \n"), (3, "x\x0by x\x0cy x y é É"), (4, "\n\n"), (5, "Word word WORD word, b"),
    (6, "longer-than-8 longer-than-9 longer-t"),
]


def naive(data: bytes):
    """(word, n, first) of each word of a file."""
    found = {}
    for m in re.finditer(rb"[^ \t\n\r]+", data):
        n, first = found.get(m[0], (0, m.start()))
        found[m[0]] = (n + 1, first)
    return found


def virtual(rows):
    return b"".join((t or "").encode() + b"\n" for _, t in sorted(rows))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def as_dict(p):
    return {r["word"].encode(): (r["n"], r["first_off"]) for r in p.collect()}


@pytest.mark.parametrize(
    "rows",
    [
        F1, [(0, "a a"), (1, "b b")], [(0, " \n")], [(0, None), (1, "x"), (-5, "y x")], [(0, "x\x0by x\x0cy")],
        [(0, "longer-than-8 longer-than-9 longer-t")], [(0, "a" * 20_000 + " b"), (1, "c " * 5000 + "last")],
    ],
)
def test_profiles_of_small_corpora(spark, rows):
    found = naive(virtual(rows))
    p = profile.profile(docs_of(spark, rows))
    assert as_dict(p) == found
    for r in p.collect():
        n, first = found[r["word"].encode()]
        assert r["repeated"] == (n > 1) and r["occur"] == (first if n == 1 else None)
    assert as_dict(profile.profile_words(scan.words_by_window(docs_of(spark, rows)))) == found
    assert as_dict(profile.profile_words(scan.words(docs_of(spark, rows)))) == found


def test_edge_corpus_facts(spark):
    p = profile.profile(docs_of(spark, F1))
    assert p.count() == 19 and profile.singular(p).count() == 17
    assert [(r["word"], r["occur"]) for r in profile.first_words(p).collect()] == [("c", 7)]
    assert scan.words(docs_of(spark, F1)).count() == 21


def test_no_word_that_does_not_repeat_gives_no_row(spark):
    assert profile.first_words(profile.profile(docs_of(spark, [(0, "a a"), (1, "b b")]))).collect() == []
    assert profile.first_words(profile.profile(docs_of(spark, []))).collect() == []


def test_documents_are_the_byte_tokenizer_s(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = naive(virtual(rows))
    p = profile.profile(spark.read.parquet(f"{sf}/documents.parquet"))
    assert as_dict(p) == found
    order = [r["occur"] for r in profile.in_order(p).collect()]
    assert order == sorted(order) and len(order) == sum(n == 1 for n, _ in found.values())
    assert [r["word"] for r in profile.first_words(p, 5).collect()] == [w.decode() for w, (n, f) in sorted(found.items(), key=lambda x: x[1][1]) if n == 1][:5]


def test_words_order_as_their_bytes(spark):
    words = ["longer-t", "longer-than-8", "longer-than-9", "z", "é", "中", "�", "\U0001f600"]
    p = profile.profile(docs_of(spark, [(0, " ".join(reversed(words)))]))
    assert [r["word"] for r in p.orderBy("word").collect()] == sorted(words, key=str.encode)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n\r\x0b中", max_size=30), max_size=8), st.integers(1, 40))
def test_batches_in_slices(texts, limit):
    column = pa.array(texts, pa.string())
    bases = np.cumsum([0] + [len(t.encode()) + 1 for t in texts])[:-1].astype(np.int64)
    got = []
    for row, end, data, off in scan.slices(column, limit):
        starts, ends = scan.find_words(data, off[:-1])
        owner = np.searchsorted(off, starts, "right") - 1
        got += zip(scan.word_array(data, starts, ends, pa.string()).to_pylist(), (bases[row:end][owner] + starts - off[owner]).tolist(), strict=True)
    assert got == [(m[0].decode(), m.start()) for m in re.finditer(rb"[^ \t\n\r]+", virtual(list(enumerate(texts))))]


def test_offsets_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(offsets, "RANGE_ROWS", 10)
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", 20)
    rows = [(7 * i % 101, "x" * i) for i in range(101)]
    got = {r["doc_id"]: r["base"] for r in offsets.with_base(docs_of(spark, rows), ("doc_id",), "text", ("doc_id",)).collect()}
    at = 0
    for i, t in sorted(rows):
        assert got[i] == at
        at += len(t) + 1


KEYS = [
    ("doc_id bigint, turn string, text string", [(1, "x", "a b"), (1, "x", "c"), (None, "y", "d"), (None, None, "e a"), (1, None, None), (1, "x", "c"), (2, "z", "f")]),
    ("doc_id string, turn string, text string", [("k%d" % (i % 7), None if i % 3 else "t", f"w{i} w{i // 2}") for i in range(60)]),
]


@pytest.mark.parametrize("ranges", [10**6, 4])
@pytest.mark.parametrize("broadcast", [10**6, 0])
@pytest.mark.parametrize(("schema", "rows"), KEYS)
def test_repeated_null_and_string_keys(spark, monkeypatch, schema, rows, ranges, broadcast):
    monkeypatch.setattr(offsets, "RANGE_ROWS", ranges)
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(rows, schema)
    key = ("doc_id", "turn")
    got = offsets.with_base(docs, key, "text", key).orderBy("base").collect()
    low = lambda x: (x is not None, x)
    assert [low(r["doc_id"]) + low(r["turn"]) for r in got] == sorted((low(r["doc_id"]) + low(r["turn"]) for r in got), key=lambda k: tuple((v is not None, v) for v in k))
    assert sorted((r["doc_id"], r["turn"], r["text"]) for r in got if r["doc_id"] and r["turn"]) == sorted(r for r in rows if r[0] and r[1]) and len(got) == len(rows)
    data = b"".join((r["text"] or "").encode() + b"\n" for r in got)
    assert [r["base"] for r in got] == [len(b"".join((r["text"] or "").encode() + b"\n" for r in got[:k])) for k in range(len(got))]
    assert as_dict(profile.profile(docs, key)) == naive(data)
    assert sorted((r["word"].encode(), r["off"]) for r in scan.words(docs, key).collect()) == sorted((m[0], m.start()) for m in re.finditer(rb"[^ \t\n\r]+", data))


@pytest.mark.parametrize("by", [[], ["lang"]])
def test_late_offsets_give_the_same_profile(spark, sf, monkeypatch, by):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = lambda: sorted(map(str, profile.profile(docs, by=by).collect()))
    soon = rows()
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(offsets, "RANGE_ROWS", 50)
    assert rows() == soon
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    late = as_dict(profile.profile(talk, ("conv_id", "turn")))
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", 10**6)
    assert late == as_dict(profile.profile(talk, ("conv_id", "turn")))


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_segments_merge_to_the_whole(spark, size):
    docs = docs_of(spark, F1)
    segments = profile.segment_profiles(docs, size)
    assert as_dict(profile.merge(segments)) == as_dict(profile.profile(docs))
    small = profile.merge(segments.select("segment_id", *profile.SMALL))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, profile.profile(docs).select(*profile.SMALL).collect()))


def test_merges_in_any_order(spark):
    docs = docs_of(spark, F1)
    parts = [profile.segment_profiles(docs, 20).where(f"segment_id = {k}").select(*profile.SMALL) for k in range(7)]
    rows = lambda p: sorted(map(tuple, p.collect()))
    whole = rows(profile.profile(docs).select(*profile.SMALL))
    balanced = profile.merge(profile.merge(profile.merge(*parts[:2]), profile.merge(*parts[2:4])), profile.merge(*parts[4:]))
    deep = functools.reduce(profile.merge_outer, parts)
    assert rows(profile.merge(*parts)) == rows(balanced) == rows(deep) == rows(profile.merge(*reversed(parts))) == whole


@pytest.mark.parametrize("name", ["merge_two", "merge_full_outer"])
def test_two_profiles_that_hold_the_whole_table_are_merged(spark, sf, name):
    assert all(half.count() for half in catalogue._halves(spark, sf))
    whole = profile.profile(spark.read.parquet(f"{sf}/documents.parquet")).select(*profile.SMALL)
    got = catalogue.QUERIES[name](spark, sf)
    assert got.agg(F.max("occur")).first()[0] > 2 * catalogue.SEGMENT_BYTES
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize(("start", "end"), [(0, 9), (9, 31), (31, None), (10**6, None), (0, 0)])
def test_a_stretch_of_the_virtual_file(spark, start, end):
    got = scan.partial_counts(docs_of(spark, F1), segment_bytes=8, start=start, end=end).collect()
    words = [(m[0].decode(), m.start()) for m in re.finditer(rb"[^ \t\n\r]+", virtual(F1))]
    want = Counter((w, off // 8) for w, off in words if off >= start and (end is None or off < end))
    assert sum(r["n"] for r in got) == sum(want.values()) and {(r["word"], r["segment_id"]) for r in got} == set(want)


def test_a_profile_merged_with_itself_repeats_all(spark):
    p = profile.profile(docs_of(spark, F1))
    assert profile.singular(profile.merge(p, p)).count() == 0 and profile.singular(profile.merge_outer(p, p)).count() == 0


def test_concatenation_is_a_merge_of_shifted_profiles(spark):
    a, b = F1[:3], F1[3:]
    shift = len(virtual(a))
    pa_, pb = (profile.profile(docs_of(spark, x)) for x in (a, b))
    pb = pb.withColumns({"first_off": F.col("first_off") + shift, "occur": F.col("occur") + shift})
    assert as_dict(profile.merge(pa_, pb)) == as_dict(profile.profile(docs_of(spark, F1)))


def test_partitions_do_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert as_dict(profile.profile(docs.repartition(13))) == as_dict(profile.profile(docs.coalesce(1)))


def test_no_text_is_shuffled_for_a_profile(spark, sf):
    plan = profile.profile(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(word" in plan
    assert "SortMergeJoin" not in plan and "RoundRobin" not in plan


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_queries_are_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TEXTS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    found = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(found.fetchall())
    if name in ("find_top_n", "singular_list"):
        assert [tuple(r[c] for c in columns) for r in got.collect()] == con.execute(catalogue.ORACLE_SQL[name]).fetchall()


def segments_of(data, size):
    """(segment, word) -> (n, first) of a file's segments."""
    found = {}
    for m in re.finditer(rb"[^ \t\n\r]+", data):
        key = (m.start() // size, m[0].decode())
        n, first = found.get(key, (0, m.start()))
        found[key] = (n + 1, first)
    return found


LONG = [(k, "word " * (k % 5) + f"w{k} " * (40 if k % 13 == 0 else 2)) for k in range(60)]


@pytest.mark.parametrize(("size", "stretch", "most"), [(7, 1, 10**6), (7, 50, 3), (64, 100, 10**6), (64, 10**6, 3)])
def test_segments_by_stretches(spark, monkeypatch, size, stretch, most):
    monkeypatch.setattr(offsets, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(offsets, "STRETCHES", most)
    data = virtual(LONG)
    for start, end in ((0, None), (3 * size, 9 * size), (len(data) // 2, None), (0, 0), (len(data) + 1, None)):
        got = profile.segment_profiles(docs_of(spark, LONG).repartition(5), size, start=start, end=end).collect()
        want = {k: v for k, v in segments_of(data, size).items() if v[1] >= start and (end is None or v[1] < end)}
        if start % size == 0:
            assert len(got) == len(want) and {(r["segment_id"], r["word"]): (r["n"], r["first_off"]) for r in got} == want
        assert all(r["first_off"] >= start for r in got)
    monkeypatch.setattr(profile, "TASK_BYTES", 0)
    late = profile.segment_profiles(docs_of(spark, LONG), size).collect()
    assert {(r["segment_id"], r["word"]): (r["n"], r["first_off"]) for r in late} == segments_of(data, size)


@pytest.mark.parametrize(("schema", "rows"), KEYS)
def test_segments_of_repeated_null_and_string_keys(spark, monkeypatch, schema, rows):
    monkeypatch.setattr(offsets, "STRETCH_BYTES", 8)
    docs, key = spark.createDataFrame(rows, schema), ("doc_id", "turn")
    ordered = offsets.with_base(docs, key, "text", key).orderBy("base").collect()
    data = b"".join((r["text"] or "").encode() + b"\n" for r in ordered)
    got = profile.segment_profiles(docs, 4, key).collect()
    assert len(got) == len(segments_of(data, 4)) and {(r["segment_id"], r["word"]): (r["n"], r["first_off"]) for r in got} == segments_of(data, 4)


def test_pieces_of_a_long_text():
    for text, copies in itertools.product((b"", b" ", b"abc", b"a bc\td\ne  fgh\r", b"abcdefghijkl", "\u00e9\u4e00 ".encode() * 3, b"abcdefghi j", b"  \n  "), (1, 2, 5)):
        data = b"\n".join([text] * copies)
        for base, step in itertools.product((0, 1, 5, 8, 9), (1, 2, 3, 8, 50)):
            first, last = base // step - (base % step == 0), (base + len(data)) // step
            got, words = list(offsets.pieces(text, base, copies, first, last, step)), {}
            for stretch, piece in got:
                piece.decode()
                words.update({(stretch, max(base, stretch * step) + m.start()): m[0] for m in re.finditer(rb"[^ \t\n\r]+", piece)})
            assert words == {((base + m.start()) // step, base + m.start()): m[0] for m in re.finditer(rb"[^ \t\n\r]+", data)}
            assert got[-1][0] == last and max(base, last * step) + len(got[-1][1]) == base + len(data)
            # every byte of text once, and blanks of as many at most
            assert sum(len(piece) for _, piece in got) <= 2 * len(data)


HUGE = [
    [(1, "a b"), (2, "word \u00e9\u00e9\u00e9 " * 40), (3, "c a"), (4, "w" * 100 + " x"), (5, "b c"), (6, "y z " * 30 + "v" * 50)],
    [(None, "a \u00e9 bcd"), (1, "x y")] + [(None, "a \u00e9 bcd")] * 40 + [(7, None)] * 30 + [(2, "last " * 20), (3, "a")],
]


@pytest.mark.parametrize("rows", HUGE)
@pytest.mark.parametrize(("size", "stretch", "most"), [(4, 1, 10**6), (8, 16, 7)])
def test_segments_of_texts_over_many_stretches(spark, monkeypatch, rows, size, stretch, most):
    monkeypatch.setattr(offsets, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(offsets, "STRETCHES", most)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    data = b"".join((r["text"] or "").encode() + b"\n" for r in offsets.with_base(docs, ["doc_id"], "text").orderBy("base").collect())
    assert len(data) == sum(len((t or "").encode()) + 1 for _, t in rows)
    for start, end in ((0, None), (4 * size, 12 * size), (len(data) // size // 2 * size, None)):
        got = profile.segment_profiles(docs, size, start=start, end=end).collect()
        want = {k: v for k, v in segments_of(data, size).items() if v[1] >= start and (end is None or v[1] < end)}
        assert len(got) == len(want) and {(r["segment_id"], r["word"]): (r["n"], r["first_off"]) for r in got} == want


@pytest.mark.parametrize("rows", HUGE)
def test_what_is_shuffled_of_a_long_text_grows_as_the_text(spark, monkeypatch, rows):
    monkeypatch.setattr(offsets, "STRETCH_BYTES", 16)
    table = offsets.order(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], "text", 8)
    assert table.long
    assert offsets.in_order(table).agg(F.sum(F.octet_length("text"))).first()[0] <= 2 * sum(len((t or "").encode()) + 1 for _, t in rows)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_words_of_segments_are_not_shuffled(spark, sf, monkeypatch, broadcast):
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(offsets, "STRETCH_BYTES", 1)
    plan = catalogue.segment_profile(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(stretch") == plan.count("Exchange") == 1 and "Join" not in plan


def exchanges(spark, sf, monkeypatch, name):
    """By what the plan of a query, or of a plan's statistics, deals out its rows; offsets are too many to be broadcast."""
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(offsets, "STRETCH_BYTES", 1, raising=False)
    monkeypatch.setattr(catalogue, "plan_of", lambda spark, statistics, *_: statistics)
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == plan.count("Exchange hashpartitioning(")
    return sorted(re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan))


def test_merged_segments_shuffle_texts_once_and_words_once(spark, sf, monkeypatch):
    assert exchanges(spark, sf, monkeypatch, "merge_all") == ["stretch", "word"]


@pytest.mark.parametrize("name", ["segment_stats", "merge_plan_dp", "segment_manifest"])
def test_statistics_of_segments_shuffle_texts_once_and_no_words(spark, sf, monkeypatch, name):
    assert exchanges(spark, sf, monkeypatch, name) == ["segment_id", "stretch"]


@pytest.mark.parametrize("name", ["merge_two", "merge_full_outer"])
def test_halves_shuffle_their_merged_words_only(spark, sf, monkeypatch, name):
    monkeypatch.setattr(offsets, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(offsets, "STRETCH_BYTES", 1)
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(stretch") == 2 and "hashpartitioning(segment_id" not in plan and "b_doc_id" not in plan


def test_a_run_stores_each_segment_from_one_task(spark, sf):
    run, n, _ = catalogue._run(spark, sf)
    files = run.segments().select("segment_id", F.input_file_name().alias("file")).distinct()
    assert n > 4 and files.count() == files.select("segment_id").distinct().count()


def test_a_scan_holds_little_beside_its_batch():
    texts = pa.array(["some words of a text " * 50] * 16_000, pa.large_string())
    tracemalloc.start()
    for _ in scan.scan_batch(texts, np.zeros(len(texts), np.int64), pa.string()):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


@pytest.mark.parametrize("together", [1, 3, 100])
def test_slices_are_counted_together(monkeypatch, together):
    monkeypatch.setattr(scan, "TOGETHER", together)
    slices = [pa.table({"word": ["a", "b", "a"], "at": [9 + k, 5 + k, 7 + k]}) for k in range(6)]
    got = [r for t in scan.combined(iter(slices), ["word"]) for r in t.to_pylist()]
    assert len(got) == 2 * -(-6 // together)
    assert sum(r["n"] for r in got if r["word"] == "a") == 12 and min(r["at"] for r in got if r["word"] == "a") == 7
