"""Raw files, stored and resumed runs, the command line, streaming, plans and scalars."""

import errno
import os
import random

import numpy as np
import pytest
from wordweir import cli
from wordweir.functions import scalars
from wordweir.operators import profile
from wordweir.plans import merge_plan
from wordweir.sources import raw, store
from wordweir.streaming import incremental

from .test_profile import as_dict, naive

SAMPLE = b"\xff\xfe a\r\n\xfe\xff b\nplain\n"


def as_bytes(p):
    return {bytes(r["word"]): (r["n"], r["first_off"]) for r in p.collect()}


def sample(seed, n):
    r = random.Random(seed)
    return bytes(r.choice(b"ab \t\n\r\x00\xff\x0b") for _ in range(n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 5000])
@pytest.mark.parametrize("buffer", [1, 5, 4096])
def test_ranges_cover_every_word_once(tmp_path, size, buffer):
    for k, data in enumerate([SAMPLE, b"", b" \n", b"x" * 3000 + b" y", sample(1, 400), sample(2, 401), b"no-end"]):
        path = tmp_path / f"f{k}-{len(data)}"
        path.write_bytes(data)
        got = [
            (bytes(w.as_py()), int(o))
            for a in range(0, len(data), size) for words, offs in raw.range_words(str(path), a, min(len(data), a + size), buffer)
            for w, o in zip(words, offs, strict=True)
        ]
        import re

        assert got == [(m[0], m.start()) for m in re.finditer(rb"[^ \t\n\r]+", data)]


def test_raw_source(spark, tmp_path):
    path = tmp_path / "raw"
    path.write_bytes(SAMPLE + sample(3, 5000) + b" " + b"w" * 20_000)
    words = raw.raw_words(spark, str(path), range_bytes=700, buffer_bytes=256)
    assert as_bytes(profile.profile_words(words)) == naive(path.read_bytes())
    assert len({bytes(r["word"]) for r in raw.raw_words(spark, str(path), end=len(SAMPLE)).collect()}) == 5
    (tmp_path / "empty").write_bytes(b"")
    assert raw.raw_words(spark, str(tmp_path / "empty")).count() == 0
    for bad, code in ((tmp_path, errno.EISDIR), (tmp_path / "none", errno.ENOENT), ("/dev/null", errno.EIO)):
        with pytest.raises(raw.FileError) as e:
            raw.raw_words(spark, str(bad))
        assert e.value.errno == code


class Stop(Exception):
    pass


def test_a_killed_run_goes_on_exactly_once(spark, tmp_path):
    data = b"once " + b"twice thrice " * 30 + b"boundary-word end twice " + sample(5, 300)
    (tmp_path / "in").write_bytes(data)
    read = lambda a, b: raw.raw_counts(spark, str(tmp_path / "in"), 100, start=a, end=b)
    done = []

    def counts(a, b):
        if len(done) == 3:
            raise Stop
        done.append(a)
        return read(a, b)

    folder = str(tmp_path / "run")
    with pytest.raises(Stop):
        store.Run(spark, folder, "x", 1).profile_segments(counts, len(data), 100)
    os.remove(f"{folder}/segments/000000002-000000002/_SUCCESS")  # as if stopped while it was written
    again = store.Run(spark, folder, "x", 1)
    with pytest.raises(store.RunError):
        again.merge(9)
    done = []
    n = again.profile_segments(lambda a, b: (done.append(a), read(a, b))[1], len(data), 100)
    assert done[0] == 200 and len(done) == n - 2
    rows = store.manifest(again.segments(), 100, len(data)).orderBy("segment_id").collect()
    assert [(r["start"], r["end"]) for r in rows] == [(100 * r["segment_id"], min(100 * r["segment_id"] + 100, len(data)) - 1) for r in rows]
    assert sum(r["words"] for r in rows) == again.segments().count() and len(rows) == n
    assert as_bytes(again.merge(n, keep=True)) == naive(data) and os.path.isdir(f"{folder}/segments")
    assert as_bytes(again.merge(n)) == naive(data) and not os.path.isdir(f"{folder}/segments")
    with pytest.raises(store.RunError):
        store.Run(spark, folder, "another input", 1)
    whole = store.Run(spark, str(tmp_path / "one"), "x")  # all segments in one job
    calls = []
    n = whole.profile_segments(lambda a, b: (calls.append((a, b)), read(a, b))[1], len(data), 100)
    assert calls == [(0, len(data))] and as_bytes(whole.merge(n)) == naive(data)


def test_stored_profiles_are_sorted_and_pruned(spark, sf, tmp_path):
    p = profile.profile(spark.read.parquet(f"{sf}/documents.parquet"))
    store.write_profile(p, str(tmp_path / "p"))
    back = store.read_profile(spark, str(tmp_path / "p"))
    assert as_dict(back) == as_dict(p)
    plan = profile.first_words(back)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Not(EqualTo(repeated,true))" in plan and "ReadSchema: struct<word:string,repeated:boolean,occur:bigint>" in plan
    assert "TakeOrderedAndProject" in plan


def test_command_line(spark, tmp_path, capfdbinary):
    (tmp_path / "in").write_bytes(b"a b a \xff\xfe c b " * 2 + b"\xfd only " + b"a " * 9000)
    run = str(tmp_path / "run")
    assert cli.main([str(tmp_path / "in"), run, "-m", "4k", "--profile-only"], spark) == 0
    assert os.path.isdir(f"{run}/segments/000000000-000000004") and not os.path.exists(f"{run}/profile")
    assert cli.main([str(tmp_path / "in"), run, "-m", "4096b", "--merge-only", "--keep-segments"], spark) == 0
    assert capfdbinary.readouterr().out == b""
    assert cli.main([str(tmp_path / "in"), run, "-m", "4k"], spark) == 0
    assert capfdbinary.readouterr().out == b"\xfd\n" and not os.path.exists(f"{run}/segments")
    assert cli.main([str(tmp_path / "in"), run, "-m", "4k", "-n", "9"], spark) == 0
    assert capfdbinary.readouterr().out == b"\xfd\nonly\n"
    (tmp_path / "same").write_bytes(b"a a")
    assert cli.main([str(tmp_path / "same"), str(tmp_path / "run2")], spark) == 0 and capfdbinary.readouterr().out == b""
    assert cli.main([str(tmp_path / "same"), run], spark) != 0
    assert cli.main([str(tmp_path), run], spark) == -errno.EISDIR & 0xFF and b"Is a directory" in capfdbinary.readouterr().err
    assert cli.main([str(tmp_path / "none"), run], spark) == -errno.ENOENT & 0xFF and b"none (input): No such file" in capfdbinary.readouterr().err
    assert cli.main([str(tmp_path / "same"), str(tmp_path / "in" / "below")], spark) != 0 and capfdbinary.readouterr().err.startswith(b"Error: ")
    assert cli.main([f"file://{tmp_path}/same", f"file://{tmp_path}/run3"], spark) == 0
    for wrong in (["-m", "1x"], ["-m", "4095"], ["-d", "1m"], ["-n", "0"], []):
        with pytest.raises(SystemExit) as e:
            cli.arguments(([str(tmp_path / "in"), run] if wrong else []) + wrong)
        assert e.value.code == cli.USAGE
    with pytest.raises(SystemExit) as e:
        cli.arguments(["-h"])
    assert e.value.code == 0
    capfdbinary.readouterr()
    assert cli.arguments(["f", "w", "-d", "0", "-p"]).sync_distance == 0


@pytest.mark.parametrize("every", [16, 2])
def test_streams_go_on_where_they_stopped(spark, sf, tmp_path, every):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder, checkpoint, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    assert incremental.latest(spark, out).count() == 0
    for k in range(3):
        docs.where(f"doc_id % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
        incremental.follow_to_table(spark, folder, docs.schema, checkpoint, out, files_per_trigger=1, compact_every=every).awaitTermination()
    want = {r["word"]: (r["n"], r["repeated"], r["first"]) for r in incremental.running_profile(docs).collect()}
    assert {r["word"]: (r["n"], r["repeated"], r["first"]) for r in incremental.latest(spark, out).collect()} == want
    assert sorted(os.listdir(out)) == (["batch=0", "batch=1", "batch=2"] if every > 3 else ["batch=1-all", "batch=2"])


def naive_cost(sizes):
    if len(sizes) == 1:
        return 0
    return min(naive_cost(sizes[:m]) + naive_cost(sizes[m:]) for m in range(1, len(sizes))) + 2 * sum(sizes)


def test_cheapest_plans():
    assert merge_plan.cheapest([(0, 10), (1, 20), (2, 30)]) == ([(0, 1, 3), (3, 2, 4)], 4, 180)
    assert merge_plan.cheapest([(5, 1)]) == ([], 5, 0)
    r = random.Random(1)
    for _ in range(30):
        sizes = [r.randrange(1, 50) for _ in range(r.randrange(1, 9))]
        steps, root, cost = merge_plan.cheapest(list(enumerate(sizes)))
        assert cost == naive_cost(sizes) and len(steps) == len(sizes) - 1
        spans, paid = {i: (i, i + 1) for i in range(len(sizes))}, 0
        for k, (a, b, new) in enumerate(steps):
            assert new == len(sizes) + k and spans[a][1] == spans[b][0]
            spans[new] = (spans[a][0], spans[b][1])
            paid += 2 * sum(sizes[slice(*spans[new])])
        assert spans[root] == (0, len(sizes)) and paid == cost
    with pytest.raises(ValueError):
        merge_plan.cheapest([])


def test_pairwise_plans():
    assert merge_plan.pairwise([(k, 1) for k in range(5)]) == ([(0, 1, 5), (2, 3, 6), (5, 6, 7), (7, 4, 8)], 8)
    assert merge_plan.pairwise([(3, 1)]) == ([], 3)


@pytest.mark.parametrize("top", [1, 3, 50, 10**6])
def test_cheapest_plans_beyond_the_interval_programme(top, monkeypatch):
    rng = random.Random(top)
    for n in [*range(1, 40), 120]:
        segments = [(k, rng.randint(0, top)) for k in range(n)]
        _, _, least = merge_plan.cheapest(segments)
        with monkeypatch.context() as m:
            m.setattr(merge_plan, "MAX_SEGMENTS", 0)
            steps, root, cost = merge_plan.cheapest(segments)
        assert cost == least and len(steps) == n - 1
        size, span, paid = dict(segments), {k: (k, k + 1) for k in range(n)}, 0
        for left, right, new in steps:
            assert span[left][1] == span[right][0]
            span[new], size[new] = (span[left][0], span[right][1]), size[left] + size[right]
            paid += 2 * size[new]
        assert span[root] == (0, n) and paid == cost


def leftmost(sizes):
    """All merges (first, cut, end) of the cheapest plan with the leftmost of equal cuts: every cut of every stretch is tried."""
    n, sums = len(sizes), np.append(0, np.cumsum(sizes))
    cost, left = {1: np.zeros(n, int)}, {}
    for width in range(2, n + 1):
        starts = n - width + 1
        least, left[width] = cost[1][:starts] + cost[width - 1][1 : 1 + starts], np.ones(starts, int)
        for m in range(2, width):
            c = cost[m][:starts] + cost[width - m][m : m + starts]
            left[width], least = np.where(c < least, m, left[width]), np.minimum(c, least)
        cost[width] = least + 2 * (sums[width:] - sums[:-width])
    found, queue = set(), [(0, n)]
    while queue:
        a, b = queue.pop()
        if b - a > 1:
            m = a + int(left[b - a][a])
            found.add((a, m, b))
            queue += [(a, m), (m, b)]
    return found


@pytest.mark.parametrize(("n", "top"), [(1, 3), (2, 3), (3, 0), (40, 0), (90, 2), (90, 50), (600, 3), (600, 9000)])
def test_cheapest_plans_cut_leftmost(n, top):
    sizes = [random.Random(n + k).randint(min(1, top), top) for k in range(n)]
    span, got = {k: (k, k + 1) for k in range(n)}, set()
    for left, right, new in merge_plan.cheapest(list(enumerate(sizes)))[0]:
        span[new] = (span[left][0], span[right][1])
        got.add((span[left][0], span[right][0], span[right][1]))
    assert got == leftmost(sizes)


@pytest.mark.parametrize("kind", ["cheapest", "pairwise"])
def test_plans_cover_all_segments(spark, kind):
    n = 1300
    sizes = spark.range(n).selectExpr("id segment_id", "40000 + id * 7919 % 6007 profile_bytes")
    rows = merge_plan.plan_of(spark, sizes, kind).orderBy("step").collect()
    used = sorted(x for r in rows for x in (r["left"], r["right"]))
    assert used == list(range(2 * n - 2)) and [r["id"] for r in rows] == list(range(n, 2 * n - 1))
    assert merge_plan.plan_of(spark, sizes.limit(0), kind).schema == merge_plan.plan_of(spark, sizes, kind).schema
    assert merge_plan.plan_of(spark, sizes.limit(0), kind).count() == 0



def test_sizes():
    assert [scalars.parse_size(s) for s in ("4096", "4096B", "64k", "1G", "2gb", "3Tb", "5m")] == [4096, 4096, 65536, 1 << 30, 2 << 30, 3 << 40, 5 << 20]
    for bad in ("", "k", "1.5g", " 1", "1kk", "-1", "1 k", "1bk", "١"):
        with pytest.raises(scalars.SizeError):
            scalars.parse_size(bad)


def test_entry(spark):
    import __spark_entry__ as e

    assert [(r["word"], r["occur"]) for r in e.entry(spark).collect()] == [("stschß", 109)]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'find_first' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
    # nor if the subpackage is there but cannot be imported
    shutil.copytree(f"{here}/wordweir/llm", tmp_path / "repo/wordweir/llm", dirs_exist_ok=True)
    code = f"import sys; sys.modules['tokenizers'] = None; {code}"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
