"""Decontamination, language ID, line dedup, token counts and packing against brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wordweir.llm.automaton import Automaton
from wordweir.llm import decontaminate, language_id, line_dedup, packing, queries, token_counts
from wordweir.llm.common import row_words
from wordweir.llm.queries import tokenizer_path

CLASH = "doc_id bigint, text string, id string, record int, key string, n int, items string, h int, drop string, ids string"
EDGES = [
    (1, None), (2, ""), (3, " \n\n "), (4, "Ünï ﬁ ² \x1c x\u3000y <|endoftext|> <s> ▁a"), (5, "w" * 70_000), (6, "the cat sat " * 9000), (7, "the cat sat"),
    (7, "the cat sat"), (8, "42 17 !!"), (None, "no id, one two three four five six seven"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 1, "k", 2, "y", 3, "d", "z") for i, t in EDGES], CLASH)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# decontamination


def naive_hits(text, items, size=8):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = cut(text), set(), set()
    at = defaultdict(list)
    for i, x in enumerate(w):
        at[x].append(i)
    for item, t in items:
        v = cut(t)
        for i in range(max(1, len(v) - size + 1)) if v else []:
            win = v[i : i + size]
            for p in at.get(win[0], []):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    ids.add(item)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 700])
def test_decontaminate_is_brute_force(spark, sf, texts, block):
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [("short", "re thansh"), ("none", "?!"), ("null", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([*texts.items(), (7, texts[7]), (-1, None), (-2, items[0][1]), (-2, items[1][1] + " " + items[0][1].upper())], "doc_id bigint, text string")
    got = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == sorted(
        (d["doc_id"], n, h, tuple(i)) for d in docs.collect() for n, h, i in [naive_hits(d["text"], items)]
    )
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block)
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [len(line) - len(line.lstrip(" :+-!")) for line in plan if "MapInArrow" in line]
    assert len(at) == 1 or len(set(at)) <= 2 and len(at) > 2  # scans stand beside each other, none within another
    kept = kept.collect()
    assert sorted(map(tuple, kept)) == sorted(tuple(d) for d in docs.collect() if not naive_hits(d["text"], items)[2])


def test_spans_are_places_in_the_original():
    automaton = Automaton([("a", "É été un deux"), ("b", "x")], 8)
    text = "¿É-- x É. été,UN\tdeux! fin"
    (found,) = automaton.scan(pa.array([text]))
    assert found.items == ["a", "b"] and [text[s["start"] : s["end"]] for s in decontaminate.spans(text, found.ranges)] == ["x É. été,UN\tdeux"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6), st.lists(st.text("abc ", max_size=400), max_size=4), st.integers(1, 4))
def test_automaton_is_brute_force(items, texts, size):
    items = [(str(k), t) for k, t in enumerate(items)]
    found = list(Automaton(items, size).scan(pa.array(texts, pa.string())))
    for text, f in zip(texts, found, strict=True):
        hit = {w for a, b in f.ranges for w in range(a, b + 1)}
        assert (f.words, len(hit), f.items) == naive_hits(text, items, size)
        assert all(a[1] + 1 < b[0] for a, b in zip(f.ranges, f.ranges[1:], strict=False))


def test_hits_are_proved_on_the_words(monkeypatch):
    automaton = Automaton([("a", "one two three")], 8)
    (_, _, hashes, _), = row_words(pa.array(["one two three"]))
    true = automaton.numbers(hashes)
    monkeypatch.setattr(automaton, "numbers", lambda h: np.tile(true, len(h))[: len(h)])
    assert automaton.states(np.append(true, 0))[2] and automaton.hit[automaton.states(true)[2]]
    assert [f.items for f in automaton.scan(pa.array(["no such words", "x y z"]))] == [[], []]


def test_a_large_benchmark_is_one_automaton():
    rng = np.random.default_rng(0)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 50_000, 5000))) for k in range(40)]
    automaton = Automaton(items, 8)
    size = sum(len(t) for _, t in items)
    assert automaton.nbytes() < 40 * size and size > 1_000_000
    (f,) = automaton.scan(pa.array([items[3][1][:400]]))
    assert f.items == ["3"] and len(f.ranges) == 1


def test_decontaminate_edges(spark, edges):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.decontaminate(edges, none).collect()
    assert len(got) == len(EDGES) and not any(r["n_hit"] or r["items"] for r in got)
    assert decontaminate.decontaminate(edges.limit(0), none).count() == 0
    some = spark.createDataFrame([(1, "cat sat the cat sat the cat sat the")], "item_id bigint, text string")
    hits = {r["n_words"]: (r["n_hit"], len(r["ranges"])) for r in decontaminate.decontaminate(edges, some).collect()}
    assert hits[27000] == (26998 + 1, 1) and hits[3] == (0, 0)


# language


def test_language_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op4_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert sum(r["accepted"] for r in got) >= 0.99 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_language_rejects_and_edges(spark, edges):
    docs = edges.withColumn("lang", F.lit("xx"))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (1, 2, 3, 8))
    assert got[7]["lang_pred"] == "xx"
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and language_id.identify(docs.limit(0)).count() == 0
    assert language_id.keep_identified(docs).columns == docs.columns


def test_few_bad_rows_do_not_set_the_least_score():
    scores = np.full((800, 4), 0.01)
    scores[np.arange(800), np.arange(800) % 4] = 0.97
    truth = np.arange(800) % 4
    truth[:2] = [1, 2]  # mislabelled
    scores[2] = [0.24, 0.25, 0.26, 0.25]  # hardly a text
    assert language_id.least_score(scores, truth) == pytest.approx(0.97 * language_id.MARGIN)
    assert language_id.least_score(np.full((9, 4), 0.25), np.zeros(9, int)) > 0.25 and language_id.least_score(np.zeros((0, 4)), np.zeros(0, int)) > 0.25
    assert language_id.least_score(np.ones((9, 1)), np.zeros(9, int)) <= 1


STRANGE = [
    "今天天气很好我们去公园散步然后回家吃饭", "Сегодня хорошая погода и мы пошли гулять в парк с детьми", "σήμερα ο καιρός είναι καλός", "오늘 날씨가 좋아서 공원에 갔습니다",
    "Tänään sää on kaunis ja menemme puistoon kävelemään", "Dnes je krásné počasí a jdeme se procházet do parku s dětmi", "Ma szép idő van és a parkba megyünk sétálni",
    "Времето днес е хубаво и отиваме на разходка в парка", "Bugün hava çok güzel ve çocuklarla parka yürüyüşe gidiyoruz", "Hari ini cuacanya bagus dan kami pergi berjalan ke taman",
    "deadbeef0123456789abcdef0fedcba9876543210cafebabe", "asdf jkl; qwer uiop zxcv bnm asdfgh jklqwe rtyuio pzxcvb", "sdfkjh sdkfjhsdf kjhsdf kjhsdfkjh sdfkjhsdf",
]


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_unlearned_languages_and_noise_are_rejected(spark, scale):
    import corpus_pipeline

    folder = f"/root/testdata/sf{scale}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(5)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n)) for n in (3, 40, 400) for _ in range(20)]
    odd = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(noise + STRANGE)], docs.schema)
    kept = [r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(odd), folder).select("doc_id").collect()]
    assert max(kept) < 10**9 and len(kept) >= 0.995 * docs.count()


def test_temperature_and_thresholds_are_inside_their_ranges(spark):
    for scale in ("0.001", "0.01", "0.1"):
        docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet")
        model = language_id.train(language_id.sample(docs, "doc_id", "text", "lang"))
        assert 0.011 < model.temperature < 9 and 0.3 < model.least < 1 and 0 < model.familiar < 2


def test_gradients_are_differences():
    rng = np.random.default_rng(0)
    emb, out, bias, part = rng.normal(size=(5, 3)), rng.normal(size=(3, 4)), rng.normal(size=4), rng.random(5)

    def loss():
        z = part @ emb @ out + bias
        return np.log(np.exp(z).sum()) - z[2]

    for x, g in zip((emb, out, bias), language_id.gradients(emb, out, bias, part, 2), strict=True):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            up = loss()
            x[i] -= 2e-6
            down = loss()
            x[i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_familiarity_is_the_share_against_chance():
    ids, part = np.array([3, 9]), np.array([0.25, 0.75])
    known = language_id.familiarity([(ids, part, 8, 1)], 2)
    total = 8 + 0.5 * language_id.BUCKETS
    assert known[1, 3] == pytest.approx(np.log(2.5 / total * language_id.BUCKETS)) and known[1, 4] == pytest.approx(np.log(0.5 / total * language_id.BUCKETS))
    assert np.allclose(known[0], 0) and sorted(language_id.shuffled("ab, cd é", np.random.default_rng(1))) == sorted("ab, cd é")


def test_language_prediction_is_the_mean_over_all_subwords():
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.normal(size=(2, language_id.BUCKETS)), np.array([0.1, -0.2]), 0.7, 0.0, rng.normal(size=(2, language_id.BUCKETS)))
    many = ["Élan vital", "abc", None, "x" * 3_000_000, "zw\x00ei drei", "a"]
    langs, best, known = language_id.predict(model, pa.array(many, pa.string()))
    for text, lang, score, f in zip(many, langs, best, known, strict=True):
        if text is not None:
            ids, part = language_id.features(text)
            z = (model.table[:, ids] @ part + model.bias) / 0.7
            assert abs(score - np.exp(z - z.max()).max() / np.exp(z - z.max()).sum()) < 1e-6
            assert abs(f - model.known["ab".index(lang), ids] @ part) < 1e-6


# lines


def naive_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if i is not None and len(key(s)) >= 40:
                holders[key(s)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [s for s in lines if i is None or len(holders[key(s)]) < 5 or i == max(holders[key(s)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_line_dedup_is_brute_force(spark, texts):
    long = "Ceci est une ligne très longue, É répétée souvent."
    rows = [*texts.items(), (-1, None), (-2, ""), (None, long), (None, None)]
    rows += [(1000 + i, f"a{i}\n \t{long.replace('C', 'c')}\x0c\n{long}\nend") for i in range(6)] + [(1005, f"{long}\n"), (1005, f"{long}\n")]
    rows += [(2000 + i, "É" * 40 if i < 5 else "é" * 40) for i in range(9)] + [(3000 + i, "x" * 39) for i in range(9)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r["record"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got), key=str) == naive_lines(rows)


def test_line_dedup_edges(spark, edges):
    assert line_dedup.dedup_lines(edges).count() == len(EDGES) and line_dedup.dedup_lines(edges.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def machine():
    return token_counts.Machine(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_token_counts_are_the_library_s(machine, library, texts):
    many = [t for _, t in EDGES if t] + list(texts.values()) + ["▁", " ", "  a", "a ", "\x00", "日本語 テキスト 😀😀", "é", "<0x41>", "</s>"]
    assert [machine.count(t) for t in many] == [len(x) for x in library.encode(many)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("thereingion ▁  \n\tÉéß日本0123.,<s>/😀"), max_size=80), st.integers(1, 9))
def test_chunks_compose_to_the_same_count(machine, library, text, chunk):
    expected = len(library.encode(text))
    assert machine.count(text) == expected and machine.count(text, chunk) == expected
    a, b, c = (machine.state_map(x) for x in (text[:chunk], text[chunk : 2 * chunk], text[2 * chunk :]))
    assert a.then(b).then(c)(machine.start) == a.then(b.then(c))(machine.start) == token_counts.run(machine.start, text)


def test_starting_over_changes_nothing(machine, texts, monkeypatch):
    some = list(texts.values())[:30]
    expected = [machine.count(t) for t in some]
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 20)
    assert [machine.count(t) for t in some] == expected


def test_states_of_one_long_text_are_bounded(machine, library, monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(97, 123, 60_000))) + " " + "".join(map(chr, rng.integers(0x3040, 0x30FF, 20_000)))
    monkeypatch.setattr(token_counts, "MAX_STATES", 500)
    most, met = 0, token_counts.Machine.state_map

    def watched(self, chunk):
        nonlocal most
        out = met(self, chunk)
        most = max(most, len(self.states))
        return out

    monkeypatch.setattr(token_counts.Machine, "state_map", watched)
    assert machine.count(text, 2000) == len(library.encode(text)) and most < 500 + 2 * 2000


def test_token_query_is_the_library(spark, sf, texts, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10_token_counts(spark, sf).collect()}
    n = {d: len(library.encode(t or "")) for d, t in texts.items()}
    assert got == {d: (len((t or "").encode()), n[d], n[d] > 4096) for d, t in texts.items()}


def test_token_count_query_edges(spark, edges, library):
    got = token_counts.count_tokens(edges, tokenizer_path("piece_bpe_32k.model")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(
        ((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in EDGES), key=str
    )


# packing


def naive_pieces(tokenizer, text):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    out, start = [], 0
    while start < len(ids):
        n = min(2048, 1 << ((len(ids) - start).bit_length() - 1))
        out.append((start, n, np.array(ids[start : start + n], "<u4").tobytes(), len(ids)))
        start += n
    return out


def test_packing_is_the_tokenizer_s_ids_in_powers_of_two(spark, edges, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").unionByName(edges.select("doc_id", "text"))
    got = packing.pack(docs, path).collect()
    want = [(d["doc_id"], *p) for d in docs.collect() for p in naive_pieces(tokenizer, d["text"])]
    assert sorted(((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and 1 << r["bucket"] == r["length"] for r in got)
    with pytest.raises(ValueError):
        packing.pack(docs, path, full=1000)


def test_plain_characters_are_cut_as_the_tokenizer_cuts():
    ids = packing.Ids(tokenizer_path("byte_bpe_50k.json"))
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and packing.PLAIN.fullmatch(chr(c))]
    for c in plain[:: 1 if len(plain) < 3000 else 7]:
        s = f"a{c}b1{c}2 {c}{c} .{c} _{c}  {c}'s{c}'ll "
        assert ids.of(s) == ids.whole(s)


def test_pieces_forgotten_are_found_again(monkeypatch, texts):
    monkeypatch.setattr(packing, "HELD_PIECES", 10)
    ids = packing.Ids(tokenizer_path("byte_bpe_50k.json"))
    assert all(ids.of(t) == ids.whole(t) for t in list(texts.values())[:20])


def test_query_digests(spark, sf, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = sorted((d, s, n, zlib.crc32(b), total) for d, t in texts.items() for s, n, b, total in naive_pieces(tokenizer, t))
    got = queries.op9_packing(spark, sf).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    clean = queries.op1_decontaminate(spark, sf).where("n_items = 0").first()
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_buckets_hold_sequences_of_equal_length(spark, edges, tmp_path):
    pieces = packing.pack(edges, tokenizer_path("byte_bpe_50k.json"))
    packing.write_buckets(pieces, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == pieces.count() and back.where("length != shiftleft(1, bucket)").count() == 0
    for batch in packing.bucket_batches(spark, f"{tmp_path}/out", 3):
        assert len({r["length"] for r in batch}) == 1 and len(batch) <= 3 and len({len(r["ids"]) for r in batch}) == 1
    assert sum(len(b) for b in packing.bucket_batches(spark, f"{tmp_path}/out", 3)) == pieces.count()


def test_long_texts_are_packed_in_parts(monkeypatch, texts):
    monkeypatch.setattr(packing, "PART_CHARS", 7)
    ids = packing.Ids(tokenizer_path("byte_bpe_50k.json"))
    for t in [*list(texts.values())[:20], "a b  c\n d 'll x's  9 y", "no-space" * 50, "   ", " a " * 9]:
        assert ids.of(t) == ids.whole(t)


def test_language_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    model = language_id.Model(["a", "b"], rng.normal(size=(2, language_id.BUCKETS)), np.zeros(2), 1.0, 0.0)
    many = pa.array(["abc def é" * k for k in (1, 0, 30, 2, 90)], pa.string())
    whole = language_id.predict(model, many)[1]
    monkeypatch.setattr(language_id, "SLICE_BYTES", 3)
    np.testing.assert_allclose(language_id.predict(model, many)[1], whole)


def test_many_lines_take_linear_time(spark):
    rows = [(i, "\n".join(f"line {j} of a text of very many lines, that all hold" for j in range(20_000))) for i in range(5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["n_lines"], r["n_dropped"]) for r in got) == [(20_000, 0)] + [(20_000, 20_000)] * 4
