"""Each operator against brute force and on the edge cases it defines."""

import hashlib
import math
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import automaton, bloom, components, decontam, eliasfano, fingerprints, jaccard, linededup, mixing, ngram_lm, packing, sharding, simhash, substring, textops, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
P = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
#: Nulls, empty and very long texts, ties, repeated rows, odd spaces.
ODD = [
    (1, P + " alpha", "en", "a", 1), (2, "intro " + P, "en", None, 1), (3, None, None, "a", None), (4, "", "en", "b", 0), (5, " \t\n ", "en", "b", 3), (6, "word " * 30_000, "en", "a", 1), (7, "É́ x\x1cy", "fr", "c", 5),
    (8, P + " alpha", "en", "a", 1), (8, P + " alpha", "en", "a", 1), (None, "no id " + P, "en", None, 2), (9, "l1\nl2\nl3\n\nl4", "en", "a", 1), (10, "x\nl1\nl2\nl3\nl4\ny", "en", "a", 1), (11, "r\nr\nr\nr\nr\nr\nr", "en", "b", 1),
]


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names clash with those the operators make."""
    df = spark.createDataFrame(ODD, DOC)
    return df.select("*", *[F.lit("x").alias(c) for c in ("k", "tie", "starts", "fp", "node", "size", "copies", "score", "h", "n")])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture
def table(spark, tmp_path):
    """A folder with a documents table of given (doc_id, text)."""

    def make(rows):
        spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_words_of_arrow_columns(texts):
    inside = textops.byte_class("space")
    got = []
    for _, _, data, off in textops.slices(pa.array(texts, pa.string())):
        w = textops.split_words(data, off, inside, lower=True)
        j = w.joined()
        got += [[w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(off) - 1)]
        assert [j.word(i) for i in range(len(j))] == [w.word(i) for i in range(len(w))]
        h = w.hashes()
        assert len(set(h.tolist())) == len({w.word(i) for i in range(len(w))})
    assert got == [words_of(lower(t)) for t in texts]


# 1


def test_fingerprint_groups_canonical_texts(spark, odd, empty):
    texts = ["A  b", "a B ", "ａ b", "é", "é", "e", None, "", "Straße", "STRASSE"]
    out = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    f = [r.fingerprint for r in out]
    assert f[0] == f[1] == f[2] and f[3] == f[4] != f[5] and f[6] == f[7] and f[8] == f[9] and len(set(f)) == 5
    assert [r.copies for r in out] == [3, 3, 3, 2, 2, 1, 2, 2, 2, 2]
    assert fingerprints.fingerprint(odd).count() == len(ODD) and fingerprints.fingerprint(empty).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark, table):
    weak = lambda x: F.pmod(F.xxhash64(x), F.lit(2)).cast("string")
    texts = ["a", "b", "c", "A", "d", "b "]
    out = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hash_of=weak).orderBy("doc_id").collect()
    assert len({r.fingerprint for r in out}) == 4 and out[0].fingerprint == out[3].fingerprint and [r.copies for r in out] == [2, 2, 1, 2, 1, 2]
    rows = fingerprints.op1_fingerprint(spark, table(list(enumerate(texts))), hash_of=weak).orderBy("doc_id").collect()
    assert len({r.fingerprint for r in rows}) == 4 and rows[0].fingerprint == rows[3].fingerprint


@pytest.mark.parametrize("rows", [[], [(5, "abc")], [(3, "abcdef"), (1, "xyz"), (9, None), (12, "ÄÖÜäöü")], [(i * 1000, "t%d " % i * (i % 7)) for i in range(50)]])
def test_edited_texts(spark, table, rows):
    got = {r.doc_id: r for r in fingerprints.op1_fingerprint(spark, table(rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    canon = lambda x: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()).split())
    seen = {}
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(t) // 2
        new = t[: len(t) - k] + after[:k]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].near_edited == float(canon(t) == canon(new)) and got[i].near_next == float(canon(t) == canon(after))
        for text, f in ((t, got[i].fingerprint), (new, got[i].edited_fingerprint)):
            assert seen.setdefault(canon(text), f) == f
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize(("quantiles", "rows"), [(4, 3), (2, 1), (3, 1000), (1, 5)])
def test_next_rows_over_many_stretches(spark, quantiles, rows):
    r = np.random.default_rng(6)
    keys = sorted(int(x) for x in [*r.integers(-50, 50, 30), *r.integers(0, 10**12, 30), *[7] * 9, 2**63 - 1])
    every = [(k, i, f"t{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame([every[i] for i in r.permutation(len(every))], "k long, tie long, text string").repartition(5)
    got = {x.tie: x.n.tie for x in fingerprints.with_next(df, "k", quantiles, rows).collect()}
    assert got == {i: (i + 1) % len(every) for i in range(len(every))}


# 2 and 10


def brute_windows(docs, width, earlier):
    first = {}
    for i, (key, units) in enumerate(docs):
        for a in range(len(units) - width + 1):
            w = tuple(units[a : a + width])
            first[w] = min(first.get(w, (key, i, a)), (key, i, a))
    out = []
    for i, (key, units) in enumerate(docs):
        gone = set()
        for a in range(len(units) - width + 1):
            if earlier(first[tuple(units[a : a + width])], (key, i, a)):
                gone |= set(range(a, a + width))
        out.append(gone)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=8), st.integers(1, 6))
def test_automaton_knows_the_first_document_of_each_window(docs, width):
    auto = automaton.SuffixAutomaton()
    for i, d in enumerate(docs):
        auto.add(d, i)
    for d in docs:
        want = [min(i for i, e in enumerate(docs) if any(e[b : b + width] == d[a : a + width] for b in range(len(e)))) for a in range(len(d) - width + 1)]
        assert auto.least_of_windows(d, width) == want
    assert auto.least_of_windows(["z"] * width, width) == [None]


@pytest.mark.parametrize(("bits", "hot", "often", "words"), [(bloom.MAX_BITS, None, 64, 50_000), (0, None, 64, 50_000), (bloom.MAX_BITS, 4, 2, 50_000), (bloom.MAX_BITS, 0, 1, 900), (0, 4, 64, 900), (bloom.MAX_BITS, None, 1, 50_000), (bloom.MAX_BITS, None, 3, 400), (0, None, 2, 2_000)])
def test_substrings_against_brute_force(spark, monkeypatch, bits, hot, often, words):
    monkeypatch.setattr(bloom, "MAX_BITS", bits)  # 0: the shuffled join instead of the filter
    r = np.random.default_rng(3)
    parts = [[f"w{x}" for x in r.integers(0, 50, 20)] for _ in range(6)]
    docs = [(i, sum((parts[r.integers(6)][r.integers(0, 5) : r.integers(12, 20)] if r.random() < 0.6 else [f"u{x}" for x in r.integers(0, 9, 7)] for _ in range(r.integers(1, 6))), [])) for i in range(60)]
    df = spark.createDataFrame([(i, "  ".join(w)) for i, w in docs], "doc_id long, text string").repartition(5)
    want = brute_windows(docs, 13, lambda f, me: f[0] < me[0])
    for row in substring.remove_repeats(df, hot=hot, often=often, shard_words=words).collect():
        gone = want[row.doc_id]
        assert bytes(row.kept).decode().split() == [w for j, w in enumerate(docs[row.doc_id][1]) if j not in gone]
        assert sum(s["to"] - s["from"] for s in row.spans) == len(gone)


def test_an_anchor_of_many_words_takes_several_automata(monkeypatch):
    monkeypatch.setattr(substring, "SHARD_WORDS", 40)
    r = np.random.default_rng(9)
    docs = [[f"w{x}" for x in r.integers(0, 3, r.integers(4, 12))] for _ in range(60)]
    rows = [(7, " ".join(d).encode(), i, 10**6) for i, d in enumerate(docs)]
    made = pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows]) for c in range(4)], ["key", "body", "lo", "hi"])
    got = {(r["h"], tuple(r["leasts"])) for b in substring._match(4, [made]) for r in b.to_pylist()}
    least = {}
    for i, d in enumerate(docs):
        for a in range(len(d) - 3):
            least.setdefault(tuple(d[a : a + 4]), i)
    assert got == {(substring.body_hash(b), tuple(least[tuple(d[a : a + 4])] for a in range(len(d) - 3))) for (_, b, _, _), d in zip(rows, docs, strict=True)}


def test_substring_edges(odd, empty):
    rows = {(r.doc_id, r.n_words): bytes(r.kept) for r in substring.remove_repeats(odd).collect()}
    assert rows[(8, 15)] == b"" and rows[(1, 15)].decode() == P + " alpha" and rows[(2, 15)] == b"intro" and rows[(None, 16)] == b"no id"
    assert rows[(3, 0)] == rows[(4, 0)] == rows[(5, 0)] == b"" and len(rows[(6, 30_000)].split()) == 30_000
    assert substring.remove_repeats(odd).count() == len(ODD) and substring.remove_repeats(empty).count() == 0


def test_texts_without_id_of_equal_short_hash_are_told_apart(spark):
    ids = spark.range(200_000)
    a = ids.select(F.concat(F.lit(P + " "), F.col("id").cast("string")).alias("a"))
    b = ids.select(F.concat_ws(" ", *[F.concat(F.lit(f"q{i}x"), F.col("id").cast("string")) for i in range(15)]).alias("b"))
    pair = a.join(b, F.hash("a") == F.hash("b")).orderBy("a").first()
    docs = spark.createDataFrame([(1, P), (None, pair.a), (None, pair.b)], "doc_id long, text string")
    kept = [bytes(r.kept).decode() for r in substring.remove_repeats(docs).collect() if r.doc_id is None]
    assert sorted(kept) == sorted([pair.a.split()[-1], pair.b])


def test_lines_against_brute_force(spark):
    r = np.random.default_rng(5)
    docs = [(i, [f"line {x}" for x in r.integers(0, 6, r.integers(0, 12))]) for i in range(40)]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string").repartition(4)
    want = brute_windows(docs, 3, lambda f, me: f[:2] < me[:2] or (f[:2] == me[:2] and me[2] >= f[2] + 3))
    for row in linededup.remove_repeated_lines(df).collect():
        lines = docs[row.doc_id][1]
        assert row.n_removed == len(want[row.doc_id]) and row.kept == "\n".join(x for j, x in enumerate(lines) if j not in want[row.doc_id])


@pytest.mark.parametrize("bits", [bloom.MAX_BITS, 0])
def test_long_lines_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(bloom, "MAX_BITS", bits)
    r = np.random.default_rng(6)
    long = [" ".join(f"w{x}" for x in r.integers(0, 99, 12)) for _ in range(4)]
    docs = [(i, [long[r.integers(4)] if r.random() < 0.3 else f"line {x}" for x in r.integers(0, 5, r.integers(0, 14))]) for i in range(40)]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string").repartition(4)
    want = brute_windows(docs, 3, lambda f, me: f[:2] < me[:2] or (f[:2] == me[:2] and me[2] >= f[2] + 3))
    seen = set()
    for i, lines in docs:
        for j, x in enumerate(lines):
            if x in long:
                want[i] |= {j} if x in seen else set()
                seen.add(x)
    for row in linededup.remove_repeated_lines(df).collect():
        lines = docs[row.doc_id][1]
        assert row.n_removed == len(want[row.doc_id]) and row.kept == "\n".join(x for j, x in enumerate(lines) if j not in want[row.doc_id])


def test_line_edges(odd, empty):
    rows = {r.doc_id: r for r in linededup.remove_repeated_lines(odd).collect()}
    assert rows[9].kept == "l1\nl2\nl3\n\nl4" and rows[10].kept == "x\ny" and rows[11].kept == "r\nr\nr" and rows[3].n_lines == 0
    assert linededup.remove_repeated_lines(odd).count() == len(ODD) and linededup.remove_repeated_lines(empty).count() == 0


# 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = packing.best_fit_decreasing(sizes, 32)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and all(sum(sizes[i] for i in r) <= 32 for r in rows)
    room = []
    for s in sorted(sizes, reverse=True):  # the same by looking at every row
        fit = [i for i, left in enumerate(room) if left >= s]
        at = min(fit, key=lambda i: room[i]) if fit else len(room)
        room += [32] * (not fit)
        room[at] -= s
    assert sorted(32 - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packing_loses_no_id(spark, odd, empty):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, length=64).collect()
    code = packing.encoder(packing.VOCABULARY)
    got = packing.unpack([(r.ids, r.cu_seqlens, r.doc_ids, r.doc_offsets) for r in rows])
    for r in docs.collect():
        assert code.decode(got[r.doc_id][:-1].tolist()) == (r.text or "") and got[r.doc_id][-1] == packing.END
    assert all(len(r.ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids and r.position_resets == r.cu_seqlens[:-1] for r in rows)
    assert packing.position_ids([0, 3, 5], 7).tolist() == [0, 1, 2, 0, 1, 0, 1]
    assert len({r.pack_id for r in rows}) == len(rows) and packing.pack(empty).count() == 0 and sum(len(r.doc_ids) for r in packing.pack(odd).collect()) >= len(ODD)


# 4


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 5000))
def test_elias_fano(values, ask):
    values = np.array(sorted(values), np.uint64)
    ef = eliasfano.EliasFano(eliasfano.encode(values, 5001))
    if len(values):
        assert (ef.access(np.arange(len(values))) == values).all()
    at = ef.find(np.array([ask, *values.tolist()], np.uint64))
    assert (at[0] >= 0) == (ask in values.tolist()) and all(values[i] == v for i, v in zip(at[1:], values, strict=True))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_brute_force(spark, odd, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id > 2").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000000 as doc_id", "text"))
    train = docs.where("doc_id % 5 <> 1")
    got = {r.doc_id: r for r in ngram_lm.score(docs, ngram_lm.fit(train, order=order)).collect()}
    tok = {r.doc_id: (*words_of(lower(r.text)), 0) for r in docs.collect()}
    grams = [Counter() for _ in range(order + 1)]
    for i, t in tok.items():
        if i % 5 != 1:
            grams[1].update((x,) for x in t)
            grams[2].update(zip((0, *t), t, strict=False))
            if order > 2:
                grams[3].update(zip((0, *t), t, t[1:], strict=False))
    total, vocabulary = sum(grams[1].values()), len(grams[1])
    base = lambda w: math.log10((grams[1][(w,)] + 0.5) / (total + 0.5 * (vocabulary + 1)))
    kept = [{}, {}] + [{g: c for g, c in grams[n].items() if c >= 2} for n in range(2, order + 1)]
    mass = [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in kept[n].items():
            mass[n][g[:-1]] += (c - 0.75) / grams[n - 1][g[:-1]]

    def logp(context, w):
        if not context:
            return base(w)
        n, g = len(context) + 1, (*context, w)
        shorter = logp(context[1:], w)
        back = max(1 - mass[n][context], 1e-9)
        return math.log10((kept[n][g] - 0.75) / grams[n - 1][context] + back * 10**shorter) if g in kept[n] else math.log10(back) + shorter

    for i, t in tok.items():
        want = sum(logp(((0, *t)[j],) if order == 2 or j == 0 else ((0, *t)[j - 1], (0, *t)[j]), w) for j, w in enumerate(t))
        assert math.isclose(got[i].base_score, sum(map(base, t)), rel_tol=1e-9) and got[i].n_tokens == len(t) and got[i].n_known == sum((w,) in grams[1] for w in t)
        assert abs(got[i].score - want) <= 0.02 * len(t) + 1e-6, (i, got[i].score, want)


def test_every_gram_of_the_query_is_kept(spark, table, monkeypatch):
    texts = [f"a b c once{i} twice{i // 2}" for i in range(60)]
    made, fit = [], ngram_lm.fit
    monkeypatch.setattr(ngram_lm, "fit", lambda *x, **y: made.append(fit(*x, **y)) or made[-1])
    rows = ngram_lm.op4_ngram_score(spark, table(list(enumerate(texts)))).collect()
    train = [(0, *texts[r.doc_id].split(), 0) for r in rows if not r.held_out]
    grams = [len({t[i : i + n] for t in train for i in range(len(t) - n + 1)}) for n in (2, 3)]
    assert [int(g.base[-1]) for g in made[0].grams] == grams and all(math.isfinite(r.score) for r in rows)


def test_scores_of_empty_tables(empty, odd):
    trie = ngram_lm.fit(empty)
    assert ngram_lm.score(empty, trie).count() == 0
    rows = ngram_lm.score(odd, trie).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 and r.n_known == 0 for r in rows)


# 5


def test_longest_first_to_the_least_loaded():
    assert sharding.lpt([("a", 5), ("b", 4), ("c", 3), ("d", 3), ("e", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.assign_shards(docs.unionByName(docs.limit(30))).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    shard = {}
    for r in rows:
        t = texts[r.doc_id].encode()
        assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and shard.setdefault(t, r.shard) == r.shard
    for s in range(16):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    group = Counter()
    for r in rows:
        group[texts[r.doc_id]] += r.size
    mean = sum(loads) / 16  # a group above a fair share is not split
    assert max(loads) <= max(1.02 * mean, max(group.values())) and min(loads) > 0.98 * (sum(loads) - max(loads)) / 15
    got = sharding.assign_shards(odd, 3).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (3, 4)} == {1} and sharding.assign_shards(empty).count() == 0


def test_shards_equal_brute_force_scheduling(spark):
    r = np.random.default_rng(12)
    texts = [f"text {i} " + "x" * int(n) for i, n in enumerate(r.integers(1, 4000, 70))]
    picks = [texts[i] for i in r.integers(0, 70, 300)]
    docs = spark.createDataFrame(list(enumerate(picks)), "doc_id long, text string").repartition(5)
    groups = sorted(((sum(len(t) + 1 for t in picks if t == g), hashlib.sha256(g.encode()).hexdigest(), g) for g in set(picks)), key=lambda x: (-x[0], x[1]))
    for shards in (3, 16):
        loads, at = [0] * shards, {}
        for size, _, g in groups:  # every group is large enough to be scheduled by itself
            at[g] = min(range(shards), key=lambda s: (loads[s], s))
            loads[at[g]] += size
        assert {r.doc_id: r.shard for r in sharding.assign_shards(docs, shards).collect()} == {i: at[t] for i, t in enumerate(picks)}


def test_rows_without_id_are_numbered_in_many_parts(spark):
    docs = spark.range(400).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("copy").alias("text")).repartition(3)
    rows = sharding.assign_shards(docs, 4, part_rows=30).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(400)) and sum(r.doc_id is None for r in rows) == 300
    none = sorted(r.slot for r in rows if r.doc_id is None)
    assert none[-1] - none[0] > 300  # they are not one run of slots, as they were dealt out


def test_slots_of_a_hot_group_in_many_parts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    one, many = (sharding.assign_shards(docs, 4, part_rows=n).collect() for n in (10**6, 3))
    assert {(r.doc_id, r.shard) for r in one} == {(r.doc_id, r.shard) for r in many} and len({r.shard for r in many if r.doc_id < 200}) == 1
    for s in range(4):
        own = [r.slot for r in many if r.shard == s]
        assert sorted(own) == list(range(len(own)))


# 6


def test_network_gradients():
    r = np.random.default_rng(0)
    x = toxicity.inputs_of(np.frombuffer(b"you are a fool or not a fool my friend", np.uint8), np.array([0, 20, 38]))
    net = toxicity.Network.fresh()
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    _, begin, n = toxicity.windows_of(x.first)
    y, ones = np.array([1.0, 0.0]), np.ones(97)
    g = net.gradients(x, begin, n, y, ones)
    loss = lambda: float(np.mean(np.log1p(np.exp(z := net.logits(x, begin, n).astype(float))) - y * z))
    for k in ("Wf", "Ub", "A", "v", "o", "bf", "Ec"):
        flat, want = net.p[k].reshape(-1), g[k].reshape(-1)
        i = int(np.argmax(np.abs(want)))
        old, step = flat[i], 1e-2
        flat[i] = old + step
        up = loss()
        flat[i] = old - step
        down = loss()
        flat[i] = old
        assert abs((up - down) / (2 * step) - want[i]) < 0.05 * abs(want[i]) + 2e-4, k


def test_windows_cover_whole_texts():
    text, begin, n = toxicity.windows_of(np.array([0, 0, 10, 58, 200]))
    assert text.tolist() == [1, 2, 3, 3, 3, 3] and n.tolist() == [10, 48, 48, 48, 48, 48] and begin[-1] + 48 == 200
    assert set(range(58, 200)) == {w for b, k in zip(begin[2:], n[2:], strict=True) for w in range(b, b + k)}


def test_sample_is_filled_from_short_texts_then_from_long_ones(spark):
    texts = [(i, ("long " * 50 if i % 10 else "short") if i % 2 else "clean " * 3) for i in range(1000)] + [(1001, None), (1003, "short"), (1003, "short")]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int")
    learned = {i for i, t in texts if t is not None and zlib.crc32(str(i).encode()) % 5}
    for rows, chars in ((50, 100), (30, 300), (400, 20)):
        got = {r.doc_id: (r.text, r.toxic) for r in toxicity.labelled_sample(docs, labels, rows, chars).collect()}
        assert got.keys() <= learned and all(t == dict(texts)[i] and y == i % 2 for i, (t, y) in got.items())
        for y in (0, 1):
            mine = [dict(texts)[i] for i in learned if i % 2 == y]
            taken, short = [t for t, z in got.values() if z == y], [t for t in mine if len(t) <= chars]
            assert len(taken) <= rows and sum(map(len, taken)) <= rows * chars and sum(len(t) <= chars for t in taken) == min(rows, len(short))
            assert len(taken) == rows or len(taken) == len(mine) or sum(map(len, taken)) > rows * chars - 250


def test_held_out_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.95 and (got.predicted == got.toxic).mean() > 0.95
    net = toxicity.train(["fool " * 5, "nice day"] * 20, [1, 0] * 20, 0.5)
    rows = toxicity.score_toxicity(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and toxicity.score_toxicity(empty, net).count() == 0
    assert toxicity.keep_clean(odd, net).columns == odd.columns
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(odd, none).collect())


# 7


def brute_simhash(t, width):
    w = words_of(lower(t))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [1, 4, 8])
def test_masks_cover_every_pair(radius):
    masks, r = simhash.masks(radius), np.random.default_rng(1)
    for _ in range(3000):
        d = np.bitwise_or.reduce(np.uint64(1) << r.choice(64, radius, replace=False).astype(np.uint64))
        assert (masks & d == 0).any()


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_forest(monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for _ in range(6)]]))
    root = simhash.forest_of(fp, np.zeros_like(fp), 2, 64)
    up = simhash.Forest(len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2)
    up.join(i, j)
    assert (root == up.roots()).all()


def test_near_duplicates_against_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 100000 as doc_id", "text"))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    fp = np.array([brute_simhash(r.text, 4) for r in rows], np.uint64)
    up = simhash.Forest(len(fp))
    up.join(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for i, r in enumerate(rows):
        assert got[r.doc_id].fp % 2**64 == int(fp[i]) and got[r.doc_id].component_id == rows[up.find(i)].doc_id
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(spark, odd, empty):
    r = np.random.default_rng(0)
    base = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 300)) for _ in range(5)]
    rows = [(10 * i, t) for i, t in enumerate(base)] + [(10 * i + 1, " ".join("edit" if j == 7 else w for j, w in enumerate(t.split()))) for i, t in enumerate(base)] + [(0, base[0])]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [0, 10, 20, 30, 40]
    assert jaccard.keep_first(odd).columns == odd.columns and jaccard.keep_first(empty).count() == 0


def brute_sets(texts):
    """Sets of five-word shingles; a shorter text is one shingle."""
    return [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if (w := words_of(lower(t))) else set() for t in texts]


def brute_groups(texts):
    """The least place of each text's group, from links between all pairs that are 4/5 alike."""
    sets, up = brute_sets(texts), simhash.Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                up.join(np.array([i]), np.array([j]))
    return up.roots().tolist()


def edited(t, kind, r):
    w, new = t.split(), lambda n: [f"n{x}" for x in r.integers(0, 10**9, n)]
    return " ".join({"append 20%": lambda: w + new(len(w) // 5), "append 10%": lambda: w + new(len(w) // 10), "cut 19%": lambda: w[: len(w) - 19 * len(w) // 100], "every 50th": lambda: [x if (i + 1) % 50 else new(1)[0] for i, x in enumerate(w)]}[kind]())


def test_no_pair_of_near_copies_is_lost(spark):
    r = np.random.default_rng(3)
    base = [" ".join(t.split()[:600]) for t in (x.text for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()) if len((t or "").split()) >= 40]
    texts = [*base, *[edited(t, k, r) for t in base for k in ("append 20%", "append 10%", "cut 19%", "every 50th")]]
    texts += ["same start " * 3 + " ".join(f"v{x}" for x in r.integers(0, 10**6, 60)) for _ in range(30)] + [None, "", "a b", "A  B", "a b c"]
    want = brute_groups(texts)
    kept = jaccard.keep_first(spark.createDataFrame([(int(i), texts[i]) for i in r.permutation(len(texts))], "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and len(set(want)) < len(texts) - 2 * len(base)


def test_texts_that_share_a_passage_stay(spark):
    r = np.random.default_rng(4)
    new = lambda n: [f"v{x}" for x in r.integers(0, 10**9, n)]
    texts = []
    for share in (670, 720, 770, 820, 850):
        passage = new(share)
        texts += [" ".join([*passage, *new(1000 - share)]) for _ in range(4)]
    a, b, *_ = brute_sets(texts[:2])
    c, d = brute_sets(texts[-2:])
    assert 0.49 < len(a & b) / len(a | b) and len(c & d) / len(c | d) < 0.75
    kept = jaccard.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(len(texts)))


def test_rows_that_share_an_id_or_have_none_stay(spark):
    r = np.random.default_rng(5)
    a, b, c, d, e, f = (" ".join(f"v{x}" for x in r.integers(0, 10**9, 40)) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (7, d), (3, b), (3, f)]
    kept = jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(0, a), (0, c), (7, d), (7, e), (3, b), (3, f)])


def test_large_group_of_near_copies(spark):
    """More than HOT texts under one shingle; the last one is alike to a copy only, not to the first."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:j], "edit", *base[j + 1 :]]) for j in range(5, 290, 7)] + [" ".join([*base[:270], *[f"z{i}" for i in range(30)]])] + ["else " * 9]
    kept = jaccard.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(brute_groups(texts)))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, edges):
    up = simhash.Forest(13)
    for a, b in edges:
        up.join(np.array([a]), np.array([b]))
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()))
    assert got == {x: up.find(x) for e in edges if e[0] != e[1] for x in e}


# 8


def test_contamination_against_brute_force(spark, odd, empty):
    r = np.random.default_rng(4)
    item = lambda n: [f"v{x}" for x in r.integers(0, 30, n)]
    items = [(i, item(n)) for i, n in enumerate([30, 20, 13, 5, 2, 1, 13])] + [(99, []), (100, item(14))]
    docs = []
    for i in range(60):
        parts = [items[r.integers(len(items))][1] if r.random() < 0.3 else item(r.integers(1, 25)) for _ in range(4)]
        docs.append((i, sum((p[: r.integers(1, 40)] for p in parts), [])))
    bench = spark.createDataFrame([(i, " -- ".join(w).upper()) for i, w in items] + [(7, None)], "item_id long, text string")
    df = spark.createDataFrame([(i, "! ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    for limit in (decontam.BLOCK_BYTES, 40):
        for row in decontam.contamination(df, bench, limit=limit).collect():
            text, hit, found = docs[row.doc_id][1], set(), set()
            for i, w in items:
                n = min(13, len(w))
                for a in range(len(w) - n + 1) if n else ():
                    for p in range(len(text) - n + 1):
                        if text[p : p + n] == w[a : a + n]:
                            hit |= set(range(p, p + n))
                            found.add(str(i))
            assert (row.n_words, row.n_hit, row.items) == (len(text), len(hit), sorted(found))
    kept, again = ({r.doc_id for r in decontam.drop_contaminated(df, bench, limit).collect()} for limit in (decontam.BLOCK_BYTES, 100))
    assert kept == again == {r.doc_id for r in decontam.contamination(df, bench).collect() if not (r.n_hit and 20 * r.n_hit >= r.n_words)}
    assert decontam.contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0 and decontam.contamination(odd, bench).count() == len(ODD)
    assert decontam.contamination(empty, bench).count() == 0 and decontam.contamination(empty, bench, limit=40).count() == 0
    assert decontam.contamination(odd, bench, limit=40).count() == len(ODD) and decontam.drop_contaminated(odd, bench, 100).columns == odd.columns


# 9


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(out[s] for s in over), free - over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, None: 40, "c": 7, "é": 900}, {"a": 10}, {"a": 0, "b": 3}, {"x": 50, "y": 50, "z": 50}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()}
    assert got.keys() == sizes.keys() and all(math.isclose(got[s], x, rel_tol=1e-9, abs_tol=1e-9) for s, x in brute_targets(sizes).items())


def test_mix_follows_targets(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.sample_copies(docs)
    rows = out.select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
    assert all(r.size == len(words_of(r.text)) and 0 <= r.copies <= 2 for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        taken, largest = sum(r.copies * r.size for r in own), max(r.size for r in own)
        assert abs(taken - own[0].target) <= 1.1 * largest and abs(sum(r.copies for r in own) - len(own) * own[0].target / own[0].source_size) <= 1
    again = mixing.sample_copies(docs.repartition(7)).select("doc_id", "copies").collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}
    assert mixing.emit(out).count() == sum(r.copies for r in rows)
    assert mixing.sample_copies(odd).count() == len(ODD) and mixing.sample_copies(empty).count() == 0


def spark_xxhash(*values):
    """Spark's xxhash64 of ints (as tuples ("i", x)), longs, texts and nulls."""
    h = 42
    for v in values:
        if v is not None:
            data = struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(data, h)
    return h - 2**64 if h >> 63 else h


def brute_mix(rows, part_rows=10**6):
    """(row, copies) of rows whose first three columns are doc_id, text and source; `hashed` of a row is what Spark hashes of it, in order."""
    sizes = {r["source"]: 0 for r in rows}
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    goal, parts, ranked, out = brute_targets(sizes), 16 + len(rows) // part_rows, {}, []
    for r in rows:
        n, h, i = len((r["text"] or "").split()), spark_xxhash(*r.values()), r["doc_id"]
        unit = 2 ** max(len(f"{n:b}") - 6, 0)
        ranked.setdefault(r["source"], []).append(((n // unit * unit, spark_xxhash(("i", 42), i, h) % parts, n, spark_xxhash(("i", 42), i), i is not None, i or 0, h), r))
    for s, own in ranked.items():
        offset = spark_xxhash(("i", 42), "n" if s is None else "s" + s) % (1 << 20) / (1 << 20)
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        out += [(r, math.floor(rank * rate + offset) - math.floor((rank - 1) * rate + offset)) for rank, (_, r) in enumerate(sorted(own, key=lambda x: x[0]), 1)]
    return out


@pytest.mark.parametrize("part_rows", [10**6, 20])
def test_mix_equals_brute_force(spark, part_rows):
    r = np.random.default_rng(13)
    rows = [(None if r.random() < 0.1 else int(i // 2), " ".join(["w"] * int(r.integers(0, 200))), [None, "a", "b", "é"][r.integers(4)]) for i in range(150)] + [(7, None, "a")] * 2
    got = mixing.sample_copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), part_rows=part_rows).collect()
    want = brute_mix([dict(zip(("doc_id", "text", "source"), x, strict=True)) for x in rows], part_rows)
    assert sorted(str((x["doc_id"], x["text"], x["source"], n)) for x, n in want) == sorted(str((x.doc_id, x.text, x.source, x.copies)) for x in got)


def test_equal_and_null_ids_are_mixed_alike_in_any_order(spark):
    rows = [(None if i % 2 else 7, f"w{i} x y", "en", "ab"[i % 3 == 0], i) for i in range(80)]
    seen = set()
    for seed in range(4):
        df = spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(80)], DOC).repartition(seed + 1)
        seen.add(tuple(sorted(r.text for r in mixing.emit(mixing.sample_copies(df, part_rows=25)).collect())))
    assert len(seen) == 1 and abs(len(seen.pop()) - 120) <= 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 3000), st.integers(0, 2**32)), min_size=1, max_size=4))
def test_bitmaps_never_differ_in_more_than_their_sets(sizes):
    sets = []
    for n, m, seed in sizes:
        r = np.random.default_rng(seed)
        both = r.integers(0, 2**63, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([both, r.integers(0, 2**63, x, dtype=np.uint64)])) for x in (m, m // 9)]
    bits = [jaccard.bitmap(s) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    found = jaccard.Bitmaps(bits).difference(i, j)
    want = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (found <= want).all() and ((found - want) % 2 == 0).all()


def test_one_meeting_of_many_texts_loses_no_link(spark):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 500, 60)]
    texts = []
    for i in range(60):
        x = list(base)
        for p in r.choice(60, int(r.integers(0, 4)), replace=False):
            x[p] = f"e{i}-{p}"
        texts.append(" ".join(x))
    rows = [(i, 0, t.encode()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "k long, tie long, text binary")
    sets = [set(next(jaccard.shingle_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))).tolist()) for _, _, t in rows]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if z in (x, y) else z for z in root]
    want = sorted(sorted(i for i in range(60) if root[i] == z) for z in set(root))
    for hot, most in ((2, 2048), (2, 7), (1000, 2048)):
        own, member = jaccard.groups(docs, hot=hot, most=most)
        at = {x.node: x.root for x in member.collect()}
        got: dict = {}
        for x in own.collect():
            got.setdefault(at.get(x.node, x.node), []).append(x.k)
        assert sorted(sorted(v) for v in got.values()) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 3)), max_size=40))
def test_a_forest_joins_what_all_edges_join(edges):
    edges = [e for e in edges if e[0] != e[1]]
    a, b, w = (np.array([e[i] for e in edges], np.int64) for i in range(3))

    def joined(places):
        root = list(range(10))
        for e in places:
            x, y = root[a[e]], root[b[e]]
            root = [min(x, y) if z in (x, y) else z for z in root]
        return root

    at = jaccard.forest(a, b, w)
    want = joined(range(len(edges)))
    assert joined(at) == want and len(at) == 10 - len(set(want))
    root = list(range(10))  # a least one: by Kruskal's rule
    total = 0
    for e in sorted(range(len(edges)), key=lambda e: w[e]):
        x, y = root[a[e]], root[b[e]]
        total += int(w[e]) if x != y else 0
        root = [min(x, y) if z in (x, y) else z for z in root]
    assert int(w[at].sum()) == total


def test_large_meetings_bring_fewer_pairs_than_texts(spark, monkeypatch):
    """Texts with 4 of 400 words changed are alike, those with 9 are alike to none but meet all others. The first round is left out, so all is left to the meetings."""
    made, candidates = [], jaccard.candidates

    def counted(met, pairs_of, keys=("h",)):
        out = candidates(met, pairs_of, keys).cache()
        if keys != ("h",):
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "candidates", counted)
    for place, name in ((jaccard, "star"), (jaccard.simhash, "links")):
        monkeypatch.setattr(place, name, lambda *_, own=getattr(place, name): own(*_).limit(0))
    r, texts = np.random.default_rng(8), []
    for i in range(160):
        x = [f"w{p}" for p in range(400)]
        for p in r.choice(9, 4 if i < 40 else 9, replace=False):
            x[44 * p + int(r.integers(5, 35))] = f"e{i}-{p}"
        texts.append(" ".join(x))
    kept = jaccard.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.select("doc_id").collect()) == [0, *range(40, 160)]
    assert made and max(made) < 160, made


def test_rows_of_one_key_and_text_are_chosen_by_their_other_columns(spark):
    rows = [(1, "a b c", s) for s in ("x", None, "y")] + [(None, "d e", "x"), (None, "f g", "x"), (7, "h i", "x"), (7, "j k", "x")]
    out = [sorted(map(str, jaccard.keep_first(spark.createDataFrame(r, "doc_id long, text string, source string")).collect())) for r in (rows, rows[::-1])]
    assert out[0] == out[1] and len(out[0]) == 5


def test_small_shards_and_split_contexts_score_alike(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    whole, cut = (ngram_lm.fit(docs.where("doc_id % 5 <> 1"), order=3, min_count=1, shard_tokens=n) for n in (10**9, 200))
    assert len(cut.grams[0].split[0]) > 0 and len(cut.grams[1].base) > len(whole.grams[1].base)
    assert [int(g.base[-1]) for g in cut.grams] == [int(g.base[-1]) for g in whole.grams]
    a, b = ({r.doc_id: r for r in ngram_lm.score(docs, t).collect()} for t in (whole, cut))
    assert all(abs(a[i].score - b[i].score) <= 0.02 * a[i].n_tokens and a[i].base_score == b[i].base_score for i in a)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 9)), max_size=30), st.sampled_from([6, 2**62]))
def test_sums_of_pairs(rows, words):
    c, w, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    want = Counter()
    for a, b, k in rows:
        want[(a, b)] += k
    got = ngram_lm.sum_pairs(c, w, n, words)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(*k, v) for k, v in sorted(want.items())]
    assert all((x == y).all() for x, y in zip(ngram_lm.unpacked(ngram_lm.packed(*got), 3), got, strict=True))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=20), st.integers(1, 30), st.integers(5, 40))
def test_every_pair_has_one_shard(counts, size, vocabulary):
    from types import SimpleNamespace

    node, parts = ngram_lm.shares(np.array(counts), size)
    cuts = ngram_lm._next_cuts([SimpleNamespace(shard=0, node=node, parts=parts)], np.array([0, len(counts)]), vocabulary)
    c, w = (x.ravel() for x in np.meshgrid(np.arange(len(counts)), np.arange(vocabulary), indexing="ij"))
    at = cuts.place(c, w)
    for s in range(len(cuts)):
        mine = np.flatnonzero(at == s)
        assert len(mine) and (c[mine[0]], w[mine[0]]) == (cuts.context[s], cuts.word[s]) and c[mine[-1]] - c[mine[0]] + 1 == cuts.width(s)
    assert (np.diff(at) >= 0).all()


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(textops.Words, "hashes", lambda w: (w.end - w.start).astype(np.uint64))  # words of one length agree
    windows = decontam.Windows([("i", b"one two six"), ("j", b"abc def")])
    windows.set_counts({int(x): 1 for keys in windows.shingles.values() for x in keys})
    text = b"two one six one two six abc dex abc def"
    for _, _, w in decontam.tokens(pa.array([text], pa.binary())):
        assert sorted(windows.hits(w, w.hashes())) == [(0, 3, 6), (1, 8, 10)]


@pytest.mark.parametrize("limit", [decontam.BLOCK_BYTES, 1])
def test_items_without_an_id_have_the_empty_name(spark, limit):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "four five"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), ("b", "two three"), (None, "four five"), ("c", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontam.contamination(docs, items, limit=limit).collect()}
    assert got == {1: (3, ["", "b"]), 2: (2, [""]), 3: (0, [])}


@pytest.mark.parametrize("low, high, spread", [(-60, 25, 6), (-9, 9, 0.5), (2, 4, 0.2), (0, 400, 30), (-1, 1, 2)])
def test_calibration_converges_at_any_scale(low, high, spread):
    r = np.random.default_rng(3)
    y = (np.arange(3000) % 2).astype(float)
    score = np.where(y == 1, high, low) + r.normal(0, spread, len(y))
    slope, offset = toxicity.calibrate(score, y, np.where(y == 1, 0.2, 1.8))
    assert slope > 0
    said = slope * score + offset >= 0
    if high - low > 6 * spread:
        assert (said == (y == 1)).mean() > 0.999
    else:
        assert said[y == 1].mean() > said[y == 0].mean()
