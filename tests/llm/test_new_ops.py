"""Ranked search, chat formatting and conversation repair against brute force and on the edge cases they define."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat, repair, textops, wand

DOC, ITEM, TURN = "doc_id long, text string", "item_id long, text string", "conv_id long, turn long, role string, text string"
CLASH = ["key", "n", "terms", "times", "item", "rank", "score", "cid", "pos", "segment", "step", "edit", "fault", "initial", "turns", "blocks", "starts", "formatted"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


# 11


def terms_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_ranks(docs, items, top=10):
    counts = [Counter(terms_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    big, every = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(x for c in counts for x in c)
    out = []
    for item, text in items:
        found = []
        for (i, _), c, n in zip(docs, counts, sizes, strict=True):
            m = 100 - 90 + (90 * n * big) // every if every else 0
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in set(terms_of(text)) if x in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def made_docs(n, seed=3):
    r = np.random.default_rng(seed)
    words = [f"w{int(x)}" for x in r.zipf(1.3, 4000) % 300]
    docs = [(int(i), " ".join(r.choice(words, r.integers(1, 60)))) for i in r.permutation(n)]
    return docs + [(1, docs[0][1])] * 3 + [(None, "w1 W2 w3!"), (None, None), (n + 1, ""), (n + 2, "w7 " * 20_000), (n + 3, "É́ w5_w6-W5"), (n + 3, "É́ w5_w6-W5")]


ITEMS = [(1, "w1 w2 w3 w4"), (2, "W2 w2; w9 w30 w31 w32"), (3, None), (4, "?!"), (4, "w7"), (None, "é w5 É"), (6, "absent"), (7, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize(("shard_docs", "cursors", "block", "parts"), [(4096, 1 << 14, 4 << 20, 1), (7, 16, 40, 3), (1, 1, 1, 2)])
def test_ranks_equal_brute_force(spark, shard_docs, cursors, block, parts):
    docs = made_docs(60 if shard_docs == 1 else 400)
    made = clashing(spark.createDataFrame(docs, DOC)).repartition(parts)
    got = wand.rank_documents(made, clashing(spark.createDataFrame(ITEMS, ITEM)), block_bytes=block, shard_docs=shard_docs, cursors=cursors)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(docs, ITEMS)


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(textops.Words, "hashes", lambda w: (w.end - w.start).astype(np.uint64))  # words of one length agree
    terms = wand.Terms(["one two six", "seven one"])
    for _, _, w in wand.words_of(pa.array(["two one ten Six seven seven eight a", ""])):
        place, term = terms.find(w)
        names = [bytes(terms.data[s : s + n]) for s, n in zip(terms.start, terms.size, strict=True)]
        assert sorted((int(p), names[t]) for p, t in zip(place, term, strict=True)) == [(0, b"two"), (1, b"one"), (3, b"six"), (4, b"seven"), (5, b"seven")]
    assert wand.Terms([None, "?"]).n == 0


def test_shards_skip_documents_that_cannot_enter():
    docs = [(i, "common rare" if i % 400 == 0 else "common filler") for i in range(4000)]
    made = wand.Terms(["common rare"])

    class Sent:
        value = made

    rows = list(wand._postings(Sent, [pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t.encode() for _, t in docs])], ["k", "t"])]))
    query = wand.Query(np.array([wand.weight(4000, 4000), wand.weight(4000, 10)]), made.of_item, 4000, 8000)
    heaps = wand.Heaps(1, 10)
    scored = sum(s.search(heaps) for s in wand.shards(query, rows))
    assert sorted(heaps.doc[0]) == list(range(0, 4000, 400)) and scored < 1000


def test_ranks_of_odd_tables(spark):
    docs, items = spark.createDataFrame(made_docs(20), DOC), spark.createDataFrame(ITEMS, ITEM)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items)):
        out = wand.rank_documents(d, i)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    named = wand.rank_documents(docs, items.select(F.col("item_id").cast("string"), "text"))
    assert {r.item_id for r in named.collect()} == {"1", "2", "4", "7", None}


# 12


ODD_TURNS = [
    (1, 0, "system", "be [SYS]kind[/SYS]"), (1, 1, "user", "a"), (1, 2, "user", "b\\[INST]"), (1, 3, "assistant", "[/INST\\"), (1, 3, "assistant", "[/INST\\"), (1, None, "to[SAYS]ol", "x[ROLE]\\\\n\n<"), (2, 0, None, None),
    (None, 1, "assistant", "\\"), (3, 5, "assistant", "[MORE]"), (3, 6, "assistant", ""), (3, 7, "assistant", "<s></s>"), (4, 0, "user", "w " * 200_000), (4, 1, "user", "["), (5, 0, "", "empty role"), (5, 1, "User", "x"),
]


def expected_chats(rows):
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        chats[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(v)] for c, v in chats.items()}


def test_chats_round_trip(spark):
    out = chat.format_chats(clashing(spark.createDataFrame(ODD_TURNS, TURN)))
    want = expected_chats(ODD_TURNS)
    rows = out.select("conv_id", "formatted", "pieces", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("pieces")).alias("l")).collect()
    assert {r.conv_id: [tuple(x) for x in r.t] for r in rows} == want and len(rows) == len(want)
    for r in rows:
        assert r.l == "".join(t for role, t in want[r.conv_id] if role == "assistant") and "".join(p.text for p in r.pieces) == r.formatted
        # as many blocks as changes of role
        assert len(re.findall(r"\[SYS\]|\[INST\]|\[ANS\]|\[ROLE\]", r.formatted)) == len(list(itertools.groupby(role for role, _ in want[r.conv_id])))
    assert chat.format_chats(spark.createDataFrame([], TURN)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[INST]", "\\"]), st.text(alphabet="<s>/[]INSTMORE\\a\n", max_size=12)), min_size=1, max_size=6), min_size=1, max_size=12))
def test_any_text_round_trips(spark, chats):
    rows = [(c, i, role, text) for c, turns in enumerate(chats) for i, (role, text) in enumerate(turns)]
    out = chat.format_chats(spark.createDataFrame(rows, TURN))
    for r in out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("pieces")).alias("l")).collect():
        assert [tuple(x) for x in r.t] == chats[r.conv_id] and r.l == "".join(t for role, t in chats[r.conv_id] if role == "assistant")


def test_templates(spark):
    other = chat.Template(begin="{B}", roles={"user": ("{U}", "{/U}")}, other=("{R}", "{T}", "{E}"), more="{+}", learned=("user", "bot"))
    df = spark.createDataFrame([(1, 0, "user", "{U}"), (1, 1, "bot", "{T}\\"), (1, 2, "bot", "[INST]")], TURN)
    r = chat.format_chats(df, other).select("formatted", chat.read_turns(F.col("formatted"), other).alias("t"), chat.read_loss(F.col("pieces"), other).alias("l")).first()
    assert [tuple(x) for x in r.t] == [("user", "{U}"), ("bot", "{T}\\"), ("bot", "[INST]")] and r.l == "{U}{T}\\[INST]" and r.formatted == "{B}{U}{\\U}{/U}{R}bot{T}{\\T}\\\\{+}[INST]{E}"
    for bad in ({"begin": ""}, {"more": "</s>"}, {"begin": "<\\s>"}, {"begin": "<<s>"}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


# 13


def whole_search(rows):
    """Least (cost, audit, roles) over all edits with up to two insertions at a place."""
    gaps = [[c for n in range(3) for c in itertools.product("ua", repeat=n)]] * (len(rows) + 1)
    best = None
    options = [[("D", 3, "")] + ([] if fault in ("blank", "duplicate") else [("K", fault == "truncated", ini), ("R", 2 + (fault == "truncated"), "u"), ("R", 2 + (fault == "truncated"), "a")]) for ini, fault in rows]
    for edits in itertools.product(*options):
        for inserted in itertools.product(*gaps):
            audit, out, cost = "I" * len(inserted[0]), "".join(inserted[0]), 2 * len(inserted[0])
            for (label, c, role), more in zip(edits, inserted[1:], strict=True):
                audit, out, cost = audit + label + "I" * len(more), out + role + "".join(more), cost + c + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best[:2]):
                best = (int(cost), audit, out)
    return best


def string_search(rows):
    """The same by whole strings from the end backwards, for any length: best (cost, audit, roles) of each grammar state."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    inf = (1 << 40, "", "")

    def insert(v):
        for _ in range(4):
            for g in range(4):
                for r in "ua":
                    if r in step[g]:
                        c = v[step[g][r]]
                        v[g] = min(v[g], (c[0] + 2, "I" + c[1], r + c[2]))
        return v

    v = insert([(0, "", ""), inf, inf, (0, "", "")])
    for ini, fault in reversed(rows):
        new = []
        for g in range(4):
            ways = [(v[g][0] + 3, "D" + v[g][1], v[g][2])]
            if fault not in ("blank", "duplicate"):
                for r, h in step[g].items():
                    c = v[h]
                    if r == ini:
                        ways.append((c[0] + (fault == "truncated"), "K" + c[1], r + c[2]))
                    if r in "ua":
                        ways.append((c[0] + 2 + (fault == "truncated"), "R" + c[1], r + c[2]))
            new.append(min(ways))
        v = insert(new)
    return v[0]


def shortest(rows):
    costs, arcs = repair.backward(rows, repair.END_COSTS)
    path, state = repair.forward(arcs, repair.START)
    return costs[repair.START], "".join([*path, repair.trailing(state)])


FAULTS = [None, None, None, "blank", "duplicate", "truncated"]


def test_shortest_paths_equal_brute_force():
    r = np.random.default_rng(5)
    for n in (0, 1, 1, 2, 2, 2, 2, 2, 2):
        rows = [("suat"[r.integers(4)], FAULTS[r.integers(6)]) for _ in range(n)]
        assert string_search(rows) == whole_search(rows)
    for n in [*range(9)] * 40:
        rows = [("suat"[r.integers(4)], FAULTS[r.integers(6)]) for _ in range(n)]
        cost, labels = shortest(rows)
        want = string_search(rows)
        assert (cost, re.sub("[a-z]", "", labels)) == want[:2]


def test_segments_compose():
    r = np.random.default_rng(6)
    for _ in range(50):
        rows = [("suat"[r.integers(4)], FAULTS[r.integers(6)]) for _ in range(r.integers(2, 12))]
        cut = int(r.integers(1, len(rows)))
        m, behind = repair.crossing(rows[:cut]), repair.backward(rows[cut:], repair.END_COSTS)[0]
        assert tuple(min(m[4 * g + h] + behind[h] for h in range(4)) for g in range(4)) == repair.backward(rows, repair.END_COSTS)[0]


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        row = (turn is not None, turn or 0, ("user" if k == 4 else role).encode(), ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text).encode())
        out[c] += [row] * (2 if k == 3 else 1)
    return {c: [(t if some else None, role.decode(), text.decode()) for some, t, role, text in sorted(v)] for c, v in out.items()}


def brute_repair(turns):
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in turns]
    cost, audit, roles = string_search(list(zip(initials, faults, strict=True)))
    lines, row, at = [], 0, 0
    for label in audit:
        if label == "I":
            lines.append({"u": "user", "a": "assistant"}[roles[at]] + ":")
        elif label != "D":
            lines.append((turns[row][1] if label == "K" else {"u": "user", "a": "assistant"}[roles[at]]) + ":" + turns[row][2])
        row, at = row + (label != "I"), at + (label != "D")
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made_turns():
    r = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system", "tool", "user", "assistant"], ["Yes.", "no", "Is it? \n", "", " \t", "ok!", "é…", "Yes.."]
    rows = [(c, i, roles[r.integers(6)], texts[r.integers(8)] + str(r.integers(40)) + "." * int(r.integers(2))) for c in range(60) for i in range(r.integers(1, 12))]
    hot = [(99, int(i), roles[r.integers(6)], texts[r.integers(8)]) for i in range(700)]
    odd = [(200, None, "user", "Hi."), (200, None, None, None), (200, 3, "", "x."), (200, 3, "assistant", "Yo."), (201, 0, "user", "a" * 300_000), (None, 0, "user", "Hi."), (None, 1, None, "Yo."), (202, 5, "user", "q."), (202, 5, "user", "q."), (203, -5, "user", "q."), (203, 9, "assistant", "q.")]
    return rows + hot + odd


@pytest.mark.parametrize("parts", [1, 40])
def test_repair_equals_brute_force(spark, tmp_path, parts):
    rows = made_turns()
    spark.createDataFrame(rows, TURN).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    put = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        got = {r[0]: tuple(r[1:]) for r in repair.op13_repair(spark, str(tmp_path)).collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    turns = damaged(rows)
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute_repair(turns[c]) if c in turns else nothing for c in {r[0] for r in rows}}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", " "), (1, 3, "assistant", "a."), (2, None, None, None)]
    out = repair.repair(clashing(spark.createDataFrame(rows, TURN))).orderBy("conv_id", "pos", "step").collect()
    assert [(r.conv_id, r.edit, r.turn, r.role, r.text, r.fault) for r in out] == [
        (1, "K", 0, "system", "s.", None), (1, "I", None, "user", "", None), (1, "K", 1, "assistant", "a.", None), (1, "D", 2, "user", " ", "blank"), (1, "D", 3, "assistant", "a.", "duplicate"), (2, "D", None, " ", " ", "blank"),
    ]
    assert repair.repair(spark.createDataFrame([], TURN)).count() == 0
