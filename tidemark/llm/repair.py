"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily. The input acceptor is the line of a conversation's rows. The edit
transducer keeps a row (cost 0), gives it another role (2), deletes it (3; the only way for blank and
repeated rows) or inserts an empty turn (2); a truncated row that stays adds 1. The grammar acceptor
takes role initials `(s?(ua)+)?` and has four states. A state of the product is a place between rows
and a grammar state, so product states have a topological order, and the shortest path is found from
the end backwards, over weights (cost, labels) in lexicographic order. Labels leave a state in only
one way each, as the grammar is deterministic; so paths of equal cost that begin with the same label
go on from the same state, and comparing (cost, first label) compares (cost, label string).

Rows are sorted into range partitions, so that a conversation of any length is cut into segments.
Costs through a segment are a small (min, +) matrix; matrices of the segments of one conversation,
folded from its end, give what every segment needs to know of the rest, and its paths from all four
states are found at once. A second fold from the start tells which of them was taken.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialise, read_table, ship

RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1
FAR = 1 << 60
#: Grammar states: nothing yet, after s, after u, after a. Next state by initial; None: not in the grammar.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
BLANK, REPEATED, TRUNCATED = "blank", "duplicate", "truncated"


def edits(initial: str, fault: str | None, state: int) -> list[tuple[int, str, int]]:
    """(cost, label, next state) of the arcs over one row from a grammar state. A label is an edit's initial, and the new role's for R and I."""
    arcs = [(DELETE, "D", state)]
    if fault not in (BLANK, REPEATED):
        stay = CUT * (fault == TRUNCATED)
        if initial in GRAMMAR[state]:
            arcs.append((stay, "K", GRAMMAR[state][initial]))
        arcs += [(RENAME + stay, "R" + r, GRAMMAR[state][r]) for r in ROLES if r in GRAMMAR[state]]
    return arcs


def with_insertions(best: list[tuple[int, str, int]]) -> tuple[tuple[int, str, int], ...]:
    """The best (cost, label, next state) from the four states of a place, given those without insertions there."""
    settled = False
    while not settled:  # a loop of insertions only adds cost, so this ends
        settled = True
        for g, h, r in [(g, h, r) for g in range(4) for r, h in GRAMMAR[g].items() if r in ROLES]:
            arc = (best[h][0] + INSERT, "I" + r, h)
            if arc < best[g] and arc[0] < FAR:
                best[g], settled = arc, False
    return tuple(best)


#: What is left to do after the last row, by state.
END = with_insertions([(0 if g in FINAL else FAR, "", g) for g in range(4)])
END_COSTS = tuple(c for c, _, _ in END)


@lru_cache(1 << 16)
def _step(initial: str, fault: str | None, after: tuple[int, ...]):
    return with_insertions([min((min(c + after[h], FAR), label, h) for c, label, h in edits(initial, fault, g)) for g in range(4)])


def backward(rows: list[tuple[str, str | None]], after: tuple[int, ...]) -> tuple[tuple[int, ...], list]:
    """Costs to the end from the place before the first of rows (initial, fault), and the best arcs of each row's place. after: those behind the last row.

    Differences between the costs of a place are bounded, so few different steps occur and they are kept.
    """
    arcs, costs = [], after
    for initial, fault in reversed(rows):
        low = min(costs)
        best = _step(initial, fault, tuple(c if c >= FAR else c - low for c in costs))
        arcs.append(best)
        costs = tuple(c if c >= FAR else c + low for c, _, _ in best)
    return costs, arcs[::-1]


def forward(arcs: list, state: int) -> tuple[list[str], int]:
    """The labels of each row along the best path from a state, with those of turns inserted before it, and the state behind the last row."""
    out = []
    for best in arcs:
        labels = ""
        while True:
            _, label, state = best[state]
            labels += label
            if label[0] != "I":
                break
        out.append(labels)
    return out, state


def trailing(state: int) -> str:
    """Labels of the turns inserted behind the last row."""
    out = ""
    while END[state][1]:
        out += END[state][1]
        state = END[state][2]
    return out


def crossing(rows: list[tuple[str, str | None]]) -> list[int]:
    """Least costs through rows from each state (rows of the matrix) to each state, row by row."""
    columns = [backward(rows, tuple(0 if g == h else FAR for g in range(4)))[0] for h in range(4)]
    return [columns[h][g] for g in range(4) for h in range(4)]


def _initial(role: Column) -> Column:
    return F.substr(role, F.lit(1), F.lit(1))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """cid, key, turn, role, text, pos and segment, written once. pos follows (key, turn, role, text), nulls first; a segment is a range partition."""
    cid = F.coalesce(F.concat(F.lit("c"), F.col(key).cast("string")), F.lit("n"))
    rows = rows.select(cid.alias("cid"), F.col(key).alias("key"), "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    # equal rows may stand in any order; the last column deals them out as well
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = ["cid", "turn", "role", "text", "_tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return materialise(rows.withColumn("segment", F.shiftright("pos", 33)), "chat-rows")


def with_faults(rows: DataFrame) -> DataFrame:
    """pos, segment, cid, initial and fault of numbered rows: the first of blank, duplicate (role and text earlier in the conversation) and truncated."""
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    name = F.unhex(F.sha2(F.concat_ws(":", F.length("cid").cast("string"), F.length("role").cast("string"), "cid", "role", "text"), 256))
    slim = rows.select("pos", "segment", "cid", _initial(F.col("role")).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), name.alias("name"))
    repeated = slim.where(~F.col("blank")).groupBy("name").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), REPEATED).when(F.col("cut"), TRUNCATED)
    return materialise(slim.join(repeated, "name", "left").select("pos", "segment", "cid", "initial", fault.alias("fault")), "chat-faults")


def runs(batches) -> Iterator[tuple[int, str, list[dict], bool]]:
    """(segment, cid, rows, whether it is its segment's first or last run) of rows sorted by pos."""
    mine, opened = [], None
    for b in batches:
        for r in b.to_pylist():
            if mine and (mine[-1]["segment"], mine[-1]["cid"]) != (r["segment"], r["cid"]):
                edge = opened != mine[-1]["segment"] or mine[-1]["segment"] != r["segment"]
                opened = mine[-1]["segment"]
                yield opened, mine[-1]["cid"], mine, edge
                mine = []
            mine.append(r)
    if mine:
        yield mine[-1]["segment"], mine[-1]["cid"], mine, True


def _matrices(batches):
    for segment, cid, rows, edge in runs(batches):
        if edge:
            matrix = crossing([(r["initial"], r["fault"]) for r in rows])
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "cid": [cid], "matrix": pa.array([matrix], pa.list_(pa.int64()))})


def _behind(batches):
    """Costs behind each segment of a conversation, from the last segment (which comes first) to the first."""
    cid, costs = None, END_COSTS
    for b in batches:
        out = []
        for r in b.to_pylist():
            last = r["cid"] != cid
            cid, costs = r["cid"], END_COSTS if last else costs
            out.append((r["segment"], cid, costs, last))
            m = r["matrix"]
            costs = tuple(min(min(m[4 * g + h] + costs[h] for h in range(4)), FAR) for g in range(4))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.bool_())], ["segment", "cid", "behind", "last"])


def _labels(batches):
    pos, labels, exits = [], [], []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(labels, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], ["pos", "labels", "exits"])
    for _, _, rows, edge in runs(batches):
        _, arcs = backward([(r["initial"], r["fault"]) for r in rows], tuple(rows[0]["behind"] or END_COSTS))
        paths = [forward(arcs, g) for g in (range(4) if edge else [START])]
        if not edge or rows[0]["last"]:
            for path, state in paths:
                path[-1] += trailing(state)
        pos += [r["pos"] for r in rows]
        labels += [list(x) for x in zip(*(path for path, _ in paths), strict=True)]
        exits += [None] * (len(rows) - 1) + [[state for _, state in paths] if edge else None]
        if len(pos) >= 20_000:
            yield flush()
            pos, labels, exits = [], [], []
    yield flush()


def _entries(batches):
    """The state in which the path enters each segment of a conversation, from the first to the last."""
    cid, state = None, START
    for b in batches:
        out = []
        for r in b.to_pylist():
            state = state if r["cid"] == cid else START
            cid = r["cid"]
            out.append((r["segment"], cid, state))
            state = r["exits"][state]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], ["segment", "cid", "entry"])


def repair(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The cheapest edits that make every conversation of turns (key, turn, role, text) legal, in order of pos and step.

    Columns: cid and key (its conversation), pos and step (order), edit (K, R, D or I), turn, initial
    (of the role that the row had), fault, role and text as they are after the edit. Rows of edit D are no
    part of the repaired conversation. An inserted turn has empty text and no turn, initial or fault.

    Turns are ordered by number, null first, and those of one number by role and text. A null role or
    text is one space; an empty role has no initial, and is in no legal place. A null key is a
    conversation. Repeated rows are found as duplicates. An empty table has no edits. Only the four
    columns are read, so others cannot clash.
    """
    spark = turns.sparkSession
    ship(spark)
    rows = numbered(turns, key)
    faults = with_faults(rows)
    line = lambda df: df.repartition("segment").sortWithinPartitions("pos")
    # two rows a segment at most
    matrices = line(faults).mapInArrow(_matrices, "segment long, cid string, matrix array<long>")
    behind = matrices.repartition("cid").sortWithinPartitions("cid", F.desc("segment")).mapInArrow(_behind, "segment long, cid string, behind array<long>, last boolean")
    found = line(faults.join(behind, ["segment", "cid"], "left")).mapInArrow(_labels, "pos long, labels array<string>, exits array<int>")
    found = materialise(found, "chat-labels").join(faults, "pos")
    ends = found.where("exits is not null").select("segment", "cid", "exits")
    entries = ends.repartition("cid").sortWithinPartitions("cid", "segment").mapInArrow(_entries, "segment long, cid string, entry int")
    labels = F.when(F.size("labels") == 1, F.element_at("labels", 1)).otherwise(F.get("labels", F.col("entry")))
    found = found.join(entries, ["segment", "cid"], "left").select("pos", "initial", "fault", F.regexp_extract_all(labels, F.lit("[A-Z][a-z]?"), 0).alias("labels"))
    out = rows.join(found, "pos").select("cid", F.col("key").alias(key), "pos", F.posexplode("labels").alias("step", "label"), "turn", "initial", "fault", "role", "text")
    edit, to = F.substr("label", F.lit(1), F.lit(1)), F.substr("label", F.lit(2))
    mine = lambda c: F.when(edit != "I", F.col(c)).alias(c)
    role = F.when(to == "u", ROLES["u"]).when(to == "a", ROLES["a"]).otherwise(F.col("role"))
    return out.select("cid", key, "pos", "step", edit.alias("edit"), mine("turn"), mine("initial"), mine("fault"), role.alias("role"), F.when(edit != "I", F.col("text")).otherwise(F.lit("")).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32 of `conv_id:turn` modulo 20. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("c")).where("c <> 0")
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("c") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


LEGAL = ("su", "ua", "au")
_COST = {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}
_SUMS = ["gaps", BLANK, REPEATED, TRUNCATED, "illegal", "cost"]


class _Sums:
    """What op13 tells of a conversation, gathered row by row: texts only pass through the digest."""

    def __init__(self, cid: str):
        self.cid, self.n, self.audit, self.sha, self.kept = cid, Counter(), [], hashlib.sha256(), 0
        self.was = self.low = self.turn = None
        self.turns = 0

    def add(self, r: dict) -> None:
        edit = r["edit"]
        self.audit.append(edit)
        self.n["cost"] += _COST[edit] + CUT * (edit in "KR" and r["fault"] == TRUNCATED)
        if edit != "I":
            self.n[r["fault"]] += 1
            self.n["illegal"] += self.was is not None and self.was + r["initial"] not in LEGAL
            self.was = r["initial"]
            if (t := r["turn"]) is not None and t != self.turn:
                self.low, self.turn, self.turns = t if self.low is None else self.low, t, self.turns + 1
        if edit != "D":
            self.sha.update((b"\n" if self.kept else b"") + f"{r['role']}:{r['text']}".encode())
            self.kept += 1

    def row(self) -> tuple:
        self.n["gaps"] = self.turn - self.low + 1 - self.turns if self.turns else 0
        return self.cid, *(self.n[c] for c in _SUMS), "".join(self.audit), self.sha.hexdigest()


def _sum_up(batches):
    schema = pa.schema([("cid", pa.string()), *((c, pa.int64()) for c in _SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now = None
    for b in batches:
        done = []
        for r in b.to_pylist():
            if now is None or now.cid != r["cid"]:
                done += [now.row()] if now else []
                now = _Sums(r["cid"])
            now.add(r)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.row(), strict=True))], schema)


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Damaged conversations, repaired. A conversation's digest is one hash over all its text, so its rows pass through one task, one by one."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    edited = repair(damage(turns)).select("cid", "pos", "step", "edit", "turn", "initial", "fault", "role", "text")
    sums = edited.repartition("cid").sortWithinPartitions("cid", "pos", "step").mapInArrow(_sum_up, "cid string, " + ", ".join(f"{c} long" for c in _SUMS) + ", audit string, repaired_sha256 string")
    every = turns.select("conv_id").distinct().withColumn("cid", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(sums, "cid", "left").select("conv_id", *[F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in [*_SUMS, "audit", "repaired_sha256"]])


#: Paths from the end backwards, as strings of a padded cost and labels, for the grammar states 0 to 3 (nothing yet, after s, u, a).
#: DuckDB has no crc32: its table is made of the polynomial.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), coded AS (
  SELECT named.*, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT)) % 20 AS c
  FROM named, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role, CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (VALUES (1), (2)) v(k) WHERE c <> 0 AND (k = 1 OR c = 3)
), told AS (
  SELECT *, left(role, 1) AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM hurt
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS was, count(*) OVER (PARTITION BY conv_id) AS n
  FROM told
), best(conv_id, i, c0, p0, c1, p1, c2, p2, c3, p3) AS (
  SELECT conv_id, n + 1, 0, '', 4, 'Iu,Ia,', 2, 'Ia,', 0, '' FROM faulty WHERE i = 1
  UNION ALL
  SELECT conv_id, i, b0[1], b0[2], b1[1], b1[2], b2[1], b2[2], b3[1], b3[2] FROM (
    SELECT conv_id, i, least(a0, (a2[1] + 2, 'Iu,' || a2[2]), (a3[1] + 4, 'Iu,Ia,' || a3[2])) AS b0, least(a1, (a2[1] + 2, 'Iu,' || a2[2]), (a3[1] + 4, 'Iu,Ia,' || a3[2])) AS b1,
      least(a2, (a3[1] + 2, 'Ia,' || a3[2])) AS b2, least(a3, (a2[1] + 2, 'Iu,' || a2[2])) AS b3
    FROM (
      SELECT b.conv_id, f.i,
        least((c0 + 3, 'D,' || p0), (c1 + st + CASE ini WHEN 's' THEN 0 ELSE 999999 END, 'K,' || p1), (c2 + st + CASE ini WHEN 'u' THEN 0 ELSE 999999 END, 'K,' || p2), (c2 + st + 2, 'Ru,' || p2)) AS a0,
        least((c1 + 3, 'D,' || p1), (c2 + st + CASE ini WHEN 'u' THEN 0 ELSE 999999 END, 'K,' || p2), (c2 + st + 2, 'Ru,' || p2)) AS a1,
        least((c2 + 3, 'D,' || p2), (c3 + st + CASE ini WHEN 'a' THEN 0 ELSE 999999 END, 'K,' || p3), (c3 + st + 2, 'Ra,' || p3)) AS a2,
        least((c3 + 3, 'D,' || p3), (c2 + st + CASE ini WHEN 'u' THEN 0 ELSE 999999 END, 'K,' || p2), (c2 + st + 2, 'Ru,' || p2)) AS a3
      FROM best b JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 999999 END AS st FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1))
), steps AS (
  SELECT conv_id, p0, c0, unnest(string_split(p0, ',')) AS label, generate_subscripts(string_split(p0, ','), 1) AS k FROM best WHERE i = 1
), placed AS (
  SELECT *, sum(CASE WHEN label LIKE 'I%' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS row FROM steps WHERE label <> ''
), mended AS (
  SELECT p.conv_id, any_value(c0) AS cost, string_agg(left(label, 1), '' ORDER BY k) AS audit,
    string_agg(CASE right(label, 1) WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE role END || ':' || CASE WHEN label LIKE 'I%' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (label <> 'D') AS line
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.row GROUP BY p.conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(line, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""
