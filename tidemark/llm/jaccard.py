"""Near copies by the Jaccard similarity of shingle sets: covering LSH for the closest, prefix filtering for the rest.

Every text is the set of its WIDTH-word shingles (64-bit hashes). Links are made in two rounds, and in
both a pair is verified on its whole sets before it links.

1. The SimHashes of the sets are looked up by the covering masks of operator 7, and of each meeting
   of many texts (below) all pair with one of them. Most copies find their group here, in few pairs.
2. SimHash cannot reach all pairs that are 4/5 alike (they differ in some ten of 64 bits), so what is
   still apart is completed exactly. Members have one order that is the same for all texts. Two sets of
   x and y members that are 4/5 alike share 4/9 (x + y) members or more, so the first member they share
   is among the first x - ceil(4x/5) + 1 of the one and y - ceil(4y/5) + 1 of the other: texts meet
   under these members and no pair is missed. The order puts shingles that a sample finds in many
   texts last, so texts seldom meet under them. In a meeting of many texts a pair is only asked about
   if the parity bitmaps of its sets, whose difference never exceeds that of the sets, allow 4/5. Its texts
   are dealt into blocks of bounded size, and each two blocks are one task's group; a meeting whose
   texts are linked already is not compared. Of the pairs that a group finds it brings a forest over
   the texts that are not linked yet, fewer pairs than texts. What forests link is taken into account
   and the rest is compared again, turn by turn, while most pairs prove alike; at the end all pairs
   that are left are verified, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.bloom import EVERYTHING, bloom_of
from tidemark.llm.components import components
from tidemark.llm.runtime import doc_key, materialise, ship, whole_groups
from tidemark.llm.textops import byte_class, mix, ngrams, slices, split_words

WIDTH = 5
#: Texts of the sample, times in it from which a shingle is common, and the most common ones that are sent out.
SAMPLE, OFTEN, COMMON = 20_000, 3, 200_000
#: Meetings of more texts first link to one of them, and bring their bitmaps to the second round.
HOT = 16
#: Texts of a block of a meeting, about.
BLOCK = 2048
#: Most members of a set, and bytes of its parity bitmap.
BITMAPS = ((256, 64), (1024, 256), (None, 1024))
TILE = 512
#: Most turns in which large meetings bring forests.
TURNS = 8
_SPACE = byte_class("space")


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Ascending hashes of each text's shingles. A text of fewer words is one shingle, one without words has none."""
    w = split_words(data, off, _SPACE, lower=True)
    h = w.hashes()
    grams = ngrams(h, width)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix(ngrams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first members of a set in the common order."""
    n = len(own)
    size = n - -(-4 * n // 5) + 1 if n else 0
    if len(common):
        at = np.searchsorted(common, own)
        hit = common[np.minimum(at, len(common) - 1)] == own
        own = np.concatenate([own[~hit], own[hit]])
    return own[:size]


def _members(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, off in slices(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(data, off))).view(np.int64))], ["h"])


def bitmap(own: np.ndarray) -> bytes:
    """One bit for each residue of the members: whether an odd number of them has it."""
    size = next(b for most, b in BITMAPS if most is None or len(own) <= most)
    return np.packbits(np.bincount((own & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of uint64) of more bytes as those of `size` bytes: residues of a power of two fold."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size // 8), axis=1)


class Bitmaps:
    """The bitmaps of some texts as rows of uint64, made once for each size."""

    def __init__(self, bits: list[bytes]):
        self.bits, self.size, self.tables = bits, np.array([len(x) for x in bits]), {}

    def table(self, s: int) -> np.ndarray:
        """Rows of s bytes; those of smaller bitmaps are zero and not for use."""
        if s not in self.tables:
            rows = self.tables[s] = np.zeros((len(self.bits), s // 8), np.uint64)
            for t in np.unique(self.size[self.size >= s]):
                at = np.flatnonzero(self.size == t)
                rows[at] = fold(np.frombuffer(b"".join(self.bits[x] for x in at), np.uint64).reshape(len(at), -1), s)
        return self.tables[s]

    def difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of places the bits in which two bitmaps differ, each pair at its smaller size: at most the members in which their sets differ."""
        out = np.zeros(len(i), np.int64)
        least = np.minimum(self.size[i], self.size[j])
        for _, s in BITMAPS:
            pair = np.flatnonzero(least == s)
            for a in range(0, len(pair), 1 << 16):
                p = pair[a : a + (1 << 16)]
                rows = self.table(s)
                out[p] = np.bitwise_count(rows[i[p]] ^ rows[j[p]]).sum(axis=1)
        return out


ROWS = "k long, tie long, node long, n long, fp long, bits binary, first array<long>"


def _rows(sent, batches) -> Iterator[pa.RecordBatch]:
    common = sent.value
    for b in batches:
        for a, end, data, off in slices(b.column(2)):
            sets = list(shingle_sets(data, off))
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, common).view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in first])]).astype(np.int32), np.concatenate(first))
            fp = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(a, end - a), b.column(1).slice(a, end - a), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), pa.array([bitmap(s) for s in sets], pa.binary()), lists],
                ["k", "tie", "node", "n", "fp", "bits", "first"],
            )


def _met(often, hot: bool, batches) -> Iterator[pa.RecordBatch]:
    """(h, node, n, at) of every prefix member that is in the filter (hot) or not in it."""
    for b in batches:
        lists = b.column(2).combine_chunks() if isinstance(b.column(2), pa.ChunkedArray) else b.column(2)
        h, size = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        ok = often.value.has(h) == hot
        row = pa.array(row[ok])
        yield pa.RecordBatch.from_arrays([pa.array(h[ok]), b.column(0).take(row), b.column(1).take(row), pa.array(at[ok])], ["h", "node", "n", "at"])


def _sets(asked, batches) -> Iterator[pa.RecordBatch]:
    """(k, tie, members) of the texts whose name's hash the filter knows."""
    for b in batches:
        b = b.filter(pa.array(asked.value.has(b.column(3).to_numpy())))
        for a, end, data, off in slices(b.column(2)):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, end - a), b.column(1).slice(a, end - a), pa.array([s.tobytes() for s in shingle_sets(data, off)], pa.binary())], ["k", "tie", "members"])


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of edges between groups a and b that join all groups that the edges join, without rings: the least of each group, again and again. There are fewer of them than groups."""
    at = np.argsort(weight, kind="stable")
    names, ends = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
    x, y, label, out = ends[: len(at)], ends[len(at) :], np.arange(len(names)), [at[:0]]
    while True:
        p, q = label[x], label[y]
        apart = p != q
        x, y, at, p, q = x[apart], y[apart], at[apart], p[apart], q[apart]
        if not len(at):
            return np.concatenate(out)
        group, first = np.unique(np.stack([p, q], axis=1).ravel(), return_index=True)
        first //= 2
        out.append(at[np.unique(first)])
        onto = np.arange(len(names))
        onto[group] = p[first] + q[first] - group
        # two groups that go onto each other: the lesser one stays
        onto = np.where((onto[onto] == np.arange(len(names))) & (np.arange(len(names)) < onto), np.arange(len(names)), onto)
        while (onto[onto] != onto).any():
            onto = onto[onto]
        label = onto[label]


def _pairs(node: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, bits: list, side: np.ndarray | None = None, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a meeting that are not linked yet and can be 4/5 alike by their sizes, places and bitmaps; with side only pairs of two sides.

    With turn only those of a forest over the groups that they would link: the likeliest at turn 0, later by a hash.
    """
    order = np.argsort(n, kind="stable")
    node, n, left, root = node[order], n[order], n[order] - at[order], root[order]
    side = side if side is None else side[order]
    maps = Bitmaps([bits[x] for x in order])
    out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for a in range(0, len(node), TILE):
        x = slice(a, a + TILE)
        for b in range(a, len(node), TILE):
            y = slice(b, b + TILE)
            if 5 * n[x][-1] < 4 * n[y][0]:
                break
            ok = (root[x][:, None] != root[y][None]) & (9 * np.minimum(left[x][:, None], left[y][None]) >= 4 * (n[x][:, None] + n[y][None]))
            if side is not None:
                ok &= side[x][:, None] != side[y][None]
            i, j = np.nonzero(ok)
            i, j = i + a, j + b
            i, j = i[i < j], j[i < j]
            differ = maps.difference(i, j)
            near = 9 * differ <= n[i] + n[j]
            i, j, differ = i[near], j[near], differ[near]
            differ = differ / (n[i] + n[j])
            out.append((i, j, differ) if turn is None else _fewest(node, root, i, j, differ, turn))
    i, j, differ = (np.concatenate(c) for c in zip(*out, strict=True))
    if turn is not None:
        i, j, _ = _fewest(node, root, i, j, differ, turn)
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])


def _fewest(node: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray, differ: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if turn:
        low, high = (f(node[i], node[j]).view(np.uint64) for f in (np.minimum, np.maximum))
        weight = mix(mix(low + np.uint64(turn)) ^ high)
    else:
        weight = differ
    at = forest(root[i], root[j], weight)
    return i[at], j[at], differ[at]


def _large(turn: int | None = None):
    """A function that makes the pairs of blocks of large meetings, of a forest or (None) all."""

    def large(frames) -> Iterator[pd.DataFrame]:
        keys = ["h", "i", "j"]
        for part in whole_groups(frames, keys):
            cut = np.any([np.diff(part[c].to_numpy()) != 0 for c in keys], axis=0)
            edge = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(part)]])
            out = [(np.zeros(0, np.int64),) * 2]
            out += [_solve_blocks(part.iloc[edge[i] : edge[i + 1]], turn) for i in np.flatnonzero(np.diff(edge) > 1)]
            a, b = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return large


def _few(frames) -> Iterator[pd.DataFrame]:
    """The pairs of small meetings, all meetings of a batch at once: each row with the d-th after it, d = 1, 2 and so on, while both are of one meeting."""
    for part in whole_groups(frames, ["h"]):
        h, node, n, at = (part[c].to_numpy() for c in ("h", "node", "n", "at"))
        left = n - at
        edge = np.concatenate([[0], np.flatnonzero(np.diff(h) != 0) + 1, [len(h)]])
        end = np.repeat(edge[1:], np.diff(edge))
        out, d, i = [(node[:0], node[:0])], 1, np.flatnonzero(end - np.arange(len(h)) > 1)
        while len(i):
            j = i + d
            ok = 9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])
            out.append((node[i[ok]], node[j[ok]]))
            d += 1
            i = i[i + d < end[i]]
        p, q = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q)}).drop_duplicates()


def _solve_blocks(f: pd.DataFrame, turn: int | None):
    side = f["own"].to_numpy() if f["i"].iloc[0] != f["j"].iloc[0] else None
    return _pairs(*(f[c].to_numpy() for c in ("node", "n", "at", "root")), f["bits"].tolist(), side, turn)


def candidates(met: DataFrame, pairs_of, keys: tuple[str, ...] = ("h",)) -> DataFrame:
    """(a, b): distinct pairs of nodes. met: (keys, node, n, at and what pairs_of needs), a node once in a meeting; pairs_of gets rows sorted by keys."""
    rows = met.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(pairs_of, "a long, b long").distinct()


def star(many: DataFrame) -> DataFrame:
    """(a, b): each text of a meeting with the least of it, where the two can be 4/5 alike by their sizes and places."""
    low = many.groupBy("h").agg(F.min(F.struct("node", "n", "at")).alias("l"))
    left = F.least(F.col("n") - F.col("at"), F.col("l.n") - F.col("l.at"))
    both = many.join(low, "h").where((F.col("node") != F.col("l.node")) & (9 * left >= 4 * (F.col("n") + F.col("l.n"))))
    return both.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()


def blocks(many: DataFrame, bitmaps: DataFrame, most: int = BLOCK) -> DataFrame:
    """(h, i, j, own, node, n, at, root, bits): meetings that are not one group yet, each two of their blocks of about `most` texts together.

    many: (h, node, n, at, root). A text's block is own, and i <= j are the two that meet.
    """
    size = many.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("of"), F.min("root").alias("r"), F.max("root").alias("s"))
    rows = many.join(size.where("r < s").select("h", "of"), "h").join(bitmaps, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return rows.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "at", "root", "bits")


def _alike(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(9 * both >= 4 * (len(x) + len(y)))
        ok = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])


def _filter(hashes: DataFrame, column: str):
    """A broadcast Bloom filter of bounded size; one that knows everything where the list is too long for it."""
    return hashes.sparkSession.sparkContext.broadcast(bloom_of(hashes, column, hashes.count()) or EVERYTHING)


def _near(batches) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, n_a, n_b, bits_a, bits_b) whose bitmaps allow 4/5."""
    for b in batches:
        bits = b.column(4).to_pylist() + b.column(5).to_pylist()
        at = np.arange(len(b))
        ok = 9 * Bitmaps(bits).difference(at, at + len(b)) <= b.column(2).to_numpy() + b.column(3).to_numpy()
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are 4/5 alike.

    nodes: (node, n, bits, k, tie), one text of each; texts: (k, tie, text), read in place. Bitmaps are
    compared first, so only the sets of pairs that may be alike move.
    """
    bits = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b")]
    pairs = pairs.join(bits[0], "a").join(bits[1], "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    pairs = materialise(pairs.mapInArrow(_near, "a long, b long"), "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    name = F.xxhash64("k", "tie").alias("name")
    one = materialise(nodes.select("node", "k", "tie", name).join(asked, "node", "left_semi"), "asked")
    sent = _filter(one, "name")
    own = texts.select("k", "tie", "text", name).mapInArrow(lambda it: _sets(sent, it), "k long, tie long, members binary")
    own = materialise(own.dropDuplicates(["k", "tie"]).join(one, ["k", "tie"]).select("node", "members"), "sets")
    sides = [own.select(F.col("node").alias(c), F.col("members").alias(f"{c}_members")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_members", "b_members")
    return materialise(both.mapInArrow(_alike, "a long, b long"), "alike")


def one_of_each(rows: DataFrame) -> DataFrame:
    """A row for each node. Only nodes of several rows (and a few that the filter takes for such) are shuffled, the others stay where they are."""
    several = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node")
    sent = _filter(materialise(several, "several"), "node")
    known = F.arrow_udf(lambda x: pa.array(sent.value.has(x.to_numpy())), "boolean")("node")
    flagged = rows.withColumn("twice", known)
    cols = ("n", "fp", "bits", "first")
    folded = flagged.where("twice").groupBy("node").agg(F.min(F.struct("k", "tie")).alias("r"), *[F.first(c).alias(c) for c in cols])
    folded = materialise(folded.select("node", "r.k", "r.tie", *cols), "folded")
    return flagged.where("not twice").select("node", "k", "tie", *cols).unionByName(folded)


def groups(docs: DataFrame, sample: int = SAMPLE, hot: int = HOT, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(k, tie, node) of every row of docs, and (node, root) of the nodes that have a near copy.

    docs: (k, tie, text binary); k and tie name a text. Texts of equal sets are one node, whatever
    their number. Nodes 4/5 alike link; links are closed.
    """
    spark = docs.sparkSession
    ship(spark)
    few = docs.select("text").sample(min(1.0, sample / max(docs.count(), 1)), 42)
    often = few.mapInArrow(_members, "h long").groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).select("h")
    common = np.sort(often.toPandas().h.to_numpy().astype(np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(common)
    rows = docs.select("k", "tie", "text").mapInArrow(lambda it: _rows(sent, it), ROWS)
    rows = materialise(rows, "prefixes")
    nodes = one_of_each(rows)
    met = nodes.select(F.explode("first").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("h")
    often = _filter(materialise(met, "meetings"), "h")
    meetings = lambda hot: nodes.select("node", "n", "first").mapInArrow(lambda it: _met(often, hot, it), "h long, node long, n long, at long")
    many = materialise(meetings(True), "hot-meetings")
    close = simhash.links(nodes.select("node", "fp", F.lit(0).cast("long").alias("check")), simhash.RADIUS)
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    near = verified(close.unionByName(star(many)).distinct(), nodes, docs)
    member = components(near)
    root = lambda c: member.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rare = candidates(meetings(False), _few).join(root("a"), "a", "left").join(root("b"), "b", "left")
    rare = rare.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    def large(turn: int | None) -> DataFrame:
        apart = many.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return candidates(blocks(apart, nodes.select("node", "bits"), most), _large(turn), ("h", "i", "j"))

    near = near.unionByName(verified(rare.unionByName(large(0)).distinct(), nodes, docs))
    member, turn = components(near), 1
    while True:
        pairs = materialise(large(turn), "apart")
        asked = pairs.count()
        if not asked:  # a forest is empty only if no pair is left
            break
        linked = verified(pairs, nodes, docs)
        near = near.unionByName(linked)
        member = components(near)
        if turn is None:
            break
        turn = turn + 1 if turn < TURNS and 2 * linked.count() > asked else None
    return rows.select("k", "tie", "node"), member


def keep_first(docs: DataFrame) -> DataFrame:
    """Of every group of near copies one row, with all its columns: that with the least doc_id, then text checksum.

    A null doc_id is the greatest. A row is known by its doc_id and text, so rows that share an id,
    or have none, are near copies only if their texts are. Of rows equal in both the one with the least
    checksum of its other columns stays, so reruns agree. Null and wordless texts are copies of each other.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known_as = [doc_key(F.col("doc_id")).alias("_k"), F.xxhash64(body).alias("_tie")]
    rows, member = groups(docs.select(known_as[0].alias("k"), known_as[1].alias("tie"), body.cast("binary").alias("text")))
    names = rows.join(member, "node", "left").groupBy("k", "tie").agg(F.first(F.coalesce("root", "node")).alias("root"), F.count(F.lit(1)).alias("c"))
    names = materialise(names, "names")
    first = names.groupBy("root").agg(F.min(F.struct("k", "tie")).alias("f"))
    # names of rows that go, or of which there are several; the others are the only row of theirs to stay
    doubtful = names.join(first, "root").where((F.struct("k", "tie") != F.col("f")) | (F.col("c") > 1)).select("k", "tie", (F.struct("k", "tie") == F.col("f")).alias("stays"))
    doubtful = materialise(doubtful.withColumn("name", F.xxhash64("k", "tie")), "doubtful")
    sent = _filter(doubtful, "name")
    known = F.arrow_udf(lambda x: pa.array(sent.value.has(x.to_numpy())), "boolean")(F.xxhash64("_k", "_tie"))
    own = docs.select("*", *known_as).withColumn("_doubtful", known)
    sure = own.where("not _doubtful").select(*docs.columns)
    # only rows that the filter takes for doubtful meet the list by a shuffle
    asked = own.where("_doubtful").select(F.struct(*docs.columns).alias("_row"), F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))).alias("_order"), "_k", "_tie")
    asked = asked.join(doubtful.select(F.col("k").alias("_k"), F.col("tie").alias("_tie"), "stays"), ["_k", "_tie"], "left").where(F.coalesce("stays", F.lit(True)))
    one = asked.groupBy("_k", "_tie").agg(F.min_by("_row", "_order").alias("_row"))
    return sure.unionByName(one.select("_row.*"))
