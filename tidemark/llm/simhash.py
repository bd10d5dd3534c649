"""SimHash near-duplicates by covering locality-sensitive hashing.

64-bit SimHash fingerprints over word shingles; distinct fingerprints are looked up under
2^(radius+1) - 1 structured bit masks. Each bit position has a vector of radius+1 bits, and the mask
of a nonzero vector v drops the positions whose vector is orthogonal to v. Any `radius` positions
span a proper subspace, so some v is orthogonal to them all: its mask drops every bit in which a pair
within the radius differs, and the pair meets in that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.runtime import LAST_ID, doc_key, materialise, read_table, ship, whole_groups
from tidemark.llm.textops import byte_class, slices, split_words

WIDTH, RADIUS, SEED = 4, 4, 42
#: Buckets of more fingerprints are cut again by blocks of bits before they are compared.
BUCKET = 2048
TILE = 1024
_SPACE = byte_class("space")


def masks(radius: int = RADIUS, seed: int = 7) -> np.ndarray:
    """Structured masks as uint64, 2^(radius+1) - 1 of them up to radius 5.

    For a greater radius the 64 bits are cut into parts, of which one differs in at most
    radius // parts bits; each part has its own masks.
    """
    parts = 1 if radius <= 5 else -(-(radius + 1) // 5)
    d = radius // parts + 1
    every = np.arange(1, 2**d)
    odd = np.array([bin(x).count("1") & 1 for x in range(2**d)])
    out = []
    for bits in np.array_split(np.arange(64), parts):
        vectors = np.random.default_rng(seed).permutation(np.resize(every, len(bits)))
        out += [sum(1 << int(i) for i, x in zip(bits, vectors, strict=True) if odd[x & v]) for v in every]
    return np.array(out, np.uint64)


def simhashes(texts, width: int = WIDTH) -> np.ndarray:
    """uint64 fingerprint of each text of an Arrow column."""
    out = []
    digest = xxhash.xxh64_intdigest
    for _, _, data, off in slices(texts):
        w = split_words(data, off, _SPACE, lower=True)
        n = np.diff(w.first)
        bits = np.zeros((len(n), 64), np.int64)
        total = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
        if len(w):
            j = w.joined()
            line = j.data.tobytes()
            begin = np.arange(len(w))
            last = np.minimum(begin + width - 1, w.first[w.doc + 1] - 1)
            begin = begin[(begin + width - 1 == last) | (begin == w.first[w.doc])]
            last = last[begin]
            h = np.array([digest(line[s:e], SEED) for s, e in zip(j.start[begin].tolist(), j.end[last].tolist(), strict=True)], np.uint64)
            one = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            has = np.flatnonzero(total)
            bits[has] = np.add.reduceat(one, np.concatenate([[0], np.cumsum(total[has])[:-1]]), axis=0, dtype=np.int64)
        out.append(np.packbits(2 * bits > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majority(h: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes: the bits set in over half of them; 0 for none."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(widths: list[int], batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [pa.array(simhashes(b.column(1), w).view(np.int64), pa.int64()) for w in widths]
        yield pa.RecordBatch.from_arrays([b.column(0), *f], ["_key", *(f"f{i}" for i in range(len(f)))])


def fingerprints(docs: DataFrame, widths: list[int], key: str = "doc_id") -> DataFrame:
    """(key, f0, f1 ...): SimHashes of every row, one for each shingle width, as signed longs. Null and wordless texts have 0."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary"))
    schema = f"_key {kind}, " + ", ".join(f"f{i} long" for i in range(len(widths)))
    return rows.mapInArrow(lambda it: _fingerprints(widths, it), schema).withColumnRenamed("_key", key)


class Forest:
    """Union-find over places; keeps a spanning forest of the links."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, xs, ys) -> None:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def forest_of(fp: np.ndarray, check: np.ndarray, radius: int, confirm: int) -> np.ndarray:
    """The place of each fingerprint's root among the links: within the radius, and their checks within `confirm` bits.

    Places are compared in tiles. A large bucket is first cut by radius+1 blocks of the bits in which
    its members differ: two within the radius agree on some block.
    """
    forest = Forest(len(fp))
    groups = [np.arange(len(fp))]
    if len(fp) > BUCKET:
        differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
        free = [i for i in range(64) if differ >> i & 1]
        groups = []
        for block in np.array_split(np.array(free, int), radius + 1):
            cut = fp & np.uint64(sum(1 << int(i) for i in block))
            order = np.argsort(cut, kind="stable")
            groups += [g for g in np.split(order, np.flatnonzero(np.diff(cut[order])) + 1) if len(g) > 1]
    for g in groups:
        for a in range(0, len(g), TILE):
            for b in range(a, len(g), TILE):
                x, y = g[a : a + TILE], g[b : b + TILE]
                i, j = np.nonzero(np.bitwise_count(fp[x][:, None] ^ fp[y][None, :]) <= radius)
                i, j = x[i], y[j]
                new = (i < j if a == b else i != j) & (np.bitwise_count(check[i] ^ check[j]) <= confirm)
                i, j = i[new], j[new]
                if len(i):
                    roots = forest.roots()
                    apart = roots[i] != roots[j]
                    forest.join(i[apart], j[apart])
    return forest.roots()


def _links(radius: int, confirm: int, frames) -> Iterator[pd.DataFrame]:
    """Rows come sorted by table and bucket; a bucket's links leave as a star for each of its components."""
    for part in whole_groups(frames, ["t", "k"]):
        cut = np.flatnonzero((np.diff(part.t) != 0) | (np.diff(part.k) != 0)) + 1
        node = part.node.to_numpy()
        fp, check = (part[c].to_numpy().view(np.uint64) for c in ("fp", "check"))
        edge = np.concatenate([[0], cut, [len(part)]])
        a, b = [node[:0]], [node[:0]]
        for i in np.flatnonzero(np.diff(edge) > 1):
            x = slice(edge[i], edge[i + 1])
            root = forest_of(fp[x], check[x], radius, confirm)
            far = np.flatnonzero(root != np.arange(len(root)))
            a.append(node[x][far])
            b.append(node[x][root[far]])
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(nodes: DataFrame, radius: int = RADIUS, confirm: int = 64) -> DataFrame:
    """(a, b) between nodes (node, fp, check): a spanning forest of every bucket's links."""
    keep = masks(radius).view(np.int64).tolist()
    spots = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(keep)])
    rows = nodes.select("node", "fp", "check", F.explode(spots).alias("s")).select("node", "fp", "check", "s.t", "s.k")
    several = rows.repartition("t", "k").sortWithinPartitions("t", "k")
    return several.mapInPandas(lambda it: _links(radius, confirm, it), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, key: str = "doc_id", confirm: tuple[int, int] | None = None) -> DataFrame:
    """key, fp (signed long) and component_id for every row of docs.

    Rows link if their SimHashes over `width`-word shingles differ in at most `radius` bits; with
    confirm = (width, bits), a second SimHash must agree to that many bits as well. component_id is
    the smallest key reachable. Rows equal in fingerprint are one node, so copies cost nothing more.
    Null or wordless texts have fingerprint 0 and link like any other. A null key counts as the
    greatest (2^63 - 1). Repeated rows each give a row; an empty table gives none. Only `key` and
    `text` are read, so other columns cannot clash.
    """
    ship(docs.sparkSession)
    rows = fingerprints(docs, [width, *([confirm[0]] if confirm else [])], key).withColumnRenamed("f0", "fp")
    rows = rows.withColumnRenamed("f1", "check") if confirm else rows.withColumn("check", F.lit(0).cast("long"))
    rows = materialise(rows.withColumn("node", F.xxhash64("fp", "check") if confirm else F.col("fp")), "simhash")
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("check").alias("check"), F.min(doc_key(F.col(key))).alias("least"))
    member = components(links(nodes, radius, confirm[1] if confirm else 64))
    roots = nodes.select("node", "least").join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("node", "component_id")
    return rows.join(of, "node").select(key, "fp", F.when(F.col("component_id") < LAST_ID, F.col("component_id")).alias("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
