"""N-gram scoring over an Elias-Fano trie.

Level 1 holds the words of the training texts: their hashes as Elias-Fano sequences, exact counts.
Level n holds n-grams that occur min_count times or more below their context, a node of level n - 1:
monotone pointers from contexts to their children, and the children's words made monotone by adding
the last value of the context before, both Elias-Fano coded. A child is found by successor search
relative to its context. Smoothing is interpolated absolute discounting: a node keeps its discounted
probability and a context its backoff weight, both as 8-bit codes.

Tasks count n-grams of their texts and send them, sorted and packed, to the shard that holds their
context and word. The shards of a level are equal shares of the occurrences of the level below, which
has exact counts; a context with more occurrences than a share is cut by ranges of the following word,
so no task gets a hot context whole. A shard adds up the counts it gets, is written to the shared
folder by the task that did so, and is memory-mapped by the tasks that score.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.eliasfano import EliasFano, encode
from tidemark.llm.runtime import crc_fold, materialise, new_folder, read_table, ship
from tidemark.llm.textops import byte_class, slices, split_words

ORDER, MIN_COUNT, DISCOUNT = 2, 2, 0.75
#: What the registered query trains: trigrams, and every n-gram however rare.
QUERY = {"order": 3, "min_count": 1}
#: Words of a shard of level 1, about, and occurrences that a shard of a further level adds up, at most about twice as many.
SHARD_ROWS, SHARD_TOKENS = 250_000, 1_000_000
#: Tokens that a task counts before it hands their n-grams on, and tokens that are looked up at once.
COUNT_TOKENS, BLOCK_TOKENS = 2_000_000, 1_500_000
#: Hash that stands for the end of a text (a word never has it but by chance in 2^64).
END = np.uint64(0x5851F42D4C957F2D)
_SPACE = byte_class("space")


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text followed by END; where each text begins, and the end."""
    w = split_words(data, off, _SPACE, lower=True)
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(first[-1]), END, np.uint64)
    out[np.arange(len(w)) + w.doc] = w.hashes()
    return out, first


def token_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, where each text begins and the end) of neighbouring rows, about BLOCK_TOKENS each."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    begin = size = end = 0

    def block():
        shift = np.cumsum([0, *(len(h) for h, _ in parts)])
        first = np.concatenate([*(f[:-1] + x for (_, f), x in zip(parts, shift, strict=False)), shift[-1:]])
        return begin, end, np.concatenate([h for h, _ in parts]), first

    for _, end, data, off in slices(texts):  # noqa: B007
        parts.append(token_hashes(data, off))
        size += len(parts[-1][0])
        if size >= BLOCK_TOKENS:
            yield block()
            parts, begin, size = [], end, 0
    if parts:
        yield block()


def local_path(at: str) -> str:
    """Levels are memory-mapped, so their folder must be mounted on every machine."""
    url = urlparse(at)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's levels need a mounted folder, not {at}")
    return url.path


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """All arrays in one file; a retried task replaces the file as a whole."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text = text.ljust(-(-(len(text) + 8) // 64) * 64 - 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    os.replace(own, path)


def load(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    n = int.from_bytes(m[:8], "little")
    return {k: np.frombuffer(m, t, size, n + 8 + at) for k, (t, size, at) in json.loads(m[8 : 8 + n]).items()}


def _part(arrays: dict, prefix: str) -> dict:
    return {k[len(prefix) :]: a for k, a in arrays.items() if k.startswith(prefix)}


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of 256 bins of equal width, and each value's bin."""
    if not len(x):
        return np.zeros(1, np.float32), np.zeros(0, np.uint8)
    low, width = x.min(), max(float(np.ptp(x)), 1e-9)
    code = np.minimum((x - low) / width * 256, 255).astype(np.uint8)
    return (np.bincount(code, x, 256) / np.maximum(np.bincount(code, minlength=256), 1)).astype(np.float32), code


def runs(x: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Neighbouring equal values and where they are."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]])
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if a < b:
            yield int(x[a]), slice(a, b)


def sum_pairs(c: np.ndarray, w: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in ascending order and the sums of their n; every w is below `words`."""
    if not len(c):
        return c, w, n
    if int(c.max()) < (2**63 - 1) // words - 1:
        order = np.argsort(c * words + w)
    else:
        order = np.lexsort((w, c))
    c, w, n = c[order], w[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])]))
    return c[start], w[start], np.add.reduceat(n, start)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, each in the smallest type that holds it, compressed."""
    narrow = [c.astype(np.min_scalar_type(int(c.max()) if len(c) else 0)) for c in columns]
    raw = np.array([len(columns[0]), *[c.itemsize for c in narrow]], np.int64).tobytes() + b"".join(c.tobytes() for c in narrow)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n, *sizes = np.frombuffer(raw, np.int64, columns + 1).tolist()
    out, at = [], 8 * (columns + 1)
    for size in sizes:
        out.append(np.frombuffer(raw, f"<u{size}", n, at).astype(np.int64))
        at += n * size
    return out


def shares(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes at which a share of about `size` occurrences begins, and the number of parts the node is cut into (a hot node is a share of its own)."""
    before = np.cumsum(count) - count
    parts = np.where(count >= 2 * size, -(-count // size), 1)
    new = np.ones(len(count), bool)
    new[1:] = (np.diff(before // size) > 0) | (parts[1:] > 1) | (parts[:-1] > 1)
    at = np.flatnonzero(new)
    return at, parts[at]


class Cuts:
    """Where the shards of a level begin: (context, word) in ascending order."""

    def __init__(self, context: np.ndarray, word: np.ndarray, contexts: int):
        self.context, self.word, self.contexts = context, word, contexts
        self.split = np.unique(context[word > 0])

    def __len__(self) -> int:
        return len(self.context)

    def place(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of each pair."""
        at = np.searchsorted(self.context, context, "right") - 1
        for c in self.split[np.isin(self.split, context)].tolist():
            mine, first = np.flatnonzero(context == c), int(np.searchsorted(self.context, c))
            last = int(np.searchsorted(self.context, c, "right"))
            at[mine] = first + np.searchsorted(self.word[first:last], word[mine], "right") - 1
        return at

    def width(self, s: int) -> int:
        """Contexts of a shard, from its first to its last."""
        if s + 1 == len(self):
            return self.contexts - int(self.context[s])
        return int(self.context[s + 1] - self.context[s]) + int(self.word[s + 1] > 0)


class Level:
    """Shards of one level, opened when first asked. base: a shard's first node, and the end."""

    def __init__(self, folder: str, n: int, base: np.ndarray):
        self.folder, self.n, self.base, self.open = folder, n, base, {}

    def __getstate__(self):
        return {"folder": self.folder, "n": self.n, "base": self.base, "open": {}}

    def shard(self, s: int):
        if s not in self.open:
            a = load(f"{self.folder}/level{self.n}-{s}.bin")
            coded = [EliasFano(_part(a, p)) for p in (("key.",) if self.n == 1 else ("ptr.", "key."))]
            self.open[s] = (a, *coded, coded[-1].last())
        return self.open[s]

    def values(self, name: str, nodes: np.ndarray) -> np.ndarray:
        """`count`, or `mass` decoded (log10), of nodes in ascending order."""
        out = np.zeros(len(nodes))
        for s, i in runs(np.searchsorted(self.base, nodes, "right") - 1):
            a = self.shard(s)[0]
            own = nodes[i] - self.base[s]
            out[i] = a["codes"][a["mass"][own]] if name == "mass" else a["count"][own]
        return out


class Words(Level):
    """Level 1. Shards are equal ranges of the hash."""

    def find(self, h: np.ndarray) -> np.ndarray:
        """Node of each of ascending hashes, -1 where unknown."""
        out = np.full(len(h), -1)
        shards = len(self.base) - 1
        width = 64 - (shards.bit_length() - 1)
        edges = [s << width for s in range(1, shards)]
        cut = [0, *np.searchsorted(h, np.array(edges, np.uint64)), len(h)]
        for s in range(shards):
            if cut[s] < cut[s + 1] and self.base[s] < self.base[s + 1]:
                at = self.shard(s)[1].find(h[cut[s] : cut[s + 1]] - np.uint64(s << width if s else 0))
                out[cut[s] : cut[s + 1]] = np.where(at >= 0, at + self.base[s], -1)
        return out


class Grams(Level):
    """Level n. split: contexts that lie in several shards, and their backoff weights."""

    def __init__(self, folder: str, n: int, base: np.ndarray, cuts: Cuts, split: tuple[np.ndarray, np.ndarray]):
        super().__init__(folder, n, base)
        self.cuts, self.split = cuts, split

    def __getstate__(self):
        return super().__getstate__() | {"cuts": self.cuts, "split": self.split}

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, log10 of the context's backoff weight) of pairs in ascending order."""
        node, back = np.full(len(context), -1), np.zeros(len(context))
        for s, i in runs(self.cuts.place(context, word)):
            if self.base[s] == self.base[s + 1]:
                continue
            a, pointers, keys, last = self.shard(s)
            c = context[i] - self.cuts.context[s]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            one, which = c[new], np.cumsum(new) - 1
            ends = pointers.access(np.concatenate([one, one + 1])).astype(np.int64)
            begin, end = ends[: len(one)], ends[len(one) :]
            before = np.where(begin > 0, keys.access(np.maximum(begin - 1, 0)).astype(np.int64) + 1, 0)
            back[i] = np.where(end > begin, a["back_codes"][a["back"][one]], 0)[which]
            x = before[which] + word[i]
            ask = np.flatnonzero((x <= last) & (end > begin)[which])
            at = keys.find(x[ask].astype(np.uint64))
            hit = (at >= begin[which[ask]]) & (at < end[which[ask]])
            node[i][ask[hit]] = at[hit] + self.base[s]
        if len(self.split[0]):
            at = np.minimum(np.searchsorted(self.split[0], context), len(self.split[0]) - 1)
            back = np.where(self.split[0][at] == context, self.split[1][at], back)
        return node, back


class Trie:
    def __init__(self, words: Words, tokens: int, vocabulary: int):
        self.words, self.grams, self.tokens, self.vocabulary = words, [], tokens, vocabulary

    def base_logp(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node (-1: unknown) of every distinct token, and which of them each token is."""
        known, place = np.unique(h, return_inverse=True)
        return self.words.find(known), place

    def descend(self, level: Grams, context: np.ndarray, word: np.ndarray, weigh: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, backoff weight, share) of every pair; context or word -1: no node, weight 1, share 0. The last two only if asked for.

        Distinct pairs are looked up in ascending order, and so come out in the order of their nodes.
        """
        node, back, mass = np.full(len(word), -1), np.ones(len(word) * weigh), np.zeros(len(word) * weigh)
        has = np.flatnonzero(context >= 0)
        if len(has):
            c, w = context[has], np.where(word[has] >= 0, word[has], self.vocabulary)
            safe = int(c.max()) < (2**63 - 1) // (self.vocabulary + 1) - 1
            order = np.argsort(c * (self.vocabulary + 1) + w) if safe else np.lexsort((w, c))
            c, w = c[order], w[order]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
            n, b = level.find(c[new], w[new])
            place, at = np.cumsum(new) - 1, has[order]
            node[at] = n[place]
            if weigh:
                share, hit = np.zeros(len(n)), np.flatnonzero(n >= 0)
                share[hit] = 10 ** level.values("mass", n[hit])
                back[at], mass[at] = (10**b)[place], share[place]
        return node, back, mass

    def walk(self, word: np.ndarray, first: np.ndarray, weigh: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For level 2, 3 ...: (node, backoff weight, share) of every token. A text's first token follows an end."""
        end = self.words.find(np.array([END]))[0]
        node = word
        for n, level in enumerate(self.grams, 2):
            context = np.concatenate([[-1], node[:-1]])
            context[first[:-1]] = end if n == 2 else -1
            node, back, mass = self.descend(level, context, word, weigh)
            yield node, back, mass

    def score(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of a text's tokens: known ones, base score, score."""
        node, place = self.ids(h)
        count, ok = np.zeros(len(node)), node >= 0
        count[ok] = self.words.values("count", node[ok])
        base = self.base_logp(count)
        p, word, base = (10**base)[place], node[place], base[place]
        for _, back, mass in self.walk(word, first, weigh=True):
            p *= back
            p += mass
        logp = np.log10(np.minimum(p, 1))
        add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
        return add((word >= 0).astype(np.int64)), add(base), add(logp)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key, at, n = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
    return key, n


def _count_words(batches) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for b in batches:
        for _, _, data, off in slices(b.column(0)):
            parts.append(token_hashes(data, off)[0])
            size += len(parts[-1])
            if size >= COUNT_TOKENS:
                key, n = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])
                parts, size = [], 0
    if parts:
        key, n = _merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["h", "n"])


def _count_grams(sent, batches) -> Iterator[pa.RecordBatch]:
    """(shard, data): packed steps of context, words and counts of the level that comes next, for one of its shards."""
    trie, cuts = sent.value
    parts, size = [], 0

    def flush():
        c, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        c, w, n = sum_pairs(c, w, np.ones(len(c), np.int64), trie.vocabulary + 1)
        at = cuts.place(c, w)
        rows = [(s, packed(np.diff(c[i], prepend=cuts.context[s]), w[i], n[i])) for s, i in runs(at)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

    for b in batches:
        for _, _, h, first in token_blocks(b.column(0)):
            known, place = trie.ids(h)
            node = word = known[place]
            for node, _, _ in trie.walk(word, first):
                pass
            context = np.concatenate([[-1], node[:-1]])
            context[first[:-1]] = -1 if trie.grams else trie.words.find(np.array([END]))[0]
            ok = (context >= 0) & (node >= 0)
            parts.append((context[ok], word[ok]))
            size += len(parts[-1][0])
            if size >= COUNT_TOKENS:
                yield flush()
                parts, size = [], 0
    if size:
        yield flush()


MADE = "shard int, n long, node array<long>, parts array<long>, split array<long>, mass array<double>"


def _made(shard: int, count: np.ndarray, size: int, split=(), mass=()) -> tuple:
    """What the driver gets of a shard: the number of its nodes, where shares of the next level begin, and parts of the mass of split contexts."""
    node, parts = shares(count.astype(np.int64), size)
    return shard, len(count), node, parts, split, mass


def _build_words(folder: str, shards: int, size: int, f: pd.DataFrame) -> pd.DataFrame:
    s = int(f.shard.iloc[0])
    h = f.h.to_numpy().view(np.uint64)
    order = np.argsort(h)
    width = 64 - (shards.bit_length() - 1)
    keys = encode(h[order] - np.uint64(s << width if s else 0), 1 << width)
    count = f.n.to_numpy()[order].astype(np.uint64)
    save(f"{folder}/level1-{s}.bin", {f"key.{k}": a for k, a in keys.items()} | {"count": count})
    return pd.DataFrame([_made(s, count, size)], columns=["shard", "n", "node", "parts", "split", "mass"])


def _build_grams(folder: str, sent, min_count: int, size: int, batches) -> Iterator[pa.RecordBatch]:
    """Builds the shard whose packed rows this task got."""
    trie, cuts = sent.value
    parts, s = [], None
    for b in batches:
        for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = shard
            step, w, n = unpacked(data.as_py(), 3)
            parts.append((np.cumsum(step) + cuts.context[s], w, n))
    if not parts:
        return
    c, w, count = sum_pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)), trie.vocabulary + 1)
    keep = count >= min_count
    c, w, count = c[keep] - cuts.context[s], w[keep], count[keep]
    if not len(c):
        return
    n, width = len(trie.grams) + 2, cuts.width(s)
    pointers = np.searchsorted(c, np.arange(width + 1))
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    each = np.diff(np.append(start, len(w)))
    lasts = w[np.append(start[1:], len(w)) - 1] + 1
    keys = w + np.repeat(np.cumsum(lasts) - lasts, each)
    above = trie.grams[-1] if trie.grams else trie.words
    total = above.values("count", c[start] + cuts.context[s])
    mass = (count - DISCOUNT) / np.repeat(total, each)
    codes, code = quantise(np.log10(mass))
    sums = np.add.reduceat(mass, start)
    weight = np.zeros(width)
    weight[c[start]] = np.log10(np.maximum(1 - sums, 1e-9))
    back_codes, back_code = quantise(weight)
    arrays = {f"ptr.{k}": a for k, a in encode(pointers, len(w) + 1).items()} | {f"key.{k}": a for k, a in encode(keys, int(keys[-1]) + 1).items()}
    save(f"{folder}/level{n}-{s}.bin", arrays | {"codes": codes, "mass": code, "count": count.astype(np.min_scalar_type(int(count.max()))), "back_codes": back_codes, "back": back_code})
    cut = np.flatnonzero(np.isin(c[start] + cuts.context[s], cuts.split))
    row = _made(s, count, size, c[start][cut] + cuts.context[s], sums[cut])
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["shard", "n", "node", "parts", "split", "mass"])


def _next_cuts(made: list, base: np.ndarray, vocabulary: int) -> Cuts:
    context, word = [], []
    for r in sorted(made, key=lambda r: r.shard):
        parts = np.minimum(np.array(r.parts, np.int64), vocabulary)
        node = np.repeat(np.array(r.node, np.int64) + base[r.shard], parts)
        step = np.arange(len(node)) - np.repeat(np.cumsum(parts) - parts, parts)
        context.append(node)
        word.append(step * vocabulary // np.repeat(parts, parts))
    return Cuts(np.concatenate(context), np.concatenate(word), int(base[-1]))


def _split_weights(made: list) -> tuple[np.ndarray, np.ndarray]:
    total: dict[int, float] = {}
    for r in made:
        for c, m in zip(r.split, r.mass, strict=True):
            total[c] = total.get(c, 0.0) + m
    keys = sorted(total)
    return np.array(keys, np.int64), np.log10(np.maximum(1 - np.array([total[c] for c in keys]), 1e-9))


def _bases(rows: list, shards: int) -> np.ndarray:
    sizes = {r.shard: r.n for r in rows}
    return np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(shards)])]).astype(np.int64)


def fit(texts: DataFrame, order: int = ORDER, folder: str | None = None, min_count: int = MIN_COUNT, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """A trie of all rows of texts (column text). Null texts are empty: one end token.

    Shards and levels are files below `folder` (the shared folder where none is named); what the
    driver gets is one row for each shard, with the shares of the next level.
    """
    spark = texts.sparkSession
    ship(spark)
    folder = local_path(folder or new_folder(spark, "ngrams"))
    raw = texts.select(F.col("text").cast("binary"))
    words = materialise(raw.mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    vocabulary, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, (vocabulary // SHARD_ROWS).bit_length())
    shards = 1 << bits
    at = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
    made = words.withColumn("shard", at.cast("int")).groupBy("shard").applyInPandas(lambda f: _build_words(folder, shards, shard_tokens, f), MADE).collect()
    trie = Trie(Words(folder, 1, _bases(made, shards)), tokens, vocabulary)
    base = trie.words.base
    for n in range(2, order + 1):
        if not made:
            break
        cuts = _next_cuts(made, base, vocabulary)
        sent = spark.sparkContext.broadcast((trie, cuts))  # folder name and shard bounds only
        counted = raw.mapInArrow(lambda it, s=sent: _count_grams(s, it), "shard int, data binary")
        made = counted.repartitionById(len(cuts), "shard").mapInArrow(lambda it, s=sent: _build_grams(folder, s, min_count, shard_tokens, it), MADE).collect()
        if made:
            base = _bases(made, len(cuts))
            trie.grams.append(Grams(folder, n, base, cuts, _split_weights(made)))
    return trie


def _score(sent, batches) -> Iterator[pa.RecordBatch]:
    trie = sent.value
    for b in batches:
        for a, end, h, first in token_blocks(b.column(1)):
            known, base, logp = trie.score(h, first)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(a, end - a), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(logp)], ["_key", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, trie: Trie, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score and score (log10) of every row.

    Null and empty texts have one token, the end. Unknown words take the smoothed share of a word
    that never occurred. Repeated rows score alike; an empty table gives no rows, and a trie of no
    texts gives every token probability 1. Only `key` and `text` are read, so other columns cannot clash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trie)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary"))
    return rows.mapInArrow(lambda it: _score(sent, it), f"_key {kind}, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("_key", key)


def op4_ngram_score(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    trie = fit(docs.where(F.coalesce(crc_fold(F.col("doc_id")) != 1, F.lit(True))), **QUERY)
    out = score(docs, trie)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(int(trie.tokens)).cast("long").alias("train_tokens"), "base_score", "score")

