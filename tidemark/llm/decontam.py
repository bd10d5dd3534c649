"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Every benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window).
A window is contained only if all its shingles are, so one of them, its rarest in the corpus, is the
necessary prefix. Documents are probed with prefix shingles alone; a hit is kept if the document has
room for the whole window around it (length and positional bounds) and the words agree one by one.

A benchmark of at most BLOCK_BYTES is broadcast and probed in one map-only scan. A larger one is joined
by a shuffle of prefixes with the same rules: places in documents that have a prefix, found by a Bloom
filter of bounded size, meet the windows and bring the words around them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import EVERYTHING, bloom_of
from tidemark.llm.runtime import doc_key, materialise, read_table, ship
from tidemark.llm.textops import Words, byte_class, ngrams, slices, split_words

WINDOW = 13
SHINGLE = 5
#: A benchmark of at most this many bytes is broadcast (a word of it takes some 500 in memory).
BLOCK_BYTES = 4 << 20
_ALNUM = byte_class("alnum")


def tokens(texts) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, off in slices(texts):
        yield a, b, split_words(data, off, _ALNUM, lower=True)


class Windows:
    """The distinct windows of some items. shingle width -> sorted hashes of that width; prefixes are chosen by set_counts()."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = [i for i, _ in items]
        self.rows: list[tuple[int, int, np.ndarray]] = []  # item, width, word hashes
        self.words: list[list[bytes]] = []
        for a, b, w in tokens(pa.array([t for _, t in items], pa.binary())):
            h = w.hashes()
            for item in range(a, b):
                own = h[w.first[item - a] : w.first[item - a + 1]]
                n = min(WINDOW, len(own))
                if n:
                    plain = [w.word(i) for i in range(w.first[item - a], w.first[item - a + 1])]
                    self.rows += [(item, n, own[i : i + n]) for i in range(len(own) - n + 1)]
                    self.words += [plain[i : i + n] for i in range(len(own) - n + 1)]
        self.widths = sorted({min(SHINGLE, n) for _, n, _ in self.rows})
        self.shingles = {k: np.unique(np.concatenate([ngrams(h, k) for _, n, h in self.rows if min(SHINGLE, n) == k])) for k in self.widths}

    def set_counts(self, counts: dict[int, int]) -> None:
        """Each window's prefix is its rarest shingle (ties: the lower hash)."""
        found: dict[int, dict[int, list]] = {k: {} for k in self.widths}
        for (item, n, h), words in zip(self.rows, self.words, strict=True):
            k = min(SHINGLE, n)
            s = ngrams(h, k)
            at = min(range(len(s)), key=lambda i: (counts.get(int(s[i]), 0), int(s[i])))
            if counts.get(int(s[at]), 0):
                found[k].setdefault(int(s[at]), []).append((item, at, h, words))
        self.prefixes = {k: (np.array(sorted(v), np.uint64), [v[x] for x in sorted(v)]) for k, v in found.items()}

    def hits(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, one past the last word) of every occurrence in the words w with hashes h."""
        for k, (keys, uses) in self.prefixes.items():
            if not len(keys) or len(h) < k:
                continue
            g = ngrams(h, k)
            where = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            for p in np.flatnonzero(keys[where] == g):
                lo, hi = w.first[w.doc[p]], w.first[w.doc[p] + 1]
                for item, at, hashes, words in uses[where[p]]:
                    a, n = p - at, len(words)
                    # hashes sort out what cannot be equal; words are compared byte by byte
                    if lo <= a and a + n <= hi and (h[a : a + n] == hashes).all() and all(w.word(a + i) == x for i, x in enumerate(words)):
                        yield item, int(a), int(a) + n


def _count(windows, batches) -> Iterator[pa.RecordBatch]:
    total: dict[int, int] = {}
    for batch in batches:
        for _, _, w in tokens(batch.column(0)):
            h = w.hashes()
            for k, keys in windows.value.shingles.items():
                g = ngrams(h, k)
                at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                for x, n in zip(*np.unique(g[keys[at] == g], return_counts=True), strict=True):
                    total[int(x)] = total.get(int(x), 0) + int(n)
    keys = np.array(list(total), np.uint64).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(total.values()), pa.int64())], ["shingle", "n"])


def _hits(windows: Windows | None, w: Words, rows: int) -> tuple[np.ndarray, list[set]]:
    """Of each text the number of hit words, and the items that hit."""
    hit = np.zeros(len(w), bool)
    found: list[set] = [set() for _ in range(rows)]
    for item, x, y in windows.hits(w, w.hashes()) if windows else ():
        hit[x:y] = True
        found[w.doc[x]].add(windows.items[item])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[w.first[1:]] - total[w.first[:-1]], found


def _clean(windows, at: int, batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for a, b, w in tokens(batch.column(at)):
            n_hit = _hits(windows.value, w, b - a)[0]
            ok.append(~((n_hit > 0) & (20 * n_hit >= np.diff(w.first))))
        yield batch.filter(pa.array(np.concatenate(ok))) if ok else batch


def _probe(windows, batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in tokens(batch.column(1)):
            n, (n_hit, found) = np.diff(w.first), _hits(windows.value, w, b - a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(s) for s in found], pa.list_(pa.string()))],
                ["_key", "n_words", "n_hit", "items"],
            )


def count_words(texts: pa.Array) -> pa.Array:
    n = [np.diff(w.first) for _, _, w in tokens(texts)]
    return pa.array(np.concatenate(n) if n else [], pa.int64())


def head_of(items: DataFrame, limit: int) -> list[tuple[str, bytes]] | None:
    """All items, if their texts have at most `limit` bytes together; no more than one item beyond that is read."""
    out, size = [], 0
    for r in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).toLocalIterator():
        size += len(r.t)
        if size > limit:
            return None
        out.append((r.i, bytes(r.t)))
    return out


def prepared(texts: DataFrame, items: list[tuple[str, bytes]]):
    """The broadcast windows of a block, with prefixes chosen by their counts in texts (column text, binary); a broadcast None if it has none."""
    sc = texts.sparkSession.sparkContext
    windows = Windows(items)
    if not windows.rows:
        return sc.broadcast(None)
    sent = sc.broadcast(windows)
    counted = texts.select("text").mapInArrow(lambda it: _count(sent, it), "shingle long, n long")
    # a row for each shingle of the block at most
    windows.set_counts({int(r.shingle) % 2**64: r.n for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()})
    sent.unpersist()
    return sc.broadcast(windows)


# a benchmark that is too large to be sent out: the same join as a shuffle


def _window_rows(batches) -> Iterator[pa.RecordBatch]:
    """(item, n, body, shingles) of every window of items: its words, joined by one space, and their shingles' hashes."""
    for batch in batches:
        for a, b, w in tokens(batch.column(1)):
            h, j, out = w.hashes(), w.joined(), ([], [], [], [])
            line = j.data.tobytes()
            for d in range(b - a):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                n = min(WINDOW, hi - lo)
                if n:
                    s = ngrams(h[lo:hi], min(SHINGLE, n)).view(np.int64)
                    each = range(hi - lo - n + 1)
                    out[0].extend([a + d] * len(each))
                    out[1].extend([n] * len(each))
                    out[2].extend(line[j.start[lo + i] : j.end[lo + i + n - 1]] for i in each)
                    out[3].extend(s[i : i + n - min(SHINGLE, n) + 1] for i in each)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.list_(pa.int64()))], ["item", "n", "body", "shingles"])


def _counted(asked, widths: list[int], batches) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of the shingles of some texts that the filter knows."""
    for batch in batches:
        for _, _, w in tokens(batch.column(0)):
            h = w.hashes()
            for k in widths:
                g = ngrams(h, k)
                x, n = np.unique(g[asked.value.has(g)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])


def _met(asked, widths: list[int], batches) -> Iterator[pa.RecordBatch]:
    """(shingle, k, tie, p, lo, hi, near) of every place where a text has a prefix that the filter knows: the words around it, from word lo, of hi words of the text."""
    for batch in batches:
        for a, _, w in tokens(batch.column(2)):
            h, j = w.hashes(), w.joined()
            line = j.data.tobytes()
            for width in widths:
                g = ngrams(h, width)
                p = np.flatnonzero(asked.value.has(g))
                p = p[p + width <= w.first[w.doc[p] + 1]] if len(p) else p
                first, last = w.first[w.doc[p]], w.first[w.doc[p] + 1]
                lo, hi = np.maximum(p - WINDOW + 1, first), np.minimum(p + WINDOW, last)
                near = [line[x:y].decode() for x, y in zip(j.start[lo].tolist(), j.end[hi - 1].tolist(), strict=True)] if len(p) else []
                row = pa.array(a + w.doc[p])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[p].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(p - first), pa.array(lo - first), pa.array(last - first), pa.array(near, pa.string())],
                    ["shingle", "k", "tie", "p", "lo", "hi", "near"],
                )


def _filter(hashes: DataFrame, column: str):
    """A broadcast Bloom filter of bounded size; one that knows everything where the list is too long for it."""
    return hashes.sparkSession.sparkContext.broadcast(bloom_of(hashes, column, hashes.count()) or EVERYTHING)


def shuffled_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, tie, a, b, body): words a to b of a text are the window body. docs: (k, tie, text binary).

    Two scans of docs, whatever the benchmark's size: one counts the windows' shingles, one finds the
    places of the chosen prefixes. Places meet windows by a shuffle and bring the words around them.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary"))
    windows = materialise(items.mapInArrow(_window_rows, "item string, n int, body binary, shingles array<long>"), "windows")
    each = windows.groupBy("body").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    widths = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect())
    asked = _filter(materialise(windows.select(F.explode("shingles").alias("shingle")).distinct(), "shingles"), "shingle")
    counts = docs.select("text").mapInArrow(lambda it: _counted(asked, widths, it), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("often"))
    own = each.select("body", "n", F.size("shingles").alias("of"), F.posexplode("shingles").alias("at", "shingle")).join(counts, "shingle")
    # a window of which the corpus lacks a shingle occurs nowhere; of the others the rarest shingle is the prefix
    prefixes = own.groupBy("body").agg(F.first("n").alias("n"), F.first("of").alias("of"), F.count(F.lit(1)).alias("found"), F.min(F.struct("often", "shingle", "at")).alias("rarest"))
    prefixes = materialise(prefixes.where("found = of").select("body", "n", "rarest.shingle", "rarest.at"), "window-prefixes")
    sent = _filter(prefixes.select("shingle").distinct(), "shingle")
    met = docs.select("k", "tie", "text").mapInArrow(lambda it: _met(sent, widths, it), "shingle long, k long, tie long, p long, lo long, hi long, near string")
    start = F.col("p") - F.col("at")
    both = met.join(prefixes, "shingle").where((start >= 0) & (start + F.col("n") <= F.col("hi")))
    same = F.array_join(F.slice(F.split("near", " "), (start - F.col("lo") + 1).cast("int"), F.col("n")), " ").cast("binary") == F.col("body")
    spans = materialise(both.where(same).select("k", "tie", start.alias("a"), (start + F.col("n")).alias("b"), "body").distinct(), "spans")
    return spans.join(windows.select("body", "item").distinct(), "body")


def _with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (k, tie, text binary and more) with n_words, n_hit and items. Equal rows of (k, tie) have equal texts."""
    rows, found = docs.withColumn("n_words", F.arrow_udf(count_words, "long")("text")), shuffled_spans(docs, benchmark)
    words = found.select("k", "tie", "a", "b").distinct().select("k", "tie", F.explode(F.sequence("a", F.col("b") - 1)).alias("p")).distinct()
    words = words.groupBy("k", "tie").agg(F.count(F.lit(1)).alias("n_hit"))
    items = found.groupBy("k", "tie").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = rows.join(words, ["k", "tie"], "left").join(items, ["k", "tie"], "left")
    return rows.withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _named(docs: DataFrame, key: str, *more) -> DataFrame:
    return docs.select(doc_key(F.col(key)).alias("k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tie"), F.col("text").cast("binary").alias("text"), *more)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all columns, of which hit words are none or under a twentieth."""
    ship(docs.sparkSession)
    head = head_of(benchmark, limit)
    if head is not None:
        shared = prepared(docs.select(F.col("text").cast("binary")), head)
        at = docs.columns.index("text")
        return docs.mapInArrow(lambda it: _clean(shared, at, it), docs.schema)
    rows = _with_hits(_named(docs, "doc_id", F.struct(*docs.columns).alias("row")), benchmark)
    return rows.where(~is_contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", limit: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, n_hit and items (sorted array of item_ids as strings) for every row of docs.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A null or
    wordless text has 0 words and no hit; a null or wordless item has no window. Items with equal
    windows are all reported, a null item_id as the empty string; repeated rows of docs each give a row. Only `key`, `text`, `item_id`
    are read, so other columns cannot clash. An empty benchmark finds nothing. One of more than
    `limit` bytes of text is not sent out but joined by a shuffle.
    """
    ship(docs.sparkSession)
    head = head_of(benchmark, limit)
    if head is not None:
        rows = docs.select(F.col(key).alias("_key"), F.col("text").cast("binary").alias("text"))
        shared = prepared(rows, head)
        out = rows.mapInArrow(lambda it: _probe(shared, it), f"_key {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, items array<string>")
    else:
        out = _with_hits(_named(docs, key, F.col(key).alias("_key")), benchmark).select("_key", "n_words", "n_hit", "items")
    return out.withColumnRenamed("_key", key)


def is_contaminated(n_hit, n_words) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, w FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, dw.n, i, item FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) dw JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
