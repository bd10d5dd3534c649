"""Substring deduplication with suffix automata of reference shards.

A word covered by a window of WINDOW words that starts in an earlier document goes. The reference is
every passage that more than one document has, cut into shards of bounded size. Documents stream through
a shard's automaton for matching statistics, which give each window's least document.

1. Anchors: of each window's K-word hashes the least is its anchor, so equal windows have equal
   anchors and neighbouring windows mostly share one. An aggregation finds anchors of two documents.
2. Passages: stretches of windows with one such anchor leave with their words. The list of anchors is
   sent as a Bloom filter of bounded size; beyond that a shuffled semi join takes its place.
   A task folds equal passages before they are dealt out, so a hot passage is a row for each task.
   An anchor of more than HOT stretches may have any number of wordings: its windows leave one by one
   and are dealt out by their own hash, so that no task gathers them.
3. The shard of the passages that occur most is broadcast, and documents stream through it where they
   are: what many documents share is never shuffled with them. The corpus would have to be read once for
   each further shard, and their number grows with it, so the other shards meet their part of the
   documents by a shuffle: passages, sorted by anchor, go into one automaton a shard and stream through it.
4. Places to remove are gathered by document. Texts that have none stay where they are; the others
   meet their places and are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.automaton import SuffixAutomaton
from tidemark.llm.bloom import EVERYTHING, bloom_of
from tidemark.llm.runtime import doc_key, materialise, read_table, ship
from tidemark.llm.textops import byte_class, ngrams, slices, sliding_min, split_words

WINDOW, K = 13, 6
#: A shard's automaton is closed at the end of the anchor that takes it past this many words; an anchor of more words takes several.
SHARD_WORDS = 50_000
#: A broadcast shard holds anchors of at least OFTEN stretches, the most frequent first, up to SHARD_WORDS words and SENT anchors.
OFTEN, SENT = 64, 5000
#: Stretches of an anchor from which its windows are dealt out one by one.
HOT = 50_000
#: Passages that a task gathers to fold equal ones before they are dealt out.
TASK_ROWS = 200_000
_SPACE = byte_class("space")


def stretches(texts, width: int, k: int) -> Iterator[tuple]:
    """(first row, words, anchors, first window, windows) of every stretch of windows with one anchor."""
    for a, _, data, off in slices(texts):
        w = split_words(data, off, _SPACE)
        if len(w) < width:
            continue
        least = sliding_min(ngrams(w.hashes(), k), width - k + 1)
        whole = w.doc[: len(least)] == w.doc[width - 1 :]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (w.doc[1 : len(least)] != w.doc[: len(least) - 1]) | ~whole[:-1]
        begin = np.flatnonzero(new & whole)
        if not len(begin):
            continue
        # a stretch ends where the next begins or where its text has no further window
        stop = np.append(begin[1:], len(least))
        stop = np.minimum(stop, w.first[w.doc[begin] + 1] - width + 1)
        yield a, w, least[begin].view(np.int64), begin, stop - begin


def _anchors(width: int, k: int, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for a, w, anchor, begin, _ in stretches(b.column(1), width, k):
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[a + w.doc[begin]])], ["anchor", "k"])


def _signed(h: int) -> int:
    """As Spark's long."""
    return h - (1 << 64) if h >> 63 else h


def body_hash(body: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(body))


def _bodies(width: int, k: int, filters, texts) -> Iterator[tuple]:
    """(row, place in its text, anchor, key to deal by, body) as arrays of every stretch whose anchor the first filter knows.

    Stretches of anchors that the second filter knows are cut into windows with keys of their own. A
    filter answers alike everywhere, so windows that it takes for hot by chance meet all the same.
    """
    known, hot = filters.value
    for a, w, anchor, begin, n in stretches(texts, width, k):
        ok = known.has(anchor)
        anchor, begin, n = anchor[ok], begin[ok], n[ok]
        if len(begin):
            often = hot.has(anchor)
            if often.any():
                each = np.where(often, n, 1)
                step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                anchor, begin, n, often = (np.repeat(x, each) for x in (anchor, begin, n, often))
                begin, n = begin + step, np.where(often, 1, n)
            row = w.doc[begin]
            j = w.joined()
            line = j.data.tobytes()
            body = [line[s:e] for s, e in zip(j.start[begin].tolist(), j.end[begin + n + width - 2].tolist(), strict=True)]
            key = anchor.copy()
            for i in np.flatnonzero(often):
                key[i] = _signed(xxhash.xxh3_64_intdigest(body[i]))
            yield a + row, begin - w.first[row], anchor, key, body


class Reference:
    """A shard that is sent out: its keys, and an automaton of all their passages."""

    def __init__(self, rows: list[tuple[int, bytes, int]], width: int):
        """rows: (key, body, least document) of every passage of the keys."""
        self.keys, self.width, self.known = np.unique(np.array([r[0] for r in rows], np.int64)), width, {}
        self.automaton = SuffixAutomaton()
        for _, body, least in sorted(rows, key=lambda r: r[2]):
            self.automaton.add(body.split(b" "), least)

    def least(self, body: bytes) -> list[int]:
        """The least document of each window of a passage; remembered, as such passages come again and again."""
        out = self.known.get(body)
        if out is None:
            out = self.known[body] = self.automaton.least_of_windows(body.split(b" "), self.width)
        return out


def _occurrences(width: int, k: int, filters, reference, batches) -> Iterator[pa.RecordBatch]:
    """Passages by (anchor, key, h, k, tie, at); for those of the broadcast shard starts, the places of windows that an earlier document has."""
    shard = reference.value
    for b in batches:
        ids = b.column(0).to_numpy()
        for row, at, anchor, key, body in _bodies(width, k, filters, b.column(2)):
            starts, stay = [None] * len(body), np.ones(len(body), bool)
            for i in np.flatnonzero(np.isin(key, shard.keys)) if len(shard.keys) else ():
                mine = ids[row[i]]
                starts[i] = [int(at[i]) + j for j, least in enumerate(shard.least(body[i])) if least is not None and least < mine]
                stay[i] = bool(starts[i])
            ok = pa.array(np.flatnonzero(stay))
            rows = pa.array(row)
            out = [pa.array(anchor), pa.array(key), pa.array([body_hash(x) for x in body], pa.int64()), b.column(0).take(rows), b.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(starts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.take(ok) for c in out], ["anchor", "key", "h", "k", "tie", "at", "starts"])


def _passages(width: int, k: int, filters, batches) -> Iterator[pa.RecordBatch]:
    """(anchor, key, body, words, lo, hi, n): least and greatest document and number of a passage among some rows of this task."""
    parts, size = [], 0

    def flush():
        t = pa.concat_tables(parts).group_by(["anchor", "key", "body"]).aggregate([("words", "min"), ("k", "min"), ("k", "max"), ("k", "count")])
        return t.select(["anchor", "key", "body", "words_min", "k_min", "k_max", "k_count"]).rename_columns(["anchor", "key", "body", "words", "lo", "hi", "n"]).combine_chunks().to_batches()

    for b in batches:
        for row, _, anchor, key, body in _bodies(width, k, filters, b.column(1)):
            parts.append(pa.table({"anchor": anchor, "key": key, "body": pa.array(body, pa.binary()), "words": pa.array([x.count(b" ") + 1 for x in body], pa.int64()), "k": b.column(0).take(pa.array(row))}))
            size += len(body)
            if size >= TASK_ROWS:
                yield from flush()
                parts, size = [], 0
    if size:
        yield from flush()


def _match(width: int, batches) -> Iterator[pa.RecordBatch]:
    """Rows (key, body, lo, hi) sorted by key -> each body's windows' least documents, where a later document has one."""

    def solve(shard):
        words = [r[1].split(b" ") for r in shard]
        out, auto = None, SuffixAutomaton()
        rest = sorted(zip(words, shard, strict=True), key=lambda y: y[1][2])
        for i, (x, r) in enumerate(rest):
            auto.add(x, r[2])
            if auto.symbols >= SHARD_WORDS or i == len(rest) - 1:
                found = [auto.least_of_windows(x, width) for x in words]
                # automata come in order of documents, so what an earlier one has found is less
                out = found if out is None else [[b if a is None else a for a, b in zip(x, y, strict=True)] for x, y in zip(out, found, strict=True)]
                auto = SuffixAutomaton()
        return out

    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)

    def shards():
        group, shard, size = [], [], 0
        for r in rows():
            if group and group[0][0] != r[0]:
                if len(group) == 1:
                    yield group, [[group[0][2]] * (group[0][1].count(b" ") + 2 - width)]
                else:
                    shard += group
                    if size >= SHARD_WORDS:
                        yield shard, solve(shard)
                        shard, size = [], 0
                group = []
            group.append(r)
            size += r[1].count(b" ") + 1
        shard += group
        if shard:
            yield shard, solve(shard)

    def batch(ready):
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*ready, strict=True), kinds, strict=True)], ["key", "h", "leasts"])

    ready = []
    for shard, leasts in shards():
        ready += [(r[0], body_hash(r[1]), x) for r, x in zip(shard, leasts, strict=True) if min(x) < r[3]]
        if len(ready) >= 5000:
            yield batch(ready)
            ready = []
    if ready:
        yield batch(ready)


def repeated_windows(docs: DataFrame, width: int = WINDOW, k: int = K, hot: int | None = None, often_n: int = OFTEN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(k, tie, starts): of every row that has any, the places of windows that start in an earlier document.

    docs: (k long, tie long, text binary); k orders documents, tie tells rows of one k apart.
    """
    spark = docs.sparkSession
    ship(spark)
    at = docs.select("k", "text").mapInArrow(lambda it: _anchors(width, k, it), "anchor long, k long")
    shared = at.groupBy("anchor").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = materialise(shared.select("anchor", (F.col("n") > (HOT if hot is None else hot)).alias("hot")), "anchors")
    n, n_hot = shared.agg(F.count(F.lit(1)), F.count_if("hot")).first()
    known, often = bloom_of(shared, "anchor", n), bloom_of(shared.where("hot"), "anchor", n_hot)
    sent = spark.sparkContext.broadcast((known or EVERYTHING, often or EVERYTHING))
    found = docs.select("k", "text").mapInArrow(lambda it: _passages(width, k, sent, it), "anchor long, key long, body binary, words long, lo long, hi long, n long")
    if known is None:
        found = found.join(shared, "anchor", "left_semi")
    several = found.repartition("key").groupBy("key", "body").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("words").alias("words"), F.sum("n").alias("n"))
    several = materialise(several, "passages")
    top = most_frequent(several, often_n, shard_words)
    shard = Reference([(r.key, bytes(r.body), r.lo) for r in several.join(F.broadcast(top), "key").select("key", "body", "lo").collect()], width)
    reference = spark.sparkContext.broadcast(shard)
    each = docs.select("k", "tie", "text").mapInArrow(lambda it: _occurrences(width, k, sent, reference, it), "anchor long, key long, h long, k long, tie long, at int, starts array<long>")
    if known is None:
        each = each.join(shared, "anchor", "left_semi")
    each = materialise(each.drop("anchor"), "occurrences")
    others = several.join(F.broadcast(top), "key", "left_anti").repartition("key").sortWithinPartitions("key")
    matched = others.select("key", "body", "lo", "hi").mapInArrow(lambda it: _match(width, it), "key long, h long, leasts array<long>")
    hit = each.where("starts IS NULL").drop("starts").join(matched, ["key", "h"]).where(F.exists("leasts", lambda x: x < F.col("k")))
    starts = F.filter(F.transform("leasts", lambda x, i: F.when(x < F.col("k"), F.col("at") + i)), lambda x: x.isNotNull())
    gone = hit.select("k", "tie", starts.alias("s")).unionByName(each.where("starts IS NOT NULL").select("k", "tie", F.col("starts").alias("s")))
    return gone.groupBy("k", "tie").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("starts"))


def most_frequent(several: DataFrame, often: int = OFTEN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(key): the keys of most stretches, at least `often`, of which all passages together have at most shard_words words. At most SENT rows."""
    keys = several.groupBy("key").agg(F.sum("n").alias("uses"), F.sum("words").alias("words"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # one key with very many wordings would take the shard for itself
    keys = keys.where((F.col("lo") < F.col("hi")) & (F.col("uses") >= often) & (F.col("words") * 4 <= shard_words)).orderBy(F.desc("uses"), "key").limit(SENT)
    upto = F.sum("words").over(Window.orderBy(F.desc("uses"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return materialise(keys.withColumn("upto", upto).where(F.col("upto") <= shard_words).select("key"), "sent-keys")


def cover(n: int, starts, width: int) -> np.ndarray:
    """Which of n units the windows at `starts` cover."""
    mark = np.zeros(n + 1, np.int64)
    if starts is not None and len(starts):
        starts = np.unique(np.asarray(starts, np.int64))
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + width, -1)
    return np.cumsum(mark[:n]) > 0


def maximal_spans(removed: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _rewrite(width: int, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, spans, kept = [], [], []
        for text, starts in zip(b.column(1), b.column(2), strict=True):
            words = (text.as_py() or b"").split()
            n_words.append(len(words))
            if starts.is_valid:
                gone = cover(len(words), starts.values.to_numpy(zero_copy_only=False), width)
                spans.append([{"from": x, "to": y} for x, y in maximal_spans(gone)])
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(words))
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["_key", "n_words", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = WINDOW, k: int = K, key: str = "doc_id", hot: int | None = None, often: int = OFTEN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """key, n_words, spans (removed word ranges) and kept (words joined by one space, binary) of every row.

    Words are runs of anything but ASCII whitespace, unchanged. Null and wordless texts have no words.
    Only documents with a smaller key count as earlier, so repeats inside a document and between rows
    of equal key stay; a null key is the greatest. A text of under `width` words never changes. Only
    `key` and `text` are read, so other columns cannot clash. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), doc_key(F.col(key)).alias("k"), F.xxhash64(body).alias("tie"), body.cast("binary").alias("text"))
    starts = repeated_windows(rows.select("k", "tie", "text"), width, k, hot, often, shard_words)
    starts = materialise(starts.withColumn("name", F.xxhash64("k", "tie")), "starts")
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(starts, "name", starts.count()) or EVERYTHING)
    marked = rows.withColumn("touched", F.arrow_udf(lambda x: pa.array(sent.value.has(x.to_numpy())), "boolean")(F.xxhash64("k", "tie")))
    # only texts that lose words (and a few that the filter takes for such) meet their places by a shuffle
    joined = marked.where("touched").join(starts.drop("name"), ["k", "tie"], "left").select("_key", "text", "starts")
    rest = marked.where("not touched").select("_key", "text", F.lit(None).cast("array<long>").alias("starts"))
    schema = f"_key {kind}, n_words long, spans array<struct<`from`:long,`to`:long>>, kept binary"
    return joined.mapInArrow(lambda it: _rewrite(width, it), schema).unionByName(rest.mapInArrow(lambda it: _rewrite(width, it), schema)).withColumnRenamed("_key", key)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
