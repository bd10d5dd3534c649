"""Ranked lexical search: WAND over shards of documents, whose heaps are merged.

One scan turns every text into its postings of the items' terms, which are written; document and term
counts come from them. Then tasks cut their postings into shards. A shard has a posting list a term and
the list's greatest impact; cursors of an item's lists are ordered by the document they stand at, and the
first cursor up to which greatest impacts add up to the item's heap threshold is the pivot. Documents
before it cannot enter the heap and are skipped by search; the pivot's own score is summed up and offered
to the heap. All items of a shard move one pivot at a time, as rows of one array. A task keeps its heaps
from shard to shard, and they are merged by a window over items.

Items are read in blocks of bounded size, each of which is broadcast and takes one scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.runtime import LAST_ID, doc_key, materialise, read_table, ship
from tidemark.llm.textops import Words, byte_class, slices, split_words

TOP = 10
#: Items of about this many bytes are one block (an item that is longer is a block of its own).
BLOCK_BYTES = 4 << 20
#: A shard ends at so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 4096
#: Items that move together: so many cursors.
CURSORS = 1 << 14
_ALNUM = byte_class("alnum")


def words_of(texts) -> Iterator[tuple[int, int, Words]]:
    for a, b, data, off in slices(texts):
        yield a, b, split_words(data, off, _ALNUM, lower=True)


class Terms:
    """The distinct terms of a block of items, numbered; those of each item."""

    def __init__(self, texts: list[str | None]):
        number: dict[bytes, int] = {}
        self.of_item: list[np.ndarray] = []
        for _, _, w in words_of(pa.array(texts, pa.string())):
            for d in range(len(w.first) - 1):
                mine = {number.setdefault(w.word(i), len(number)) for i in range(w.first[d], w.first[d + 1])}
                self.of_item.append(np.array(sorted(mine), np.int64))
        self.n = len(number)
        data = b"".join(number)
        off = np.cumsum([0, *map(len, number)])
        own = Words(np.frombuffer(data, np.uint8), off[:-1], off[1:], np.zeros(self.n, np.int64), np.array([0, self.n]))
        hashes = own.hashes()
        order = np.argsort(hashes, kind="stable")
        # terms of one hash, should there be any, are in tables of their own
        place = np.arange(self.n) - np.searchsorted(hashes[order], hashes[order])
        self.tables = [(hashes[order[place == p]], order[place == p]) for p in range(int(place.max(initial=-1)) + 1)]
        self.data, self.start, self.size = own.data, own.start, own.end - own.start

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of a word, number of its term) of all words that are terms: looked up by hash, compared byte by byte."""
        found = [(np.zeros(0, np.int64),) * 2]
        h = w.hashes()
        for hashes, order in self.tables if len(w) else ():
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            place = np.flatnonzero(hashes[at] == h)
            found.append(self._same(w, place, order[at[place]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _same(self, w: Words, place: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = w.end[place] - w.start[place] == self.size[term]
        place, term = place[same], term[same]
        if not len(place):
            return place, term
        size = self.size[term]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = w.data[np.repeat(w.start[place], size) + inside] != self.data[np.repeat(self.start[term], size) + inside]
        same = np.add.reduceat(differ, np.cumsum(size) - size) == 0
        return place[same], term[same]


_POSTINGS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def _postings(terms, batches) -> Iterator[pa.RecordBatch]:
    """One row for each text that has words: their number, its terms of the block and how often they occur."""
    for b in batches:
        for a, _, w in words_of(b.column(1)):
            n = np.diff(w.first)
            place, term = terms.value.find(w)
            found, times = np.unique(w.doc[place] * terms.value.n + term, return_counts=True)
            doc = found // max(terms.value.n, 1)
            ends = np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (found - doc * terms.value.n, times)]
            rows = pa.RecordBatch.from_arrays([b.column(0).slice(a, len(n)), pa.array(n), *lists], schema=_POSTINGS)
            yield rows.filter(pa.array(n > 0))


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


@dataclass
class Query:
    """What tasks need of a block: weights of its terms, terms of its items, counts of the corpus."""

    weights: np.ndarray
    of_item: list[np.ndarray]
    docs: int
    words: int
    shard_docs: int = SHARD_DOCS
    shard_postings: int = SHARD_POSTINGS
    cursors: int = CURSORS

    def impacts(self, term: np.ndarray, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Addends of scores, in 64-bit integers."""
        m = 100 - 90 + (90 * n * self.docs) // self.words
        return self.weights[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


class Heaps:
    """The best scores of each item and their documents; score 0 is a free place."""

    def __init__(self, items: int, top: int):
        self.score, self.doc = np.zeros((items, top), np.int64), np.full((items, top), LAST_ID, np.int64)
        self.floor = np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """One document for each of some different items. Of equal scores the lesser doc_id is better."""
        least = self.score[item].min(axis=1)
        may = score >= np.maximum(least, 1)
        item, score, doc, least = item[may], score[may], doc[may], least[may]
        worst = np.where(self.score[item] == least[:, None], self.doc[item], np.iinfo(np.int64).min)
        seat = worst.argmax(axis=1)
        ok = (score > least) | (doc < worst[np.arange(len(item)), seat])
        item, seat = item[ok], seat[ok]
        self.score[item, seat], self.doc[item, seat] = score[ok], doc[ok]
        self.floor[item] = np.maximum(self.score[item].min(axis=1), 1)


class Shard:
    """Posting lists of neighbouring documents, by term, with greatest impacts."""

    def __init__(self, query: Query, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, times: np.ndarray):
        self.query, self.ids, self.end = query, ids, len(ids)
        doc = np.repeat(np.arange(len(ids)), sizes)
        impact = query.impacts(term, times, n[doc])
        order = np.lexsort((doc, term))
        self.doc, self.impact = np.append(doc[order], self.end), np.append(impact[order], 0)
        self.key = term[order] * (self.end + 1) + doc[order]
        # one more term, which no document has, fills up rows of items with fewer terms
        self.first = np.searchsorted(term[order], np.arange(len(query.weights) + 2))
        self.top = np.zeros(len(query.weights) + 1, np.int64)
        np.maximum.at(self.top, term, impact)

    def at(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The document at a place of a term's list; behind the list, the end."""
        return np.where(place < self.first[term + 1], self.doc[np.minimum(place, len(self.doc) - 1)], self.end)

    def search(self, heaps: Heaps) -> int:
        """Offers to the heaps every document that may enter them; returns how many scores were summed up."""
        held = [t[self.top[t] > 0] for t in self.query.of_item]
        todo = sorted((i for i, t in enumerate(held) if len(t)), key=lambda i: len(held[i]))
        scored = 0
        while todo:
            width = len(held[todo[-1]])
            some, todo = todo[-max(1, self.query.cursors // width) :], todo[: -max(1, self.query.cursors // width)]
            term = np.full((len(some), width), len(self.query.weights))
            for k, i in enumerate(some):
                term[k, : len(held[i])] = held[i]
            scored += self._pivots(heaps, np.array(some), term)
        return scored

    def _pivots(self, heaps: Heaps, item: np.ndarray, term: np.ndarray) -> int:
        place = self.first[term]
        now, top, scored = self.at(term, place), self.top[term], 0
        while len(item):
            order = now.argsort(axis=1)
            bound = np.take_along_axis(top, order, 1).cumsum(axis=1)
            enough = bound >= heaps.floor[item][:, None]
            rows = np.arange(len(item))
            pivot = now[rows, order[rows, enough.argmax(axis=1)]]
            go = enough[:, -1] & (pivot < self.end)
            if not go.all():
                item, term, place, now, top, pivot = item[go], term[go], place[go], now[go], top[go], pivot[go]
                if not len(item):
                    break
            behind = np.nonzero(now < pivot[:, None])
            t = term[behind]
            place[behind] = np.searchsorted(self.key, t * (self.end + 1) + pivot[behind[0]])
            now[behind] = self.at(t, place[behind])
            here = now == pivot[:, None]
            score = np.where(here, self.impact[np.minimum(place, len(self.impact) - 1)], 0).sum(axis=1)
            heaps.offer(item, score, self.ids[pivot])
            on = np.nonzero(here)
            place[on] += 1
            now[on] = self.at(term[on], place[on])
            scored += len(item)
        return scored


def shards(query: Query, batches) -> Iterator[Shard]:
    parts, docs, postings = [], 0, 0

    def close() -> Shard:
        ids, n, sizes, term, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        lists = np.argsort(np.argsort(order, kind="stable")[np.repeat(np.arange(len(ids)), sizes)], kind="stable")
        return Shard(query, ids[order], n[order], sizes[order], term[lists], times[lists])

    for b in batches:
        size = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        term, times = (b.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        ends, a = np.concatenate([[0], np.cumsum(size)]), 0
        while a < len(ids):
            z = min(a + query.shard_docs - docs, int(np.searchsorted(ends, ends[a] + query.shard_postings - postings, "right")) - 1, len(ids))
            z = max(z, a + 1)
            parts.append((ids[a:z], n[a:z], size[a:z], term[ends[a] : ends[z]], times[ends[a] : ends[z]]))
            docs, postings, a = docs + z - a, postings + int(ends[z] - ends[a]), z
            if docs >= query.shard_docs or postings >= query.shard_postings or a < len(ids):
                yield close()
                parts, docs, postings = [], 0, 0
    if parts:
        yield close()


def _search(query, top: int, batches) -> Iterator[pa.RecordBatch]:
    heaps = Heaps(len(query.value.of_item), top)
    for shard in shards(query.value, batches):
        shard.search(heaps)
    item, seat = np.nonzero(heaps.score)
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(heaps.doc[item, seat]), pa.array(heaps.score[item, seat])], ["item", "key", "score"])


def blocks(items: DataFrame, size: int) -> Iterator[list[Row]]:
    """Rows of items (id, text), about `size` bytes of text together."""
    block, held = [], 0
    for r in items.toLocalIterator():
        n = len((r[1] or "").encode())
        if block and held + n > size:
            yield block
            block, held = [], 0
        block.append(r)
        held += n
    if block:
        yield block


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", item: str = "item_id", block_bytes: int = BLOCK_BYTES, **limits: int) -> DataFrame:
    """item, rank (from 1), key and score: the `top` rows of docs of highest score above 0 for every row of items, equal scores by key, null last.

    Terms are ASCII letters (lower-cased) and digits and characters beyond ASCII; a score adds up integer
    weights over an item's terms, once each. A null or wordless text matches nothing and is not counted.
    Repeated rows of docs are ranked side by side; each row of items is an item of its own, whatever its
    id, and one that nothing matches has no rows. An empty table on either side gives an empty result.
    Only `key`, `item` and the two texts are read, so other columns cannot clash. limits: those of Query.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item].dataType
    texts = docs.select(doc_key(F.col(key)).alias("key"), F.col("text").cast("binary"))
    found = []
    for block in blocks(items.select(item, "text"), block_bytes):
        terms = Terms([r[1] for r in block])
        sent = spark.sparkContext.broadcast(terms)
        made = materialise(texts.mapInArrow(lambda it, sent=sent: _postings(sent, it), "key long, n long, terms array<int>, times array<int>"), "postings")
        counts = made.agg(F.count(F.lit(1)), F.sum("n")).first()
        holding = np.zeros(terms.n, np.int64)
        # a row a term of the block
        for r in made.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            holding[r[0]] = r[1]
        query = spark.sparkContext.broadcast(Query(np.array([weight(counts[0], int(h)) for h in holding], np.int64), terms.of_item, counts[0], counts[1] or 1, **limits))
        best = made.mapInArrow(lambda it, query=query: _search(query, top, it), "item long, key long, score long")
        names = pa.RecordBatch.from_arrays([pa.array(range(len(block)), pa.int64()), pa.array([r[0] for r in block], to_arrow_type(kind))], ["item", "name"])
        first = Window.partitionBy("item").orderBy(F.desc("score"), "key")
        best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        best = best.join(spark.createDataFrame(pa.Table.from_batches([names])), "item").select("name", "rank", "key", "score")
        found.append(best)
    empty = spark.createDataFrame([], f"name {kind.simpleString()}, rank int, key long, score long")
    out = empty if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("name").alias(item), "rank", F.when(F.col("key") < LAST_ID, F.col("key")).alias(key), "score")


def op11_wand(spark, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT row_number() OVER () AS item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), s AS (
  SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0
), p AS (
  SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs
), i AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))) AS impact FROM p JOIN w USING (term), s
), r AS (
  SELECT item, item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item, item_id, row, doc_id HAVING sum(impact) > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10
"""
