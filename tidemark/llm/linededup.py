"""Line deduplication by winnowing over line hashes.

Of every WIDTH neighbouring lines the one with the least hash is selected as their fingerprint, and a
line of LONG words or more is a fingerprint by itself. A repeated run of WIDTH lines, or of one long
line, holds a selected fingerprint in each of its occurrences, so none is missed.

1. The hashes of selected lines are counted; those of two places or more are sent out as a Bloom filter.
2. Each selected line whose hash it knows leaves as one row: its place and the lines around it as far
   as windows reach in which it is the least. Equal rows are folded to their first occurrence.
3. Rows of one fingerprint meet. A match is extended to both sides of the fingerprint, line by line
   through the bytes of both: the windows that hold the fingerprint are compared as texts, and each
   learns its first occurrence. Beyond them the next fingerprint, at most WIDTH lines on, goes on.
4. Every run but its first occurrence is deleted. Texts without one are written where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import EVERYTHING, bloom_of
from tidemark.llm.runtime import doc_key, materialise, read_table, ship
from tidemark.llm.substring import cover
from tidemark.llm.textops import byte_class, mix, slices, sliding_min, split_words

#: Lines of a window, and words from which a line is a window by itself.
WIDTH, LONG = 3, 10
_LINE = np.ones(256, bool)
_LINE[10] = False
_SPACE = byte_class("space")


def selected(texts, width: int, long: int) -> Iterator[tuple]:
    """(first row, lines, marks, first window, windows, width of a window) of the stretches of windows with one fingerprint, and of long lines."""
    for a, _, data, off in slices(texts):
        w = split_words(data, off, _LINE)
        if not len(w):
            continue
        h = w.hashes()
        if len(w) >= width:
            least = sliding_min(h, width)
            whole = w.doc[: len(least)] == w.doc[width - 1 :]
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (w.doc[1 : len(least)] != w.doc[: len(least) - 1])
            begin = np.flatnonzero(new & whole)
            stop = np.append(np.flatnonzero(new), len(least))
            stop = stop[np.searchsorted(stop, begin, "right")] if len(begin) else begin
            stop = np.minimum(stop, w.first[w.doc[begin] + 1] - width + 1)
            yield a, w, least[begin].view(np.int64), begin, stop - begin, width
        words = split_words(data, off, _SPACE).start
        full = np.flatnonzero(np.searchsorted(words, w.end) - np.searchsorted(words, w.start) >= long)
        yield a, w, mix(h[full] ^ np.uint64(0x9E3779B97F4A7C15)).view(np.int64), full, np.ones(len(full), np.int64), 1


def _marks(width: int, long: int, batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, mark, _, n, size in selected(b.column(0), width, long):
            # a stretch of more windows than a fingerprint is in has it at two places
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mark, np.where(n > size, 2, 1)))], ["mark"])


def _places(width: int, long: int, known, batches) -> Iterator[pa.RecordBatch]:
    """(mark, body, k, tie, at, n, w): body is the lines of a stretch of n windows of w lines, joined by line feeds."""
    for b in batches:
        for a, w, mark, begin, n, size in selected(b.column(2), width, long):
            ok = known.value.has(mark)
            if not ok.any():
                continue
            mark, begin, n = mark[ok], begin[ok], n[ok]
            j = w.joined(10)
            text = j.data.tobytes()
            body = [text[s:e] for s, e in zip(j.start[begin].tolist(), j.end[begin + n + size - 2].tolist(), strict=True)]
            row = pa.array(a + w.doc[begin])
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark), pa.array(body, pa.binary()), b.column(0).take(row), b.column(1).take(row), pa.array(begin - w.first[w.doc[begin]], pa.int64()), pa.array(n, pa.int32()), pa.array(np.full(len(n), size), pa.int32())],
                ["mark", "body", "k", "tie", "at", "n", "w"],
            )


def _extended(batches) -> Iterator[pa.RecordBatch]:
    """Each window of a stretch (mark, body, f, n, w): (mark, window, j, f, w)."""
    for b in batches:
        rows, windows, at = [], [], []
        for i, (body, n, w) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
            lines = body.split(b"\n")
            rows += [i] * n
            at += range(n)
            windows += [b"\n".join(lines[j : j + w]) for j in range(n)]
        row = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(windows, pa.binary()), pa.array(at, pa.int32()), b.column(2).take(row), b.column(4).take(row)], ["mark", "window", "j", "f", "w"])


_PLACE = "struct<k:long,tie:long,at:long>"


def repeated_runs(docs: DataFrame, width: int = WIDTH, long: int = LONG) -> DataFrame:
    """(k, tie, spans): of every row that has any, the (at, w) of windows that repeat an earlier one. docs: (k, tie, text binary)."""
    spark = docs.sparkSession
    ship(spark)
    marks = docs.select("text").mapInArrow(lambda it: _marks(width, long, it), "mark long")
    several = materialise(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"), "line-marks")
    known = bloom_of(several, "mark", several.count())
    sent = spark.sparkContext.broadcast(known or EVERYTHING)
    found = docs.select("k", "tie", "text").mapInArrow(lambda it: _places(width, long, sent, it), "mark long, body binary, k long, tie long, at long, n int, w int")
    if known is None:
        found = found.join(several, "mark", "left_semi")
    found = materialise(found, "line-places")
    place = F.struct("k", "tie", "at")
    folded = materialise(found.groupBy("mark", "body", "w").agg(F.min(place).alias("f"), F.first("n").alias("n")), "line-stretches")
    windows = folded.select("mark", "body", "f", "n", "w").mapInArrow(_extended, f"mark long, window binary, j int, f {_PLACE}, w int")
    here = F.struct(F.col("f.k").alias("k"), F.col("f.tie").alias("tie"), (F.col("f.at") + F.col("j")).alias("at"))
    first = windows.groupBy("mark", "window", "w").agg(F.min(here).alias("g"))
    learnt = windows.join(first, ["mark", "window", "w"]).groupBy("f", "w").agg(F.collect_list(F.struct("j", "g")).alias("gs"))
    own = found.join(folded.select("mark", "body", "w", "f"), ["mark", "body", "w"]).select("k", "tie", "at", "w", "f").join(learnt, ["f", "w"])
    hit = own.select("k", "tie", "w", "at", F.explode("gs").alias("x")).select("k", "tie", "w", (F.col("at") + F.col("x.j")).alias("at"), "x.g")
    same = (F.col("k") == F.col("g.k")) & (F.col("tie") == F.col("g.tie"))
    # a run may not be deleted by an occurrence that overlaps it
    hit = hit.where(~same | (F.col("at") >= F.col("g.at") + F.col("w")))
    return hit.groupBy("k", "tie").agg(F.array_sort(F.collect_set(F.struct("at", "w"))).alias("spans"))


def _delete(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_lines, n_removed, kept = [], [], []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            lines = (text.as_py() or "").split("\n")
            full = [i for i, x in enumerate(lines) if x]
            gone = np.zeros(len(full), bool)
            spans = spans.as_py() or []
            for w in {s["w"] for s in spans}:
                gone |= cover(len(full), [s["at"] for s in spans if s["w"] == w], w)
            drop = {i for i, g in zip(full, gone.tolist(), strict=True) if g}
            n_lines.append(len(full))
            n_removed.append(len(drop))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else "\n".join(lines))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["_key", "n_lines", "n_removed", "kept"])


def remove_repeated_lines(docs: DataFrame, width: int = WIDTH, long: int = LONG, key: str = "doc_id") -> DataFrame:
    """key, n_lines, n_removed and kept (the text without later repeats) for every row.

    A line is a run of characters other than the line feed; empty lines are not counted and always
    kept. A run repeats if it has `width` lines or a line of `long` words. Order is (key, text checksum,
    place), a null key last: of repeated rows with equal key and text none is earlier than the other, so
    both are kept. Null and empty texts have no lines. Runs of fewer lines, none of them long, stay. Only
    `key` and `text` are read, so other columns cannot clash. An empty table gives no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), doc_key(F.col(key)).alias("k"), F.xxhash64(body).alias("tie"), body.alias("text"))
    spans = repeated_runs(rows.select("k", "tie", F.col("text").cast("binary").alias("text")), width, long)
    spans = materialise(spans.withColumn("name", F.xxhash64("k", "tie")), "line-spans")
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(spans, "name", spans.count()) or EVERYTHING)
    touched = F.arrow_udf(lambda x: pa.array(sent.value.has(x.to_numpy())), "boolean")(F.xxhash64("k", "tie"))
    marked = rows.withColumn("touched", touched)
    # only texts that lose lines (and a few that the filter takes for such) meet their spans by a shuffle
    joined = marked.where("touched").join(spans.drop("name"), ["k", "tie"], "left").select("_key", "text", "spans")
    rest = marked.where("not touched").select("_key", "text", F.lit(None).cast("array<struct<at:long,w:int>>").alias("spans"))
    schema = f"_key {kind}, n_lines long, n_removed long, kept string"
    return joined.mapInArrow(_delete, schema).unionByName(rest.mapInArrow(_delete, schema)).withColumnRenamed("_key", key)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents),
f AS (SELECT doc_id, j, x, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS nr FROM l WHERE x <> ''),
win AS (SELECT doc_id, nr, body, 3 AS w FROM (SELECT doc_id, nr, count(*) OVER w AS n, array_to_string(list(x) OVER w, chr(10)) AS body FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3
  UNION ALL SELECT doc_id, nr, x, 1 FROM f WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 10),
firsts AS (SELECT w, body, min(struct_pack(k := doc_id, nr := nr)) AS f FROM win GROUP BY w, body),
hit AS (SELECT doc_id, unnest(range(nr, nr + w)) AS nr FROM win JOIN firsts USING (w, body) WHERE doc_id > f.k OR nr >= f.nr + w),
gone AS (SELECT DISTINCT doc_id, nr FROM hit),
dropped AS (SELECT doc_id, j FROM f JOIN gone USING (doc_id, nr))
SELECT doc_id, count(*) FILTER (WHERE x <> '') AS n_lines, count(*) FILTER (WHERE d.j IS NOT NULL) AS n_removed,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY l.j) FILTER (WHERE d.j IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN dropped d USING (doc_id, j) GROUP BY doc_id
"""
