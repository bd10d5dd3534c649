"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. Documents
are ordered within their source by size, the expected copies are summed up along that order, one
offset is added, and a document is emitted once for every integer boundary its stretch crosses.
Ordering by size makes the emitted words follow the target closely, whatever the spread of sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialise, read_table, ship
from tidemark.llm.textops import byte_class, slices, split_words

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of one source and size class are ranked in this many parts, and one more for each PART_ROWS rows there are.
PARTS, PART_ROWS = 16, 1_000_000
BUDGET, CEILING = 1.5, 2.0
_SPACE = byte_class("space")
_OWN = ("_h", "_src", "_class", "_part", "_rank", "_base")


def count_words(texts: pa.Array) -> pa.Array:
    """Of each text the number of [^\\x20\\x09-\\x0D]+; 0 for null."""
    n = [np.diff(split_words(data, off, _SPACE).first) for _, _, data, off in slices(texts)]
    return pa.array(np.concatenate(n) if n else [], pa.int64())


def n_words(text) -> Column:
    return F.arrow_udf(count_words, "long")(text.cast("string"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target. sizes: one row a source (source, source_size).

    Targets share `budget` times all words by weight and stop at `ceiling` times the source's size;
    the excess is shared again until none is above. Sorting by size / weight gives the fixed point in
    one pass: a prefix of that order is capped, and the rest share what the prefix leaves.
    """
    place = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w)
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    share = (budget * F.sum("source_size").over(all_rows) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    s = s.withColumn("share", share).withColumn("free", F.col("share") * F.col("w") <= ceiling * F.col("source_size"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("source_size") / F.col("w")).alias("r"), F.col("share").alias("level")))).over(all_rows)["level"]
    cap = ceiling * F.col("source_size")
    return s.withColumn("level", level).select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("w"), cap)).cast("double").alias("target"))


def size_class(size) -> Column:
    """Sizes that agree in their six leading binary digits share a class: at most 32 classes an octave."""
    unit = F.pow(F.lit(2.0), F.greatest(F.length(F.bin(size)) - 6, F.lit(0)))
    return F.floor(size / unit) * unit.cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """All columns of docs, `size` (words of the text) and `_h`, a hash of the whole row by which rows of one size and doc_id are ordered."""
    docs = docs.drop("size", "source_size", "target", "copies", *_OWN)
    plain = [F.col(f.name) for f in docs.schema if not f.dataType.simpleString().startswith(("map", "struct", "array", "variant"))]
    return docs.withColumn("_h", F.xxhash64(*plain)).withColumn("size", n_words(F.col("text")))


def sample_copies(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """All columns of docs with size, source_size, target and copies (long) of every row.

    Needs columns doc_id, text, source. Null text has size 0; such a row can be emitted but adds no
    words. A null source is a source of its own. Rows are ranked by size, doc_id and a hash of the
    whole row, and only rows that are equal in all plain columns can change places, so reruns agree on
    the rows emitted, however the input is dealt out and whether or not doc_ids are null or repeated.
    An empty table, or one without words, has no copies. Other columns pass through; those named like
    an added column are replaced.
    """
    ship(docs.sparkSession)
    return copies_of(materialise(measured(docs), "measured"), weights, budget, ceiling, seed, part_rows)


def copies_of(rows: DataFrame, weights=WEIGHTS, budget: float = BUDGET, ceiling: float = CEILING, seed: int = 42, part_rows: int = PART_ROWS) -> DataFrame:
    """sample_copies of rows that are measured and written already; their text is not needed."""
    parts = PARTS + rows.count() // part_rows
    src = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = rows.withColumn("_src", src).withColumn("_class", size_class(F.col("size"))).withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_h"), F.lit(parts)))
    counts = rows.groupBy("_src", "_class", "_part").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, ceiling)
    goal = goal.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_src"), "source_size", "target")
    # a source has at most 32 classes an octave times the parts here
    ahead = Window.partitionBy("_src").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_src", "_class", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base")).join(goal, "_src")
    inner = Window.partitionBy("_src", "_class", "_part").orderBy("size", F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "_h")
    out = rows.withColumn("_rank", F.row_number().over(inner)).join(base, ["_src", "_class", "_part"])
    offset = F.pmod(F.xxhash64(F.lit(seed), "_src"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda n: F.floor(n * rate + offset)
    rank = F.col("_base") + F.col("_rank")
    return out.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long")).drop(*_OWN)


def emit(sampled: DataFrame) -> DataFrame:
    """One row for each copy."""
    kept = sampled.where(F.col("copies") > 0)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("_copy")


def op9_mix_systematic(spark, sf_dir: str) -> DataFrame:
    ship(spark)
    # words are counted once; texts are not needed any more
    rows = measured(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    out = copies_of(materialise(rows, "measured"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
