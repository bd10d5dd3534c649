"""Sharding by longest-processing-time scheduling.

Groups of equal texts must stay together. There can be as many groups as rows, so they are not
scheduled one by one on the driver: a group above a fixed share of all bytes is a unit of its own,
and the others are gathered by their digest into a fixed number of units. The bounded list of units,
sorted by size, goes to the least-loaded shard through a heap. All row work is Spark aggregation.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import doc_key, materialise, read_table

#: Light groups are gathered into this many units.
UNITS = 4096
#: A group of more than 1/HEAVY of all bytes is a unit of its own, so there are fewer than HEAVY of them.
HEAVY = 8192
#: Rows of a unit are numbered in this many parts and one more for each PART_ROWS rows it has, so that one task never numbers a hot group.
PARTS, PART_ROWS = 16, 1_000_000


def lpt(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Largest first to the least-loaded shard; ties by name and by shard number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def assign_shards(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", units: int = UNITS, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    Null texts are empty (size 1, checksum 0) and form one group with empty texts. Rows that agree
    in key and text are kept apart as rows and take neighbouring slots. An empty table gives an
    empty result. Only `key` and `text` are read, so other columns cannot clash. A group larger than
    a fair share of a shard makes that shard larger: groups are never split.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("t")).select(
        "doc_id",
        (F.octet_length("t").cast("long") + 1).alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.sha2("t", 256).alias("digest"),
    )
    # rows without an id are told apart by their place, which is written down with them
    rows = materialise(rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    light = F.concat(F.lit("u"), F.pmod(F.xxhash64("digest"), F.lit(units)).cast("string"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    heavy = [r[0] for r in groups.where(F.col("bytes") * HEAVY > total).select("digest").collect()]
    unit = F.when(F.col("digest").isin(heavy), F.col("digest")).otherwise(light) if heavy else light
    rows = rows.withColumn("unit", unit)
    # fewer than UNITS + HEAVY rows, whatever the input
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    shard_of = lpt([(r.unit, r.bytes) for r in sizes], shards)
    plan = docs.sparkSession.createDataFrame([(r.unit, shard_of[r.unit], PARTS + r.n // part_rows) for r in sizes], "unit string, shard int, parts long")
    part = F.pmod(F.xxhash64(doc_key(F.col("doc_id")), "place"), F.col("parts"))
    parts = rows.join(F.broadcast(plan), "unit").withColumn("part", part).drop("parts")
    counts = parts.groupBy("shard", "unit", "part").agg(F.count(F.lit(1)).alias("n"))
    # at most (UNITS + HEAVY) * PARTS rows and one more for each part_rows rows
    ahead = Window.partitionBy("shard").orderBy("unit", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("unit", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("unit", "part").orderBy("doc_id", "digest")
    numbered = parts.withColumn("at", F.row_number().over(inner))
    return numbered.join(base, ["unit", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at") - 1).cast("long").alias("slot")
    )


def op5_shard_lpt(spark, sf_dir: str) -> DataFrame:
    out = assign_shards(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
