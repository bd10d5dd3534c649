"""Writing the fact table: sequence numbers, the cold table, retention, regrouping, and changes to the small tables.

Cold rows are partitioned by `event_date` and `shard`; hot rows are in the store of `hot.py`.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint, source_kind
from tidemark.schema import COLUMNS, DAY_MS, EVERY_MS, KEEP_HOT_MS
from tidemark.sources.log import Files
from tidemark.sources.scan import EXCEPTIONS, PARTITIONED, conform, list_days, shard

#: Changes when the fingerprint rules do.
FINGERPRINT_VERSION = 1


def event_date():
    return F.date_from_unix_date(F.expr(f"received_ms div {DAY_MS}").cast("int"))


@dataclass
class Ranked:
    """Rows in order, written once: `_at` holds the range partition of a row and its place in it."""

    staged: DataFrame
    rows: int

    def numbered(self, after: int) -> DataFrame:
        """With gapless sequence numbers above `after`."""
        counts = self.staged.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
        ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range partition
        counts = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
        place = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
        return conform(self.staged.withColumn("_range", F.shiftright("_at", 33)).join(counts, "_range").withColumn("seq", F.lit(after) + F.col("_base") + place))


def ranked(df: DataFrame) -> Ranked:
    """Rows by received time, and by the other columns where times are equal.

    Spark samples the bounds of range partitions, so no task sorts more than a share of the rows,
    however many of them fall into one hour; rows that are equal in all columns may be dealt out too.
    """
    spark, seen = df.sparkSession, Observation()
    order = ["received_ms", *[c for c in COLUMNS if c not in ("seq", "received_ms")], "_tie"]
    rows = conform(df).drop("seq").withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    at = new_folder(spark, "ranked")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
    return Ranked(spark.read.schema(rows.schema).parquet(at), seen.get["n"])


def with_seq(df: DataFrame, after: int) -> DataFrame:
    """Gapless sequence numbers above `after`, in order of received time."""
    return ranked(df).numbered(after)


def write_cold(df: DataFrame, cold: str) -> int:
    """Adds rows to their day and shard partitions, clustered. Returns how many."""
    seen = Observation()
    rows = clustered(conform(df).withColumn("event_date", event_date()).withColumn("shard", shard()))
    # counted behind the shuffle: what is before it runs once more to sample the bounds
    cold_writer(rows.observe(seen, F.count(F.lit(1)).alias("n"))).mode("append").parquet(cold)
    return seen.get["n"]


def clustered(rows: DataFrame) -> DataFrame:
    """Rows of day and shard partitions, spread over tasks and sorted by exception group, event name, session and time.

    A session's page views lie in one shard of a day and close to each other there, and so do an
    exception group's and an event's rows in theirs. Bloom filters of sessions and groups let readers
    pass over row groups without them.
    """
    order = ["event_date", "shard", "exc_group", "event_name", "sid", "received_ms"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def cold_writer(rows: DataFrame) -> DataFrameWriter:
    """Parquet by day and shard with Bloom filters, which grow with what a row group holds."""
    out = rows.write.partitionBy("event_date", "shard").option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in ("sid", "exc_group"):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no one has yet, in the shared folder of spark.checkpoint.dir (of this machine where Spark runs on one alone and that is unset)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"file://{tempfile.gettempdir()}"
    return f"{at.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a new folder."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    return Files(spark, path).exists(path)


def cutoff(now: int, keep: int = KEEP_HOT_MS) -> int:
    """Hot rows received before this are due for the cold table."""
    return now - keep


def next_run(last: int, every: int = EVERY_MS) -> int:
    """When compaction is due again: once in `every`, a second at least."""
    return last + max(every, 1000)


def expired_days(days: DataFrame, now: int, keep_ms: int) -> DataFrame:
    """Days (column event_date) whose last second is older than the retention."""
    end = (F.unix_date("event_date") + 1).cast("long") * DAY_MS - 1000
    return days.select("event_date").distinct().where(end < now - keep_ms)


def enforce_retention(spark: SparkSession, cold: str, now: int, keep_ms: int) -> list[str]:
    """Deletes expired day partitions, found by listing, through the table's own file system; returns their days."""
    days, files = [str(r[0]) for r in expired_days(list_days(spark, cold), now, keep_ms).orderBy("event_date").collect()], Files(spark, cold)
    for d in days:
        files.delete(f"{cold}/event_date={d}")
    return days


def regrouped(df: DataFrame) -> DataFrame:
    """Exception groups made anew from the stored texts, with a column that tells changed rows. A client's own group is not stored and so is lost."""
    new = F.when(F.col("kind") == "exception", fingerprint("exc_type", "exc_message", "exc_stack")).otherwise(F.col("exc_group"))
    return df.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col("exc_group"))).withColumn("exc_group", F.col("_new")).drop("_new")


def applied_version(spark: SparkSession, state: str) -> int:
    """The fingerprint version that stored rows were grouped by; 0 where none was ever written."""
    return spark.read.parquet(state).first()[0] if exists(spark, state) else 0


def regroup_if_needed(spark: SparkSession, hot, cold: str, state: str, staging: str, now: int, owner: str = "regroup", version: int = FINGERPRINT_VERSION) -> tuple[int, int] | None:
    """Groups stored exceptions of a HotStore and the cold table anew if they were grouped by other rules, and writes the version down.

    (hot, cold) rows changed, or None if nothing was due or another step is at the store. The cold
    rewrite replaces whole partitions, so it must not meet a compaction: both hold the store's lease.
    """
    if applied_version(spark, state) == version:
        return None
    with hot.alone(owner, now) as mine:
        if not mine:
            return None
        changed = hot.regroup(), regroup_cold(spark, cold, f"{staging}/cold") if exists(spark, cold) else 0
        spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(state)
    return changed


def regroup_cold(spark: SparkSession, cold: str, staging: str) -> int:
    """Rewrites only the exceptions of days in which a group changes; returns the number of changed rows."""
    rows = regrouped(spark.read.schema(PARTITIONED).parquet(cold).where(F.col("shard") == EXCEPTIONS))
    days = {r.event_date: r.n for r in rows.groupBy("event_date").agg(F.count_if("changed").alias("n")).where("n > 0").collect()}
    if days:
        # written aside first, since a table cannot be overwritten while it is read
        rows.where(F.col("event_date").isin(list(days))).drop("changed").write.mode("overwrite").parquet(staging)
        again = clustered(spark.read.schema(PARTITIONED).parquet(staging))
        cold_writer(again).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(cold)
    return sum(days.values())


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Rows replace those of equal keys."""
    return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def listed(table: DataFrame, key: str) -> DataFrame:
    """An entity table in key order."""
    return table.orderBy(key)


def found(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.where(F.col(key) == value)


def put_project(projects: DataFrame, row: DataFrame) -> DataFrame:
    """Adds or replaces one project. Its name must not be another project's, regardless of case."""
    clash = projects.alias("p").join(row.alias("r"), (F.lower("p.name") == F.lower("r.name")) & (F.col("p.id") != F.col("r.id")), "left_semi")
    if not clash.isEmpty():
        raise ValueError("another project has this name")
    return upsert(projects, row, "id")


def registered(sources: DataFrame, fresh: DataFrame, now) -> DataFrame:
    """The sources with fresh ones (column uri), which belong to no project yet."""
    new = fresh.select("uri", source_kind("uri").alias("kind"), F.lit(now).cast("timestamp").alias("created_at"), F.lit(now).cast("timestamp").alias("first_seen"), F.lit(now).cast("timestamp").alias("last_seen"))
    return sources.unionByName(new.join(sources, "uri", "left_anti"), allowMissingColumns=True)


def delete_project(projects: DataFrame, sources: DataFrame, pixels: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the project and its pixels; its sources stay, unassigned. Events are kept."""
    free = F.when(F.col("project_id") == project, F.lit(None)).otherwise(F.col("project_id"))
    return projects.where(F.col("id") != project), sources.withColumn("project_id", free), pixels.where(F.col("project_id") != project)


def set_triage(table: DataFrame, project: str, group: str, source: str, now, resolved: bool | None = None, muted: bool | None = None, note: str | None = None, by: str | None = None) -> DataFrame:
    """One state changed: None leaves an axis as it is, True is anchored at now, a blank note is no note."""
    spark = table.sparkSession
    mine = (F.col("project_id") == project) & (F.col("group_id") == group) & (F.col("source") == source)
    old = table.where(mine).first()
    at = lambda wish, was: was if wish is None else (now if wish else None)
    new = (project, group, source, at(resolved, old and old.resolved_at), at(muted, old and old.muted_at), (old and old.note) if note is None else (note.strip() or None), now, by)
    return table.where(~mine).unionByName(spark.createDataFrame([new], table.schema))
