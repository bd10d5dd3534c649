"""Reading the fact table: hot and cold parts, day pruning, duplicates."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.predicates import is_event
from tidemark.operators.metrics import between
from tidemark.schema import COLUMNS, DAY_MS, FACT
from tidemark.sources.log import Files

PARTITIONED = T.StructType([*FACT.fields, T.StructField("event_date", T.DateType()), T.StructField("shard", T.IntegerType())])
#: Page views of a day are dealt into this many shards by session; its exceptions and its events are in one each.
SHARDS = 16
EXCEPTIONS, EVENTS = SHARDS, SHARDS + 1


def shard() -> Column:
    """The cold table's second partition column, by kind and session; rows of no session are dealt out by time."""
    key = F.coalesce(F.nullif("sid", F.lit("")), F.col("received_ms").cast("string"))
    return F.when(F.col("kind") == "exception", EXCEPTIONS).when(is_event(), EVENTS).otherwise(F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")).cast("int")


def session_shards(sid: str) -> Column:
    """Where a session's rows can lie. The session's own shard is a constant, so other partitions are pruned."""
    own = F.pmod(F.xxhash64(F.lit(sid)), F.lit(SHARDS)).cast("int")
    return (F.col("shard") == own) | F.col("shard").isin(EXCEPTIONS, EVENTS)


def conform(df: DataFrame) -> DataFrame:
    """All fact columns in order and of their types; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT])


def combined(cold: DataFrame, hot: DataFrame, start: int, end: int, overlap: tuple[int, int] | None = None) -> DataFrame:
    """Cold and hot rows of a window, each once: equal rows are left by a crash between writing and deleting.

    overlap: received times (first, last) between which equal rows can lie, where that is known. Only
    those rows are shuffled to be compared; the others pass as they are.
    """
    both = between(conform(cold).unionByName(conform(hot), allowMissingColumns=True), start, end)
    if overlap is None:
        return both.distinct()
    shared = F.col("received_ms").between(*overlap)
    return both.where(~shared).unionByName(both.where(shared).distinct())


def overlap_of(hot: DataFrame) -> tuple[int, int]:
    """Where equal rows can lie if compaction leaves none in the cold table: the time of the hot rows. Reads one column of them."""
    first, last = hot.agg(F.min("received_ms"), F.max("received_ms")).first()
    return (0, -1) if first is None else (first, last)


def list_days(spark: SparkSession, path: str) -> DataFrame:
    """The day folders of the cold table as rows (event_date, empty ones too), by one listing of its folder: no file is opened."""
    names = [n.removeprefix("event_date=") for n, folder, _ in Files(spark, path).listed(path) if folder and n.startswith("event_date=")]
    return spark.createDataFrame([(n,) for n in names], "name string").select(F.try_to_date("name").alias("event_date")).where("event_date IS NOT NULL")


def list_files(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """(event_date, path, bytes) of the cold table's Parquet files from `start`'s day to `end`'s day inclusive. Spark lists the day folders in tasks where there are many; no file is opened."""
    if list_days(spark, path).isEmpty():
        return spark.createDataFrame([], "event_date date, path string, bytes long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = files.select(F.to_date(F.col("event_date").cast("string")).alias("event_date"), F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    return _days(files, start, end)


def check_files(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """list_files with `rows`: those of a file whose footer can be read, null for another.

    A scan of no columns reads the files' footers alone, in tasks, and passes over those it cannot read.
    A file that holds no rows is not told from an unreadable one, which makes no difference to who reads them.
    """
    files = list_files(spark, path, start, end)
    if files.isEmpty():
        return files.withColumn("rows", F.lit(None).cast("long"))
    found = _days(spark.read.schema(PARTITIONED).option("ignoreCorruptFiles", "true").parquet(path), start, end)
    counts = found.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    return files.join(counts, "path", "left").select("event_date", "path", "bytes", "rows")


def _days(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    day = lambda ms: F.date_from_unix_date(F.lit(ms // DAY_MS).cast("int"))
    if start is not None:
        df = df.where(F.col("event_date") >= day(start))
    if end is not None:
        df = df.where(F.col("event_date") <= day(end))
    return df


def read_cold(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, skip: Callable[[list[str]], None] | None = None, shards: Column | None = None) -> DataFrame:
    """Day partitions from `start`'s day to `end`'s day inclusive; other directories are not listed for rows. shards: a condition on `shard`.

    skip: files whose footer cannot be read are left out, and their paths given to it. That takes a job
    over the footers first. A file that fails later, while its rows are read, fails the query all the same.
    """
    df = spark.read.schema(PARTITIONED).parquet(path)
    df = _days(df if shards is None else df.where(shards), start, end)
    if skip is not None:
        bad = [r.path for r in check_files(spark, path, start, end).where("rows IS NULL").select("path").toLocalIterator()]
        if bad:
            skip(bad)
            df = df.where(~F.col("_metadata.file_path").isin(bad))
    return df.select(*COLUMNS)


def read_session(spark: SparkSession, path: str, sid: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The cold rows of one session: three of a day's shards, and in them the row groups whose statistics and Bloom filters allow it."""
    return read_cold(spark, path, start, end, shards=session_shards(sid)).where(F.col("sid") == sid)


def read_group(spark: SparkSession, path: str, group: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The cold rows of one exception group: one of a day's shards, sorted by group."""
    return read_cold(spark, path, start, end, shards=F.col("shard") == EXCEPTIONS).where((F.col("kind") == "exception") & (F.col("exc_group") == group))


def read_events(spark: SparkSession, path: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The cold rows of custom and pixel events of one name: one of a day's shards, sorted by name."""
    return read_cold(spark, path, start, end, shards=F.col("shard") == EVENTS).where(is_event() & (F.col("event_name") == name))


def read_sessions(spark: SparkSession, path: str, ids: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """The cold rows of a few sessions, as `traces_of` asks for them."""
    shards = F.col("shard").isin(EXCEPTIONS, EVENTS)
    for sid in ids:
        shards = shards | session_shards(sid)
    return read_cold(spark, path, start, end, shards=shards).where(F.col("sid").isin(*ids))


def earliest_ms(spark: SparkSession, cold: str, hot) -> int | None:
    """Midnight of the earliest day folder of the cold table, empty or not; else the earliest row of a HotStore, as its log has it. Opens no data file."""
    first = list_days(spark, cold).agg(F.min("event_date")).first()[0]
    if first is not None:
        return (first.toordinal() - 719_163) * DAY_MS
    start, end = hot.span()
    return start if end >= start else None


def warn_of(paths: list[str]) -> None:
    warnings.warn(f"{len(paths)} unreadable files are skipped, among them {paths[0]}", stacklevel=2)


def window(spark: SparkSession, cold: str, hot, start: int, end: int, skip: Callable[[list[str]], None] = warn_of) -> DataFrame:
    """The rows of a window from the cold table and a HotStore, each once; unreadable cold files are skipped and reported.

    The hot store's version is taken first: rows that are moved afterwards are then seen twice, and
    never not at all.
    """
    state = hot.state()
    young, span = hot.read(start, end, state), hot.span(state)
    old = read_cold(spark, cold, start, end, skip) if Files(spark, cold).exists(cold) else spark.createDataFrame([], FACT)
    return combined(old, young, start, end, span)


def before(hot: DataFrame, threshold: int) -> DataFrame:
    return hot.where(F.col("received_ms") < threshold)


def new_sources(df: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """URIs not known yet, up to the room that is left below `most`."""
    fresh = df.select(F.col("source").alias("uri")).distinct().join(known.select("uri"), "uri", "left_anti")
    return fresh.orderBy("uri").limit(max(most - known.count(), 0))
