"""Headline metrics, series, breakdowns and rollups. Every function is DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import is_event
from tidemark.functions.text import filled
from tidemark.schema import BOUNCE_MS, MAX_POINTS, MIN_SAMPLES, TOP

#: Breakdown name -> column.
BREAKDOWNS = {
    "pages": "pathname", "referrers": "referrer_host", "countries": "country", "languages": "language", "browsers": "ua_browser", "operating_systems": "ua_os", "devices": "ua_device",
    "utm_sources": "utm_source", "utm_mediums": "utm_medium", "utm_campaigns": "utm_campaign",
}


def load() -> Column:
    return F.col("kind") == "page_load"


def between(df: DataFrame, start: int, end: int) -> DataFrame:
    """Half-open window on received time."""
    return df.where((F.col("received_ms") >= start) & (F.col("received_ms") < end))


def summary(df: DataFrame, flag: str = "is_unique_user") -> DataFrame:
    """One row. Visitors are page loads with the flag; the bounce rate needs five samples."""
    d = F.col("duration_ms")
    out = df.agg(
        F.count_if(load()).alias("pageviews"), F.count_if(load() & F.col(flag)).alias("visitors"), F.count_if(is_event()).alias("events"),
        F.count("duration_ms").alias("samples"), F.count_if(d.between(*BOUNCE_MS)).alias("bounces"), F.round(F.median("duration_ms")).cast("long").alias("median_ms"),
    )
    return out.select("pageviews", "visitors", "events", F.when(F.col("samples") >= MIN_SAMPLES, F.col("bounces") / F.col("samples")).alias("bounce_rate"), "median_ms")


def series(df: DataFrame, start: int, end: int, bucket: int, flag: str = "is_unique_user") -> DataFrame:
    """Counts by epoch-aligned bucket, with empty buckets. Beyond MAX_POINTS buckets only those that have rows."""
    bucket = max(bucket, 1)
    at = F.col("received_ms") - F.pmod("received_ms", F.lit(bucket))
    exc = F.col("kind") == "exception"
    rows = df.where(load() | is_event() | exc).groupBy(at.cast("long").alias("ts")).agg(
        F.count_if(load()).alias("pageviews"), F.count_if(load() & F.col(flag)).alias("visitors"), F.count_if(is_event()).alias("events"), F.count_if(exc).alias("exceptions")
    )
    first, last = start - start % bucket, (end - 1) - (end - 1) % bucket
    if last < first or (last - first) // bucket + 1 > MAX_POINTS:
        return rows.orderBy("ts")
    grid = df.sparkSession.range(first, last + 1, bucket, 1).select(F.col("id").alias("ts"))
    return grid.join(rows, "ts", "left").fillna(0).orderBy("ts")


def previous_series(df: DataFrame, start: int, end: int, bucket: int, flag: str = "is_unique_user") -> DataFrame:
    """The window before, on the grid of the present one, so that both series agree place by place."""
    span = end - start
    moved = between(df, start - span, start).withColumn("received_ms", F.col("received_ms") + span)
    return series(moved, start, end, bucket, flag).withColumn("ts", F.col("ts") - span)


def breakdown(df: DataFrame, column: str, flag: str = "is_unique_user", limit: int = TOP) -> DataFrame:
    """Page loads by value, most first; absent values are the empty string."""
    flag = "is_unique_page" if column == "pathname" else flag
    rows = df.where(load()).groupBy(filled(column).alias("key")).agg(F.count(F.lit(1)).alias("pageviews"), F.count_if(flag).alias("visitors"))
    return rows.orderBy(F.desc("pageviews"), "key").limit(limit)


def breakdowns(df: DataFrame, flag: str = "is_unique_user", limit: int = TOP) -> DataFrame:
    """All breakdowns at once, by one shuffle: (dimension, key, pageviews, visitors)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), filled(c).alias("key"), F.col("is_unique_page" if n == "pages" else flag).alias("u")) for n, c in BREAKDOWNS.items()])
    rows = df.where(load()).select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count(F.lit(1)).alias("pageviews"), F.count_if("p.u").alias("visitors"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("pageviews"), "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def version_breakdown(df: DataFrame, flag: str = "is_unique_user", limit: int = TOP) -> DataFrame:
    rows = df.where(load()).groupBy(filled("ua_browser").alias("browser"), filled("ua_version").alias("version")).agg(F.count(F.lit(1)).alias("pageviews"), F.count_if(flag).alias("visitors"))
    return rows.orderBy(F.desc("pageviews"), "browser", "version").limit(limit)


def count_by(df: DataFrame, column: str, limit: int = TOP) -> DataFrame:
    return df.groupBy(filled(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def event_names(df: DataFrame, limit: int = TOP) -> DataFrame:
    return count_by(df.where(is_event()), "event_name", limit)


def source_rollup(df: DataFrame, flag: str = "is_unique_user") -> DataFrame:
    """By source; the flag counts on page loads and events alike."""
    rows = df.where(load() | is_event()).groupBy("source")
    return rows.agg(F.count_if(load()).alias("pageviews"), F.count_if(flag).alias("visitors"), F.count_if(is_event()).alias("events"))


def owned(rollup: DataFrame, sources: DataFrame) -> DataFrame:
    return rollup.join(sources, rollup["source"] == sources["uri"], "left").drop("uri")


def project_rollup(rollup: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Every project, with or without traffic. A source of an unknown project is in no row."""
    sums = owned(rollup, sources).groupBy("project_id").agg(*[F.sum(c).alias(c) for c in ("pageviews", "visitors", "events")])
    out = projects.join(sums, projects["id"] == sums["project_id"], "left").drop("project_id").fillna(0, ["pageviews", "visitors", "events"])
    return out.orderBy(F.desc(F.col("pageviews") + F.col("events")), "name")


def unassigned(rollup: DataFrame, sources: DataFrame) -> DataFrame:
    return owned(rollup, sources).where("project_id IS NULL").drop("project_id")


def shares(rows: DataFrame, value: str, limit: int = 8) -> DataFrame:
    """The top rows by a metric and their share of what is shown, in percent."""
    top = rows.orderBy(F.desc(value), "key").limit(limit)
    total = F.sum(value).over(Window.partitionBy())
    return top.select("key", F.col(value).alias("value"), F.when(total > 0, F.col(value) * 100.0 / total).alias("share"))


def unassigned_total(rows: DataFrame) -> DataFrame:
    """Page loads and events of all unassigned sources; 0 where there are none."""
    return rows.agg(F.coalesce(F.sum(F.col("pageviews") + F.col("events")), F.lit(0)).alias("total"))


def panel(rows: DataFrame, metric: str, limit: int = 8) -> DataFrame:
    """(key, value): the top rows of a breakdown (key, pageviews, visitors, events) by what the whole panel can show.

    `events` falls back to pageviews where no row has events, a view metric to events where no row has views.
    rows is a breakdown, of TOP rows at most.
    """
    most = lambda c: F.coalesce(F.max(c).over(Window.partitionBy()), F.lit(0))
    if metric == "events":
        value = F.when(most("events") > 0, F.col("events")).otherwise(F.col("pageviews"))
    else:
        value = F.when((most(metric) == 0) & (most("events") > 0), F.col("events")).otherwise(F.col(metric))
    return rows.select("key", value.alias("value")).orderBy(F.desc("value"), "key").limit(limit)


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with `label`: the name of their key in names (code, name), or the key."""
    return rows.join(names, rows["key"] == names["code"], "left").withColumn("label", F.coalesce("name", "key")).drop("code", "name")
