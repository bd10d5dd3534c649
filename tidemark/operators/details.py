"""Exception groups, their details, named events, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.predicates import is_event
from tidemark.functions.text import filled, source_label, status
from tidemark.operators.metrics import load
from tidemark.schema import GROUPS, TIMELINE, TOP, TRACES, TREND, VARIANTS


def order() -> Column:
    """Later rows win ties by sequence number."""
    return F.struct("received_ms", "seq")


def newest(c: str) -> Column:
    return F.max_by(c, order())


def newest_known(c: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order()))


def earliest_known(c: str, when: Column | None = None) -> Column:
    known = F.col(c).isNotNull() if when is None else F.col(c).isNotNull() & when
    return F.min_by(F.col(c), F.when(known, order()))


def trend_place(start: int, end: int, buckets: int = TREND) -> Column:
    step = F.expr(f"((received_ms - {start}L) * {buckets}L) div {max(end - start, 1)}L")
    return F.least(F.greatest(step, F.lit(0)), F.lit(buckets - 1)).cast("int")


def trend_array(start: int, end: int, buckets: int = TREND) -> Column:
    at = trend_place(start, end, buckets)
    return F.array(*[F.count_if(at == i) for i in range(buckets)])


def trend(df: DataFrame, start: int, end: int, by: list[str], buckets: int = TREND) -> DataFrame:
    """(by..., place, n) for places that have rows."""
    return df.groupBy(*by, trend_place(start, end, buckets).alias("place")).agg(F.count(F.lit(1)).alias("n"))


def exceptions(df: DataFrame) -> DataFrame:
    return df.where((F.col("kind") == "exception") & F.col("exc_group").isNotNull())


def exception_groups(df: DataFrame, start: int, end: int, limit: int = GROUPS) -> DataFrame:
    """By group and source, last seen first. Type and message are those of the newest occurrence."""
    rows = exceptions(df).groupBy("exc_group", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"), newest("exc_type").alias("exc_type"), newest("exc_message").alias("exc_message"), trend_array(start, end).alias("trend")
    )
    return rows.orderBy(F.desc("last_ms"), "exc_group", "source").limit(limit)


def inbox(groups: DataFrame, sources: DataFrame, projects: DataFrame, triage: DataFrame) -> DataFrame:
    """Groups with project and triage state; only assigned sources have one. triage: as schema.TRIAGE, a state for each project, group and source."""
    known = groups.join(sources.withColumnRenamed("uri", "source"), "source", "left").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id", "left")
    state = triage.select("project_id", F.col("group_id").alias("exc_group"), "source", F.unix_millis("resolved_at").alias("resolved_ms"), F.unix_millis("muted_at").alias("muted_ms"))
    out = known.join(state, ["project_id", "exc_group", "source"], "left")
    return out.withColumn("status", status("last_ms", "resolved_ms", "muted_ms"))


def search(rows: DataFrame, text: str) -> DataFrame:
    hit = [F.lower(filled(c)).contains(text.lower()) for c in ("exc_type", "exc_message", "project")]
    return rows.where(hit[0] | hit[1] | hit[2])


def detail_summary(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: count, first and last time, and the newest values of some columns. No row if there is none."""
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"), *[newest(c).alias(c) for c in columns])
    return out.where("n > 0")


def exception_detail(df: DataFrame, group: str, sources: list[str]) -> DataFrame:
    return exceptions(df).where((F.col("exc_group") == group) & F.col("source").isin(*sources))


def app_versions(rows: DataFrame, limit: int = TOP) -> DataFrame:
    """Releases; qualified by their app if the rows come from several."""
    pairs = rows.groupBy(filled("source").alias("s"), filled("app_version").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    label = source_label("s")
    many = F.size(F.collect_set(F.nullif(label, F.lit(""))).over(Window.partitionBy())) > 1  # pairs are few: sources times releases of one group
    key = F.when(F.col("v") == "", "").when(many & (label != ""), F.concat(label, F.lit(" @ "), "v")).otherwise(F.col("v"))
    return pairs.select(key.alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def exception_variants(rows: DataFrame, limit: int = VARIANTS) -> DataFrame:
    """By message, stack and handling; absent values are values of their own."""
    out = rows.groupBy("exc_message", "exc_stack", "exc_handled").agg(
        F.count(F.lit(1)).alias("n"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"), newest("ua_browser").alias("browser"), newest("ua_os").alias("os"),
        newest("source").alias("source"), newest("app_version").alias("app_version"), newest_known("metadata_json").alias("metadata_json"), newest_known("sid").alias("sid"),
    )
    return out.orderBy(F.desc("n"), F.asc_nulls_first("exc_message"), F.asc_nulls_first("exc_stack"), F.asc_nulls_first("exc_handled")).limit(limit)


def named_events(df: DataFrame, name: str) -> DataFrame:
    return df.where(is_event() & (F.col("event_name") == name))


def event_variants(rows: DataFrame, limit: int = VARIANTS) -> DataFrame:
    """By metadata text."""
    out = rows.groupBy("metadata_json").agg(
        F.count(F.lit(1)).alias("n"), F.min("received_ms").alias("first_ms"), F.max("received_ms").alias("last_ms"), newest("ua_browser").alias("browser"), newest("ua_os").alias("os"),
        newest("source").alias("source"), newest("pathname").alias("pathname"), newest_known("sid").alias("sid"),
    )
    return out.orderBy(F.desc("n"), F.asc_nulls_first("metadata_json")).limit(limit)


def has_session() -> Column:
    return F.col("sid").isNotNull() & (F.col("sid") != "")


def traces(df: DataFrame) -> DataFrame:
    """A row for each session."""
    return df.where(has_session()).groupBy("sid").agg(
        F.min("received_ms").alias("started_ms"), F.max("received_ms").alias("last_ms"), F.min_by("source", order()).alias("source"), earliest_known("pathname", load()).alias("entry_path"),
        earliest_known("country").alias("country"), earliest_known("ua_browser").alias("browser"), earliest_known("ua_version").alias("version"), earliest_known("ua_device").alias("device"), earliest_known("app_version").alias("app_version"),
        F.count_if(load()).alias("pageviews"), F.count_if(is_event()).alias("events"), F.count_if(F.col("kind") == "exception").alias("exceptions"),
    )


def recent_traces(df: DataFrame, limit: int = TRACES) -> DataFrame:
    return traces(df).orderBy(F.desc("started_ms"), "sid").limit(limit)


def traces_of(rows: DataFrame, window: DataFrame, limit: int = TRACES) -> DataFrame:
    """Whole sessions of the newest occurrences: at most `limit` session ids meet all rows of the window."""
    ids = rows.where(has_session()).groupBy("sid").agg(F.max(order()).alias("o")).orderBy(F.desc("o"), "sid").limit(limit).select("sid")
    return recent_traces(window.join(F.broadcast(ids), "sid", "left_semi"), limit)


def session_rows(df: DataFrame, sid: str, limit: int = TIMELINE) -> DataFrame:
    return df.where(F.col("sid") == sid).orderBy("received_ms", "seq").limit(limit)


def session_timeline(df: DataFrame, sid: str, limit: int = TIMELINE) -> DataFrame:
    """Rows of a session in order; pixel rows count for the limit but are not shown."""
    return session_rows(df, sid, limit).where(F.col("kind").isin("page_load", "page_unload", "custom", "exception")).select("received_ms", "seq", "kind", "bid", "pathname", "event_name", "exc_type", "exc_message", "duration_ms", "metadata_json")


def session_context(df: DataFrame, sid: str, limit: int = TIMELINE) -> DataFrame:
    cols = ("source", "country", "language", "ua_browser", "ua_version", "ua_os", "ua_device", "referrer_host", "app_version")
    return session_rows(df, sid, limit).agg(F.min("received_ms").alias("started_ms"), F.max("received_ms").alias("ended_ms"), F.count(F.lit(1)).alias("n"), *[earliest_known(c).alias(c) for c in cols]).where("n > 0")


def time_on_page(df: DataFrame) -> DataFrame:
    """Page loads with the last known duration of their page view."""
    unload = df.where((F.col("kind") == "page_unload") & F.col("duration_ms").isNotNull() & has_session()).groupBy("sid", "bid").agg(newest("duration_ms").alias("on_page_ms"))
    return df.where(load() & has_session()).select("sid", "bid", "seq", "pathname").join(unload, ["sid", "bid"], "left")


def children(df: DataFrame) -> DataFrame:
    """Events and exceptions with the page view they belong to: the first load of the same session and page view."""
    views = df.where(load() & has_session()).groupBy("sid", "bid").agg(F.min_by("seq", order()).alias("view_seq"))
    rows = df.where(has_session() & F.col("kind").isin("custom", "exception")).select("sid", "bid", "seq", "kind")
    return rows.join(views, ["sid", "bid"], "left").withColumn("is_orphan", F.col("view_seq").isNull())


