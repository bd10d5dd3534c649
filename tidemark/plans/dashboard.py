"""The dashboard: one filtered scan for two windows and all panels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.predicates import Filter, visitor_flag, where
from tidemark.operators import details, metrics
from tidemark.sources import store

#: What the panels read.
COLUMNS = [
    "received_ms", "seq", "kind", "source", "sid", "pathname", "is_unique_user", "is_unique_page", "referrer_host", "referrer_group", "country", "language", "ua_browser", "ua_version", "ua_os", "ua_device",
    "utm_source", "utm_medium", "utm_campaign", "duration_ms", "event_name", "app_version",
]


def dashboard(df: DataFrame, start: int, end: int, bucket: int, sources: DataFrame, projects: DataFrame, keep: Filter | None = None) -> dict[str, DataFrame]:
    """Panels by name; each is lazy.

    The filtered rows of both windows are written once, with the columns that panels read, and all
    panels read that table: what is before it runs once, and a lost executor costs no more than its tasks.
    """
    flag = visitor_flag(keep)
    at = store.new_folder(df.sparkSession, "dashboard")
    both = where(metrics.between(df, start - (end - start), end), keep).select(*COLUMNS)
    both.write.parquet(at)
    both = df.sparkSession.read.schema(both.schema).parquet(at)
    now, before = metrics.between(both, start, end), metrics.between(both, start - (end - start), start)
    rollup = metrics.source_rollup(now, flag)
    return {
        "summary": metrics.summary(now, flag), "previous": metrics.summary(before, flag), "series": metrics.series(now, start, end, bucket, flag), "previous_series": metrics.previous_series(both, start, end, bucket, flag),
        "breakdowns": metrics.breakdowns(now, flag), "versions": metrics.version_breakdown(now, flag), "events": metrics.event_names(now),
        "sources": rollup.orderBy((rollup["pageviews"] + rollup["events"]).desc(), "source").limit(25), "projects": metrics.project_rollup(rollup, sources, projects),
        "unassigned": metrics.unassigned(rollup, sources), "traces": details.recent_traces(now),
    }
