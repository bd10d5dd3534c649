"""Registered queries, each over the whole events (or documents, pages, conversations) table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import ingest_catalog, store_catalog
from tidemark.functions import text
from tidemark.functions.predicates import DASHBOARD, EXCEPTIONS, Fields, Filter, is_event, visitor_flag, where
from tidemark.operators import details, metrics
from tidemark.plans.dashboard import dashboard
from tidemark.schema import DAY_MS
from tidemark.sources import adapter, scan

#: The window asked about holds the whole events table; its halves are compared, and ten days of it show pruning.
START = 1_704_067_200_000
END = START + 30 * DAY_MS
HALF = START + 15 * DAY_MS
PART = (START + 9 * DAY_MS, START + 19 * DAY_MS)
_IN = f"received_ms >= {START} AND received_ms < {END}"
_EV = "kind IN ('pixel', 'custom')"
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None, base: str = adapter.SQL) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = f"{base}{sql}"


def _facts(spark, sf_dir, start=START, end=END) -> DataFrame:
    return metrics.between(adapter.facts(spark, sf_dir), start, end)


def _n(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in pairs)


def _cnt(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def _summary_sql(rows: str, flag: str = "is_unique_user") -> str:
    d = "duration_ms"
    return (
        f"SELECT {_n(('pageviews', _cnt("kind = 'page_load'")), ('visitors', _cnt(f"kind = 'page_load' AND {flag}")), ('events', _cnt(_EV)))}, "
        f"CASE WHEN count({d}) >= 5 THEN {_cnt(f'{d} BETWEEN 100 AND 5000')} / CAST(count({d}) AS DOUBLE) END AS bounce_rate, CAST(round(median({d})) AS BIGINT) AS median_ms FROM f WHERE {rows}"
    )


_add("summary", lambda s, d: metrics.summary(adapter.facts(s, d)), _summary_sql("true"))
_add("summary_window", lambda s, d: metrics.summary(_facts(s, d, *PART)), _summary_sql(f"received_ms >= {PART[0]} AND received_ms < {PART[1]}"))
_add("summary_previous", lambda s, d: metrics.summary(_facts(s, d, START, HALF)), _summary_sql(f"received_ms >= {START} AND received_ms < {HALF}"))
_path = lambda: Fields(DASHBOARD).eq("path", "/P3")
_add("summary_path_flag", lambda s, d: metrics.summary(where(_facts(s, d), _path()), visitor_flag(_path())), _summary_sql(f"{_IN} AND lower(pathname) = '/p3'", "is_unique_page"))


def _series_sql(bucket: int, shift: int = 0, START: int = START) -> str:
    first, last = START - START % bucket, (END - 1) - (END - 1) % bucket
    cols = [("pageviews", _cnt("kind = 'page_load'")), ("visitors", _cnt("kind = 'page_load' AND is_unique_user")), ("events", _cnt(_EV)), ("exceptions", _cnt("kind = 'exception'"))]
    rows = f"SELECT (received_ms + {shift}) - (received_ms + {shift}) % {bucket} AS ts, {_n(*cols)} FROM f WHERE received_ms + {shift} >= {START} AND received_ms + {shift} < {END} GROUP BY 1"
    vals = ", ".join(f"coalesce(r.{n}, 0) AS {n}" for n, _ in cols)
    return f"SELECT CAST(g.ts - {shift} AS BIGINT) AS ts, {vals} FROM (SELECT unnest(range({first}, {last + 1}, {bucket})) AS ts) g LEFT JOIN ({rows}) r USING (ts)"


for _name, _bucket in (("hour", 3_600_000), ("day", DAY_MS), ("week", 7 * DAY_MS)):
    _add(f"timeseries_{_name}", lambda s, d, b=_bucket: metrics.series(_facts(s, d), START, END, b), _series_sql(_bucket))
_add("timeseries_previous", lambda s, d: metrics.previous_series(_facts(s, d), HALF, END, DAY_MS), _series_sql(DAY_MS, END - HALF, HALF))


def _break_sql(column: str, flag: str) -> str:
    return f"SELECT coalesce({column}, '') AS key, {_n(('pageviews', 'count(*)'), ('visitors', _cnt(flag)))} FROM f WHERE {_IN} AND kind = 'page_load' GROUP BY 1 ORDER BY pageviews DESC, key LIMIT 25"


for _name, _column in metrics.BREAKDOWNS.items():
    _add(f"breakdown_{_name}", lambda s, d, c=_column: metrics.breakdown(_facts(s, d), c), _break_sql(_column, "is_unique_page" if _column == "pathname" else "is_unique_user"))
_add(
    "breakdowns_fused",
    lambda s, d: metrics.breakdowns(_facts(s, d)),
    " UNION ALL ".join(f"(SELECT '{n}' AS dimension, * FROM ({_break_sql(c, 'is_unique_page' if n == 'pages' else 'is_unique_user')}))" for n, c in metrics.BREAKDOWNS.items()),
)
_add(
    "breakdown_versions",
    lambda s, d: metrics.version_breakdown(_facts(s, d)),
    f"SELECT coalesce(ua_browser, '') AS browser, coalesce(ua_version, '') AS version, {_n(('pageviews', 'count(*)'), ('visitors', _cnt('is_unique_user')))} FROM f WHERE {_IN} AND kind = 'page_load' GROUP BY 1, 2 ORDER BY pageviews DESC, 1, 2 LIMIT 25",
)


def _count_sql(column: str, rows: str) -> str:
    return f"SELECT coalesce({column}, '') AS key, {_n(('n', 'count(*)'))} FROM f WHERE {rows} GROUP BY 1 ORDER BY n DESC, key LIMIT 25"


_add("breakdown_event_names", lambda s, d: metrics.event_names(_facts(s, d)), _count_sql("event_name", f"{_IN} AND {_EV}"))
_ROLL = f"(SELECT source, {_n(('pageviews', _cnt("kind = 'page_load'")), ('visitors', _cnt('is_unique_user')), ('events', _cnt(_EV)))} FROM f WHERE {_IN} AND (kind = 'page_load' OR {_EV}) GROUP BY source)"
_rollup = lambda s, d: metrics.source_rollup(_facts(s, d))
_add("source_rollup", _rollup, f"SELECT * FROM {_ROLL}")
_add(
    "project_rollup",
    lambda s, d: metrics.project_rollup(_rollup(s, d), adapter.sources(s), adapter.projects(s)),
    f"SELECT p.id, p.name, {_n(*[(c, f'coalesce(sum(r.{c}), 0)') for c in ('pageviews', 'visitors', 'events')])} FROM projects p LEFT JOIN sources s ON s.project_id = p.id LEFT JOIN {_ROLL} r ON r.source = s.uri GROUP BY 1, 2",
)
_add("unassigned", lambda s, d: metrics.unassigned(_rollup(s, d), adapter.sources(s)), f"SELECT r.* FROM {_ROLL} r LEFT JOIN sources s ON r.source = s.uri WHERE s.project_id IS NULL")
_add(
    "unassigned_total",
    lambda s, d: metrics.unassigned_total(metrics.unassigned(_rollup(s, d), adapter.sources(s))),
    f"SELECT {_n(('total', 'coalesce(sum(r.pageviews + r.events), 0)'))} FROM {_ROLL} r LEFT JOIN sources s ON r.source = s.uri WHERE s.project_id IS NULL",
)
_add(
    "panel_without_events",
    lambda s, d: metrics.panel(metrics.breakdown(_facts(s, d), "country").withColumn("events", F.lit(0).cast("long")), "events"),
    f"SELECT key, pageviews AS value FROM ({_break_sql('country', 'is_unique_user')}) ORDER BY value DESC, key LIMIT 8",
)
_add(
    "panel_events_only",
    lambda s, d: metrics.panel(metrics.event_names(_facts(s, d)).select("key", F.lit(0).cast("long").alias("pageviews"), F.lit(0).cast("long").alias("visitors"), F.col("n").alias("events")), "visitors"),
    f"SELECT key, n AS value FROM ({_count_sql('event_name', f'{_IN} AND {_EV}')}) ORDER BY value DESC, key LIMIT 8",
)
_add(
    "share_percent",
    lambda s, d: metrics.shares(metrics.breakdown(_facts(s, d), "country"), "pageviews"),
    f"SELECT key, pageviews AS value, pageviews * 100.0 / sum(pageviews) OVER () AS share FROM (SELECT * FROM ({_break_sql('country', 'is_unique_user')}) ORDER BY pageviews DESC, key LIMIT 8)",
)


def _delta(s, d) -> DataFrame:
    now, before = metrics.summary(_facts(s, d, HALF, END)), metrics.summary(_facts(s, d, START, HALF))
    pair = now.select("pageviews", "events").crossJoin(before.select(F.col("pageviews").alias("p0"), F.col("events").alias("e0")))  # one row each
    return pair.select(text.delta_percent("pageviews", "p0").alias("pageviews_delta"), text.delta_percent("events", "e0").alias("events_delta"))


_win = lambda c: (f"count(*) FILTER (WHERE received_ms >= {HALF} AND received_ms < {END} AND {c})", f"count(*) FILTER (WHERE received_ms >= {START} AND received_ms < {HALF} AND {c})")
_dsql = lambda c: f"CASE WHEN {_win(c)[1]} > 0 THEN ({_win(c)[0]} - {_win(c)[1]}) / CAST({_win(c)[1]} AS DOUBLE) * 100 END"
_add("delta_percent", _delta, f"SELECT {_dsql("kind = 'page_load'")} AS pageviews_delta, {_dsql(_EV)} AS events_delta FROM f")

# exceptions
_EXC = f"{_IN} AND kind = 'exception' AND exc_group IS NOT NULL"
_place = f"least(greatest(((received_ms - {START}) * 20) // {END - START}, 0), 19)"
_trend20 = "array_to_string([" + ", ".join(f"count(*) FILTER (WHERE {_place} = {i})" for i in range(20)) + "], ',')"
_GROUPS = f"(SELECT exc_group, source, {_n(('n', 'count(*)'))}, min(received_ms) AS first_ms, max(received_ms) AS last_ms, arg_max(exc_type, seq) AS exc_type, arg_max(exc_message, seq) AS exc_message, {_trend20} AS trend FROM f WHERE {_EXC} GROUP BY 1, 2 ORDER BY last_ms DESC, 1, 2 LIMIT 500)"


def _groups(s, d) -> DataFrame:
    return details.exception_groups(_facts(s, d), START, END).withColumn("trend", F.array_join(F.transform("trend", lambda x: x.cast("string")), ","))


def _inbox(s, d) -> DataFrame:
    return details.inbox(_groups(s, d), adapter.sources(s), adapter.projects(s), adapter.triage(s))


_INBOX = f"(SELECT g.*, s.project_id, p.name AS project, t.resolved_ms, t.muted_ms, CASE WHEN t.muted_ms IS NOT NULL THEN 'ignored' WHEN g.last_ms <= t.resolved_ms THEN 'resolved' ELSE 'unresolved' END AS status FROM {_GROUPS} g LEFT JOIN sources s ON g.source = s.uri LEFT JOIN projects p ON p.id = s.project_id LEFT JOIN triage t ON t.project_id = s.project_id AND t.group_id = g.exc_group AND t.source = g.source)"
_add("exception_groups", _groups, f"SELECT * FROM {_GROUPS}")
_add("triage_status", _inbox, f"SELECT * FROM {_INBOX}")
_add("inbox_status_counts", lambda s, d: _inbox(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"SELECT status, {_n(('n', 'count(*)'))} FROM {_INBOX} GROUP BY 1")
_add("inbox_search", lambda s, d: details.search(_inbox(s, d), "RANGE").select("exc_group", "source", "n"), f"SELECT exc_group, source, n FROM {_INBOX} WHERE lower(coalesce(exc_type, '')) LIKE '%range%' OR lower(coalesce(exc_message, '')) LIKE '%range%' OR lower(coalesce(project, '')) LIKE '%range%'")
_add("exception_trend", lambda s, d: details.trend(details.exceptions(_facts(s, d)), START, END, ["exc_group"]), f"SELECT exc_group, CAST({_place} AS INTEGER) AS place, {_n(('n', 'count(*)'))} FROM f WHERE {_EXC} GROUP BY 1, 2")

_ONE = "substr(sha256(unhex(sha256('typeerror' || chr(10) || 'boom at'))), 1, 16)"
_two = ["https://site0.example.com", "https://site1.example.com", "app://svc2"]
_ROWS = f"{_EXC} AND exc_group = {_ONE} AND source IN ({', '.join(repr(x) for x in _two)})"


def _one(s, d) -> DataFrame:
    group = s.range(1).select(text.fingerprint(F.lit("TypeError"), F.lit("boom at 3"), F.lit(None).cast("string")).alias("g")).first().g
    return details.exception_detail(_facts(s, d), group, _two)


def _last(*cols: str) -> str:
    return ", ".join(f"first({c} ORDER BY seq DESC) AS {a}" for c, a in (x.split(":") for x in cols))


_known = lambda c: f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
_span = f"{_n(('n', 'count(*)'))}, min(received_ms) AS first_ms, max(received_ms) AS last_ms"
_add("exception_detail_summary", lambda s, d: details.detail_summary(_one(s, d), "exc_type", "exc_message"), f"SELECT * FROM (SELECT {_span}, {_last('exc_type:exc_type', 'exc_message:exc_message')} FROM f WHERE {_ROWS}) WHERE n > 0")
_add(
    "exception_variants",
    lambda s, d: details.exception_variants(_one(s, d)),
    f"SELECT exc_message, exc_stack, exc_handled, {_span}, {_last('ua_browser:browser', 'ua_os:os', 'source:source', 'app_version:app_version')}, {_known('metadata_json')}, {_known('sid')} FROM f WHERE {_ROWS} GROUP BY 1, 2, 3 ORDER BY n DESC, 1 NULLS FIRST, 2 NULLS FIRST, 3 NULLS FIRST LIMIT 50",
)
_add(
    "exception_app_versions",
    lambda s, d: details.app_versions(_one(s, d)),
    f"SELECT CASE WHEN coalesce(app_version, '') = '' THEN '' ELSE regexp_replace(source, '^(https|http|app|pixel)://', '') || ' @ ' || app_version END AS key, {_n(('n', 'count(*)'))} FROM f WHERE {_ROWS} GROUP BY 1 ORDER BY n DESC, key LIMIT 25",
)
for _name, _column in (("browser", "ua_browser"), ("os", "ua_os"), ("device", "ua_device"), ("source", "source")):
    _add(f"count_by_{_name}", lambda s, d, c=_column: metrics.count_by(_one(s, d), c), _count_sql(_column, _ROWS))

# named events
_EVT = f"{_IN} AND {_EV} AND event_name = 'signup'"
_named = lambda s, d: details.named_events(_facts(s, d), "signup")
for _name, _column in (("country", "country"), ("language", "language"), ("page", "pathname")):
    _add(f"count_by_{_name}", lambda s, d, c=_column: metrics.count_by(_named(s, d), c), _count_sql(_column, _EVT))
_add(
    "country_names",
    lambda s, d: metrics.named(metrics.count_by(_named(s, d), "country"), adapter.country_names(s)),
    f"SELECT key, n, CASE key WHEN 'US' THEN 'United States' WHEN 'DE' THEN 'Germany' WHEN 'FR' THEN 'France' ELSE key END AS label FROM ({_count_sql('country', _EVT)})",
)
_add("event_detail_summary", lambda s, d: details.detail_summary(_named(s, d), "source"), f"SELECT * FROM (SELECT {_span}, {_last('source:source')} FROM f WHERE {_EVT}) WHERE n > 0")
_add("event_trend", lambda s, d: details.trend(_named(s, d), START, END, []), f"SELECT CAST({_place} AS INTEGER) AS place, {_n(('n', 'count(*)'))} FROM f WHERE {_EVT} GROUP BY 1")
_add(
    "event_variants",
    lambda s, d: details.event_variants(_named(s, d)),
    f"SELECT metadata_json, {_span}, {_last('ua_browser:browser', 'ua_os:os', 'source:source', 'pathname:pathname')}, {_known('sid')} FROM f WHERE {_EVT} GROUP BY 1 ORDER BY n DESC, 1 NULLS FIRST LIMIT 50",
)
_add(
    "event_sources_labelled",
    lambda s, d: metrics.count_by(_named(s, d), "source").select(text.source_label("key").alias("label"), "n"),
    f"SELECT regexp_replace(key, '^(https|http|app|pixel)://', '') AS label, n FROM ({_count_sql('source', _EVT)})",
)

# sessions
_SES = "sid IS NOT NULL AND sid <> ''"
_first = lambda c, a, w="": f"arg_min({c}, seq) FILTER (WHERE {c} IS NOT NULL{w}) AS {a}"
_TRACE = f"""SELECT sid, min(received_ms) AS started_ms, max(received_ms) AS last_ms, arg_min(source, seq) AS source, {_first('pathname', 'entry_path', " AND kind = 'page_load'")}, {_first('country', 'country')}, {_first('ua_browser', 'browser')},
 {_first('ua_version', 'version')}, {_first('ua_device', 'device')}, {_first('app_version', 'app_version')}, {_n(('pageviews', _cnt("kind = 'page_load'")), ('events', _cnt(_EV)), ('exceptions', _cnt("kind = 'exception'")))} FROM f WHERE {_IN} AND {_SES}"""
_add("sessions", lambda s, d: details.traces(_facts(s, d)), f"{_TRACE} GROUP BY sid")
_add("recent_traces", lambda s, d: details.recent_traces(_facts(s, d)), f"{_TRACE} GROUP BY sid ORDER BY started_ms DESC, sid LIMIT 10")
_add(
    "traces_of_occurrences",
    lambda s, d: details.traces_of(_one(s, d), _facts(s, d)),
    f"{_TRACE} AND sid IN (SELECT sid FROM f WHERE {_ROWS} AND {_SES} GROUP BY sid ORDER BY max(seq) DESC LIMIT 10) GROUP BY sid ORDER BY started_ms DESC, sid LIMIT 10",
)


def _sid(s, d) -> str:
    return _facts(s, d).where(details.has_session()).groupBy("sid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sid").first().sid


_SID = f"(SELECT sid FROM f WHERE {_IN} AND {_SES} GROUP BY sid ORDER BY count(*) DESC, sid LIMIT 1)"
_add(
    "session_trace",
    lambda s, d: details.session_timeline(_facts(s, d), _sid(s, d)),
    f"SELECT received_ms, seq, kind, bid, pathname, event_name, exc_type, exc_message, duration_ms, metadata_json FROM (SELECT * FROM f WHERE {_IN} AND sid = {_SID} ORDER BY received_ms, seq LIMIT 1000) WHERE kind <> 'pixel'",
)
_add(
    "session_context",
    lambda s, d: details.session_context(_facts(s, d), _sid(s, d)),
    f"SELECT min(received_ms) AS started_ms, max(received_ms) AS ended_ms, {_n(('n', 'count(*)'))}, {', '.join(_first(c, c) for c in ('source', 'country', 'language', 'ua_browser', 'ua_version', 'ua_os', 'ua_device', 'referrer_host', 'app_version'))} FROM (SELECT * FROM f WHERE {_IN} AND sid = {_SID} ORDER BY received_ms, seq LIMIT 1000)",
)
_add(
    "trace_time_on_page",
    lambda s, d: details.time_on_page(_facts(s, d)),
    f"SELECT l.sid, l.bid, l.seq, l.pathname, u.on_page_ms FROM (SELECT * FROM f WHERE {_IN} AND {_SES} AND kind = 'page_load') l LEFT JOIN (SELECT sid, bid, arg_max(duration_ms, seq) AS on_page_ms FROM f WHERE {_IN} AND {_SES} AND kind = 'page_unload' AND duration_ms IS NOT NULL GROUP BY 1, 2) u ON l.sid = u.sid AND l.bid = u.bid",
)
_add(
    "trace_children",
    lambda s, d: details.children(_facts(s, d)),
    f"SELECT c.sid, c.bid, c.seq, c.kind, v.view_seq, v.view_seq IS NULL AS is_orphan FROM (SELECT * FROM f WHERE {_IN} AND {_SES} AND kind IN ('custom', 'exception')) c LEFT JOIN (SELECT sid, bid, arg_min(seq, seq) AS view_seq FROM f WHERE {_IN} AND {_SES} AND kind = 'page_load' GROUP BY 1, 2) v ON c.sid = v.sid AND c.bid = v.bid",
)

# filters
_d = Fields(DASHBOARD, {"alpha": ["https://site0.example.com", "https://site1.example.com", "pixel://px0"]}, {"p0": ["https://site0.example.com"]})
_e = Fields(EXCEPTIONS)
_EMPTY = "(country IS NULL OR country = '')"
_FILTERS: dict[str, tuple[Callable[[], Filter], str]] = {
    "eq": (lambda: _d.eq("browser", "chrome"), "lower(ua_browser) = 'chrome'"),
    "ne_nullable": (lambda: _d.ne("browser", "Safari"), "NOT (lower(ua_browser) = 'safari') OR ua_browser IS NULL"),
    "not_eq": (lambda: ~_d.eq("browser", "Safari"), "NOT (lower(ua_browser) = 'safari')"),
    "empty_sentinel": (lambda: _d.eq("country", ""), f"{_EMPTY} AND NOT {_EV}"),
    "event_empty": (lambda: _d.eq("event", ""), f"(event_name IS NULL OR event_name = '') AND {_EV}"),
    "exception_empty": (lambda: _e.eq("app_version", ""), "app_version IS NULL OR app_version = ''"),
    "ne_empty": (lambda: _d.ne("referrer", ""), "referrer_host IS NOT NULL AND referrer_host <> ''"),
    "null": (lambda: _d.eq("referrer", None), "referrer_host IS NULL"),
    "not_null": (lambda: _d.ne("referrer", None), "referrer_host IS NOT NULL"),
    "in": (lambda: _d.is_in("country", ["us", "De"]), "lower(country) IN ('us', 'de')"),
    "in_cs": (lambda: _d.is_in("country", ["us", "DE"], case=True), "country IN ('us', 'DE')"),
    "contains": (lambda: _d.contains("referrer", "GOO"), "contains(lower(referrer_host), 'goo')"),
    "startswith": (lambda: _d.starts("referrer", "Blog."), "starts_with(lower(referrer_host), 'blog.')"),
    "endswith": (lambda: _d.ends("path", "1"), "ends_with(lower(pathname), '1')"),
    "like": (lambda: _d.like("referrer", "*.ORG"), "lower(referrer_host) LIKE '%.org'"),
    "like_cs": (lambda: _d.like("path", "/p?", case=True), "pathname LIKE '/p_'"),
    "matches": (lambda: _d.matches("path", "p1[01]?$"), "regexp_matches(pathname, 'p1[01]?$')"),
    "matches_named": (lambda: _d.matches("path", r"(?P<page>[[:alpha:]])(?P<number>1\d)$"), r"regexp_matches(pathname, '(?P<page>[[:alpha:]])(?P<number>1\d)$')"),
    "matches_letters": (lambda: _d.matches("browser", r"^\p{Lu}\p{Ll}+x$"), r"regexp_matches(ua_browser, '^\p{Lu}\p{Ll}+x$')"),
    "and_or": (lambda: _d.eq("browser", "Chrome") & (_d.eq("os", "Linux") | _d.eq("country", "US")), "lower(ua_browser) = 'chrome' AND (lower(ua_os) = 'linux' OR lower(country) = 'us')"),
    "project": (lambda: _d.eq("project", "ALPHA"), "source IN ('https://site0.example.com', 'https://site1.example.com', 'pixel://px0')"),
    "project_id": (lambda: _d.eq("project", "p0"), "source IN ('https://site0.example.com')"),
    "project_unknown": (lambda: _d.ne("project", "nobody"), "true"),
    "source_forms": (lambda: _d.eq("source", "Svc2"), "lower(source) IN ('https://svc2', 'app://svc2', 'pixel://svc2', 'svc2')"),
    "source_in": (lambda: _d.is_in("source", ["site0.example.com", "pixel://px1"]), "lower(source) IN ('https://site0.example.com', 'pixel://px1')"),
    "bool": (lambda: _e.eq("handled", False), "coalesce(exc_handled, false) = false"),
    "bool_text": (lambda: _e.eq("handled", "TRUE"), "coalesce(exc_handled, false) = true"),
    "truthy": (lambda: _d.truthy("event"), "event_name IS NOT NULL AND event_name <> ''"),
    "truthy_bool": (lambda: _e.truthy("handled"), "coalesce(exc_handled, false)"),
}
for _name, (_f, _where) in _FILTERS.items():
    _add(f"filter_{_name}", lambda s, d, f=_f: _facts(s, d).where(f().column).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs")), f"SELECT kind, {_n(('n', 'count(*)'), ('seqs', 'sum(seq)'))} FROM f WHERE {_IN} AND ({_where}) GROUP BY kind")

# scans
_add(
    "dedup_union",
    lambda s, d: metrics.summary(scan.combined(adapter.facts(s, d).where(F.col("received_ms") < HALF), adapter.facts(s, d).where(F.col("received_ms") >= HALF - DAY_MS), START, END, (HALF - DAY_MS, HALF))),
    _summary_sql(_IN),
)
_add(
    "new_sources",
    lambda s, d: scan.new_sources(adapter.facts(s, d), adapter.sources(s).where("uri LIKE 'https%'"), 10_000),
    "SELECT DISTINCT source AS uri FROM f WHERE source NOT IN (SELECT uri FROM sources WHERE uri LIKE 'https%')",
)
_add("events_by_kind", lambda s, d: adapter.facts(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_event()).alias("events")), f"SELECT kind, {_n(('n', 'count(*)'), ('events', _cnt(_EV)))} FROM f GROUP BY kind")
_add("exception_fingerprints", lambda s, d: adapter.facts(s, d).where("kind = 'exception'").select("seq", "exc_group"), "SELECT seq, exc_group FROM f WHERE kind = 'exception'")
_add("source_label", lambda s, d: adapter.facts(s, d).select("source").distinct().select("source", text.source_label("source").alias("label"), text.source_kind("source").alias("kind"), text.pixel_id("source").alias("pixel")), "SELECT DISTINCT source, regexp_replace(source, '^(https|http|app|pixel)://', '') AS label, CASE WHEN source LIKE 'app://%' THEN 'application' ELSE 'website' END AS kind, CASE WHEN source LIKE 'pixel://%' THEN substr(source, 9) END AS pixel FROM f")
_add("referrer_group", lambda s, d: adapter.facts(s, d).groupBy("referrer_host", "referrer_group").agg(F.count(F.lit(1)).alias("n")), f"SELECT referrer_host, referrer_group, {_n(('n', 'count(*)'))} FROM f GROUP BY 1, 2")

# text functions over the other tables; whole tables, no adapter
_docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")
_pages = lambda s, d: s.read.parquet(f"{d}/pages.parquet")
_talk = lambda s, d: s.read.parquet(f"{d}/conversations.parquet")
_add("summary_line", lambda s, d: _talk(s, d).select("conv_id", "turn", text.summary_line("text").alias("line")), "SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda v: trim(v, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda v: v <> '')[1], '') AS line FROM conversations", "")
_add("normalize_path", lambda s, d: _pages(s, d).select("page_id", text.normalize_path(F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)).alias("path")), "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)", "")
_add("slugify", lambda s, d: _docs(s, d).select("doc_id", text.slugify("source").alias("slug"), text.slugify("text").alias("both")), "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'project') AS slug, coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'project') AS both FROM documents", "")
_add(
    "primary_language",
    lambda s, d: _docs(s, d).select("doc_id", text.primary_language(F.concat(F.substring_index("text", " ", 1), F.when(F.col("doc_id") % 2 == 0, "-XX;q=1, en").otherwise(" ,fr"))).alias("language")),
    """SELECT doc_id, CASE WHEN regexp_full_match(x, '[a-z]+') THEN x END AS language FROM (SELECT doc_id, lower(split_part(trim(split_part(split_part(h, ',', 1), ';', 1)), '-', 1)) AS x
 FROM (SELECT doc_id, split_part(text, ' ', 1) || CASE WHEN doc_id % 2 = 0 THEN '-XX;q=1, en' ELSE ' ,fr' END AS h FROM documents))""",
    "",
)
_add("utm_extract", lambda s, d: _pages(s, d).select("page_id", text.utm(F.concat("url", F.when(F.locate("?", F.col("url")) > 0, "&").otherwise("?"), F.lit("utm_source=a&utm_source=+b%20"), "page_id"), "utm_source").alias("utm_source")), "SELECT page_id, 'b ' || page_id AS utm_source FROM pages WHERE url NOT LIKE '%#%' UNION ALL SELECT page_id, NULL FROM pages WHERE url LIKE '%#%'", "")
_add("strip_urls", lambda s, d: _pages(s, d).select("page_id", text.strip_urls(F.concat(F.lit("at ("), "url", F.lit(") end"))).alias("t")), "SELECT page_id, regexp_replace('at (' || url || ') end', '[A-Za-z]+://[^ \\t\\n\\r)\\]}>\"''`,;]*', '', 'g') AS t FROM pages", "")


#: Words like ids of changing lengths and glued to other letters, for both engines.
_IDS = {
    "h": "substr(md5(url), 1, 6 + cast(page_id % 12 as int))", "a": "'0x' || substr(md5(url), 7, cast(page_id % 4 as int))", "g": "CASE page_id % 3 WHEN 0 THEN 'g' WHEN 1 THEN '_' ELSE '' END || substr(md5(url), 3, 14)",
    "u": "CASE WHEN page_id % 5 = 0 THEN upper(md5(url)) ELSE md5(url) END", "p": "CASE WHEN page_id % 2 = 0 THEN '(' ELSE '-' END",
}
_UUID = "p || concat_ws('-', substr(u, 1, 8), substr(u, 9, 4), substr(u, 13, 4), substr(u, 17, 4), substr(u, 21, 12))"
_ids = [f"{sql} AS {n}" for n, sql in _IDS.items()]
_add(
    "mask_ids",
    lambda s, d: _pages(s, d).selectExpr("page_id", *_ids).selectExpr("page_id", f"concat_ws(' ', 'at', h, a, g, {_UUID}) AS t").select("page_id", text.mask_ids("t").alias("t")),
    f"""SELECT page_id, concat_ws(' ', 'at', CASE WHEN length(h) >= 10 AND regexp_matches(h, '[0-9]') THEN '<hash>' ELSE h END, CASE WHEN length(a) > 2 THEN '<addr>' ELSE a END,
 CASE WHEN page_id % 3 = 2 AND regexp_matches(g, '[0-9]') THEN '<hash>' ELSE g END, CASE WHEN p = '(' THEN '(<uuid>' ELSE {_UUID} END) AS t FROM (SELECT page_id, {', '.join(_ids)} FROM pages)""",
    "",
)
_add("normal_frame", lambda s, d: _pages(s, d).select("page_id", text.normal_frame(F.concat(F.lit("  At Handler ("), F.lit("/srv/app/lib/Util.js:"), "page_id", F.lit(":2)  x"), "page_id", F.lit("?q=1"))).alias("t")), "SELECT page_id, 'at handler (util.js::) x' AS t FROM pages", "")
_add("version_label", lambda s, d: adapter.facts(s, d).select("seq", text.version_label(text.source_label("source"), "app_version").alias("label")), "SELECT seq, regexp_replace(source, '^(https|http|app|pixel)://', '') || CASE WHEN app_version IS NULL THEN '' ELSE ' @ ' || app_version END AS label FROM f")
_add(
    "metadata_split",
    lambda s, d: _pages(s, d).select("page_id", F.to_json(F.create_map(F.substring(F.concat("url", "url"), F.lit(1), (F.col("page_id") % 40 + 1).cast("int")), F.substring(F.concat("url", "url"), F.lit(1), (F.col("page_id") % 61).cast("int")), F.lit("u"), F.col("url"))).alias("j"))
    .select("page_id", F.size(text.metadata_part("j", True)).cast("long").alias("tags"), F.size(text.metadata_part("j", False)).cast("long").alias("context")),
    f"""SELECT page_id, {_n(('tags', 'a::INT + b::INT'), ('context', '2 - a::INT - b::INT'))} FROM
 (SELECT page_id, least(2 * length(url), page_id % 40 + 1) <= 24 AND least(2 * length(url), page_id % 61) <= 32 AS a, length(url) <= 32 AS b FROM pages)""",
    "",
)


def _dashboard(s, d) -> DataFrame:
    """Every panel as rows (panel, key, a, b, c)."""
    p = dashboard(adapter.facts(s, d), HALF, END, DAY_MS, adapter.sources(s), adapter.projects(s))
    row = lambda name, key, a, b, c: p[name].select(F.lit(name).alias("panel"), F.expr(key).cast("string").alias("key"), *[F.expr(x).cast("long").alias(n) for n, x in zip("abc", (a, b, c), strict=True)])
    parts = [row(n, "''", "pageviews", "visitors", "events") for n in ("summary", "previous")] + [row(n, "ts", "pageviews", "visitors", "events") for n in ("series", "previous_series")]
    parts += [row("breakdowns", "dimension || '=' || key", "pageviews", "visitors", "0"), row("versions", "browser || '/' || version", "pageviews", "visitors", "0"), row("events", "key", "0", "0", "n")]
    parts += [row(n, k, "pageviews", "visitors", "events") for n, k in (("sources", "source"), ("projects", "id"), ("unassigned", "source"))] + [row("traces", "sid", "started_ms", "pageviews", "events")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


_NOW = f"received_ms >= {HALF} AND received_ms < {END}"
_half = lambda sql: sql.replace(_IN, _NOW)
_rolled = _half(_ROLL)
_panel = lambda name, key, a, b, c, rows: f"SELECT '{name}' AS panel, CAST({key} AS VARCHAR) AS key, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, CAST({c} AS BIGINT) AS c FROM ({rows})"
_three = ("pageviews", "visitors", "events")
_add(
    "dashboard",
    _dashboard,
    " UNION ALL ".join([
        _panel("summary", "''", *_three, _summary_sql(_NOW)), _panel("previous", "''", *_three, _summary_sql(f"received_ms >= {START} AND received_ms < {HALF}")),
        _panel("series", "ts", *_three, _series_sql(DAY_MS, 0, HALF)), _panel("previous_series", "ts", *_three, _series_sql(DAY_MS, END - HALF, HALF)),
        *[_panel("breakdowns", f"'{n}=' || key", "pageviews", "visitors", "0", _half(_break_sql(c, "is_unique_page" if n == "pages" else "is_unique_user"))) for n, c in metrics.BREAKDOWNS.items()],
        _panel("versions", "browser || '/' || version", "pageviews", "visitors", "0", _half(f"SELECT coalesce(ua_browser, '') AS browser, coalesce(ua_version, '') AS version, {_n(('pageviews', 'count(*)'), ('visitors', _cnt('is_unique_user')))} FROM f WHERE {_IN} AND kind = 'page_load' GROUP BY 1, 2 ORDER BY pageviews DESC, 1, 2 LIMIT 25")),
        _panel("events", "key", "0", "0", "n", _half(_count_sql("event_name", f"{_IN} AND {_EV}"))), _panel("sources", "source", *_three, f"SELECT * FROM {_rolled} ORDER BY pageviews + events DESC, source LIMIT 25"),
        _panel("projects", "id", *_three, f"SELECT p.id, {', '.join(f'coalesce(sum(r.{c}), 0) AS {c}' for c in _three)} FROM projects p LEFT JOIN sources s ON s.project_id = p.id LEFT JOIN {_rolled} r ON r.source = s.uri GROUP BY 1"),
        _panel("unassigned", "source", *_three, f"SELECT r.* FROM {_rolled} r LEFT JOIN sources s ON r.source = s.uri WHERE s.project_id IS NULL"),
        _panel("traces", "sid", "started_ms", "pageviews", "events", _half(f"{_TRACE} GROUP BY sid ORDER BY started_ms DESC, sid LIMIT 10")),
    ]),
)
_QUERIES.update(ingest_catalog.queries() | store_catalog.queries())
_SQL.update(ingest_catalog.oracle_sql() | store_catalog.oracle_sql())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
