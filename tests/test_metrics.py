from rows import custom, exc, frame, load

from tidemark.functions.predicates import DASHBOARD, Fields, visitor_flag
from tidemark.operators import details, metrics
from tidemark.plans.dashboard import dashboard
from tidemark.schema import DAY_MS
from tidemark.sources import adapter, scan


def test_summary_counts_loads_and_visitors(spark):
    df = frame(spark, load(1000, True), load(2000), load(3000, True), load(4000, True, "https://b.com"))
    row = metrics.summary(metrics.between(df, 0, 10_000).where(Fields(DASHBOARD).eq("source", "A.com").column)).first()
    assert (row.pageviews, row.visitors, row.events, row.bounce_rate, row.median_ms) == (3, 2, 0, None, None)
    top = metrics.breakdown(df, "pathname").first()
    assert (top.key, top.pageviews, top.visitors) == ("/home", 4, 3)
    assert metrics.version_breakdown(df).first().version == "120.0"


def test_bounce_rate_needs_five_samples_and_counts_short_ones(spark):
    unload = [{"kind": "page_unload", "duration_ms": d} for d in (50, 100, 5000, 5001, 10)]
    row = metrics.summary(frame(spark, *unload)).first()
    assert row.bounce_rate == 2 / 5 and row.median_ms == 100
    assert metrics.summary(frame(spark, *unload[:4])).first().bounce_rate is None
    even = [{"kind": "page_unload", "duration_ms": d} for d in (1, 2, 3, 4)]
    assert metrics.summary(frame(spark, *even)).first().median_ms == 3  # 2.5, half away from zero


def test_empty_table(spark):
    row = metrics.summary(frame(spark, load(1)).where("false")).first()
    assert (row.pageviews, row.visitors, row.events) == (0, 0, 0)


def test_series_fills_gaps_and_aligns_the_window_before(spark):
    df = frame(spark, load(1000, True), load(2000), exc(3 * DAY_MS - 1), load(-DAY_MS + 3 * DAY_MS))
    now = metrics.series(metrics.between(df, 0, 3 * DAY_MS), 0, 3 * DAY_MS, DAY_MS).collect()
    assert [r.pageviews for r in now] == [2, 0, 1] and now[2].exceptions == 1
    before = metrics.previous_series(df, 3 * DAY_MS, 6 * DAY_MS, DAY_MS).collect()
    assert [r.ts for r in before] == [0, DAY_MS, 2 * DAY_MS] and [r.pageviews for r in before] == [2, 0, 1]


def test_series_with_too_many_points_keeps_populated_ones(spark):
    out = metrics.series(frame(spark, load(5), load(9_999_999)), 0, 10_000_000, 1000).collect()
    assert [r.ts for r in out] == [0, 9_999_000]


def test_window_is_half_open(spark):
    df = frame(spark, load(4000), load(10_000), load(12_000), load(20_000))
    assert metrics.between(df, 10_000, 20_000).count() == 2 and metrics.between(df, 0, 10_000).count() == 1


def test_visitors_of_pages_if_the_filter_names_pages(spark):
    f = Fields(DASHBOARD)
    assert visitor_flag(f.eq("PATH", "/x") & f.eq("os", "Linux")) == "is_unique_page"
    assert visitor_flag(f.eq("os", "Linux")) == visitor_flag(None) == "is_unique_user"


def test_rollup_counts_flags_of_events_too(spark):
    df = frame(spark, load(1, True), custom(2, "x", is_unique_user=True), {"received_ms": 3, "kind": "pixel", "source": "pixel://px"})
    got = {r.source: (r.pageviews, r.visitors, r.events) for r in metrics.source_rollup(df).collect()}
    assert got == {"https://a.com": (1, 2, 1), "pixel://px": (0, 0, 1)}
    sources = spark.createDataFrame([("https://a.com", "p"), ("pixel://px", None)], "uri string, project_id string")
    projects = spark.createDataFrame([("p", "P"), ("q", "Q")], "id string, name string")
    assert [(r.id, r.visitors) for r in metrics.project_rollup(metrics.source_rollup(df), sources, projects).collect()] == [("p", 2), ("q", 0)]
    assert [r.source for r in metrics.unassigned(metrics.source_rollup(df), sources).collect()] == ["pixel://px"]


def test_fused_breakdowns_equal_single_ones(spark):
    df = adapter.facts(spark, "/root/testdata/sf0.001")
    fused = metrics.breakdowns(df).collect()
    for name, column in metrics.BREAKDOWNS.items():
        assert sorted((r.key, r.pageviews, r.visitors) for r in fused if r.dimension == name) == sorted(map(tuple, metrics.breakdown(df, column).collect()))


def test_duplicates_of_a_crash_count_once(spark):
    rows = frame(spark, load(1000, True), load(2000))
    row = metrics.summary(scan.combined(rows, rows, 0, 10_000)).first()
    assert (row.pageviews, row.visitors) == (2, 1)
    old = rows.drop("app_version", "sid")
    assert scan.combined(old, rows.limit(0), 0, 10_000).count() == 2


def test_split_into_hot_and_cold_does_not_matter(spark):
    df = adapter.facts(spark, "/root/testdata/sf0.001")
    end = df.agg({"received_ms": "max"}).first()[0] + 1
    whole = metrics.summary(df).first()
    for share in (3, 7):
        assert metrics.summary(scan.combined(df.where(f"seq % {share} = 0"), df.where(f"seq % {share} <> 0"), 0, end)).first() == whole
    assert sum(r.pageviews for r in metrics.series(df, end - 40 * DAY_MS, end, DAY_MS).collect()) == whole.pageviews


def test_groups_trend_cap_and_lookup(spark):
    df = frame(spark, *[exc(i, f"g{i:03}") for i in range(505)], exc(600, "g504", "https://b.com"))
    groups = details.exception_groups(df, 0, 1000).collect()
    assert len(groups) == 500 and "g000" not in {g.exc_group for g in groups}
    assert all(sum(g.trend) == g.n for g in groups)
    assert {(g.exc_group, g.source) for g in groups} >= {("g504", "https://a.com"), ("g504", "https://b.com")}
    assert details.exception_detail(df, "g000", ["https://a.com"]).count() == 1
    assert details.detail_summary(details.exception_detail(df, "none", ["https://a.com"])).count() == 0


def test_variants_take_the_newest_known_context(spark):
    df = frame(spark, exc(1, sid="s1", ua_browser="Chrome", metadata_json="{}"), exc(2, sid=None, ua_browser="Firefox"), exc(3, exc_message=None))
    first, second = details.exception_variants(df).collect()
    assert (first.n, first.browser, first.sid, first.metadata_json) == (2, "Firefox", "s1", "{}") and second.exc_message is None


def test_releases_are_qualified_if_several_apps(spark):
    df = frame(spark, exc(1, app_version="1.0"), exc(2, app_version="1.0", source="app://b"), exc(3, app_version="1.0"), exc(4))
    assert [(r.key, r.n) for r in details.app_versions(df).collect()] == [("a.com @ 1.0", 2), ("", 1), ("b @ 1.0", 1)]
    assert [(r.key, r.n) for r in details.app_versions(df.where("source = 'https://a.com'")).collect()] == [("1.0", 2), ("", 1)]


def test_event_detail(spark):
    df = frame(spark, custom(2000, "signup", "s1", metadata_json='{"a":"1"}'), custom(3000, "signup", "s2", metadata_json='{"a":"1"}', ua_browser="Firefox"), custom(4000, "signup"), custom(5, "Signup"))
    rows = details.named_events(df, "signup")
    assert details.detail_summary(rows).first().n == 3
    first, second = details.event_variants(rows).collect()
    assert (first.n, first.browser, first.sid, second.metadata_json) == (2, "Firefox", "s2", None)
    assert [r.sid for r in details.traces_of(rows, df).collect()] == ["s2", "s1"]


def test_session_trace_order_limit_and_context(spark):
    df = frame(spark, exc(3000, sid="s", seq=2), load(1000, sid="s", country="DE"), custom(2000, "x", "s", seq=1), {"received_ms": 500, "kind": "pixel", "sid": "s"})
    assert [r.kind for r in details.session_timeline(df, "s").collect()] == ["page_load", "custom", "exception"]
    row = details.session_context(df, "s").first()
    assert (row.started_ms, row.ended_ms, row.country) == (500, 3000, "DE")
    assert details.session_timeline(df, "s", 1).count() == 0  # the pixel row takes the only place
    trace = details.recent_traces(df).first()
    assert (trace.pageviews, trace.events, trace.exceptions, trace.entry_path) == (1, 2, 1, "/home")


def test_page_views_and_their_children(spark):
    df = frame(spark, load(1, sid="s"), {"received_ms": 2, "kind": "page_unload", "sid": "s", "bid": "b", "duration_ms": 7}, {"received_ms": 3, "kind": "page_unload", "sid": "s", "bid": "b"}, custom(4, "x", "s"), custom(5, "y", "s", bid="other"))
    assert details.time_on_page(df).first().on_page_ms == 7
    assert {r.seq: r.is_orphan for r in details.children(df).collect()} == {3: False, 4: True}


def test_inbox_states(spark):
    df = frame(spark, exc(10, "a"), exc(20, "b"), exc(30, "c"), exc(40, "d", "https://free.com"))
    sources = spark.createDataFrame([("https://a.com", "p")], "uri string, project_id string")
    projects = spark.createDataFrame([("p", "P")], "id string, name string")
    triage = spark.createDataFrame([("p", "a", "https://a.com", 10, None), ("p", "b", "https://a.com", 19, None), ("p", "c", "https://a.com", 99, 1), ("p", "d", "https://free.com", 99, None)], "project_id string, group_id string, source string, resolved_ms long, muted_ms long").selectExpr("project_id", "group_id", "source", "timestamp_millis(resolved_ms) AS resolved_at", "timestamp_millis(muted_ms) AS muted_at")
    got = {r.exc_group: r.status for r in details.inbox(details.exception_groups(df, 0, 100), sources, projects, triage).collect()}
    assert got == {"a": "resolved", "b": "unresolved", "c": "ignored", "d": "unresolved"}


def test_dashboard_panels_agree(spark):
    df = adapter.facts(spark, "/root/testdata/sf0.001")
    start = 1_704_844_800_000
    panels = dashboard(df, start, start + 10 * DAY_MS, DAY_MS, adapter.sources(spark), adapter.projects(spark), Fields(DASHBOARD).ne("path", "/p1"))
    assert sum(r.pageviews for r in panels["series"].collect()) == panels["summary"].first().pageviews
    assert len(panels["series"].collect()) == len(panels["previous_series"].collect()) == 10
    assert sum(r.pageviews for r in panels["previous_series"].collect()) == panels["previous"].first().pageviews


def test_day_partitions_are_pruned(spark, tmp_path):
    from tidemark.sources import store

    store.write_cold(frame(spark, load(1), load(DAY_MS), load(2 * DAY_MS)), str(tmp_path))
    got = scan.read_cold(spark, str(tmp_path), DAY_MS, DAY_MS + 5)
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert scan.list_days(spark, str(tmp_path)).count() == 3


def test_country_table(spark):
    from tidemark.sources import zones

    names = dict(zones.countries(spark).collect())
    assert not names or (names["DE"] == "Germany" and all(len(c) == 2 for c in names))
