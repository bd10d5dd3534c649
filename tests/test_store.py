import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor
from threading import Event

import pytest
from pyspark.sql import functions as F
from rows import custom, exc, frame, load

from tidemark import store_catalog
from tidemark.schema import COLUMNS, DAY_MS, MAX_BODY, PIXEL, PROJECT, SOURCE, TRIAGE
from tidemark.sources import enrich, hot, log, scan, store
from tidemark.sources import zones as tz
from tidemark.sources.entities import Entities
from tidemark.streaming import ingest

UA = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"


def test_sequence_numbers_are_gapless_and_ordered(spark):
    df = frame(spark, *[load(ms) for ms in (9_000_000, 5, 7, 5, 90_000_000)])
    rows = store.with_seq(df, 100).orderBy("seq").collect()
    assert [r.seq for r in rows] == [101, 102, 103, 104, 105] and [r.received_ms for r in rows] == [5, 5, 7, 9_000_000, 90_000_000]


def place(tmp_path, *names):
    return [str(tmp_path / n) for n in names]


def test_numbers_are_ranked_in_range_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = store.ranked(frame(spark, *[load(5_000 + i % 7, bid=str(i % 40)) for i in range(400)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranked.staged.select(F.shiftright("_at", 33)).distinct().count() > 2  # one millisecond is no bound to a task
    rows = ranked.numbered(10).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(11, 411)) and [(r.received_ms, r.bid) for r in rows] == sorted((r.received_ms, r.bid) for r in rows)


def test_append_compact_retention(spark, tmp_path):
    at, cold = place(tmp_path, "hot", "cold")
    store_ = hot.HotStore(spark, at)
    assert store_.read().count() == 0 and store_.compact(cold, DAY_MS) == 0 and store_.append(frame(spark)) == 0
    assert store_.append(frame(spark, load(1), load(DAY_MS + 1))) == 2
    assert hot.HotStore(spark, at).append(frame(spark, load(2 * DAY_MS + 1))) == 1  # another process goes on with the numbers
    assert [r.seq for r in store_.read().orderBy("seq").collect()] == [1, 2, 3] and store_.span() == (1, 2 * DAY_MS + 1)
    assert store_.read(start=2 * DAY_MS).count() == 1 and store_.read(end=DAY_MS).count() == 2
    assert store_.compact(cold, 2 * DAY_MS) == 2 and store_.read().count() == 1
    both = scan.window(spark, cold, store_, 0, 9 * DAY_MS)
    assert both.count() == 3 and both.columns == COLUMNS
    assert store_.append(frame(spark, load(DAY_MS + 5), load(9 * DAY_MS))) == 2 and store_.compact(cold, 2 * DAY_MS) == 1
    assert sorted(r.seq for r in scan.window(spark, cold, store_, 0, 10 * DAY_MS).collect()) == [1, 2, 3, 4, 5]
    assert store.enforce_retention(spark, cold, 3 * DAY_MS - 1000, DAY_MS) == ["1970-01-01"]
    assert scan.read_cold(spark, cold).count() == 2
    assert store_.delete_keys(spark.createDataFrame([(3,), (3,), (77,)], "seq long")) == 1 and [r.seq for r in store_.read().collect()] == [5]
    assert scan.before(store_.read(), DAY_MS).count() == 0


def test_a_move_that_is_cut_off_loses_and_doubles_nothing(spark, tmp_path):
    at, cold = place(tmp_path, "hot", "cold")
    store_ = hot.HotStore(spark, at)
    store_.append(frame(spark, load(1), load(2), load(3 * DAY_MS)))
    every = lambda: sorted(r.seq for r in scan.window(spark, cold, store_, 0, 9 * DAY_MS).collect())
    assert store_.copy_old(cold, DAY_MS).rows == 2 and every() == [1, 2, 3]  # killed between writing and publishing
    store_.append(frame(spark, load(3)))
    with pytest.raises(log.Lost):
        store_._rewrite(store_.read(), list(store_.state()["parts"]))
    assert every() == [1, 2, 3, 4] and store_.compact(cold, DAY_MS) == 1 and every() == [1, 2, 3, 4]
    assert scan.read_cold(spark, cold).count() == 3 and store_.read().count() == 1 and not store_.state()["moving"]
    assert len(store_.vacuum(0)) == 0 and len(store_.vacuum(1 << 60)) == 3 and every() == [1, 2, 3, 4]


def test_rows_that_arrive_while_parts_are_replaced_stay(spark, tmp_path):
    at, cold = place(tmp_path, "hot", "cold")
    store_ = hot.HotStore(spark, at)
    store_.append(frame(spark, load(1), load(2 * DAY_MS)))
    move = store_.copy_old(cold, DAY_MS)
    store_.append(frame(spark, load(2)), ("s", 0))  # both while compaction runs
    store_.append(frame(spark, load(3)), ("s", 1))
    store_._replace(move.parts, move.young, moving={})
    assert sorted(r.received_ms for r in store_.read().collect()) == [2, 3, 2 * DAY_MS] and scan.window(spark, cold, store_, 0, 9 * DAY_MS).count() == 4
    with pytest.raises(log.Lost):
        store_._replace(move.parts, {})  # a second step that read the same parts


def test_batches_count_once(spark, tmp_path):
    store_ = hot.HotStore(spark, str(tmp_path / "hot"))
    go = lambda n, s="a": store_.append(frame(spark, load(n)), (s, n))
    assert [go(0), go(1), go(1), go(0), go(0, "b")] == [1, 1, 0, 0, 1] and store_.read().count() == 3
    assert store_.append(frame(spark), ("a", 5)) == 0 and go(4) == 0 and go(6) == 1


def test_versions_are_published_once(spark, tmp_path):
    first, second = (log.Log(spark, str(tmp_path / "x"), {"n": 0}) for _ in range(2))
    assert first.load() == (0, {"n": 0}) and first.commit(lambda s: {"n": s["n"] + 1}) == (1, {"n": 1})
    calls = []

    def slow(s):
        calls.append(s["n"])
        if len(calls) == 1:
            second.commit(lambda t: {"n": t["n"] + 10})
        return {"n": s["n"] + 100}

    assert first.commit(slow) == (3, {"n": 111}) and calls == [1, 11] and second.commit(lambda s: None) == (3, {"n": 111})
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: log.Log(spark, str(tmp_path / "x"), {"n": 0}).commit(lambda s: {"n": s["n"] + 1}), range(40)))
    assert first.load() == (43, {"n": 151})
    first.clear()
    assert first.versions() == list(range(24, 44)) and first.load() == (43, {"n": 151})
    assert not [n for n, _, _ in first.files.listed(first.folder) if not n.startswith("0")]


def test_versions_in_a_store_without_links(spark, tmp_path):
    (tmp_path / "far").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./x", f"file://{tmp_path}/far")
    first, second = (log.Log(spark, "viewfs://far/x/store", {"n": 0}) for _ in range(2))
    assert first.files.fs.getScheme() == "viewfs" and first.commit(lambda s: {"n": 1})[0] == 1
    assert not second.files.publish("other", f"{second.folder}/{1:020}.json") and second.commit(lambda s: {"n": s["n"] + 1}) == (2, {"n": 2}) == first.load()
    assert [n for n, _, _ in first.files.listed(first.folder)] == sorted(f"{v:020}.json" for v in (1, 2)) or len(first.versions()) == 2
    far = hot.HotStore(spark, "viewfs://far/x/hot")
    assert far.append(frame(spark, load(1), load(DAY_MS))) == 2 and far.compact("viewfs://far/x/cold", 5) == 1
    assert scan.window(spark, "viewfs://far/x/cold", far, 0, 2 * DAY_MS).count() == 2 and scan.list_days(spark, "viewfs://far/x/cold").count() == 1


def test_leases_do_not_overlap(spark, tmp_path):
    stores = [hot.HotStore(spark, str(tmp_path / "hot")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda i: stores[i % 4].lease(i + 1), range(20)))
    sizes = {b: a for a, b in zip(got[1:], got, strict=False)}
    assert sorted(a - b for b, a in sizes.items()) + [stores[0].state()["next_seq"] - got[-1]] and stores[0].state()["next_seq"] == 1 + sum(range(1, 21))
    assert len(set(got)) == 20


def test_upkeep(spark, tmp_path):
    at, cold = place(tmp_path, "hot", "cold")
    store_ = hot.HotStore(spark, at)
    store_.append(frame(spark, load(1), load(5 * DAY_MS), load(9 * DAY_MS)))
    now = 10 * DAY_MS
    assert store_.take("replace", "other", now, 1000) and hot.upkeep(store_, cold, now, "me") is None
    done = hot.upkeep(store_, cold, now + 2000, "me", keep_cold_ms=7 * DAY_MS)  # the other's lease has run out
    assert done == {"moved": 2, "days": ["1970-01-01"], "vacuumed": 0} and not store_.state()["leases"]
    assert hot.upkeep(store_, cold, now + 3000, "me") is None and hot.upkeep(store_, cold, now + 2000 + store.EVERY_MS, "you")["moved"] == 0
    assert scan.window(spark, cold, store_, 0, 99 * DAY_MS).count() == 2


def test_upkeep_goes_on_after_a_failure(spark, tmp_path):
    store_, stop, told, times = hot.HotStore(spark, str(tmp_path / "hot")), Event(), [], iter([5 * DAY_MS, 6 * DAY_MS])
    store_.append(frame(spark, load(1)))

    def clock():
        if len(told) == 0:
            raise OSError("no clock")
        now = next(times)
        if now > 5 * DAY_MS:
            stop.set()
        return now

    assert hot.keep_up(store_, str(tmp_path / "cold"), "me", stop, clock, every_ms=1, failed=told.append) == 2
    assert [str(e) for e in told] == ["no clock"] and store_.read().count() == 0


def test_large_bodies_are_refused(spark):
    body = lambda n: '{"u":"https://e.com/","n":"' + "x" * n + '"}'
    lines = spark.createDataFrame([(body(n),) for n in (5, MAX_BODY - 29, MAX_BODY - 28, 10**6)] + [(None,), ("",)], "body string")
    assert sorted(len(r.n) for r in enrich.parse(lines, "hit").collect()) == sorted(n for n in (5, MAX_BODY - 29, MAX_BODY - 28) if len(body(n)) <= MAX_BODY)


def test_regroup_rewrites_changed_parts_only(spark, tmp_path):
    at, cold, aside, state = place(tmp_path, "hot", "cold", "aside", "state")
    stack = {"exc_stack": "at handler (app.js:1:2)"}
    good = store.regrouped(frame(spark, exc(1, **stack))).drop("changed")
    store.write_cold(good.unionByName(frame(spark, exc(DAY_MS, "stale", **stack), load(DAY_MS))), cold)
    store_ = hot.HotStore(spark, at)
    for rows in (good, frame(spark, exc(2, "stale", **stack), load(3))):
        store_.append(rows)
    assert store_.take("replace", "compaction", 5, 1000) and store.regroup_if_needed(spark, store_, cold, state, aside, 5) is None
    store_.release("replace", "compaction")
    day0, parts = sorted((tmp_path / "cold" / "event_date=1970-01-01").rglob("*.parquet")), set(store_.state()["parts"])
    assert store.regroup_if_needed(spark, store_, cold, state, aside, 5) == (1, 1) and store.regroup_if_needed(spark, store_, cold, state, aside, 5) is None
    assert sorted((tmp_path / "cold" / "event_date=1970-01-01").rglob("*.parquet")) == day0 and len(parts & set(store_.state()["parts"])) == 1
    rows = scan.read_cold(spark, cold).unionByName(store_.read())
    assert rows.where("kind = 'exception'").select("exc_group").distinct().count() == 1 and rows.count() == 6
    assert store.regroup_cold(spark, cold, aside) == 0 and store_.regroup() == 0


def test_listing_and_unreadable_files(spark, tmp_path):
    cold, at = place(tmp_path, "cold", "hot")
    store_ = hot.HotStore(spark, at)
    assert scan.list_days(spark, cold).count() == 0 and scan.list_files(spark, cold).count() == 0 and scan.earliest_ms(spark, cold, store_) is None
    store_.append(frame(spark, load(7)))
    assert scan.earliest_ms(spark, cold, store_) == 7
    store.write_cold(frame(spark, load(DAY_MS), load(2 * DAY_MS, sid="s"), exc(2 * DAY_MS)), cold)
    (tmp_path / "cold" / "event_date=1969-12-30").mkdir()
    (tmp_path / "cold" / "not a day").mkdir()
    assert sorted(str(r[0]) for r in scan.list_days(spark, cold).collect()) == ["1969-12-30", "1970-01-02", "1970-01-03"] and scan.earliest_ms(spark, cold, store_) == -2 * DAY_MS
    assert scan.list_files(spark, cold).count() == 3 and scan.list_files(spark, cold, 2 * DAY_MS, 3 * DAY_MS).count() == 2 and scan.list_files(spark, cold, end=DAY_MS).count() == 1
    junk = next((tmp_path / "cold" / "event_date=1970-01-03").iterdir())
    for name, text in (("junk.parquet", "junk" * 100), ("short.parquet", "x"), ("empty.parquet", "")):
        (junk / name).write_text(text)  # Spark passes over the empty one by itself
    told = []
    assert scan.read_cold(spark, cold, skip=told.extend).count() == 3 and sorted(p.rsplit("/", 1)[1] for p in told) == ["junk.parquet", "short.parquet"]
    assert sorted((r.rows is None, r.bytes) for r in scan.check_files(spark, cold).where("rows IS NULL OR rows <> 1").collect()) == [(True, 1), (True, 400)]
    told.clear()
    assert scan.read_cold(spark, cold, 0, DAY_MS, skip=told.extend).count() == 1 and not told
    with pytest.warns(UserWarning, match="unreadable"):
        assert scan.window(spark, cold, store_, 0, 9 * DAY_MS).count() == 4


def files_read(df):
    """Files that the scans of an executed plan read."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        if node.nodeName().startswith("Scan parquet"):
            n += node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return n


def test_point_lookups_read_few_files(spark, tmp_path):
    cold = str(tmp_path / "cold")
    rows = [load(d * DAY_MS + i, sid=f"s{i % 60}" if i % 9 else None, bid=f"b{i}") for d in range(3) for i in range(300)] + [exc(d * DAY_MS + i, f"g{i % 20}", sid=f"s{i}") for d in range(3) for i in range(60)] + [custom(d * DAY_MS + i, f"e{i % 5}", sid=f"s{i}") for d in range(3) for i in range(60)]
    facts = frame(spark, *rows)
    store.write_cold(facts, cold)
    every = files_read(scan.read_cold(spark, cold))
    named = scan.read_events(spark, cold, "e3", DAY_MS)
    assert sorted(map(str, named.collect())) == sorted(map(str, facts.where(f"event_name = 'e3' AND received_ms >= {DAY_MS}").collect())) and files_read(named) * 5 <= every
    one, group, few = scan.read_session(spark, cold, "s7"), scan.read_group(spark, cold, "g7"), scan.read_sessions(spark, cold, ["s1", "s2"], DAY_MS, DAY_MS)
    same = lambda got, want: sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert same(one, facts.where("sid = 's7'")) and same(group, facts.where("exc_group = 'g7'")) and same(few, facts.where(f"sid IN ('s1', 's2') AND received_ms BETWEEN {DAY_MS} AND {2 * DAY_MS - 1}"))
    assert files_read(group) * 5 <= every and files_read(one) * 3 <= every and files_read(few) <= files_read(one)


def test_small_tables(spark):
    now = dt.datetime(2024, 1, 1)
    p = spark.createDataFrame([("p", "P", "p", now)], PROJECT)
    s = spark.createDataFrame([("https://a.com", "p", "website", None, now, None, None)], SOURCE)
    x = spark.createDataFrame([("1", "p", "n", "e", {"k": "v"}, now, None)], PIXEL)
    p2, s2, x2 = store.delete_project(p, s, x, "p")
    assert (p2.count(), s2.first().project_id, x2.count()) == (0, None, 0)
    assert store.upsert(p, p.withColumn("name", F.lit("Q")), "id").first().name == "Q"
    t = spark.createDataFrame([], TRIAGE)
    t = store.set_triage(t, "p", "g", "s", now, resolved=True, note=" n ")
    t = store.set_triage(t, "p", "g", "s", now, muted=True)
    row = t.first()
    assert (row.resolved_at, row.muted_at, row.note) == (now, now, "n")
    assert store.set_triage(t, "p", "g", "s", now, resolved=False, note=" ").first().note is None
    fresh = scan.new_sources(frame(spark, load(1), load(2, source="https://b.com")), s, 10)
    assert [r.uri for r in fresh.collect()] == ["https://b.com"] and scan.new_sources(frame(spark, load(2, source="x")), s, 1).count() == 0


def raw(kind, body, **more):
    return {"kind": kind, "body": json.dumps(body), "user_agent": UA, "accept_language": "de-DE,de", "dnt": None, "sec_gpc": None, "received_ms": 1000} | more


LINES = [
    raw("hit", {"b": "b1", "i": " s1 ", "e": "load", "u": "https://www.Example.com/a/?utm_source=x", "r": "https://www.google.com/q", "q": True, "t": "Europe/Berlin"}),
    raw("hit", {"b": "b1", "e": "custom", "u": "https://example.com/a", "r": "https://example.com/", "n": "signup", "d": {"z": "1", "a": "2"}}, received_ms=2000),
    raw("hit", {"e": "load", "u": "nonsense"}), raw("hit", {"e": "load", "u": "https://e.com/"}, dnt="1"), raw("hit", {"e": "load", "u": "https://e.com/"}, user_agent="Googlebot/2.1"),
    raw("exception", {"u": "https://example.com/", "ty": "TypeError", "m": "m" * 2000, "h": False, "v": " 1.0 ", "d": {"k": "v"}}, received_ms=3000),
]


def zones(spark):
    return spark.createDataFrame([("Europe/Berlin", "DE")], "zone string, country string")


def test_enrichment(spark):
    rows = ingest.facts_of(spark.createDataFrame(LINES, ingest.RAW), zones(spark)).orderBy("received_ms").collect()
    page, event, error = rows
    assert (page.source, page.pathname, page.sid, page.referrer_host, page.referrer_group, page.country, page.language, page.ua_browser, page.utm_source, page.is_unique_user) == ("https://example.com", "/a", "s1", "google.com", "Search", "DE", "de", "Chrome", "x", True)
    assert (event.kind, event.event_name, event.metadata_json, event.referrer_host) == ("custom", "signup", '{"a":"2","z":"1"}', None)
    assert (error.app_version, len(error.exc_message), error.country, error.metadata_json) == ("1.0", 1001, None, '{"k":"v"}')
    pixels = spark.createDataFrame([("1", "open", {"k": "v"})], "id string, event_name string, metadata map<string,string>")
    hits = enrich.pixel_hits(spark.createDataFrame([("1", 5), ("2", 6)], "pixel_id string, received_ms long"), pixels).collect()
    assert [(h.source, h.event_name, h.metadata_json) for h in hits] == [("pixel://1", "open", '{"k":"v"}')]


def test_stream_equals_batch_and_registers_sources(spark, tmp_path):
    box, store_, tables = tmp_path / "in", hot.HotStore(spark, str(tmp_path / "hot")), Entities(spark, str(tmp_path / "e"))
    box.mkdir()
    (box / "a.json").write_text("\n".join(json.dumps(x) for x in LINES[:3]))
    go = lambda: ingest.start(spark, str(box), store_, str(tmp_path / "cp"), zones(spark), once=True).awaitTermination()
    tables.register(spark.createDataFrame([("https://known.com",)], "uri string"), dt.datetime(2024, 1, 1), 10)

    def register(day):
        facts = ingest.facts_of(ingest.lines(spark, str(box)), zones(spark))
        ingest.register_sources(spark, facts, tables, str(tmp_path / "cs"), dt.datetime(2024, 1, day), once=True).awaitTermination()

    go()
    register(2)
    store_.append(frame(spark, load(4)))
    more = [raw("hit", {"e": "load", "u": f"https://{h}.com/"}, received_ms=5000) for h in ("known", "new", "new")]
    (box / "b.json").write_text("\n".join(json.dumps(x) for x in LINES[3:] + more))
    go()
    register(3)
    got = store_.read().where("received_ms > 4")
    want = ingest.facts_of(spark.createDataFrame(LINES + more, ingest.RAW), zones(spark))
    assert sorted(map(str, got.drop("seq").collect())) == sorted(map(str, want.drop("seq").collect()))
    assert [r.seq for r in store_.read().orderBy("seq").collect()] == list(range(1, 8))
    assert sorted((r.uri, r.created_at.day) for r in tables.read("sources").collect()) == [("https://example.com", 2), ("https://known.com", 1), ("https://new.com", 3)]


def test_live_series(spark, tmp_path):
    frame(spark, load(1000), load(2000), load(1000) | {"seq": 0}, load(3_600_000)).write.parquet(str(tmp_path / "f"))
    stream = ingest.live_series(spark.readStream.schema(spark.read.parquet(str(tmp_path / "f")).schema).parquet(str(tmp_path / "f")))
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.pageviews for r in spark.table("live").collect()) == [1, 2]


def test_zones_of_this_machine(spark):
    got = dict(map(tuple, tz.zones(spark).collect()))
    assert not got or (got["Europe/Berlin"] == "DE" and got["America/New_York"] == "US" and "Nowhere/Land" not in got)


def test_entity_changes_of_several_callers(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    first, second = (Entities(spark, str(tmp_path / "e")) for _ in range(2))
    assert first.read("projects").count() == 0 and first.read("triage").columns == TRIAGE.fieldNames()
    project = lambda i, n: spark.createDataFrame([(i, n, n, now)], PROJECT)
    first.put_project(project("p", "P"))
    first.register(spark.createDataFrame([("https://b.com",), ("https://a.com",), ("https://a.com",)], "uri string"), now, 1)
    assert [r.uri for r in second.read("sources").collect()] == ["https://a.com"]
    second.upsert("sources", spark.createDataFrame([("https://a.com", "p", "website", None, now, None, None)], SOURCE), "uri")
    second.upsert("pixels", spark.createDataFrame([("1", "p", "n", "e", {"k": "v"}, now, None)], PIXEL), "id")
    before = first.log.load()[1]
    # a name that another caller takes meanwhile is refused on the second try
    seen = []

    def late(t):
        if not seen:
            seen.append(1)
            second.put_project(project("q", "Q"))
        return {"projects": store.put_project(t["projects"], project("r", "q"))}

    with pytest.raises(ValueError):
        first.update(late)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: x[0].set_triage("p", "g", "https://a.com", now, **x[1]), [(first, {"resolved": True}), (second, {"muted": True})]))
    state = first.read("triage").first()
    assert state.resolved_at == now and state.muted_at == now
    assert sorted(r.id for r in first.read("projects").collect()) == ["p", "q"]
    first.delete_project("p")
    assert [r.id for r in second.read("projects").collect()] == ["q"] and second.read("pixels").count() == 0 and second.read("sources").first().project_id is None
    assert [r.id for r in first.read("projects", before).collect()] == ["p"]  # a reader of an older version is not disturbed
    assert second.vacuum(0) == [] and len(second.vacuum(1 << 60)) >= 5 and [r.id for r in first.read("projects").collect()] == ["q"]


def test_zone_links(spark):
    tab = spark.createDataFrame([("# comment",), ("XA\t+00\tOne/Main\tnote",), ("XB\t+00\tTwo/Main",), ("broken",)], "value string")
    later = spark.createDataFrame([("XZ,XA\t+00\tOne/Main",), ("XC,XD\t+00\tThree/Main",)], "value string")
    known = tz.countries_of_tabs(tab, later)
    assert dict(map(tuple, known.collect())) == {"One/Main": "XA", "Two/Main": "XB", "Three/Main": "XC"}
    lines = ["L One/Main Old", "Link  Old Older # twice", "Z Zone 1", "L Ring/A Ring/B", "L Ring/B Ring/A", "L Nowhere Gone", "L Two/Main Three/Main", "L short"] + [f"L {f'c{i - 1}' if i else 'Two/Main'} c{i}" for i in range(40)]
    links = tz.links_of_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = dict(map(tuple, tz.with_links(known, links).collect()))
    assert {z: c for z, c in got.items() if z[0] != "c"} == {"One/Main": "XA", "Two/Main": "XB", "Three/Main": "XC", "Old": "XA", "Older": "XA"}
    assert {z for z in got if z[0] == "c"} == {f"c{i}" for i in range(32)}  # 32 hops and no more
    assert dict(map(tuple, tz.with_links(known, links.where("false")).collect())) == dict(map(tuple, known.collect()))
    with pytest.raises(FileNotFoundError):
        tz.zones(spark, "file:///nowhere")


def test_zone_links_of_many_aliases(spark):
    """More steps than one recursive query of Spark may have rows, and every number of hops."""
    chains = spark.range(75_000).select(F.concat(F.lit("c"), "id").alias("alias"), F.when(F.col("id") % 30 == 0, F.lit("Z")).otherwise(F.concat(F.lit("c"), F.col("id") - 1)).alias("target"))
    links = chains.unionByName(spark.createDataFrame([("r", "s"), ("s", "r"), (None, "Z"), ("none", None), ("Z", "Y")], "alias string, target string"))
    known = spark.createDataFrame([("Z", "XA"), ("Y", "XB")], "zone string, country string")
    got = tz.with_links(known, links).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    assert dict(map(tuple, got.collect())) == {"XA": 75_001, "XB": 1}
    few = links.where("alias IN ('r', 's', 'Z') OR try_cast(substr(alias, 2) AS int) < 30")
    for hops in (0, 1, 2, 3, 5, 6, 7, 11, 30, 31):
        got = sorted(r.zone for r in tz.with_links(known, few, hops).collect())
        assert got == sorted(["Y", "Z"] + [f"c{i}" for i in range(min(hops, 30))]), hops


def test_facts_of_appended_batches_are_made_once(spark, monkeypatch):
    rows, seen = frame(spark, *[load(ms % 7) for ms in range(100)]), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    monkeypatch.setattr(store_catalog.adapter, "facts", lambda *_: rows.mapInArrow(counted, rows.schema))
    got = store_catalog.queries()["append_batches"](spark, "").collect()
    assert [(r.n, r.first, r.last, r.total, r.used) for r in got] == [(100, 1, 100, 5050, 100)] and seen.value == 100
