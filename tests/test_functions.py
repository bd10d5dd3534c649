import csv
import datetime as dt
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import custom, exc, frame, load

from tidemark.functions import agents, ranges, text, urls
from tidemark.functions.predicates import DASHBOARD, EXCEPTIONS, Fields, java_pattern, where
from tidemark.schema import DAY_MS


def each(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", f("v").alias("x")).orderBy("i").collect()]


CASES = [
    (text.drop_query, "chunk-7.mjs?build=91&x:3:8", "chunk-7.mjs"), (text.drop_query, "plain", "plain"), (text.strip_urls, "GET ws://api.test:81/v2/[x] failed, see ftp://h/p;q", "GET ] failed, see ;q"), (text.strip_urls, "no scheme //host/x", "no scheme //host/x"),
    (text.mask_ids, "order 0f8fad5b-d9cb-469f-a165-70867728950e/7", "order <uuid>/7"), (text.mask_ids, "x0f8fad5b-d9cb-469f-a165-70867728950e", "x0f8fad5b-d9cb-469f-a165-70867728950e"), (text.mask_ids, "read 0x7FFE at +0xa", "read <addr> at +<addr>"),
    (text.mask_ids, "feedface defaced", "feedface defaced"), (text.mask_ids, "sum 9e107d9d372bb682 ok, 12ab34 short", "sum <hash> ok, 12ab34 short"), (text.strip_digits, "v8.1-rc2 line 404", "v.-rc line "),
    (text.base_paths, "in (/opt/svc/lib/queue.py:7)", "in (queue.py:7)"), (text.base_paths, "D:\\work\\app\\main.cs:40", "D:main.cs:40"), (text.base_paths, "from lib/util.ts:3", "from util.ts:3"), (text.base_paths, "yes/no or 50/50 by /metrics", "yes/no or 50/50 by /metrics"),
    (text.base_paths, "of /u/v/ and w.x/ and //", "of v and w.x and //"), (text.collapse, "\tone\u00a0 two\r\n three ", "one two three"), (text.summary_line, " \r\n\t\n  head line\ntail", "head line"), (text.summary_line, None, ""),
    (text.source_label, "pixel://p7", "p7"), (text.source_label, "bare", "bare"), (text.normalize_path, "/Docs/v1//", "/Docs/v1"), (text.normalize_path, "///", "/"), (text.primary_language, "PT-br;q=0.8,es", "pt"), (text.primary_language, "x1", None),
    (text.slugify, "--Größe & Gewicht 2--", "gr-e-gewicht-2"), (text.slugify, "...", "project"), (text.referrer_group, "duckduckgo.com", "Search"), (text.referrer_group, "old.reddit.com", "Social"), (text.referrer_group, "intranet.local", None),
    (text.website_source, " Shop.TEST. ", "https://shop.test"), (text.pixel_id, "pixel://open-1", "open-1"),
]


def test_text_cases(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(CASES)], "i int, v string")
    picked = F.when(F.lit(False), F.lit(""))
    for i, (f, _, _) in enumerate(CASES):
        picked = picked.when(F.col("i") == i, f("v"))
    got = [r.x for r in df.select("i", picked.alias("x")).orderBy("i").collect()]
    assert got == [want for _, _, want in CASES]


def test_frames(spark):
    calls = "  at visit (node.ts:31:7)\r\nat visit (node.ts:28:9)\n \t \nat visit (leaf.ts:2:2)\nat visit (node.ts:1:1)"
    assert each(spark, [calls, "\n", None], text.frames)[0] == ["at visit (node.ts::)", "at visit (leaf.ts::)", "at visit (node.ts::)"]
    builds = each(spark, ["at draw (https://static.test/js/main.9f2.js:1:77)", "at draw (http://other.test/main.a10.js:5:1)", "at draw (https://static.test/js/side.js:1:77)"], text.frames)
    assert builds[0] == builds[1] == builds[2] == ["at draw ()"]


def test_fingerprints(spark):
    import hashlib

    rows = [("TypeError", "x 1", None, None), (" typeerror ", "x 2", "  ", None), ("TypeError", "y", None, None), ("TypeError", "a", "at f (a.js:1:2)", None), ("TypeError", "b", "at f (/q/r/a.js:9:2)", None), ("E", "m", None, " mine ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, m string, s string, o string")
    g = [r.g for r in df.select("i", text.fingerprint("t", "m", "s", "o").alias("g")).orderBy("i").collect()]
    assert g[0] == g[1] != g[2] and g[3] == g[4] != g[0]
    assert g[0] == hashlib.sha256(hashlib.sha256(b"typeerror\nx").digest()).hexdigest()[:16]
    assert g[5] == hashlib.sha256(b"mine").hexdigest()[:16]


def test_truncate_counts_bytes(spark):
    assert each(spark, ["abcdef", "äöü", "abc", None, "aäb"], lambda c: text.truncate(c, 3)) == ["abc…", "ä…", "abc", None, "aä…"]


def test_utm_last_value_wins_decoded(spark):
    urls = ["https://h/?utm_source=a&utm_source=b+c%21", "https://h/?utm_source=&x=1", "https://h/#?utm_source=z", "https://h/?utm%5Fsource=q#f", "https://h/?utm_source=5%+of%20%zz%41", "https://h/?utm_source=%E9x"]
    assert each(spark, urls, lambda c: text.utm(c, "utm_source")) == ["b c!", None, None, "q", "5% of %zzA", "\ufffdx"]


def test_metadata(spark):
    df = spark.createDataFrame([({f"k{i:02}": "v" * 2000 for i in range(40)},), ({"b": "1", "a": "2"},), ({},), (None,)], "m map<string,string>")
    big, small, none, null = [r.j for r in df.select(text.metadata_json("m").alias("j")).collect()]
    assert small == '{"a":"2","b":"1"}' and none is None and null is None and big.count('"k') == 32
    one = spark.createDataFrame([('{"a":"x","k2":"' + "y" * 40 + '"}',)], "j string").select(text.metadata_part("j", True).alias("t"), text.metadata_part("j", False).alias("c")).first()
    assert list(one.t) == ["a"] and list(one.c) == ["k2"]


def test_status_delta_and_labels(spark):
    df = spark.createDataFrame([(5, 5, None, 3.0, 2.0, "app", None), (6, 5, None, 1.0, 0.0, None, None), (1, 5, 1, 1.0, 4.0, "a", "2")], "l long, r long, m long, now double, before double, a string, v string")
    rows = df.select(text.status("l", "r", "m").alias("s"), text.delta_percent("now", "before").alias("d"), text.version_label("a", "v").alias("x")).collect()
    assert [tuple(r) for r in rows] == [("resolved", 50.0, "app"), ("unresolved", None, "Unknown"), ("ignored", -75.0, "a @ 2")]


def labelled():
    with open(Path(__file__).parent / "data" / "agents.tsv", encoding="utf-8") as f:
        return list(csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE))


def test_labelled_agents():
    wrong = []
    for r in labelled():
        app, _, system, kind = agents.classify(r["agent"])
        if (kind, system or "") != (r["kind"], r["os"]) or (kind != "Bot" and (app or "") != r["app"]):
            wrong.append((r, app, system, kind))
    assert not wrong


PROGRAMS = [
    ("sync-tool/v3.20.1", "sync-tool", "3.20.1", None, "App"), ("Reader (Macintosh; 13.2) 4.5", "Reader", "4.5", "macOS", "App"), ("Reader (Macintosh; 13.2)", "Reader", None, "macOS", "App"), ("notes/7.1 (fedora; (beta 2.2))", "notes", "7.1", "Linux", "App"),
    ("Mozilla/5.0 (X11; CrOS armv7l) OddShell/6.2", "OddShell", "6.2", "ChromeOS", "App"), ("Mozilla/5.0 (Macintosh)", None, None, "macOS", "App"), ("curious/9.9 studios", "curious", "9.9", None, "App"), ("gate CFNetwork/1.2 x/3", "gate", "1.2", "iOS", "App"),
]


def test_programs_and_noise():
    for agent, *want in PROGRAMS:
        assert list(agents.classify(agent)) == want, agent
    assert all(agents.classify(b)[3] == "Bot" for b in ("", "\t", "(;)", "7.0.1", "price-spider 1", "Chatbot/3 (Android)", "Mozilla/5.0 (Linux) WebCrawlerX/1.0"))
    assert [agents.find_version(v) for v in ("r2 3.14.15", "v0.9", "arm64 1.10;", "9", "lib2.5", "6.0a1", "x.7.1")] == ["3.14.15", "0.9", "1.10", None, None, None, None]


HOSTS = [
    ("https://WWW.www.Shop.test/a b?q#f", "shop.test", "/a%20b"), ("https://ß.de/x", "xn--zca.de", "/x"), ("https://Fußball.example", "xn--fuball-cta.example", "/"), ("https://MÜNCHEN.example", "xn--mnchen-3ya.example", "/"), ("https://例え。テスト", "xn--r8jz45g.xn--zckzah", "/"),
    ("https://xn--mnchen-3ya.example", "xn--mnchen-3ya.example", "/"), ("https://xn--a", None, None), ("https://xn--abc-", None, None), ("https://soft\u00adhyphen.test", "softhyphen.test", "/"), ("https://a\u200db.test", None, None), ("https://\u0301a.test", None, None),
    ("https://שלום.test", "xn--9dbne9b.test", "/"), ("https://שa.test", None, None), ("https://a\u2026b.test", None, None), ("https://\ue000.test", None, None), ("https://١٢.שלום", None, None), ("https://2130706433/", "127.0.0.1", "/"), ("no url", None, None),
]


def test_hosts():
    assert [(u, *urls.host_and_path(u)) for u, _, _ in HOSTS] == HOSTS


def test_host_mapping_equals_the_published_table():
    idna = pytest.importorskip("idna")
    for o in [*range(0x80, 0x3400, 3), *range(0xA000, 0x20000, 7)]:
        c = chr(o)
        if unicodedata.category(c)[0] in "CM" or unicodedata.bidirectional(c) != "L" or unicodedata.bidirectional(unicodedata.normalize("NFKC", c)[0]) != "L":
            continue
        try:
            want = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in idna.uts46_remap("a" + c, False, False).split("."))
        except idna.IDNAError:
            want = None
        try:
            got = urls.to_ascii("a" + c)
        except ValueError:
            got = None
        assert got == want, hex(o)


def test_lines_of_patterns(spark):
    df = spark.createDataFrame([("x",), ("x\n",), ("x\ny",)], "v string")
    hits = lambda p: [r.v for r in df.where(F.col("v").rlike(java_pattern(p))).collect()]
    assert hits("x$") == ["x"] and hits("(?m)x$") == ["x", "x\n", "x\ny"] and hits("(?m:^x$)\\n?$") == ["x", "x\n"]
    assert hits("(?:(?m)x)$") == ["x"] and hits("(?m)(?-m:x$)") == ["x"] and hits("(?im)X$|(?s)nothing") == ["x", "x\n", "x\ny"]


def test_filters(spark):
    f, e = Fields(DASHBOARD), Fields(EXCEPTIONS)
    df = frame(spark, load(1), load(2, ua_browser=None), load(3, ua_browser="safari", country=""), custom(4, None), custom(5, "x", country="DE"), exc(6, exc_handled=None), exc(7, exc_handled=True))
    ids = lambda x: [r.seq for r in where(df, x).orderBy("seq").collect()]
    assert ids(f.eq("browser", "CHROME")) == [0]
    assert ids(f.ne("browser", "chrome")) == [1, 2, 3, 4, 5, 6] and ids(~f.eq("browser", "chrome")) == [2]
    assert ids(f.eq("country", "")) == [0, 1, 2, 5, 6] and ids(f.eq("event", "")) == [3]
    assert ids(f.eq("country", None)) == [0, 1, 3, 5, 6] and ids(f.ne("country", "")) == [4]
    assert ids(e.eq("handled", False) & f.eq("event", None) & f.is_in("source", ["a.com"])) == [0, 1, 2, 3, 5]
    assert ids(f.like("browser", "S*i") | f.matches("event", "^x$")) == [2, 4] and ids(f.contains("browser", "HRO")) == [0]
    assert ids(Fields(DASHBOARD, {"Site": ["https://a.com"]}).eq("project", "site")) == list(range(7)) and ids(f.eq("project", "none")) == []
    assert ids(e.truthy("handled")) == [6] and ids(f.is_in("browser", [])) == []


@pytest.mark.parametrize("bad", [lambda f: f.eq("nope", "x"), lambda f: f.eq("os", 3), lambda f: f.matches("os", "(?=x)"), lambda f: f.matches("os", "("), lambda f: f.truthy("project"), lambda f: f.contains("project", "x"), lambda f: f.is_in("os", [1])])
def test_bad_filters_are_refused(bad):
    with pytest.raises(ValueError):
        bad(Fields(DASHBOARD))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ranges(spark):
    now = 1_700_000_000_000
    got = lambda *x: tuple(value(spark, ranges.resolve_range(*[F.lit(v) for v in x], now)))
    assert got(None, None, None) == (now - 7 * DAY_MS, now, DAY_MS)
    assert got(now - 3_600_000, now, "minute")[2] == 60_000
    assert got(now - 30 * DAY_MS, now, "minute")[2] == 3_600_000
    assert got(5, 0, "hour") == (0, 1, 3_600_000)
    assert got(0, ranges.LAST_MS * 2, "day")[1] == ranges.LAST_MS
    assert [value(spark, ranges.custom_interval(F.lit(d))) for d in (1, 10, 50, 150, 300)] == ["15m", "hour", "4h", "day", "week"]
    assert value(spark, ranges.preset_range(F.lit("90d"), now)) == (now - 90 * DAY_MS, now, "day") and value(spark, ranges.preset_range(F.lit("all"), now, 5)) == (5, now, "week")
    assert value(spark, ranges.preset_range(F.lit("fortnight"), now)) is None
    assert [tuple(value(spark, ranges.nice_ticks(F.lit(n)))) for n in (0, 1, 3, 7, 10, 19, 100, 1234)] == [(1, 1), (1, 1), (1, 3), (2, 4), (3, 4), (5, 4), (25, 4), (500, 3)]


def test_first_visit_of_a_day(spark):
    from tidemark.sources.enrich import is_first_today

    now = dt.datetime(2024, 1, 2, 3)
    df = spark.createDataFrame([(None, now), (dt.datetime(2024, 1, 1, 23), now), (dt.datetime(2024, 1, 2, 1), now)], "ims timestamp, now timestamp")
    assert [r.u for r in df.select(is_first_today(F.col("ims"), F.col("now")).alias("u")).collect()] == [True, True, False]
