"""User-agent classes and URL parts, in Arrow batches (ingest only)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.urls import host_and_path

#: Words of compatibility that name no product (fixed values).
STRUCTURAL = {"mozilla", "compatible", "applewebkit", "khtml", "gecko", "like"}
#: Words that give away a system, in the order of search (fixed values).
SYSTEMS = [("iOS", "iphone|ipad|ipod|ios|cfnetwork"), ("Android", "android"), ("Windows", "windows"), ("macOS", "macos|macintosh|darwin|mac os x"), ("ChromeOS", "cros"), ("Linux", "linux|ubuntu|debian|fedora")]
#: Families of system labels by how they begin (fixed values).
FAMILIES = [("Windows", "windows"), ("iOS", "iphone|ipad|ipod|ios"), ("macOS", "mac os|macos"), ("Android", "android"), ("ChromeOS", "chromeos"), ("Linux", "linux")]
#: Browsers by the tokens of their user agents, the first that has one counts: label, tokens of which the first that is found
#: holds the version, and tokens that must be there too. Compatibility tokens come last (fixed values).
BROWSERS = [
    ("Internet Explorer", "MSIE", ""), ("Internet Explorer", "rv", "Trident"), ("Edge", "Edg EdgA EdgiOS Edge", ""), ("Opera", "OPR OPiOS OPT OPX", ""), ("Opera", "Version", "Opera"), ("Opera", "Opera Opera_Mini Opera_Mobi", ""), ("Vivaldi", "Vivaldi", ""),
    ("Yandex Browser", "YaBrowser", ""), ("SamsungBrowser", "SamsungBrowser", ""), ("UC Browser", "UCBrowser UC_Browser", ""), ("Firefox", "Firefox FxiOS Focus", ""), ("GSA", "GSA", ""), ("Chrome", "Chrome CriOS Chromium HeadlessChrome", ""),
    ("Safari", "Version", "Safari"), ("Safari", "Safari", ""),
]
_MARKS = [(label, marks.split(), also.split()) for label, marks, also in BROWSERS]
#: All tokens in one pattern, so that an agent is read once, whatever the number of browsers.
_TOKEN = re.compile(r"\b(" + "|".join(sorted({t.replace("_", " ") for _, marks, also in _MARKS for t in marks + also}, key=len, reverse=True)) + r")(?:[/ :]([0-9.]*))?(?![A-Za-z])")
_WEBVIEW = re.compile(r"\b(?:iPhone|iPad|iPod)\b.*\bMobile/")
#: Consoles and television sets, which count as desktops, by how their user agents name them: the first group is the client, the second its version.
_APPLIANCE = re.compile(r"\b(PlayStation Vita|PlayStation Portable|PlayStation [3-9]|Nintendo (?:Switch|Wii ?U?|3DS|DSi)|New Nintendo 3DS|InettvBrowser)\b[;/]? ?([0-9][0-9.]*)?", re.I)
_SPELT = {"playstation": "PlayStation", "nintendo": "Nintendo", "new": "New", "inettvbrowser": "InettvBrowser"}
#: Crawlers whose names say neither bot, crawler nor spider.
CRAWLERS = (
    "slurp|facebookexternalhit|facebookcatalog|mediapartners-google|feedfetcher-google|google-read-aloud|googleimageproxy|google-inspectiontool|apis-google|google favicon|bingpreview|ia_archiver|heritrix|nutch|"
    "yeti/|daum|ichiro|y!j-|embedly|quora link preview|outbrain|chrome-lighthouse|pingdom|uptimerobot|statuscake|phantomjs|archive\\.org|scrapy|zgrab|masscan|nessus|nikto|w3c_validator|skypeuripreview|vkshare|bitlybot|flipboardproxy|tumblr/"
)
_CRAWLER = re.compile(CRAWLERS, re.I)
_BOTTISH = re.compile(r"bot|crawler|spider", re.I)
#: Telephones by these names are no bots.
_NOT_BOTS = re.compile(r"cubot", re.I)
_VERSION = re.compile(r"(?:(?<![A-Za-z0-9.])|(?<=(?<![A-Za-z0-9])[vV]))\d++(?:\.\d++)++(?![A-Za-z0-9])")
_COMMENT = re.compile(r"\([^()]*\)")
_MOBILE = re.compile(r"\bMobile\b|Windows Phone|IEMobile|Opera M(?:ini|obi)|BlackBerry|BB10|KAIOS", re.I)


def find_version(text: str) -> str | None:
    """The first number of two or more dotted parts that stands by itself; one v before it is allowed."""
    m = _VERSION.search(text)
    return m[0] if m else None


def without_comments(agent: str) -> str:
    """The text outside parentheses."""
    while (shorter := _COMMENT.sub("", agent)) != agent:
        agent = shorter
    return re.sub(r"\(.*$", "", agent, flags=re.S).replace(")", "")


def has_word(text: str, words: str) -> bool:
    """Whether one of the words (joined by |) stands between characters that are no letters or digits."""
    return re.search(rf"(?<![a-z0-9])(?:{words})(?![a-z0-9])", text) is not None


def is_bot_name(name: str) -> bool:
    return _BOTTISH.search(name) is not None


def sniff_os(agent: str) -> str | None:
    low = agent.lower()
    return next((name for name, words in SYSTEMS if has_word(low, words) or (name == "macOS" and "mac os x" in low)), None)


def normal_os(label: str | None) -> str | None:
    """The family of a system's label; others as they are, UNKNOWN and empty ones none."""
    if not label or label.upper() == "UNKNOWN":
        return None
    return next((name for name, words in FAMILIES if re.match(words, label.lower())), label)


def product(agent: str) -> tuple[str | None, str | None]:
    """First product outside comments and its version, or else the first version outside comments."""
    depth = 0
    for token in agent.split():
        skipped = depth > 0 or "(" in token
        if skipped:
            depth = max(0, depth + token.count("(") - token.count(")"))
        if skipped or "://" in token:
            continue
        name, _, version = token.partition("/")
        name = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", name)
        if name and not re.fullmatch(r"[0-9.]+", name) and name.lower() not in STRUCTURAL:
            return name, find_version(version) or find_version(without_comments(agent))
    return None, None


def appliance(agent: str) -> tuple[str, str | None] | None:
    """Name and version of a console or television set."""
    if m := _APPLIANCE.search(agent):
        first, _, rest = m[1].partition(" ")
        return f"{_SPELT.get(first.lower(), first)} {rest}".strip(), m[2] or None
    return None


def browser(agent: str) -> tuple[str, str | None] | None:
    """Label and version of the browser whose tokens an agent holds."""
    found: dict[str, str] = {}
    for m in _TOKEN.finditer(agent):
        found.setdefault(m[1].replace(" ", "_"), (m[2] or "").strip("."))
    for label, marks, also in _MARKS:
        if all(t in found for t in also) and (mark := next((t for t in marks if found.get(t)), None)):
            return label, found[mark]
    return ("Webview", None) if _WEBVIEW.search(agent) else None


@lru_cache(maxsize=20_000)
def classify(agent: str) -> tuple[str | None, str | None, str | None, str]:
    """(app, version, os, kind); kind: Desktop, Mobile, App or Bot."""
    agent = agent.strip()
    if not agent:
        return None, None, None, "Bot"
    system = sniff_os(agent)
    crawler = _CRAWLER.search(agent)
    if crawler or (agent.startswith(("Mozilla/", "Opera/")) and is_bot_name(_NOT_BOTS.sub("", agent))):
        return (crawler[0].strip("/") if crawler else product(agent)[0]), None, system, "Bot"
    if console := appliance(agent):
        return *console, console[0], "Desktop"
    if agent.startswith(("Mozilla/", "Opera/")) and (known := browser(agent)):
        mobile = system in ("iOS", "Android") or _MOBILE.search(agent)
        return *known, system, "Mobile" if mobile else "Desktop"
    app, version = product(agent)
    nobody = is_bot_name(app) if app else system is None
    return app, version, system, "Bot" if nobody else "App"


def ua_classes(agents: str) -> Column:
    def made(agents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(a or "") for a in agents], columns=["app", "version", "os", "kind"])

    return F.pandas_udf(made, "struct<app:string,version:string,os:string,kind:string>")(agents)


def ua_parts(agents: str) -> Column:
    """The steps of the fallback by themselves: product, its version, system, text outside comments, first version in it, whether it names a bot."""

    def made(agents: pd.Series) -> pd.DataFrame:
        rows = [(*product(a), sniff_os(a), without_comments(a), find_version(a), is_bot_name(a)) for a in agents.fillna("")]
        return pd.DataFrame(rows, columns=["product", "version", "os", "outside", "number", "bot"])

    return F.pandas_udf(made, "struct<product:string,version:string,os:string,outside:string,number:string,bot:boolean>")(agents)


def os_family(labels: str) -> Column:
    """normal_os as a built-in expression."""
    c = F.col(labels)
    out = F.when(F.upper(c).isin("UNKNOWN", "") | c.isNull(), F.lit(None))
    for name, words in FAMILIES:
        out = out.when(F.lower(c).rlike(f"^(?:{words})"), name)
    return out.otherwise(c)


def url_fields(urls: str) -> Column:
    def made(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([host_and_path(u) for u in urls], columns=["host", "path"])

    return F.pandas_udf(made, "struct<host:string,path:string>")(urls)
