"""Text functions of ingest and display, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts that contain one of these are search engines, else social sites (fixed values, in this order).
SEARCH = ["google.", "bing.", "duckduckgo.", "yahoo.", "yandex.", "baidu.", "ecosia.", "brave.", "startpage.", "qwant."]
SOCIAL = ["facebook.", "twitter.", "x.com", "t.co", "linkedin.", "reddit.", "instagram.", "youtube.", "mastodon", "bsky.", "pinterest.", "tiktok.", "news.ycombinator.com", "lobste.rs", "threads."]

_SEG, _SEP = r"[A-Za-z0-9._~@+$\-]", r"[/\\]"
_ANY = r"[A-Za-z0-9._~@+$\-/\\]"
_TOKEN = r"[A-Za-z0-9_\-]"
_HEX = "[0-9A-Fa-f]"


def _s(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_unicode(x) -> Column:
    return F.regexp_replace(_s(x), r"(?U)^\s+|\s+$", "")


def filled(x) -> Column:
    """Absent values group under the empty string."""
    return F.coalesce(_s(x), F.lit(""))


def summary_line(x) -> Column:
    """First line that is not blank, trimmed; empty if there is none."""
    lines = F.transform(F.split(_s(x), r"\r?\n"), trim_unicode)
    return F.coalesce(F.get(F.filter(lines, lambda v: v != ""), F.lit(0)), F.lit(""))


def source_label(uri) -> Column:
    return F.regexp_replace(_s(uri), "^(https|http|app|pixel)://", "")


def source_scheme(uri) -> Column:
    return F.nullif(F.regexp_extract(_s(uri), "^(https|http|app|pixel)://", 1), F.lit(""))


def source_kind(uri) -> Column:
    """application for app://, else website."""
    return F.when(_s(uri).startswith("app://"), "application").otherwise("website")


def pixel_id(uri) -> Column:
    return F.when(_s(uri).startswith("pixel://"), F.substr(_s(uri), F.lit(9)))


def website_source(host) -> Column:
    return F.concat(F.lit("https://"), F.lower(F.regexp_replace(F.trim(_s(host)), r"\.$", "")))


def app_source(name) -> Column:
    return F.concat(F.lit("app://"), F.trim(_s(name)))


def pixel_source(pixel) -> Column:
    return F.concat(F.lit("pixel://"), _s(pixel))


def truncate(x, limit: int) -> Column:
    """At most `limit` UTF-8 bytes, cut between characters, with an ellipsis if anything was cut.

    Of n bytes at least n / 4 are characters, so only characters up to `limit` come into question;
    their running byte counts decide.
    """
    x = _s(x)
    chars = F.split(F.substring(x, 1, limit), "")
    step = lambda acc, c: F.struct((acc["n"] + F.octet_length(c)).alias("n"), F.when(acc["n"] + F.octet_length(c) <= limit, F.concat(acc["s"], c)).otherwise(acc["s"]).alias("s"))
    cut = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step)["s"]
    return F.when(F.octet_length(x) <= limit, x).when(F.octet_length(x) == F.length(x), F.concat(F.substring(x, 1, limit), F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))


def primary_language(header) -> Column:
    tag = F.trim(F.substring_index(F.substring_index(_s(header), ",", 1), ";", 1))
    tag = F.lower(F.substring_index(tag, "-", 1))
    return F.when(tag.rlike(r"^[a-z]+\z"), tag)


def normalize_path(path) -> Column:
    bare = F.regexp_replace(_s(path), r"/+\z", "")
    return F.when(bare == "", "/").otherwise(bare)


def _decode(x) -> Column:
    """A form value: plus signs are spaces, escapes are bytes of UTF-8, and a percent sign without two hexadecimal digits stands for itself."""
    whole = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), x)


def utm(url, name: str) -> Column:
    """Last non-blank value of a query parameter, decoded, trimmed and capped."""
    query = F.regexp_extract(F.substring_index(_s(url), "#", 1), r"(?s)\?(.*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: _decode(F.substring_index(p, "=", 1)) == name)
    values = F.transform(pairs, lambda p: trim_unicode(_decode(F.regexp_replace(p, "^[^=]*=?", ""))))
    found = F.filter(values, lambda v: v != "")
    return truncate(F.get(found, F.size(found) - 1), 256)


def clean_field(x, limit: int) -> Column:
    """Trimmed and capped; blank becomes null."""
    return truncate(F.nullif(trim_unicode(x), F.lit("")), limit)


def metadata_json(m, capped: bool = True) -> Column:
    """Key-sorted JSON text of a map; of at most 32 entries with capped keys and values, unless told otherwise. Empty is null."""
    entries = F.array_sort(F.map_entries(_s(m)))
    if capped:
        entries = F.transform(F.slice(entries, 1, 32), lambda e: F.struct(truncate(e["key"], 256).alias("key"), truncate(e["value"], 1024).alias("value")))
        # keys that were cut may be equal, and then are neighbours: the last stays
        after = F.concat(F.slice(entries, F.lit(2), F.size(entries)), F.array(F.lit(None).cast("struct<key:string,value:string>")))
        entries = F.filter(F.zip_with(entries, after, lambda e, x: F.when(~e["key"].eqNullSafe(x["key"]), e)), lambda e: e.isNotNull())
    return F.when(F.size(_s(m)) > 0, F.to_json(F.map_from_entries(entries)))


def slugify(name) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(_s(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "project").otherwise(bare)


def referrer_group(host) -> Column:
    """Substring match, search engines first."""
    any_of = lambda xs: "|".join(x.replace(".", r"\.") for x in xs)
    return F.when(_s(host).rlike(any_of(SEARCH)), "Search").when(_s(host).rlike(any_of(SOCIAL)), "Social")


#: Names of primary language tags (fixed values).
LANGUAGES = {
    "ar": "Arabic", "bg": "Bulgarian", "cs": "Czech", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "es": "Spanish", "et": "Estonian", "fi": "Finnish", "fr": "French", "he": "Hebrew", "hi": "Hindi",
    "hr": "Croatian", "hu": "Hungarian", "id": "Indonesian", "it": "Italian", "ja": "Japanese", "ko": "Korean", "lt": "Lithuanian", "lv": "Latvian", "nb": "Norwegian", "nl": "Dutch", "no": "Norwegian", "pl": "Polish",
    "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sk": "Slovak", "sl": "Slovenian", "sr": "Serbian", "sv": "Swedish", "th": "Thai", "tr": "Turkish", "uk": "Ukrainian", "vi": "Vietnamese", "zh": "Chinese",
}


def language_name(code) -> Column:
    """The name of a language tag's first part; the code where it has none."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.substring_index(F.lower(F.trim(_s(code))), "-", 1)), _s(code))


def country_flag(code) -> Column:
    """The two regional indicators of a country code; null for anything but two letters."""
    c = F.upper(F.trim(_s(code)))
    sign = lambda i: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(c, i, 1)) + 0x65))), "UTF-8")
    return F.when(c.rlike(r"\A[A-Z]{2}\z"), F.concat(sign(1), sign(2)))


def delta_percent(now, before) -> Column:
    return F.when(F.abs(_s(before)) > 2.220446049250313e-16, (_s(now) - _s(before)) / _s(before) * 100)


def version_label(app, version) -> Column:
    app, version = (F.nullif(filled(x), F.lit("")) for x in (app, version))
    return F.coalesce(F.when(app.isNotNull() & version.isNotNull(), F.concat_ws(" @ ", app, version)), app, version, F.lit("Unknown"))


def metadata_part(json, tags: bool) -> Column:
    """Entries of a JSON object with a key of up to 24 and a value of up to 32 characters are tags, the others context."""
    m = F.from_json(_s(json), "map<string,string>")
    short = lambda k, v: (F.length(k) <= 24) & (F.length(v) <= 32)
    return F.map_filter(m, short if tags else lambda k, v: ~short(k, v))


def status(last_seen, resolved_at, muted_at) -> Column:
    """ignored before resolved before unresolved; resolved holds while nothing was seen since."""
    return F.when(_s(muted_at).isNotNull(), "ignored").when(_s(last_seen) <= _s(resolved_at), "resolved").otherwise("unresolved")


# normalisers of exception text, in the order of their pipelines


def drop_query(x) -> Column:
    return F.substring_index(_s(x), "?", 1)


def strip_urls(x) -> Column:
    return F.regexp_replace(_s(x), "[A-Za-z]+://[^ \\t\\n\\r)\\]}>\"'`,;]*", "")


def base_paths(x) -> Column:
    """Path-like runs become their last segment: those of two separators, or of one before a name with a dot."""
    x = F.regexp_replace(_s(x), f"(?<!{_ANY})(?={_SEG}*{_SEP}{_SEG}*{_SEP})(?:{_ANY}*{_SEP})?({_SEG}+){_SEP}*(?!{_ANY})", "$1")
    x = F.regexp_replace(x, rf"(?<!{_ANY}){_SEG}*{_SEP}({_SEG}*\.{_SEG}*)(?!{_ANY})", "$1")
    return F.regexp_replace(x, rf"(?<!{_ANY})({_SEG}*\.{_SEG}*){_SEP}(?!{_ANY})", "$1")


def _tokens(x, body: str, mark: str) -> Column:
    return F.regexp_replace(x, f"(?<!{_TOKEN}){body}(?!{_TOKEN})", mark)


def mask_ids(x) -> Column:
    """UUIDs, hexadecimal addresses and long hexadecimal words."""
    x = _tokens(_s(x), f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}", "<uuid>")
    x = _tokens(x, f"0[xX]{_HEX}+", "<addr>")
    return _tokens(x, f"(?=[A-Fa-f]*[0-9]){_HEX}{{10,}}", "<hash>")


def strip_digits(x) -> Column:
    return F.regexp_replace(_s(x), "[0-9]", "")


def collapse(x) -> Column:
    return trim_unicode(F.regexp_replace(_s(x), r"(?U)\s+", " "))


def normal_message(x) -> Column:
    return collapse(strip_digits(mask_ids(F.lower(strip_urls(x)))))


def normal_frame(x) -> Column:
    return collapse(strip_digits(mask_ids(F.lower(base_paths(strip_urls(drop_query(x)))))))


def frames(stack) -> Column:
    """Normalised lines without blanks and without equal neighbours."""
    lines = F.filter(F.transform(F.split(_s(stack), r"\r?\n"), trim_unicode), lambda v: v != "")
    lines = F.filter(F.transform(lines, normal_frame), lambda v: v != "")
    pairs = F.zip_with(lines, F.slice(F.concat(F.array(F.lit(None).cast("string")), lines), F.lit(1), F.greatest(F.size(lines), F.lit(0))), lambda a, b: F.when(~a.eqNullSafe(b), a))
    return F.filter(pairs, lambda v: v.isNotNull())


def fingerprint(kind, message, stack, override=None) -> Column:
    """16 hex digits: of the trimmed override hashed once, else of type and frames (or message) hashed twice."""
    kind, message, stack = _s(kind), _s(message), _s(stack)
    top = F.array_join(F.transform(F.slice(frames(stack), 1, 5), lambda v: F.concat(v, F.lit("\n"))), "")
    body = F.when(trim_unicode(filled(stack)) != "", top).otherwise(normal_message(summary_line(filled(message))))
    text = F.concat(F.lower(trim_unicode(filled(kind))), F.lit("\n"), body)
    twice = F.substring(F.sha2(F.unhex(F.sha2(text, 256)), 256), 1, 16)
    if override is None:
        return twice
    own = trim_unicode(filled(override))
    return F.when(own != "", F.substring(F.sha2(own, 256), 1, 16)).otherwise(twice)
