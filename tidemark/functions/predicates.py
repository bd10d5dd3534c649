"""Filters over the fact table with the service's rules for absent values.

Filters are made by calls and combined with &, | and ~; a text syntax is left to the caller. Every
filter knows which properties it refers to, which decides how visitors are counted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DASHBOARD = {
    "project": "source", "source": "source", "path": "pathname", "referrer": "referrer_host", "country": "country", "language": "language", "browser": "ua_browser", "version": "ua_version",
    "os": "ua_os", "device": "ua_device", "utm_source": "utm_source", "utm_medium": "utm_medium", "utm_campaign": "utm_campaign", "event": "event_name",
}
EXCEPTIONS = {
    "project": "source", "source": "source", "browser": "ua_browser", "version": "ua_version", "os": "ua_os", "device": "ua_device", "app": "source", "app_version": "app_version",
    "type": "exc_type", "message": "exc_message", "handled": "exc_handled",
}


_PARTS = re.compile(r"\\.|\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\]|\(\?(?:P?<\w+>|<?[=!]|>|[A-Za-z]*(?:-[A-Za-z]+)?[:)])|.", re.S)
_FLAGS = re.compile(r"\(\?([A-Za-z]*)(?:-([A-Za-z]+))?([:)])")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "digit": "Digit", "lower": "Lower", "upper": "Upper", "punct": "Punct", "space": "Space", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print"}


def java_pattern(pattern: str) -> str:
    """A pattern of the service's dialect (linear time, Unicode classes, $ at the very end) as a Java pattern; ValueError if it is none.

    Look-around, back-references, atomic groups and the flag U (which swaps greed there) are refused.
    """
    out = []
    lines, outer = False, []  # whether $ is the end of a line here, and was around the open groups
    for p in _PARTS.findall(pattern):
        flags = _FLAGS.fullmatch(p)
        if p[0] == "(" and not (flags and flags[3] == ")"):
            outer.append(lines)
        elif p == ")" and outer:
            lines = outer.pop()
        if flags:
            lines = "m" not in (flags[2] or "") and (lines or "m" in flags[1])
        if re.match(r"\(\?(?:<?[=!]|>)|\\[1-9kK]", p) or re.match(r"\(\?[A-Za-z]*U", p):
            raise ValueError("look-around, back-references, atomic groups and the flag U are not supported")
        if re.match(r"\(\?P?<", p):
            p = "("  # names do not matter for a search
        elif p == "$" and not lines:
            p = r"\z"
        elif p[0] == "[":
            p = _POSIX.sub(lambda m: f"\\{'P' if m[1] else 'p'}{{{_CLASSES.get(m[2], m[2])}}}", p)
        out.append(p)
    java = "(?Ud)" + "".join(out)
    spark = SparkSession.getActiveSession()
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except (Py4JJavaError, PySparkException) as e:
        raise ValueError(f"invalid pattern: {e}") from None
    return java


def is_event() -> Column:
    return F.col("kind").isin("pixel", "custom")


@dataclass(frozen=True)
class Filter:
    column: Column
    properties: frozenset

    def __and__(self, other: Filter) -> Filter:
        return Filter(self.column & other.column, self.properties | other.properties)

    def __or__(self, other: Filter) -> Filter:
        return Filter(self.column | other.column, self.properties | other.properties)

    def __invert__(self) -> Filter:
        """Plain NOT: a row whose value is absent stays out."""
        return Filter(~self.column, self.properties)

    def references(self, name: str) -> bool:
        return name in self.properties




class Fields:
    """Filter constructors over one vocabulary. projects: name and id -> source URIs, for `project`."""

    def __init__(self, names: dict[str, str], projects: dict[str, list[str]] | None = None, ids: dict[str, list[str]] | None = None):
        self.names, self.ids = names, ids or {}
        self.projects = {k.lower(): v for k, v in (projects or {}).items()}

    @classmethod
    def of_tables(cls, names: dict[str, str], projects: DataFrame, sources: DataFrame, pixels: DataFrame) -> Fields:
        """With every project's sources and pixels, from the entity tables (of which there are thousands of rows, not millions)."""
        owned = sources.select("project_id", "uri").unionByName(pixels.select("project_id", F.concat(F.lit("pixel://"), "id").alias("uri")))
        uris = owned.groupBy("project_id").agg(F.array_sort(F.collect_set("uri")).alias("uris"))
        rows = projects.select("id", "name").join(uris, F.col("id") == F.col("project_id"), "left").collect()
        return cls(names, {r.name: list(r.uris or []) for r in rows}, {r.id: list(r.uris or []) for r in rows})

    def _name(self, name: str) -> str:
        low = name.lower()
        if low not in self.names:
            raise ValueError(f"unknown field {name}; known: {', '.join(sorted(self.names))}")
        return low

    def _col(self, name: str) -> Column:
        return F.col(self.names[name])

    def _of(self, name: str, column: Column) -> Filter:
        return Filter(column, frozenset([name]))

    def _text(self, name: str) -> tuple[str, Column]:
        name = self._name(name)
        if name in ("project", "handled"):
            raise ValueError(f"{name} has no text operators")
        return name, self._col(name)

    @staticmethod
    def source_forms(value: str) -> list[str]:
        """A value without a scheme stands for all its schemes."""
        v = value.lower()
        return [v] if "://" in v else [f"https://{v}", f"app://{v}", f"pixel://{v}", v]

    def _uris(self, values) -> list[str]:
        out = []
        for v in values:
            out += self.projects.get(v.lower(), self.ids.get(v, []))
        return sorted(set(out))

    def eq(self, name: str, value) -> Filter:
        """Equal regardless of case. None: absent. "": absent or empty. Absent values never equal a text."""
        name = self._name(name)
        c = self._col(name)
        if name == "project":
            return self._of(name, c.isin(self._uris([value])))
        if value is None:
            return self._of(name, c.isNull())
        if name == "handled":
            return self._of(name, F.coalesce(c, F.lit(False)) == (value if isinstance(value, bool) else value.lower() == "true"))
        if not isinstance(value, str):
            raise ValueError("a text is needed")
        if value == "":
            empty = c.isNull() | (c == "")
            if "path" in self.names:
                empty = empty & (is_event() if name == "event" else ~is_event())
            return self._of(name, empty)
        if self.names[name] == "source":
            return self._of(name, F.lower(c).isin(self.source_forms(value)))
        return self._of(name, F.lower(c) == value.lower())

    def ne(self, name: str, value) -> Filter:
        """Not equal; absent values are unequal to any text. None and "": present."""
        name = self._name(name)
        c = self._col(name)
        if value is None:
            return self._of(name, c.isNotNull())
        if name == "project" or name == "handled":
            return ~self.eq(name, value)
        if value == "":
            return self._of(name, c.isNotNull() & (c != ""))
        return self._of(name, ~self.eq(name, value).column | c.isNull())

    def is_in(self, name: str, values: list[str], case: bool = False) -> Filter:
        name = self._name(name)
        c = self._col(name)
        if any(not isinstance(v, str) for v in values) or name == "handled":
            raise ValueError("a list of texts is needed")
        if name == "project":
            return self._of(name, c.isin(self._uris(values)))
        if self.names[name] == "source":
            return self._of(name, F.lower(c).isin([f for v in values for f in self.source_forms(v)]))
        return self._of(name, c.isin(values) if case else F.lower(c).isin([v.lower() for v in values]))

    def contains(self, name: str, value: str, case: bool = False) -> Filter:
        name, c = self._text(name)
        return self._of(name, c.contains(value) if case else F.lower(c).contains(value.lower()))

    def starts(self, name: str, value: str, case: bool = False) -> Filter:
        name, c = self._text(name)
        return self._of(name, c.startswith(value) if case else F.lower(c).startswith(value.lower()))

    def ends(self, name: str, value: str, case: bool = False) -> Filter:
        name, c = self._text(name)
        return self._of(name, c.endswith(value) if case else F.lower(c).endswith(value.lower()))

    def like(self, name: str, glob: str, case: bool = False) -> Filter:
        """* and ? as in file names, over the whole value."""
        name, c = self._text(name)
        body = "".join({"*": ".*", "?": "."}.get(x, re.sub(r"([\\.^$|()\[\]{}+*?\-])", r"\\\1", x)) for x in glob)
        return self._of(name, c.rlike(("(?d)" if case else "(?iud)") + rf"\A(?:{body})\z"))

    def matches(self, name: str, pattern: str) -> Filter:
        """Regular expression anywhere in the value; look-around and back-references are refused."""
        name, c = self._text(name)
        return self._of(name, c.rlike(java_pattern(pattern)))

    def truthy(self, name: str) -> Filter:
        name = self._name(name)
        if name == "project":
            raise ValueError("project needs a comparison")
        c = self._col(name)
        return self._of(name, F.coalesce(c, F.lit(False)) if name == "handled" else c.isNotNull() & (c != ""))


def where(df: DataFrame, f: Filter | None) -> DataFrame:
    return df if f is None else df.where(f.column)


def visitor_flag(f: Filter | None) -> str:
    """Visitors of a page if the filter names pages, else of the site."""
    return "is_unique_page" if f is not None and f.references("path") else "is_unique_user"
