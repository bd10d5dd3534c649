"""Host and path of a URL by the rules of the URL Standard (https://url.spec.whatwg.org)."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote_to_bytes

SPECIAL = {"http", "https", "ws", "wss", "ftp", "file"}
_DOT, _DOTS = {".", "%2e"}, {"..", ".%2e", "%2e.", "%2e%2e"}
#: Code points that no domain may have, by the standard.
_FORBIDDEN = set("\0\t\n\r #/<>?@[\\]^|:%") | {chr(i) for i in range(0x20)} | {"\x7f"}
_ESCAPED = set(' "<>`#?{}')
#: Fixed values of UTS 46: characters whose old and new mappings differ, joiners, full stops, and what is left out.
_DEVIATIONS, _JOINERS, _STOPS = "ßς\u200c\u200d", "\u200c\u200d", ".\u3002\uff0e\uff61"
_IGNORED = {0xAD, 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x200B, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x3164, 0xFEFF, 0xFFA0}
_IGNORED_RANGES = [(0x180B, 0x180F), (0x206A, 0x206F), (0xFE00, 0xFE0F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0100, 0xE01EF)]


def _escape(text: str, also: set[str]) -> str:
    return "".join(c if " " <= c <= "~" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _number(part: str) -> int | None:
    """A part of an IPv4 address: decimal, octal after 0, hexadecimal after 0x."""
    low = part.lower()
    base, digits = (16, low[2:]) if low.startswith("0x") else (8, low[1:]) if len(low) > 1 and low[0] == "0" else (10, low)
    if not digits:
        return 0 if base == 16 else None
    try:
        return int(digits, base) if digits.isalnum() and digits.isascii() else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """The address, None if it is none; ValueError if it must be one and is wrong."""
    parts = host.removesuffix(".").split(".")
    if not (parts[-1].isdigit() and parts[-1].isascii()) and _number(parts[-1]) is None or not parts[-1]:
        return None
    if not (parts[-1][0].isdigit()):
        return None
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        raise ValueError(host)
    total = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(total))


def _ignored(o: int) -> bool:
    return o in _IGNORED or any(a <= o <= b for a, b in _IGNORED_RANGES)


@lru_cache(maxsize=20_000)
def _mapped(c: str) -> str:
    """What one character becomes: compatibility forms and case are folded, but for the characters that only differ between the old and new protocol."""
    if c in _DEVIATIONS:
        return c
    if c in _STOPS:
        return "."
    if c == "\u1e9e":
        return "ß"
    if _ignored(ord(c)):
        return ""
    out = unicodedata.normalize("NFKC", c)
    for _ in range(2):  # folding can give what normalises further, and again
        out = unicodedata.normalize("NFKC", out.casefold())
    if set(out) & set(_STOPS):
        raise ValueError(f"{c!r} holds a full stop")
    return out


def _valid_label(label: str) -> bool:
    """Whether the code points of a mapped label may stand in it, beside the rules for joiners and for both directions."""
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        return False
    for i, c in enumerate(label):
        if c in _JOINERS:
            # behind a virama; a non-joiner also between letters that join, which Arabic script has
            arabic = c == _JOINERS[0] and 0 < i < len(label) - 1 and {unicodedata.bidirectional(label[i - 1]), unicodedata.bidirectional(label[i + 1])} == {"AL"}
            if not arabic and (i == 0 or unicodedata.combining(label[i - 1]) != 9):
                return False
        elif not c.isascii() and (unicodedata.category(c) in ("Cc", "Cf", "Cs", "Co", "Cn", "Zs", "Zl", "Zp") or 0x2FF0 <= ord(c) <= 0x2FFF or c in "\u31ef\ufffc\ufffd"):
            return False
    return True


def _valid_directions(label: str) -> bool:
    """The rule of RFC 5893 for a label of a domain in which some label runs from right to left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    ends = [k for k in kinds if k != "NSM"][-1:]
    if kinds[0] in ("R", "AL"):
        return set(kinds) <= {"R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and ends[0] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)
    return kinds[0] == "L" and set(kinds) <= {"L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"} and ends[0] in ("L", "EN")


def to_ascii(name: str) -> str:
    """A domain's ASCII form by UTS 46 without transitional mapping, as the URL Standard asks; ValueError for one that has none.

    SQL cannot call the JVM's own implementation, as it has no static method for it; java.net.IDN
    and Python's codec are of 2003, which makes other domains of some names.
    """
    name = unicodedata.normalize("NFC", "".join(map(_mapped, name)))
    labels, out = name.split("."), []
    for i, label in enumerate(labels):
        if label.startswith("xn--"):
            plain = label[4:].encode("ascii").decode("punycode") if len(label) > 4 else ""
            if plain.isascii() or unicodedata.normalize("NFC", "".join(map(_mapped, plain))) != plain:
                raise ValueError(name)
            labels[i], shown = plain, label
        else:
            shown = label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")
        out.append(shown)
    if not all(_valid_label(x) for x in labels if x):
        raise ValueError(name)
    both = any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for x in labels for c in x)
    if both and not all(_valid_directions(x) for x in labels if x):
        raise ValueError(name)
    return ".".join(out)


def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        return f"[{ipaddress.IPv6Address(text[1:-1] if text.endswith(']') else '')}]"
    if not special:
        if set(text) & (_FORBIDDEN - {"%"}):
            raise ValueError(text)
        return _escape(text, set())
    name = to_ascii(unquote_to_bytes(text).decode("utf-8"))
    if not name or set(name) & _FORBIDDEN:
        raise ValueError(text)
    return _ipv4(name) or name


def _path(text: str, special: bool) -> str:
    if special:
        text = text.replace("\\", "/")
    if not text:
        return "/" if special else ""
    out: list[str] = []
    parts = text.split("/")[1:]
    for i, part in enumerate(parts):
        low, last = part.lower(), i == len(parts) - 1
        if low in _DOTS:
            del out[-1:]
        elif low not in _DOT:
            out.append(_escape(part, _ESCAPED))
            continue
        if last:
            out.append("")
    return "/" + "/".join(out)


@lru_cache(maxsize=20_000)
def host_and_path(url: str | None) -> tuple[str | None, str | None]:
    """(host in lower case without leading www., path) of an absolute URL; nulls where it is invalid or has no host."""
    text = re.sub(r"[\t\n\r]", "", (url or "").strip("".join(map(chr, range(0x21)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):(.*)\Z", text, re.S)
    if not m:
        return None, None
    scheme, rest = m[1].lower(), re.sub(r"#.*", "", m[2], flags=re.S)
    special = scheme in SPECIAL
    if special and scheme != "file":
        rest = rest.lstrip("/\\")
    elif rest.replace("\\", "/")[:2] == "//" if special else rest[:2] == "//":
        rest = rest[2:]
    else:
        return None, None
    at = re.search(r"[/\\?]" if special else r"[/?]", rest)
    authority, tail = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    named = authority.rpartition("@")[2]
    port = re.search(r":([^\]:]*)\Z", named)
    try:
        if port:
            if port[1] and not (port[1].isascii() and port[1].isdigit() and int(port[1]) < 65536):
                return None, None
            named = named[: port.start()]
        host = _host(named, special)
    except (ValueError, UnicodeError):
        return None, None
    while host.startswith("www."):
        host = host[4:]
    if not host:
        return None, None
    return host.lower(), _path(tail.partition("?")[0], special)
