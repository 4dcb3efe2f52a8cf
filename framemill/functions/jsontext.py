"""JSON that arrives as text: quoted, escaped, fenced or otherwise marked up."""

from __future__ import annotations

import html
import json
import re

#: Characters that carry no content: byte-order mark, zero-width characters, soft hyphen.
INVISIBLE = "﻿​‌‍⁠­"
_TAG = re.compile(r"^\s*<([A-Za-z][\w-]*)[^<>]*>(.*)</\1\s*>\s*$", re.S)
_DECODER = json.JSONDecoder()

#: Layers of mark-up around a value after which it is taken as text. Quoting doubles the signs of a text each time, so none is quoted so often.
MAX_DEPTH = 100


def _load(text: str):
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _unfenced(text: str) -> str | None:
    """What stands between a code fence that begins the text and the one that ends it."""
    fence = text[:3]
    if fence not in ("```", "~~~") or len(text) < 6 or not text.endswith(fence):
        return None
    head, newline, rest = text[3:-3].partition("\n")
    if newline and re.fullmatch(r"[\w+-]*", head.strip()):
        return rest
    return text[3:-3]


def _readings(text: str):
    """The text itself, then without one layer of quoting or mark-up, most literal first."""
    yield text
    if (inside := _unfenced(text)) is not None:
        yield inside
    if text[0] == "<" and (m := _TAG.match(text)):
        yield m[2]
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'`":
        yield text.strip(text[0])
    if '\\"' in text and not (text[0] == text[-1] == '"'):
        yield f'"{text}"'
    if "&quot;" in text or "&#34;" in text:
        yield html.unescape(text)


def parse(text: str | None, depth: int = MAX_DEPTH):
    """(True, value) of JSON in any of these dresses, (False, None) where it is incomplete or no JSON.

    A text that parses to a string is read again, so that JSON inside a JSON string counts; a
    string whose content is no JSON is not JSON. An object between other words is accepted where
    the words hold no brace.
    """
    if text is None or depth <= 0:
        return False, None
    text = text.strip(INVISIBLE + " \t\r\n\f\v")
    if not text:
        return False, None
    for reading in _readings(text):
        ok, value = _load(reading.strip())
        if not ok and reading is not text:
            ok, value = parse(reading, depth - 1)
        if ok:
            return parse(value, depth - 1) if isinstance(value, str) else (True, value)
    start = text.find("{")
    if start > 0 or (start == 0 and not text.endswith("}")):
        try:
            value, end = _DECODER.raw_decode(text, start)
        except (ValueError, RecursionError):
            return False, None
        if "{" not in text[end:] and "}" not in text[end:]:
            return True, value
    return False, None


def is_blank(value) -> bool:
    """Null, blank text (invisible characters count as blank), or an empty array or object."""
    if value is None:
        return True
    if isinstance(value, str):
        return not value.strip(INVISIBLE + " \t\r\n\f\v 　")
    return isinstance(value, (list, dict)) and not value
