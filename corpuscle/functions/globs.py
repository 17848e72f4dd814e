"""Path patterns as regular expressions.

``*`` takes any characters, slashes too; ``**/`` an optional run of folders; ``?`` one character but a slash; ``{a,b}``
decides for good: what stands before it is matched once, from the left, and not tried otherwise. ``[`` is a plain character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.+?/)??")
            i += 3
        elif pattern.startswith("*", i):
            i += 2 if pattern.startswith("**", i) else 1
            out.append(".*?")
        else:
            out.append("[^/]" if pattern[i] == "?" else re.escape(pattern[i]))
            i += 1
    return "".join(out)


def _alternatives(pattern: str) -> tuple[str, list[str], str] | None:
    """Before, choices and after of the first brace that closes."""
    a = pattern.find("{")
    b = pattern.find("}", a)
    if a < 0 or b < 0:
        return None
    return pattern[:a], pattern[a + 1 : b].split(","), pattern[b + 1 :]


def _body(pattern: str) -> str:
    parts = _alternatives(pattern)
    if parts is None:
        return _plain(pattern)
    before, choices, after = parts
    return f"(?>{_plain(before)})(?=.)(?:{'|'.join(_body(c + after) for c in choices)})"


def regex(pattern: str) -> str:
    return f"(?s)^{_body(pattern)}\\z"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(regex(pattern))


def matches_anywhere(path: Column, pattern: str) -> Column:
    """As ``matches``; a pattern without a slash is looked for in every folder."""
    return matches(path, pattern) if "/" in pattern else matches(path, pattern) | matches(path, "**/" + pattern)
