"""String expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as white space when a string is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The default character classes that are removed from text.
# The named classes stand for the same characters (ASCII letters and digits, and
# WHITESPACE), and match several times faster than the characters spelled out.
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
SPECIAL = rf"[^\p{{Alnum}}{SPACE}]"
SPECIAL_KEEP_COLON = rf"[^\p{{Alnum}}{SPACE}:]"
# Text that reads as a number; guards casts, since a plain cast also takes "1d" or "1f".
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
WHOLE_NUMBER = r"^[+-]?\d{1,38}$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def strip_special(c: Column, pattern: str = SPECIAL) -> Column:
    return F.regexp_replace(c, pattern, "")


def reencode(c: Column, encoding: str = "UTF-8") -> Column:
    """Read the UTF-8 bytes of the text as another encoding; valid UTF-8 is unchanged."""
    if encoding.upper().replace("-", "") == "UTF8":
        return c
    return F.decode(F.encode(c, "UTF-8"), encoding)


def strip_affixes(c: Column, prefix: str = "", suffix: str = "") -> Column:
    out = c
    if prefix:
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 2**31 - 1)).otherwise(out)
    if suffix:
        keep = F.length(out) - len(suffix)
        out = F.when(out.endswith(suffix), F.substring(out, F.lit(1), keep)).otherwise(out)
    return out


def to_number(c: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def duration_seconds(c: Column) -> Column:
    """``h:m:s``, ``m:s`` or ``s`` to seconds; anything else becomes null."""
    parts = F.transform(F.split(c.cast("string"), ":"), to_number)
    weights = {1: (1,), 2: (60, 1), 3: (3600, 60, 1)}
    out = None
    for size, factors in weights.items():
        total = sum((F.get(parts, F.lit(i)) * f for i, f in enumerate(factors)), F.lit(0.0))
        out = (F if out is None else out).when(F.size(parts) == size, total)
    return out


def resolution_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^\dx]", "")


def extract_first(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a capture group, null when the pattern does not match."""
    pattern = java_pattern(pattern)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def java_pattern(pattern: str) -> str:
    """Plain groups in place of ``(?P<name>...)``, which Java does not read."""
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def group_names(pattern: str) -> list[str]:
    index = re.compile(pattern).groupindex
    return sorted(index, key=index.get)


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(lowered, F.lit(word))
    return out


def count_words(lowered: Column, words: Sequence[str]) -> Column:
    """Non-overlapping occurrences of the words, anywhere in the text."""
    total = F.lit(0)
    for word in words:
        gone = F.length(lowered) - F.length(F.replace(lowered, F.lit(word), F.lit("")))
        total = total + F.floor(gone / len(word)).cast("int")
    return total
