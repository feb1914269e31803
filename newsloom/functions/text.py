"""Text normalisation as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the web's text tools see it; Java's \s knows ASCII only. Printable ASCII, most of a text, is told apart by one range.
SPACE = r"[[^!-~]&&[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]+"
#: The white space of ASCII but for the space, and a wide range that holds all other white space: what is looked for before a text is searched by patterns.
BREAKS, BEYOND = "\t\n\x0b\f\r", r"[\u00A0\u1680-\uFFFF]"
#: ASCII word boundaries; Java's \b counts accented letters as word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The five references that are decoded, in order.
REFERENCES = [("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "'")]


def _where(test: Callable[[Column], Column], value: Column, change: Callable[[Column], Column]) -> Column:
    """change(value) where the value passes the test, else the value."""
    # bound once, so the text that `value` makes is not made again for each branch
    return F.transform(F.array(value), lambda v: F.when(test(v), change(v)).otherwise(v))[0]


def _where_held(mark: str, value: Column, change: Callable[[Column], Column]) -> Column:
    """A look for one plain text costs a tenth of a pattern's, and most texts hold none of what the patterns change."""
    return _where(lambda v: v.contains(mark), value, change)


def _beyond_ascii(value: Column) -> Column:
    return F.octet_length(value) > F.length(value)


def whitespace(value: Column) -> Column:
    """Tags become spaces, a few character references are decoded, white space is collapsed and trimmed; null is empty."""

    def decoded(v: Column) -> Column:
        for pattern, mark in REFERENCES:
            v = F.regexp_replace(v, pattern, mark)
        return v

    out = _where_held("<", F.coalesce(value, F.lit("")), lambda v: F.regexp_replace(v, "<[^>]*>", " "))
    out = _where_held("&", out, decoded)
    for c in BREAKS:
        out = _where_held(c, out, lambda v, c=c: F.replace(v, F.lit(c), F.lit(" ")))
    out = _where(lambda v: _beyond_ascii(v) & v.rlike(BEYOND), out, lambda v: F.regexp_replace(v, SPACE, " "))
    return F.trim(_where_held("  ", out, lambda v: F.regexp_replace(v, "  +", " ")))


@cache
def _folds() -> tuple[str, str]:
    """Characters of the basic plane whose canonical decomposition is one character and marks, and that character."""
    pairs = []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        plain = [x for x in unicodedata.normalize("NFD", c) if not "\u0300" <= x <= "\u036f"] if not 0xD800 <= code < 0xE000 else []
        if len(plain) == 1 and plain[0] != c:
            pairs.append((c, plain[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(value: Column) -> Column:
    """Without combining accents, lower case. Plain ASCII text is not looked up character by character."""
    bare = lambda v: _where(_beyond_ascii, F.translate(v, *_folds()), lambda x: F.regexp_replace(x, r"[\u0300-\u036F]", ""))
    return F.lower(_where(_beyond_ascii, value, bare))


def for_match(value: Column) -> Column:
    """`whitespace`, then unaccented lower case: the form that rules are matched against."""
    return unaccented(whitespace(value))


def shortened(value: Column, most: int) -> Column:
    """At most `most` characters; a cut text ends in an ellipsis."""
    text = whitespace(value)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - 1))), F.lit("…")))


def printable(value: Column) -> Column:
    """Control characters become spaces; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\u0000-\u001f\u007f]", " "))


def inline(value: Column) -> Column:
    """One line without the characters that messengers read as emphasis."""
    return F.trim(F.regexp_replace(F.regexp_replace(printable(value), "[*_~`]", ""), SPACE, " "))


def filled(*values: Column) -> Column:
    """The first value that is neither null nor empty; else the empty text."""
    return F.coalesce(*[F.when(v != "", v) for v in values], F.lit(""))
