"""String columns shared by all operators.

Whitespace, line breaks and word boundaries follow Python's Unicode rules, which
differ from Java's regex shorthands, so they are spelled out as character classes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() and str.split() treat as white space.
ASCII_WS = r"\x09-\x0d\x1c-\x20"
WS_CLASS = ASCII_WS + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CLASS}]"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The breaks Python's str.splitlines() recognises.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
ASCII_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]"

# First bytes, in UTF-8, of every white space character beyond ASCII.
_WIDE_WS_BYTES = ("C285", "C2A0", "E19A80", "E280", "E2819F", "E38080")

# Secret shapes, in the order they are applied, and the mark put in their place.
SECRET_PATTERNS = {
    "sk": r"sk-[a-zA-Z0-9]{48}",
    "gsk": r"gsk_[a-zA-Z0-9]{52}",
    "ghp": r"ghp_[a-zA-Z0-9]{36}",
    "google": r"AIzaSy[a-zA-Z0-9_-]{35}",
    "assignment": (
        r"(?iu)(?:api_key|api_secret|secret_key|password|passwd|token)"
        + WS + r"*=" + WS + r"*[\"'][^\"']{8,}[\"']"
    ),
}
SECRET_MARK = "[REDACTED_SECRET]"

# A literal every match of the pattern must contain: a cheap test before the regex.
_SECRET_GUARDS = {"sk": "sk-", "gsk": "gsk_", "ghp": "ghp_", "google": "AIzaSy", "assignment": "="}
# An assignment also needs one of these in lower case.  The long s folds to "s" in a regex
# that ignores case, but has no lower-case form of its own.
_NAME_PARTS = ("api_key", "api_secret", "secret_key", "passw", "token", "\u017f")

MIN_CONTENT_CHARS = 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def by_ws(text: Column, plain: Column, wide: Column) -> Column:
    """``plain`` for texts whose white space is all ASCII, ``wide`` for the others.

    A class with the wide characters costs Java ten tests per letter; a byte search
    for them is nearly free, and few texts hold any.
    """
    raw = text.cast("binary")
    has_wide = F.lit(False)
    for head in _WIDE_WS_BYTES:
        has_wide = has_wide | F.contains(raw, F.unhex(F.lit(head)))
    return F.when(has_wide, wide).otherwise(plain)


def normalize_ws(text: Column) -> Column:
    """Key for near-literal copies: stripped, lower-cased, runs of white space made one blank."""
    low = F.lower(strip_ws(text))
    # Single blanks are left alone: they need no replacing.
    plain = F.regexp_replace(low, rf"[\x09-\x0d\x1c-\x1f][{ASCII_WS}]*| [{ASCII_WS}]+", " ")
    return by_ws(text, plain, F.regexp_replace(low, f"{WS}+", " "))


def split_lines(text: Column) -> Column:
    """Lines of a text; one that ends with a break has a last empty line."""
    return by_ws(text, F.split(text, ASCII_LINE_BREAK), F.split(text, LINE_BREAK))


def lines(text: Column) -> Column:
    """Lines of a text without a last empty one."""
    return let(
        split_lines(text),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def universal_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def is_substantial(text: Column, min_chars: int = MIN_CONTENT_CHARS) -> Column:
    """Whether enough is left after stripping; most texts show it in their first characters."""
    enough = lambda t: F.length(strip_ws(t)) >= min_chars
    return enough(F.left(text, F.lit(4 * min_chars))) | enough(text)


def redact(text: Column) -> Column:
    """Replace secrets; each pattern sees the output of the one before it.

    The mark holds none of the guard literals, so testing the original text is
    enough, and texts without a candidate never reach a regex.
    """
    literal_keys = [k for k in SECRET_PATTERNS if k != "assignment"]
    has_literal = F.lit(False)
    tokens_gone = text
    for key in literal_keys:
        has_literal = has_literal | F.contains(text, F.lit(_SECRET_GUARDS[key]))
        tokens_gone = F.regexp_replace(tokens_gone, SECRET_PATTERNS[key], SECRET_MARK)
    tokens_gone = F.when(has_literal, tokens_gone).otherwise(text)
    names = lambda low: reduce(or_, [F.contains(low, F.lit(part)) for part in _NAME_PARTS])
    assigned = F.contains(text, F.lit(_SECRET_GUARDS["assignment"])) & F.exists(F.array(F.lower(text)), names)
    return F.when(
        assigned, F.regexp_replace(tokens_gone, SECRET_PATTERNS["assignment"], SECRET_MARK)
    ).otherwise(tokens_gone)


def secret_hits(text: Column) -> dict[str, Column]:
    """Hits of each pattern on the text the earlier patterns left behind."""
    hits, current = {}, text
    for key, pattern in SECRET_PATTERNS.items():
        counted = F.regexp_count(current, F.lit(pattern))
        hits[key] = F.when(F.contains(text, F.lit(_SECRET_GUARDS[key])), counted).otherwise(F.lit(0))
        current = F.regexp_replace(current, pattern, SECRET_MARK)
    return hits


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix of the base name; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s).(\.[^.]+)$", 1))
