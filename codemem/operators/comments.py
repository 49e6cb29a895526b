"""Tagged comments and docstrings.

All records of a file are computed as one array inside its row: the per-file log
is a projection, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codemem.functions import text as tx
from codemem.operators.symbols import rows_of
from codemem.schema import COMMENT

# Developer tags and the suffixes of each comment style.
TAGS = ("TODO", "FIXME", "NOTE", "BUG", "HACK", "WARNING", "ADR", "DEPRECATED")
HASH_SUFFIXES = (".py", ".sh", ".yaml", ".yml", ".ini")
SLASH_SUFFIXES = (".js", ".ts", ".jsx", ".tsx", ".c", ".cpp", ".h", ".go", ".java", ".rs", ".css")
MARKUP_SUFFIXES = (".html", ".htm", ".xml", ".md")

# Text put before a record of each kind.
LABELS = {"line": "Line ", "docstring": "Docstring: ", "block": "Block Comment: ", "html": "HTML Comment: "}

# A word in Python's sense ends where no letter, digit or underscore follows.
_WORD = r"[\p{L}\p{N}_]"


def tag_pattern(tags: Sequence[str] = TAGS) -> str:
    return rf"(?iu)(?<!{_WORD})(?:{'|'.join(tags)})(?!{_WORD})"


def has_tag(text: Column, tags: Sequence[str] = TAGS) -> Column:
    return text.rlike(tag_pattern(tags))


def _record(kind: str, line: Column | None, ord_: Column, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.lit(None) if line is None else line).cast("int").alias("line"),
        ord_.cast("int").alias("ord"),
        text.alias("text"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{COMMENT}>")


def _numbered(kind: str, texts: Column) -> Column:
    return F.transform(texts, lambda t, i: _record(kind, None, i, t))


def _line_comments(content: Column, marker: str, tags: Sequence[str]) -> Column:
    """Text after the first marker of each line, kept when tagged."""
    # "." in Java stops at more line ends than the split does; [^\n] stops at none that is left.
    body = lambda line: tx.strip_ws(F.regexp_extract(line, rf"{marker}{tx.WS}*([^\n]*)", 1))
    candidates = F.transform(
        tx.split_lines(content), lambda line, i: F.struct((i + 1).alias("n"), line.alias("l"))
    )
    candidates = F.filter(candidates, lambda c: F.contains(c["l"], F.lit(marker)))
    records = F.transform(candidates, lambda c: _record("line", c["n"], c["n"], body(c["l"])))
    kept = F.filter(records, lambda r: has_tag(r["text"], tags))
    # A file without the marker or without any tag never gets split.
    return F.when(F.contains(content, F.lit(marker)) & has_tag(content, tags), kept).otherwise(_none())


def hash_comments(content: Column, tags: Sequence[str] = TAGS) -> Column:
    return _line_comments(content, "#", tags)


def slash_comments(content: Column, tags: Sequence[str] = TAGS) -> Column:
    return _line_comments(content, "//", tags)


def docstring_comments(content: Column) -> Column:
    """Every triple-quoted text, tagged or not: double quotes first, then single quotes."""
    quoted = lambda q: F.regexp_extract_all(content, F.lit(f"(?s){q}(.*?){q}"), F.lit(1))
    both = F.concat(quoted('"""'), quoted("'''"))
    texts = F.filter(F.transform(both, tx.strip_ws), lambda t: t != "")
    has_quotes = F.contains(content, F.lit('"""')) | F.contains(content, F.lit("'''"))
    return F.when(has_quotes, _numbered("docstring", texts)).otherwise(_none())


def _block_lines(content: Column, pattern: str, clean) -> Column:
    blocks = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    return F.transform(F.flatten(F.transform(blocks, tx.split_lines)), clean)


def block_comments(content: Column, tags: Sequence[str] = TAGS) -> Column:
    star_less = lambda l: tx.strip_ws(F.ltrim(tx.strip_ws(l), F.lit("*")))
    tagged = F.filter(_block_lines(content, r"(?s)/\*(.*?)\*/", star_less), lambda t: has_tag(t, tags))
    return F.when(
        F.contains(content, F.lit("/*")) & has_tag(content, tags), _numbered("block", tagged)
    ).otherwise(_none())


def html_comments(content: Column, tags: Sequence[str] = TAGS) -> Column:
    tagged = F.filter(_block_lines(content, r"(?s)<!--(.*?)-->", tx.strip_ws), lambda t: has_tag(t, tags))
    return F.when(
        F.contains(content, F.lit("<!--")) & has_tag(content, tags), _numbered("html", tagged)
    ).otherwise(_none())


def comment_records(path: Column, content: Column, tags: Sequence[str] = TAGS) -> Column:
    """All records of a file in order; other suffixes have none."""
    ext = tx.suffix(path)
    return (
        F.when(ext.isin(*HASH_SUFFIXES), F.concat(hash_comments(content, tags), docstring_comments(content)))
        .when(ext.isin(*SLASH_SUFFIXES), F.concat(slash_comments(content, tags), block_comments(content, tags)))
        .when(ext.isin(*MARKUP_SUFFIXES), html_comments(content, tags))
        .otherwise(_none())
    )


def record_text(record: Column) -> Column:
    """``Line 3: …``, ``Docstring: …``, ``Block Comment: …`` or ``HTML Comment: …``."""
    numbered = F.concat(F.lit(LABELS["line"]), record["line"].cast("string"), F.lit(": "))
    label = F.when(record["kind"] == "line", numbered)
    for kind in ("docstring", "block", "html"):
        label = label.when(record["kind"] == kind, F.lit(LABELS[kind]))
    return F.concat(label, record["text"])


def comments(
    files: DataFrame,
    keys: Sequence[str] = ("path",),
    path: str = "path",
    content: str = "content",
    tags: Sequence[str] = TAGS,
) -> DataFrame:
    """One row per record: keys, kind, line, ord, text."""
    found = files.select(*keys, comment_records(F.col(path), F.col(content), tags).alias("records"))
    return rows_of(found, "records", "r").select(*keys, "r.*")


def comment_logs(
    files: DataFrame,
    keys: Sequence[str] = ("path",),
    path: str = "path",
    content: str = "content",
    tags: Sequence[str] = TAGS,
) -> DataFrame:
    """One text per file with records: a path line, then the records."""
    found = files.select(*keys, comment_records(F.col(path), F.col(content), tags).alias("records"))
    body = F.array_join(F.transform("records", record_text), "\n")
    # Fixed value: the path line.
    text = F.concat(F.lit("File Path: "), F.col(path), F.lit("\n"), body)
    logs = found.select(*keys, F.when(F.size("records") > 0, F.array(text)).alias("logs"))
    return rows_of(logs, "logs", "text")
