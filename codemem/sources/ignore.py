"""Ignore rules: pattern lines in the usual ``.gitignore`` syntax, compiled to anchored regexes.

The regexes use only syntax that Python, Java and RE2 share, so one compiled rule
serves the executor-side walk, the column form and a SQL check.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

class IgnoreRule(NamedTuple):
    ord: int
    pattern: str
    regex: str
    negated: bool
    dir_only: bool


# What the manual of the format gives a meaning, longest first; anything else stands for itself.
_TOKENS = re.compile(
    r"""
    (?P<folders>(?:^|(?<=/))\*\*(?:/\*\*)*/)    # any folders, or none
    | (?P<inside>(?:^|(?<=/))\*\*$)            # everything inside
    | (?P<name>(?:^|(?<=/))\*(?=/|$))          # any one name
    | (?P<some>\*+)                           # any characters of a name
    | (?P<one>\?)
    | (?P<escaped>\\.)
    | \[(?P<not>[!^]?)(?P<set>\]?[^\]/]*)\]    # a closing bracket at the front is a member
    | (?P<char>.)
    """,
    re.VERBOSE | re.DOTALL,
)
_IN_A_SET = str.maketrans({c: "\\" + c for c in "\\[]^"})


def _literal(char: str) -> str:
    return "\\" + char if char in r"\.^$*+?{}[]|()" else char


def _translate(token: re.Match) -> str:
    match token.lastgroup:
        case "folders":
            return "(?:.+/)?"
        case "inside":
            return ".*" if token.start() else ".+"
        case "name":
            return "[^/]+"
        case "some":
            return "[^/]*"
        case "one":
            return "[^/]"
        case "set":
            return f"[{'^' if token['not'] else ''}{token['set'].translate(_IN_A_SET)}]"
        case _:
            return _literal(token[0][-1])


def _without_end_blanks(line: str) -> str:
    line = line.rstrip("\r\n")
    bare = line.rstrip(" \t")
    # A backslash keeps one trailing blank.
    return line[: len(bare) + 1] if bare.endswith("\\") else bare


def compile_rule(ord_: int, line: str) -> IgnoreRule | None:
    """One pattern line, or None for a comment or a line without a name."""
    pattern = _without_end_blanks(line)
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    path = re.sub("/+", "/", pattern[negated:])
    name = path.strip("/")
    if not name:
        return None
    dir_only = path.endswith("/")
    # A slash that is not the last character ties the pattern to the top.
    anywhere = "" if "/" in path.removesuffix("/") else "(?:.+/)?"
    body = _TOKENS.sub(_translate, name)
    if name == "**" or name.endswith("/**"):
        below = ""
    else:
        below = "/.*" if dir_only else "(?:/.*)?"
    return IgnoreRule(ord_, pattern, f"(?s)^{'' if name == '**' else anywhere}{body}{below}$", negated, dir_only)


def compile_rules(pattern_lines: Iterable[str]) -> list[IgnoreRule]:
    rules: list[IgnoreRule] = []
    for line in pattern_lines:
        rule = compile_rule(len(rules), line)
        if rule:
            rules.append(rule)
    return rules


def ancestors_and_self(path: Column) -> Column:
    """``a/b/c`` → ``[a/, a/b/, a/b/c]``: every name the walk would have tested."""
    parts = F.split(path, "/")
    upto = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.when(i < F.size(parts), F.concat(upto(i), F.lit("/"))).otherwise(upto(i)),
    )


def matches_rules(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """True when the last rule that matches is not a negation."""
    verdict = None
    for rule in reversed(rules):
        test = path.rlike(rule.regex)
        verdict = F.when(test, not rule.negated) if verdict is None else verdict.when(test, not rule.negated)
    return F.lit(False) if verdict is None else verdict.otherwise(False)


def is_ignored(path: Column, rules: Sequence[IgnoreRule]) -> Column:
    """True when the file or any folder above it is ignored; a pruned folder hides all below it."""
    if not rules:
        return F.lit(False)
    return F.exists(ancestors_and_self(path), lambda p: matches_rules(p, rules))


# ---- rules as a table -----------------------------------------------------------------

RULES = "repo STRING, ord INT, pattern STRING, regex STRING, negated BOOLEAN"


def rule_rows(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``repo, ord, pattern, regex, negated``: the lines of each repository's rule file at its top.

    ``files(repo, path, content)`` is a scan.
    """

    @F.udf("array<struct<ord:int,pattern:string,regex:string,negated:boolean>>")
    def compiled(content):
        return [(r.ord, r.pattern, r.regex, r.negated) for r in compile_rules((content or "").split("\n"))]

    found = files.filter(F.col("path") == name).select("repo", compiled("content").alias("rules"))
    return found.select("repo", F.explode("rules").alias("r")).select("repo", "r.*")


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``repo, path`` of the files that their own repository's ``rules`` hide.

    Every different name, a file's or a folder's, is tested once against the rules of its repository: the
    last rule that matches it decides.  A folder that is hidden hides all below it.
    """
    named = files.select("repo", "path", F.explode(ancestors_and_self(F.col("path"))).alias("name"))
    names = named.select("repo", "name").distinct()
    tested = names.alias("n").join(rules.alias("r"), (F.col("n.repo") == F.col("r.repo")) & F.rlike(F.col("n.name"), F.col("r.regex")))
    verdicts = tested.groupBy("n.repo", "n.name").agg(F.max_by("r.negated", "r.ord").alias("shown"))
    hidden = verdicts.filter(~F.col("shown")).select("repo", "name")
    return named.join(hidden, ["repo", "name"], "left_semi").select("repo", "path").distinct()
