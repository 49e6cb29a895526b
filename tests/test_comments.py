from codemem.operators import comments as cm


def log(frame, path, content):
    rows = cm.comment_logs(frame([(path, content)], "path STRING, content STRING")).collect()
    assert len(rows) <= 1
    return rows[0].text.split("\n")[1:] if rows else []


def test_hash_comments_and_docstrings(frame):
    content = (
        "# NOTE: helpers\nimport time\n\ndef f(x):\n    \"\"\"\n    Cleans input.\n    \"\"\"\n    # TODO: more formats\n"
        "    s = '# fixme in a string'\n    return x  # plain\n'''single'''\n\"\"\"\"\"\"\n"
    )
    assert log(frame, "u.py", content) == [
        "Line 1: NOTE: helpers",
        "Line 8: TODO: more formats",
        "Line 9: fixme in a string'",
        "Docstring: Cleans input.",
        "Docstring: single",
    ]


def test_docstring_keeps_inner_lines(frame):
    rows = cm.comments(frame([("d.py", '"""\n  First.\n\n    Second.\n"""')], "path STRING, content STRING")).collect()
    assert [(r.kind, r.line, r.text) for r in rows] == [("docstring", None, "First.\n\n    Second.")]


def test_tags_are_whole_words_in_any_case(frame):
    lines = ["# todo a", "# TODOs b", "# xTODO c", "# TODO_d", "# éTODO e", "# (Bug) f", "# adr-7 g", "# TODOé"]
    assert log(frame, "t.sh", "\n".join(lines)) == ["Line 1: todo a", "Line 6: (Bug) f", "Line 7: adr-7 g"]


def test_line_numbers_follow_every_line_break(frame):
    assert log(frame, "t.yml", "a\x0cb\u2028c\r\n# HACK d") == ["Line 4: HACK d"]


def test_slash_and_block_comments(frame):
    content = 'u = "http://x"; // FIXME link\n/* NOTE one\n * ** BUG two\n ** plain\n */ /* no */\n//   WARNING late'
    assert log(frame, "a.ts", content) == [
        'Line 1: x"; // FIXME link',
        "Line 6: WARNING late",
        "Block Comment: NOTE one",
        "Block Comment: ** BUG two",
    ]


def test_markup_comments(frame):
    content = "TODO outside\n<!-- TODO in\n bug two\n none -->\n<!-- x --><!-- HACK -->"
    assert log(frame, "r.md", content) == ["HTML Comment: TODO in", "HTML Comment: bug two", "HTML Comment: HACK"]


def test_other_suffixes_have_no_comments(frame):
    for path in ("a.toml", "b.json", "c.txt", "Makefile", "d.bat"):
        assert log(frame, path, "# TODO x // TODO y <!-- TODO z -->") == []
