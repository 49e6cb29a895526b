import pytest
from pyspark.sql import functions as F

from codemem.operators import files as fi
from codemem.sources.ignore import compile_rules, rule_rows


def kept(frame, paths, operator):
    return {r["path"] for r in operator(frame([(p,) for p in paths], "path STRING")).collect()}


def test_ignored_folders_at_any_depth_but_not_file_names(frame):
    paths = ["src/build/x.py", "src/build", "a/.git/config", "node_modules/p/i.js", "Build/x.py", "env.py", "a/b.py"]
    assert kept(frame, paths, fi.outside_ignored_dirs) == {"src/build", "Build/x.py", "env.py", "a/b.py"}


def test_text_files(frame):
    paths = ["a.PY", ".gitignore", "d/.env.example", ".env", "dockerfile", "x/Dockerfile", "x.tsx", "gitignore", "a.py/b", "LICENSE"]
    assert kept(frame, paths, fi.text_files) == {"a.PY", ".gitignore", "d/.env.example", "x/Dockerfile", "gitignore", "LICENSE"}


@pytest.mark.parametrize(
    "lines, ignored, not_ignored",
    [
        (["*.log"], ["a.log", "d/e/a.log", "x.log/inside.py"], ["a.logs", "log"]),
        (["build/"], ["build/a", "x/build/a"], ["build", "x/build"]),
        (["/top.py"], ["top.py"], ["d/top.py"]),
        (["docs/*.md"], ["docs/a.md"], ["docs/s/a.md", "x/docs/a.md"]),
        (["a/**/z.py"], ["a/z.py", "a/b/c/z.py"], ["z.py", "b/a/z.py"]),
        (["**/tmp"], ["tmp", "a/tmp", "a/tmp/x"], ["tmpx"]),
        (["x/**"], ["x/y", "x/y/z"], ["x", "y/x/z"]),
        (["*.log", "!keep.log"], ["a.log"], ["keep.log", "d/keep.log"]),
        (["out/", "!out/keep.txt"], ["out/keep.txt"], ["keep.txt"]),
        (["out/*", "!out/keep/"], ["out/a", "out/b/c"], ["out/keep/a"]),
        (["file?.t[xy]t"], ["file1.txt", "d/fileA.tyt"], ["file.txt", "file12.txt", "file1.tzt"]),
        (["[!a]b"], ["cb"], ["ab"]),
        (["# comment", "", "\\#real", "\\!bang"], ["#real", "!bang"], ["comment", "real"]),
        (["trail  ", "kept\\ "], ["trail", "kept "], ["trail  ", "kept"]),
        (["a[.py"], ["a[.py"], ["a.py"]),
    ],
)
def test_ignore_rules(frame, lines, ignored, not_ignored):
    rules = compile_rules(lines)
    assert kept(frame, ignored + not_ignored, lambda f: fi.not_ignored(f, rules)) == set(not_ignored)


def test_no_rules_keep_all(frame):
    assert kept(frame, ["a", "b/c"], lambda f: fi.not_ignored(f, [])) == {"a", "b/c"}


def test_dataset_names(frame):
    rows = frame([("/x/My-Repo name",), ("/a/web-app/",), ("core",)], "p STRING")
    got = [r[0] for r in rows.select(fi.dataset_name(F.col("p"))).collect()]
    assert got == ["codemem_my_repo_name", "codemem_web_app", "codemem_core"]
    assert rows.limit(1).select(fi.legacy_dataset_name(F.lit("a/b c.py\\d"))).first()[0] == "a_b_c_py_d"


def test_changed_files_fall_back_to_last_commit(frame):
    status = frame(
        [
            ("dirty", None, "a.py", "unstaged"), ("dirty", "a.py", "a.py", "staged"), ("dirty", None, "d\\n.py", "untracked"),
            ("dirty", None, "old.py", "last_commit"), ("dirty", None, "a.py", "last_commit"),
            ("clean", "gone.py", "", "last_commit"), ("clean", "was.py", "now.py", "last_commit"), ("clean", None, None, "last_commit"),
        ],
        "repo STRING, a_path STRING, b_path STRING, area STRING",
    )
    assert {tuple(r) for r in fi.changed_files(status).collect()} == {
        ("dirty", "a.py"), ("dirty", "d/n.py"), ("clean", "gone.py"), ("clean", "now.py"),
    }


def test_no_status_means_no_changes(frame):
    empty = frame([], "repo STRING, a_path STRING, b_path STRING, area STRING")
    assert fi.changed_files(empty).count() == 0


def test_incremental_files(frame):
    files = frame([("r", "a.py", 1), ("r", "b.py", 2), ("s", "a.py", 3)], "repo STRING, path STRING, n INT")
    changes = frame([("r", "a.py"), ("r", "a.py"), ("r", "zz.py")], "repo STRING, path STRING")
    assert [r["n"] for r in fi.incremental_files(files, changes).collect()] == [1]


def test_decoding_drops_invalid_bytes(frame):
    raw = [b"plain\r\ntext\rx", b"caf\xc3\xa9", b"a\xff\xfeb\xc3", b"\xe2\x82", "é\ufffdz".encode(), b"\xed\xa0\x80q"]
    rows = frame([(i, bytearray(b)) for i, b in enumerate(raw)], "i INT, raw BINARY")
    got = [r["content"] for r in fi.decode_utf8(rows).orderBy("i").collect()]
    want = [b.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for b in raw]
    assert got == want


def test_each_repository_has_its_own_rules(frame):
    scan = [
        ("a", ".gitignore", "*.log\r\n!keep.log\nout/\n# note\n"), ("b", ".gitignore", "keep.log\n!out/\n*\n!*.log\n"), ("c", "sub/.gitignore", "*"),
        ("a", "x.log", ""), ("a", "keep.log", ""), ("a", "out/deep/f.py", ""), ("a", "f.py", ""),
        ("b", "x.log", ""), ("b", "keep.log", ""), ("b", "out/f.log", ""), ("b", "f.py", ""),
        ("c", "x.log", ""), ("c", "out/f.py", ""),
    ]
    files = frame(scan, "repo STRING, path STRING, content STRING")
    rules = rule_rows(files)
    assert {(r.repo, r.ord, r.negated) for r in rules.collect()} == {("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, False), ("b", 1, True), ("b", 2, False), ("b", 3, True)}
    kept = {(r.repo, r.path) for r in fi.not_ignored_by_rules(files, rules).collect()}
    assert kept == {
        ("a", ".gitignore"), ("a", "keep.log"), ("a", "f.py"), ("b", "x.log"), ("b", "keep.log"),
        ("c", "sub/.gitignore"), ("c", "x.log"), ("c", "out/f.py"),
    }
    for repo in "abc":
        own = [r for r in scan if r[0] == repo]
        lines = next((r[2] for r in own if r[1] == ".gitignore"), "").split("\n")
        one = frame(own, "repo STRING, path STRING, content STRING")
        assert {p for r, p in kept if r == repo} == {r.path for r in fi.not_ignored(one, compile_rules(lines)).collect()}
