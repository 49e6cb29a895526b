import os

import pytest

from codemem.plans import remember as rm
from codemem.plans.queries import _export_tree
from codemem.session import mounted
from codemem.sources import tree


def write(root, path, content):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    mode, kw = ("wb", {}) if isinstance(content, bytes) else ("w", {"encoding": "utf-8", "newline": ""})
    with open(at, mode, **kw) as handle:
        handle.write(content)


@pytest.fixture
def project(tmp_path):
    root = str(tmp_path / "My-Proj")
    for path, content in {
        ".gitignore": "logs/\n*.txt\n!keep.txt\n",
        ".env.example": "KEY=",
        ".env": "KEY=1",
        "__init__.py": "# package marker",
        "src/_hidden.py": "x = 1\r\ny = 2\rz = 3",
        "src/deep/er/a.PY": b"caf\xc3\xa9\xff = 1",
        "src/build/skip.py": "no",
        "node_modules/m/i.js": "no",
        "logs/a.md": "no",
        "src/logs/b.md": "no",
        "note.txt": "no",
        "keep.txt": "yes",
        "pic.png": "no",
        "Makefile": "all:",
        **{f"many/f{i}.md": f"file {i}" for i in range(40)},
    }.items():
        write(root, path, content)
    os.symlink(os.path.join(root, "many"), os.path.join(root, "linked"))
    os.symlink("/nowhere/at/all.md", os.path.join(root, "broken.md"))
    return root


EXPECTED = {".gitignore", ".env.example", "__init__.py", "src/_hidden.py", "src/deep/er/a.PY", "keep.txt", "Makefile", "broken.md"} | {
    f"many/f{i}.md" for i in range(40)
}


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_listing(spark, project, slices):
    rows = tree.list_tree(spark, project, slices=slices).collect()
    assert len(rows) == len({r.relative_path for r in rows})
    assert {r.relative_path for r in rows} == EXPECTED
    assert {r.repo for r in rows} == {"My-Proj"}


def test_reading(spark, project):
    rows = {r.relative_path: r for r in tree.read_tree(spark, project).collect()}
    assert set(rows) == EXPECTED
    assert rows["src/_hidden.py"].content == "x = 1\ny = 2\nz = 3"
    assert rows["src/deep/er/a.PY"].content == "café = 1"
    # An unreadable file is reported and the scan goes on.
    assert rows["broken.md"].content is None and "No such file" in rows["broken.md"].error


def test_names_reach_the_reading_stage_in_many_tasks(spark, project):
    assert tree.read_tree(spark, project, read_tasks=7).rdd.getNumPartitions() == 7


def test_missing_root_is_an_error_row(spark, tmp_path):
    rows = tree.list_tree(spark, str(tmp_path / "none")).collect()
    assert len(rows) == 1 and rows[0].error


def test_scan_to_documents(spark, project, tmp_path):
    files = tree.read_tree(spark, project).filter("error is null").withColumnRenamed("relative_path", "path")
    docs = {r.doc_id: r for r in rm.remember(files.select("repo", "path", "content")).collect()}
    # Files of fewer than 15 characters are left out.
    assert set(docs) == {"file:.gitignore", "file:__init__.py", "file:src/_hidden.py"}
    assert docs["file:__init__.py"].dataset == "codemem_my_proj"
    assert docs["file:__init__.py"].text == (
        "File Path: __init__.py\n[AST CODE SYMBOLS] File: __init__.py\n---\n# package marker"
    )


def test_export_round_trip(spark, frame, tmp_path):
    files = frame([("r1", "a/x.py", "é\nprint()"), ("r2", "y.md", "")], "repo STRING, path STRING, content STRING")
    root = str(tmp_path / "out")
    _export_tree(files, root)
    got = {r.relative_path: r.content for r in tree.read_tree(spark, root).collect()}
    assert got == {"r1/a/x.py": "é\nprint()", "r2/y.md": ""}


def test_roots_must_be_mounted():
    assert mounted("file:///a/b") == mounted("file:/a/b") == mounted("/a/b") == "/a/b"
    assert mounted("rel/a") == "rel/a"
    with pytest.raises(ValueError):
        mounted("s3a://bucket/a")
