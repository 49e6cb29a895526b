import glob

from pyspark.sql import functions as F

from codemem.operators import graph as gr, symbols as sy

FILES = [
    ("r", "a/m.py", "import os\nclass A: pass\nclass A: pass\ndef f(): pass\ndef g(): pass\ndef f(x): pass"),
    ("r", "b.ts", "import x from 'os'; class S extends B {}\nfunction A() {}"),
    ("r", "c.md", "# text"),
    ("s", "a/m.py", "class A: pass"),
    ("s", "odd:name.py", "def h(): pass"),
]


def table(frame):
    return sy.extract_symbols(frame(FILES, "repo STRING, path STRING, content STRING"))


def test_nodes_and_edges(frame):
    symbols = table(frame)
    nodes = {(r.repo, r.id): r for r in gr.graph_nodes(symbols).collect()}
    assert len(nodes) == gr.graph_nodes(symbols).count() == 12
    file, cls, fn = nodes["r", "file:a/m.py"], nodes["r", "class:a/m.py:A"], nodes["r", "func:a/m.py:f"]
    assert (file.label, file.title, file.path, file.shape, file.size) == ("m.py", "File: a/m.py", "a/m.py", "dot", 22)
    assert (cls.label, cls.title, cls.path, cls.shape, cls.size) == ("Class A", "Class A in a/m.py", None, "diamond", 16)
    assert (fn.label, fn.title, fn.path, fn.shape, fn.size) == ("fn f()", "Function f in a/m.py", None, "triangle", 12)
    edges = [(r.repo, r.src, r.dst, r.label) for r in gr.graph_edges(symbols).collect()]
    assert len(edges) == len(set(edges)) == 7
    assert ("r", "file:b.ts", "func:b.ts:A", "defines") in edges
    assert {(e[0], e[2]) for e in edges} == {k for k, n in nodes.items() if n.grp != "file"}


def test_stats_count_symbols_before_and_nodes_after(frame):
    symbols = table(frame)
    assert tuple(gr.graph_stats(symbols).first()) == (5, 4, 5, 12, 7)
    by_repo = {r.repo: tuple(r)[1:] for r in gr.graph_stats(symbols, ("repo",)).collect()}
    assert by_repo == {"r": (3, 3, 4, 8, 5), "s": (2, 1, 1, 4, 2)}
    assert tuple(gr.graph_stats(symbols.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_digest(frame):
    got = {(r.repo, r.path): r.section for r in gr.digest_rows(table(frame)).collect()}
    assert got["r", "a/m.py"] == "### 📄 `a/m.py`\n  - Class A\n  - fn f()\n  - fn g()"
    assert got["r", "c.md"].endswith("\n  - *(No top-level classes/functions extracted)*")
    # A colon in a path loses nothing.
    assert got["s", "odd:name.py"].endswith("\n  - fn h()")


def test_digest_is_written_in_path_order(frame, spark, tmp_path):
    out = str(tmp_path / "digest")
    gr.write_digest(table(frame).filter("repo = 'r'"), "demo", out)
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*")))
    assert text.startswith("# Codebase Architecture Digest: demo\n\n## High-Level Architecture Metrics\n- **Indexable Files**: 3\n")
    assert text.index("`a/m.py`") < text.index("`b.ts`") < text.index("`c.md`")


def test_json_leaves_out_missing_paths(frame):
    rows = {r.id: r.json for r in gr.node_json(gr.graph_nodes(table(frame)).filter("repo = 'r'")).collect()}
    assert rows["file:c.md"] == (
        '{"id":"file:c.md","label":"c.md","group":"file","title":"File: c.md","path":"c.md","shape":"dot","size":22}'
    )
    assert '"path"' not in rows["class:b.ts:S"]
    edge = gr.edge_json(gr.graph_edges(table(frame)).filter("file = 'b.ts' and dst like 'class%'")).first()
    assert edge.json == '{"from":"file:b.ts","to":"class:b.ts:S","label":"defines"}'


def test_filter_prune_and_importers(frame):
    symbols = table(frame)
    nodes = gr.graph_nodes(symbols)
    assert {r.id for r in gr.filter_nodes(nodes, "cLaSs s").collect()} == {"class:b.ts:S"}
    current = frame([("r", "b.ts"), ("s", "a/m.py")], "repo STRING, path STRING")
    assert {(r.repo, r.file) for r in gr.prune_stale(nodes, current).collect()} == {("r", "b.ts"), ("s", "a/m.py")}
    assert gr.prune_stale(gr.graph_edges(symbols), current).count() == 3
    imports = sy.import_rows(symbols, ("repo", "path"))
    assert {(r.repo, r.path) for r in gr.importers_of(imports, "os").collect()} == {("r", "a/m.py"), ("r", "b.ts")}
