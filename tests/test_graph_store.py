import glob

import pytest
from pyspark.sql import functions as F

from codemem.operators import graph as gr, symbols as sy
from codemem.plans import graph_store
from codemem.plans.graph_store import GraphStore
from codemem.session import work_dir

SCAN = "repo STRING, path STRING, content STRING"


def scan(n=40, **edits):
    rows = {("r" if i % 3 else "s/t", f"pkg/f{i}.py"): f"import os\nfrom pkg import f{i - 1}\nclass C{i}: pass\ndef f(): pass" for i in range(n)}
    rows["r", "web/a.ts"] = "import x from './b'; class S extends B {}\nfunction A() {}"
    for path, text in edits.items():
        rows["r", path] = text
    return [(r, p, t) for (r, p), t in rows.items()]


@pytest.fixture
def graph(spark):
    return GraphStore(spark, f"{work_dir(spark, 'test-graph')}/graph").create()


def everything(symbols):
    return sorted(map(str, gr.graph_nodes(symbols).drop("pos").collect())) + sorted(map(str, gr.graph_edges(symbols).collect()))


def rebuilt(frame, rows):
    return everything(sy.extract_symbols(frame([r for r in rows if r[2] is not None], SCAN)))


def files_of(graph):
    return set(glob.glob(f"{graph.root}/*/*/*.parquet"))


def test_a_refreshed_graph_equals_a_rebuilt_one(graph, frame):
    first = scan()
    graph.refresh(frame(first, SCAN))
    assert everything(graph.symbols()) == rebuilt(frame, first)
    second = [r for r in scan(**{"pkg/f4.py": "class Other: pass\ndef more(): pass", "new.go": "type Node struct {}\nfunc main() {}"}) if r[1] != "pkg/f7.py"]
    graph.refresh(frame(second, SCAN))
    assert everything(graph.symbols()) == rebuilt(frame, second)
    assert graph.stats().first().total_files == len(second)
    assert graph.symbols(["s/t"]).select("repo").distinct().collect()[0].repo == "s/t"


def test_only_changed_files_are_parsed_and_only_their_buckets_written(graph, frame, monkeypatch):
    graph.refresh(frame(scan(), SCAN))
    before, parsed = files_of(graph), []
    extract = sy.extract_symbols
    monkeypatch.setattr(graph_store.sy, "extract_symbols", lambda files: parsed.append({r.path for r in files.collect()}) or extract(files))
    graph.refresh(frame(scan(**{"pkg/f4.py": "class Changed: pass\ndef f(): pass"}), SCAN))
    assert parsed == [{"pkg/f4.py"}]
    assert len(before - files_of(graph)) == 1
    graph.refresh(frame(scan(**{"pkg/f4.py": "class Changed: pass\ndef f(): pass"}), SCAN))
    assert parsed[1] == set() and len(before - files_of(graph)) == 1


def test_what_could_not_be_read_stays(graph, frame):
    graph.refresh(frame(scan(), SCAN))
    rows = [("r", "pkg", None), ("r", "web/a.ts", None), ("r", "x.py", "class X: pass  # a new file")]
    graph.refresh(frame(rows, SCAN))
    held = {r.path for r in graph.symbols(["r"]).collect()}
    assert "web/a.ts" in held and "x.py" in held and len(held) == len([r for r in scan() if r[0] == "r"]) + 1
    graph.refresh(frame([("r", "x.py", "class X: pass  # a new file")], SCAN))
    assert {r.path for r in graph.symbols(["r"]).collect()} == {"x.py"} and graph.symbols(["s/t"]).count() == 14


def test_emptying_and_forgetting(graph, frame):
    graph.refresh(frame(scan(), SCAN))
    graph.forget_files(frame([("r", "web/a.ts"), ("s/t", "web/a.ts")], "repo STRING, path STRING"))
    assert graph.symbols().filter("path = 'web/a.ts'").count() == 0 and graph.symbols().count() == 40
    graph.refresh(frame([], SCAN), repos=["r"])
    assert {r.repo for r in graph.symbols().collect()} == {"s/t"}
    graph.refresh(frame([], SCAN))
    assert graph.symbols().count() == 14
    assert GraphStore(graph.spark, graph.root).create().symbols().count() == 14


def test_stored_imports(graph, frame):
    graph.refresh(frame(scan(6), SCAN))
    edges = {(r.path, r.target) for r in graph.imports(["r"]).filter("inside").collect()}
    assert edges == {("pkg/f2.py", "pkg/f1.py"), ("pkg/f5.py", "pkg/f4.py")}


def test_a_refresh_lists_only_touched_parts(graph, frame, plan):
    graph.refresh(frame(scan(), SCAN))
    touched = frame([("r", "0001")], "owner STRING, part STRING")
    from codemem.plans import partitions as pt

    text = plan(pt.inside(graph._rows(), touched, pt.names(touched, graph_store.PARTITIONS)))
    filters = text.split("PartitionFilters:")[1].split("]")[0]
    assert "owner#" in filters and "part#" in filters and "PushedFilters: [IsNotNull(path)" in text
