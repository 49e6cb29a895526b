import glob
import json
import os

import pytest

from codemem.api import CodeMemory
from codemem.operators.memory import NO_RESULTS
from codemem.session import work_dir

TAX = '''def tax(income: float) -> float:
    """
    Local income tax.

    TODO: ask a service for the rate
    """
    return income * 0.15
'''
PHONE = '# NOTE: helpers\nimport time\n\ndef clean_phone(phone):\n    """Digits only."""\n    return phone\n'


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "Shop-App"
    os.makedirs(root)
    (root / "main.py").write_text(TAX)
    (root / "utils.py").write_text(PHONE)
    (root / "README.md").write_text("# Shop\nTODO in main.py\n")
    return root


@pytest.fixture
def memory(spark):
    return CodeMemory(spark, work_dir(spark, "test-api")).create()


def test_a_session(memory, project, frame, tmp_path):
    files = memory.scan(str(project))
    memory.remember(files)
    assert [r.dataset for r in memory.datasets().collect()] == ["codemem_shop_app"]
    assert {(r.kind, r.n_docs) for r in memory.status().collect()} == {("file", 3), ("comment", 2)}
    answer = memory.ask("income tax rate", datasets=["codemem_shop_app"])
    assert answer.startswith("File Path: main.py\n[AST CODE SYMBOLS] File: main.py\n") or "Docstring: Local income tax." in answer

    memory.log("phones are stored as digits")
    assert "phones are stored as digits" in memory.ask("phones stored digits", 1)
    assert [r.text.split("\n")[1] for r in memory.decisions().collect()] == ["phones are stored as digits"]

    (project / "utils.py").write_text(PHONE.replace("clean_phone", "strip_phone"))
    changes = frame([("Shop-App", "utils.py")], "repo STRING, path STRING")
    memory.remember(memory.scan(str(project)), changes=changes)
    assert "strip_phone" in memory.ask("strip_phone", 1) and "clean_phone" not in memory.ask("clean_phone", 10)
    assert {(r.kind, r.n_docs) for r in memory.status().collect()} == {("file", 3), ("comment", 2), ("decision", 1)}

    (project / "main.py").unlink()
    memory.refresh(memory.scan(str(project)))
    assert "main.py" not in {r.path for r in memory.store.docs().collect()}
    memory.forget(file="README.md")
    assert {r.path for r in memory.store.docs().collect()} == {"utils.py", None}
    asked = frame([(1, "phone digits")], "query_id INT, text STRING")
    assert memory.ask_many(asked, 2).count() == 2
    with pytest.raises(ValueError):
        memory.forget()
    with pytest.raises(ValueError):
        memory.ask("")
    memory.forget(everything=True)
    assert memory.ask("anything") == NO_RESULTS


def test_unreadable_files_and_history_survive_a_refresh(memory, project, frame):
    commits = frame([("Shop-App", "h1", "Ann", "a@x", __import__("datetime").datetime(2024, 1, 1), "+00:00", "start", True)],
                    "repo STRING, hash STRING, author STRING, email STRING, authored_ts TIMESTAMP, tz STRING, message STRING, is_root BOOLEAN")
    changed = frame([("h1", 0, "main.py", "main.py", None, True)], "hash STRING, ord BIGINT, a_path STRING, b_path STRING, patch STRING, is_root BOOLEAN")
    memory.remember(memory.scan(str(project)), commits, changed, tag="first")
    rows = [("Shop-App", "main.py", TAX), ("Shop-App", "utils.py", None)]
    memory.refresh(frame(rows, "repo STRING, path STRING, content STRING"))
    assert {(r.kind, r.path) for r in memory.store.docs().collect()} == {
        ("file", "main.py"), ("comment", "main.py"), ("file", "utils.py"), ("comment", "utils.py"), ("commit", None)}
    symbols = memory.symbols(memory.scan(str(project))).cache()
    near = memory.ask_with_graph("income tax rate", symbols, 1).collect()
    assert [(r.repo, r.label) for r in near if r.grp == "func"] == [("Shop-App", "fn tax()")]
    memory.forget(tag="first")
    assert memory.store.docs().count() == 0


def test_structure(memory, project, tmp_path):
    symbols = memory.symbols(memory.scan(str(project))).cache()
    nodes, edges, stats = memory.graph(symbols)
    assert tuple(stats.first()) == (3, 0, 2, 5, 2) and nodes.count() == 5 and edges.count() == 2
    assert [r.path for r in memory.importers(symbols, "time").collect()] == ["utils.py"]
    memory.write_graph(symbols, str(tmp_path / "graph"))
    lines = [json.loads(line) for f in glob.glob(str(tmp_path / "graph" / "of=node" / "*.txt")) for line in open(f)]
    assert {n["id"] for n in lines} >= {"file:main.py", "func:main.py:tax"}
    memory.write_digest(symbols, "shop", str(tmp_path / "digest"))
    assert glob.glob(str(tmp_path / "digest" / "part-*"))


def test_imports_of_a_project(memory, project):
    (project / "shop").mkdir()
    (project / "shop" / "__init__.py").write_text("from utils import clean_phone\n\nNUMBER_OF_SHOPS = 3  # three\n")
    (project / "page.py").write_text('import shop\nimport os\n\n\ndef page():\n    """The page of one shop."""\n')
    files = memory.scan(str(project))
    memory.remember(files)
    memory.refresh_structure(files)
    symbols = memory.structure.symbols()
    assert {r.path for r in symbols.collect()} == {"main.py", "utils.py", "README.md", "page.py", "shop/__init__.py"}
    indirect = {(r.target, r.path, r.hops) for r in memory.importers(symbols, "utils.py", indirect=True).collect()}
    assert indirect == {("utils.py", "shop/__init__.py", 1), ("utils.py", "page.py", 2)}
    assert {r.path for r in memory.importers(symbols, "os").collect()} == {"page.py"}
    near = {(r.file, r.hops, tuple(r.via)) for r in memory.ask_with_imports("clean phone helpers digits only", symbols, k=1).collect()}
    assert near == {("shop/__init__.py", 1, ("utils.py", "shop/__init__.py")), ("page.py", 2, ("utils.py", "shop/__init__.py", "page.py"))}
