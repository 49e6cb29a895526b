from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from codemem.operators import imports as im

FILES = [
    "lib/tax/rate.py", "lib/tax/__init__.py", "old/lib/tax/rate.py", "app.py", "web/store.ts", "web/ui/view.tsx", "web/ui/index.js", "rate.md", "web/app.js",
]


@pytest.fixture
def resolved(frame):
    def run(path, module, repo="r"):
        files = frame([("r", f) for f in FILES] + [("other", "rate.py")], "repo string, path string")
        rows = im.import_edges(files, frame([(repo, path, module)], "repo string, path string, module string")).collect()
        return [(r.target, r.inside) for r in rows]

    return run


@pytest.mark.parametrize(
    "path, module, target",
    [
        ("app.py", "lib.tax.rate", "lib/tax/rate.py"),
        ("app.py", "rate", "lib/tax/rate.py"),  # the one nearest to the root
        ("app.py", "old.lib.tax.rate", "old/lib/tax/rate.py"),
        ("app.py", "lib.tax.rate.compute", "lib/tax/rate.py"),  # a name inside the module
        ("app.py", "lib.tax.*", "lib/tax/__init__.py"),
        ("app.py", "tax", "lib/tax/__init__.py"),
        ("app.py", "store", None),  # a script is no Python module
        ("app.py", "os.path", None),
        ("web/ui/view.tsx", "../store", "web/store.ts"),
        ("web/ui/view.tsx", "../store.js", "web/store.ts"),
        ("web/app.js", "./ui", "web/ui/index.js"),
        ("web/app.js", "./store", "web/store.ts"),
        ("web/app.js", "./view", None),  # relative names are whole paths
        ("web/app.js", "react", None),
        ("web/app.js", "../../../web/store", "web/store.ts"),
        ("app.py", "", None),
    ],
)
def test_what_a_name_stands_for(resolved, path, module, target):
    assert resolved(path, module) == [(target or module, target is not None)]


def test_repositories_are_apart(resolved):
    assert resolved("app.py", "rate", "other") == [("rate.py", True)]
    assert resolved("app.py", "lib.tax.rate", "third") == [("lib.tax.rate", False)]


def plain_closure(links):
    importers = defaultdict(set)
    for repo, target, path in links:
        importers[repo, target].add(path)
    out = set()
    for repo, target in list(importers):
        hops, todo = {}, deque([(target, 0)])
        while todo:
            at, n = todo.popleft()
            for path in importers.get((repo, at), ()):
                if path not in hops and path != target:
                    hops[path] = n + 1
                    todo.append((path, n + 1))
        out |= {(repo, target, p, n) for p, n in hops.items()}
    return out


EDGES = "repo string, path string, module string, target string, inside boolean"


def as_edges(frame, links):
    return frame([(r, p, t, t, True) for r, t, p in links], EDGES)


def test_closure_on_random_graphs_with_cycles(frame):
    rng = np.random.default_rng(8)
    links = {(f"r{rng.integers(0, 2)}", f"f{rng.integers(0, 14)}", f"f{rng.integers(0, 14)}") for _ in range(45)}
    found = im.importers_closure(as_edges(frame, links))
    assert {tuple(r) for r in found.collect()} == plain_closure(links)
    assert found.count() == found.distinct().count()


def test_closure_of_some_targets_and_hops(frame):
    links = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "d"), ("r", "d", "a"), ("r", "os", "a"), ("r", "a", "a")]
    edges = as_edges(frame, links)
    asked = frame([("r", "os"), ("r", "unknown"), ("r", "os")], "repo string, target string")
    assert {tuple(r) for r in im.importers_closure(edges, asked).collect()} == {("r", "os", "a", 1), ("r", "os", "b", 2), ("r", "os", "c", 3), ("r", "os", "d", 4)}
    assert {r.path for r in im.importers_closure(edges, asked, most_hops=2).collect()} == {"a", "b"}


def test_no_edges(frame):
    assert im.importers_closure(frame([], EDGES)).collect() == []
    assert im.import_neighbours(frame([], "rank long, repo string, path string"), frame([], EDGES)).collect() == []


def test_module_with_a_million_importers(spark):
    n = 1_000_000
    of_hub = spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), F.lit("hub").alias("module"), F.lit("hub").alias("target"), F.lit(True).alias("inside"))
    hub = spark.createDataFrame([("r", "hub", "os", "os", False)], of_hub.schema)
    found = im.importers_closure(of_hub.union(hub))
    counts = {(r.target, r.hops): r["count"] for r in found.groupBy("target", "hops").count().collect()}
    assert counts == {("hub", 1): n, ("os", 1): 1, ("os", 2): n}


def test_neighbours_both_ways_with_their_path(frame):
    links = [("r", "b", "a"), ("r", "c", "b"), ("r", "c", "d"), ("r", "e", "d"), ("r", "b2", "a"), ("r", "c", "b2"), ("s", "b", "z")]
    edges = as_edges(frame, links).unionByName(frame([("r", "a", "os", "os", False), ("r", "e", "os", "os", False)], EDGES))
    seeds = frame([(1, "r", "a"), (2, "r", "d"), (3, "s", "q")], "rank long, repo string, path string")
    got = {(r.rank, r.file, r.hops, ">".join(r.via)) for r in im.import_neighbours(seeds, edges, hops=3).collect()}
    assert got == {
        (1, "b", 1, "a>b"), (1, "b2", 1, "a>b2"), (1, "c", 2, "a>b>c"), (1, "d", 3, "a>b>c>d"),
        (2, "c", 1, "d>c"), (2, "e", 1, "d>e"), (2, "b", 2, "d>c>b"), (2, "b2", 2, "d>c>b2"), (2, "a", 3, "d>c>b>a"),
    }


def test_a_level_joins_the_newest_rows_only(frame, monkeypatch):
    seen = []
    join = im.sized_join
    monkeypatch.setattr(im, "sized_join", lambda a, b, on, how: seen.append((how, a.count())) or join(a, b, on, how))
    links = [("r", f"f{i}", f"f{i + 1}") for i in range(6)]
    im.importers_closure(as_edges(frame, links)).collect()
    assert [n for how, n in seen if how == "inner"] == [6, 5, 4, 3, 2, 1]
