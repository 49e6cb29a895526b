from pyspark.sql import functions as F

from codemem.functions import text as tx
from codemem.operators import symbols as sy

MODULE = '''"""Shapes of things."""
import os
from math import sqrt

class Shape(Base):
    """A shape."""
    def area(self, a, b):
        """Its area."""
        return a * b

def scale(x):
    """Make larger."""
    return x * 2
'''

EDGES = '''
import a as b, c.d
from . import x
from m import *
from ..p import q as r
if True:
    def hidden(): pass
try:
    class Gone: pass
except ImportError: pass
class A(m.B, C, metaclass=D):
    class Inner: pass
    async def go(self, /, k, *args, only, **kw): pass
    def one(self): pass
def f(p, /, b, *args, c): 
    def inner(): pass
async def g(): pass
'''


def one(frame, path, content):
    return sy.extract_symbols(frame([(path, content)], "path STRING, content STRING")).first()


def test_python_module(frame):
    row = one(frame, "s.py", MODULE)
    assert row.module_docstring == "Shapes of things." and row.parse_ok
    assert row.imports == ["os", "math.sqrt"]
    (cls,) = row.classes
    assert (cls.name, cls.bases, cls.docstring, cls.lineno) == ("Shape", ["Base"], "A shape.", 5)
    assert [(m.name, m.args, m.docstring, m.lineno) for m in cls.methods] == [("area", ["self", "a", "b"], "Its area.", 7)]
    assert [(f.name, f.args, f.lineno) for f in row.functions] == [("scale", ["x"], 11)]


def test_python_edges(frame):
    row = one(frame, "e.PY", EDGES)
    assert row.imports == ["a", "c.d", "x", "m.*", "p.q"]
    assert [(c.name, c.bases) for c in row.classes] == [("A", ["C"])]
    assert [(m.name, m.args) for m in row.classes[0].methods] == [("go", ["k"]), ("one", ["self"])]
    assert [(f.name, f.args) for f in row.functions] == [("f", ["b"]), ("g", [])]


def test_python_that_does_not_parse(frame):
    for content in ("def (", "x = \0", "(" * 5000):
        row = one(frame, "b.py", content)
        assert not row.parse_ok and row.classes == row.functions == row.imports == []


def test_redaction_can_break_a_parse(frame):
    secret = frame([("t.py", 'f(a=1, token="longsecret")\ndef g(): pass')], "path STRING, content STRING")
    assert sy.extract_symbols(secret).first().parse_ok
    redacted = secret.withColumn("content", tx.redact(F.col("content")))
    assert not sy.extract_symbols(redacted).first().parse_ok


def test_typescript(frame):
    row = one(
        frame,
        "u.ts",
        """
import { a, b } from 'react';
import Def from "./def";
import * as all from 'skipped';
import 'side';
export class Store extends Base { load() {} }
subclass Foo
export const arrow = async (t: Map<string, number>) => 1;
export async function getUser(id,
  opts) { return null; }
const bare = x => x;
const typed = (x): T => x;
""",
    )
    assert row.imports == ["react", "./def"]
    assert [(c.name, c.bases, c.lineno) for c in row.classes] == [("Store", ["Base"], None), ("Foo", [], None)]
    # Declared functions first, arrow functions after them.
    assert [(f.name, f.args) for f in row.functions] == [
        ("getUser", ["id", "opts"]), ("arrow", ["t: Map<string", "number>"]),
    ]


def test_go_and_rust(frame):
    go = one(frame, "m.go", "type Node struct {}\ntype I interface {}\nfunc (n *Node) Walk(d int, s string) {}\nfunc main() {}\nfunc Map[T any](x T) {}")
    assert [c.name for c in go.classes] == ["Node"]
    assert [(f.name, f.args) for f in go.functions] == [("Walk", ["d int", "s string"]), ("main", [])]
    rust = one(frame, "m.rs", "pub struct Row {}\nenum Kind {}\npub trait Load {}\npub async fn load(p: &str) {}\nfn foo<T>(x: T) {}")
    assert [c.name for c in rust.classes] == ["Row", "Kind", "Load"]
    assert [(f.name, f.args) for f in rust.functions] == [("load", ["p: &str"])]


def test_unicode_space_counts_as_space(frame):
    assert [c.name for c in one(frame, "x.js", "class\u00a0Wide {}").classes] == ["Wide"]


def test_other_suffixes_have_no_symbols(frame):
    row = one(frame, "x.md", "class Foo\nfunction f() {}")
    assert row.classes == row.functions == row.imports == []


def summary(frame, path, content, limit=None):
    rows = sy.extract_symbols(frame([(path, content)], "path STRING, content STRING"))
    return rows.select(sy.summary_text(F.col("path"), limit)).first()[0]


def test_summary(frame):
    assert summary(frame, "s.py", MODULE) == "\n".join(
        [
            "[AST CODE SYMBOLS] File: s.py",
            "Module Summary: Shapes of things.",
            "Imports: os, math.sqrt",
            "Classes:",
            "  - Class Shape (inherits: Base)",
            "    Doc: A shape.",
            "    * method area(self, a, b) - Its area.",
            "Standalone Functions:",
            "  - func scale(x) - Make larger.",
        ]
    )
    assert summary(frame, "e.txt", "nothing") == "[AST CODE SYMBOLS] File: e.txt"


def test_summary_names_fifteen_imports(frame):
    text = summary(frame, "i.py", "\n".join(f"import m{i}" for i in range(20)), 15)
    assert text.endswith("Imports: " + ", ".join(f"m{i}" for i in range(15)))


def test_symbol_tables(frame):
    rows = sy.extract_symbols(frame([("s.py", MODULE)], "path STRING, content STRING"))
    assert [r.name for r in sy.class_rows(rows).collect()] == ["Shape"]
    assert [(r["class"], r.name) for r in sy.method_rows(rows).collect()] == [("Shape", "area")]
    assert [(r["class"], r.base) for r in sy.base_rows(rows).collect()] == [("Shape", "Base")]
    assert [r.module for r in sy.import_rows(rows).orderBy("pos").collect()] == ["os", "math.sqrt"]


def test_symbols_in_sql(spark, frame):
    from codemem.functions import tables

    tables.register(spark)
    text = '"""About."""\nimport os, sys\nclass A(B, c.D):\n    """One."""\n    def m(self, x): pass\ndef f(a, *, k): pass\n'
    frame([("a.py", text), ("b.py", "def broken(:"), ("c.py", None), ("d.py", "")], "path STRING, content STRING").createOrReplaceTempView("sources")
    rows = spark.sql("SELECT path, s.* FROM sources, LATERAL python_symbols(content) s ORDER BY kind, pos").collect()
    assert [tuple(r) for r in rows] == [
        ("a.py", "class", 0, "A", None, "", "B", "One.", 3, "About."),
        ("a.py", "function", 0, "f", None, "a", "", "", 6, "About."),
        ("a.py", "import", 0, "os", None, "", "", "", None, "About."),
        ("a.py", "import", 1, "sys", None, "", "", "", None, "About."),
        ("a.py", "method", 0, "m", "A", "self, x", "", "", 5, "About."),
    ]
