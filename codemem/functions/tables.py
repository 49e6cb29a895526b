"""Table functions, so that SQL reaches what a file's text holds: ``LATERAL python_symbols(content)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codemem.operators.symbols import describe_python

# One row per class, method, function and import; a file that does not parse gives none.
SYMBOL_ROWS = "kind STRING, pos BIGINT, name STRING, owner STRING, args STRING, bases STRING, docstring STRING, lineno BIGINT, module_docstring STRING"

NAMES = [field.split()[0] for field in SYMBOL_ROWS.split(", ")]


def symbol_rows(source: str | None) -> list[dict]:
    found = describe_python(source) if source is not None else None
    if found is None:
        return []
    empty = {"owner": None, "args": "", "bases": "", "docstring": "", "lineno": None, "module_docstring": found["module_docstring"]}
    rows = [empty | {"kind": "import", "pos": i, "name": name} for i, name in enumerate(found["imports"])]
    listed = lambda f: {"name": f["name"], "args": ", ".join(f["args"]), "docstring": f["docstring"], "lineno": f["lineno"]}
    for i, c in enumerate(found["classes"]):
        rows.append(empty | {"kind": "class", "pos": i, "name": c["name"], "bases": ", ".join(c["bases"]), "docstring": c["docstring"], "lineno": c["lineno"]})
        rows += [empty | {"kind": "method", "pos": j, "owner": c["name"]} | listed(m) for j, m in enumerate(c["methods"])]
    return rows + [empty | {"kind": "function", "pos": i} | listed(f) for i, f in enumerate(found["functions"])]


# Rows travel as Arrow batches.  (A table function that is handed whole Arrow arrays cannot stand in a LATERAL join.)
@udtf(returnType=SYMBOL_ROWS, useArrow=True)
class PythonSymbols:
    def eval(self, content: str) -> Iterator[tuple]:
        for row in symbol_rows(content):
            yield tuple(row[name] for name in NAMES)


def register(spark: SparkSession) -> None:
    """Make ``python_symbols(content)`` known to SQL."""
    spark.udtf.register("python_symbols", PythonSymbols)
