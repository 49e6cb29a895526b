"""Symbols of source files: a file table in, one nested symbol row per file out.

Python files are parsed with the standard parser inside Arrow batches; all other
languages are matched by regexes in the JVM.  Only ``.py`` rows reach Python.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codemem.functions import text as tx
from codemem.functions.text import WS
from codemem.schema import CLASS, FUNC, SYMBOL_COLUMNS

# Declaration shapes per language (white space in Python's sense).
JS_CLASS = rf"(?:export{WS}+)?(?:default{WS}+)?class{WS}+([A-Za-z0-9_]+)(?:{WS}+extends{WS}+([A-Za-z0-9_]+))?"
JS_FUNCTION = rf"(?:export{WS}+)?(?:async{WS}+)?function{WS}+([A-Za-z0-9_]+){WS}*\(([^)]*)\)"
JS_ARROW = (
    rf"(?:export{WS}+)?(?:const|let|var){WS}+([A-Za-z0-9_]+){WS}*={WS}*(?:async{WS}*)?\(([^)]*)\){WS}*=>"
)
JS_IMPORT = rf"import{WS}+(?:\{{[^}}]+\}}|[A-Za-z0-9_]+){WS}+from{WS}+['\"]([^'\"]+)['\"]"
GO_STRUCT = rf"type{WS}+([A-Za-z0-9_]+){WS}+struct"
GO_FUNCTION = rf"func{WS}+(?:\([^)]+\){WS}+)?([A-Za-z0-9_]+){WS}*\(([^)]*)\)"
RUST_TYPE = rf"(?:pub{WS}+)?(?:struct|enum|trait){WS}+([A-Za-z0-9_]+)"
RUST_FUNCTION = rf"(?:pub{WS}+)?(?:async{WS}+)?fn{WS}+([A-Za-z0-9_]+){WS}*\(([^)]*)\)"

JS_SUFFIXES = (".js", ".ts", ".jsx", ".tsx")
GO_SUFFIX = ".go"
RUST_SUFFIX = ".rs"
PY_SUFFIX = ".py"
MAX_SUMMARY_IMPORTS = 15


def rows_of(df: DataFrame, array: str, alias: str, position: str | None = None) -> DataFrame:
    """Explode an array column.

    The outer form is used on purpose: a plain ``explode`` makes the optimizer infer a
    size filter and push it below the projection, which runs the extraction twice.
    """
    keep = [c for c in df.columns if c != array]
    if position:
        out = df.select(*keep, F.posexplode_outer(array).alias(position, alias))
    else:
        out = df.select(*keep, F.explode_outer(array).alias(alias))
    return out.filter(F.col(alias).isNotNull())


# ---- regex languages ------------------------------------------------------------------


def _matches(content: Column, pattern: str, build) -> Column:
    """Scan once for whole matches, then take the groups out of each short match."""
    group = lambda m, n: F.regexp_extract(m, pattern, n)
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: build(lambda n: group(m, n)))


def argument_names(inner: Column) -> Column:
    return F.filter(F.transform(F.split(inner, ","), tx.strip_ws), lambda a: a != "")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _class_struct(name: Column, base: Column | None) -> Column:
    bases = _strings() if base is None else F.when(base == "", _strings()).otherwise(F.array(base))
    return F.struct(
        name.alias("name"),
        bases.alias("bases"),
        F.array().cast(f"array<{FUNC}>").alias("methods"),
        F.lit("").alias("docstring"),
        F.lit(None).cast("int").alias("lineno"),
    )


def _func_struct(group) -> Column:
    return F.struct(
        group(1).alias("name"),
        argument_names(group(2)).alias("args"),
        F.lit("").alias("docstring"),
        F.lit(None).cast("int").alias("lineno"),
    )


def js_classes(content: Column) -> Column:
    return _matches(content, JS_CLASS, lambda g: _class_struct(g(1), g(2)))


def js_functions(content: Column) -> Column:
    return _matches(content, JS_FUNCTION, _func_struct)


def js_arrows(content: Column) -> Column:
    return _matches(content, JS_ARROW, _func_struct)


def js_imports(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(JS_IMPORT), F.lit(1))


def go_structs(content: Column) -> Column:
    return _matches(content, GO_STRUCT, lambda g: _class_struct(g(1), None))


def go_functions(content: Column) -> Column:
    return _matches(content, GO_FUNCTION, _func_struct)


def rust_types(content: Column) -> Column:
    return _matches(content, RUST_TYPE, lambda g: _class_struct(g(1), None))


def rust_functions(content: Column) -> Column:
    return _matches(content, RUST_FUNCTION, _func_struct)


def regex_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Symbols by regex; suffixes without a rule get empty arrays.  ``content`` is dropped."""
    text, ext = F.col(content), tx.suffix(F.col(path))
    is_js = ext.isin(*JS_SUFFIXES)
    keep = [c for c in files.columns if c != content]
    return files.select(
        *keep,
        F.lit("").alias("module_docstring"),
        F.when(is_js, js_imports(text)).otherwise(_strings()).alias("imports"),
        F.when(is_js, js_classes(text))
        .when(ext == GO_SUFFIX, go_structs(text))
        .when(ext == RUST_SUFFIX, rust_types(text))
        .otherwise(F.array().cast(f"array<{CLASS}>"))
        .alias("classes"),
        F.when(is_js, F.concat(js_functions(text), js_arrows(text)))
        .when(ext == GO_SUFFIX, go_functions(text))
        .when(ext == RUST_SUFFIX, rust_functions(text))
        .otherwise(F.array().cast(f"array<{FUNC}>"))
        .alias("functions"),
        F.lit(True).alias("parse_ok"),
    )


# ---- Python ---------------------------------------------------------------------------

# Files whose texts and symbols a task holds as Python objects at once.
FILES_AT_ONCE = 256


def _describe_func(node: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
    """Name, plain positional argument names, docstring and line."""
    return {
        "name": node.name,
        "args": [a.arg for a in node.args.args],
        "docstring": ast.get_docstring(node) or "",
        "lineno": node.lineno,
    }


def _imported_names(node: ast.Import | ast.ImportFrom) -> list[str]:
    """Full dotted names; the leading dots of a relative import are lost."""
    package = getattr(node, "module", None)
    return [f"{package}.{item.name}" if package else item.name for item in node.names]


def describe_python(source: str) -> dict | None:
    """Symbols declared directly in a module, or None when it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    found: dict = {"module_docstring": ast.get_docstring(module) or "", "imports": [], "classes": [], "functions": []}
    for statement in module.body:
        match statement:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                found["functions"].append(_describe_func(statement))
            case ast.Import() | ast.ImportFrom():
                found["imports"] += _imported_names(statement)
            case ast.ClassDef(name=name, bases=bases, body=body):
                defs = (s for s in body if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)))
                found["classes"].append(
                    {
                        "name": name,
                        "bases": [b.id for b in bases if isinstance(b, ast.Name)],
                        "methods": list(map(_describe_func, defs)),
                        "docstring": ast.get_docstring(statement) or "",
                        "lineno": statement.lineno,
                    }
                )
    return found


def python_symbols(files: DataFrame, content: str = "content") -> DataFrame:
    """Symbols of Python files.  Parsing is the only step that leaves the JVM.

    A file that does not parse yields empty arrays and ``parse_ok = false``.
    """
    keep = [f for f in files.schema if f.name != content]
    described = StructType.fromDDL(SYMBOL_COLUMNS)
    schema = StructType([*keep, *described.fields])
    arrow = to_arrow_schema(schema)
    kept_names = [f.name for f in keep]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = {"module_docstring": "", "imports": [], "classes": [], "functions": []}
        for batch in (b.slice(at, FILES_AT_ONCE) for b in batches for at in range(0, b.num_rows, FILES_AT_ONCE)):
            found = [describe_python(source) for source in batch.column(content).to_pylist()]
            columns = [batch.column(name).cast(arrow.field(name).type) for name in kept_names]
            for field in list(arrow)[len(kept_names) : -1]:
                columns.append(pa.array([(f or nothing)[field.name] for f in found], field.type))
            columns.append(pa.array([f is not None for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return files.mapInArrow(parse, schema)


def extract_symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """All languages: the ``.py`` rows through the parser, the rest by regex."""
    is_py = tx.suffix(F.col(path)) == PY_SUFFIX
    parsed = python_symbols(files.filter(is_py), content)
    matched = regex_symbols(files.filter(~is_py), path, content)
    return matched.unionByName(parsed)


# ---- symbol tables --------------------------------------------------------------------


def class_rows(symbols: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    one = rows_of(symbols.select(*keys, "classes"), "classes", "c", "pos")
    return one.select(*keys, "pos", "c.*")


def function_rows(symbols: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    one = rows_of(symbols.select(*keys, "functions"), "functions", "f", "pos")
    return one.select(*keys, "pos", "f.*")


def method_rows(symbols: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    owner = class_rows(symbols, keys).select(
        *keys, F.col("pos").alias("class_pos"), F.col("name").alias("class"), "methods"
    )
    return rows_of(owner, "methods", "m", "pos").select(*keys, "class_pos", "class", "pos", "m.*")


def base_rows(symbols: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    owner = class_rows(symbols, keys).select(*keys, F.col("name").alias("class"), "bases")
    return rows_of(owner, "bases", "base")


def import_rows(symbols: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    return rows_of(symbols.select(*keys, "imports"), "imports", "module", "pos")


# ---- summary text ---------------------------------------------------------------------

# The labels and bullets of the outline in the three functions below.


def _signature(lead: str, f: Column) -> Column:
    tail = F.when(f["docstring"] != "", F.concat(F.lit(" - "), tx.strip_ws(f["docstring"]))).otherwise("")
    return F.concat(F.lit(lead), f["name"], F.lit("("), F.array_join(f["args"], ", "), F.lit(")"), tail)


def _class_lines(c: Column) -> Column:
    inherits = F.when(
        F.size(c["bases"]) > 0, F.concat(F.lit(" (inherits: "), F.array_join(c["bases"], ", "), F.lit(")"))
    ).otherwise("")
    doc = F.when(c["docstring"] != "", F.array(F.concat(F.lit("    Doc: "), tx.strip_ws(c["docstring"]))))
    return F.concat(
        F.array(F.concat(F.lit("  - Class "), c["name"], inherits)),
        F.coalesce(doc, _strings()),
        F.transform(c["methods"], lambda m: _signature("    * method ", m)),
    )


def summary_text(path: Column, max_imports: int | None = None) -> Column:
    """Text outline over the symbol columns; empty sections are left out.

    ``max_imports`` names only the first imports.
    """
    section = lambda title, rows, array: F.when(
        F.size(array) > 0, F.concat(F.array(F.lit(title)), rows)
    ).otherwise(_strings())
    classes, functions, imports = F.col("classes"), F.col("functions"), F.col("imports")
    head = F.array(F.concat(F.lit("[AST CODE SYMBOLS] File: "), path))
    about = F.when(
        F.col("module_docstring") != "",
        F.array(F.concat(F.lit("Module Summary: "), tx.strip_ws(F.col("module_docstring")))),
    ).otherwise(_strings())
    named = F.array_join(imports if max_imports is None else F.slice(imports, 1, max_imports), ", ")
    uses = F.when(F.size(imports) > 0, F.array(F.concat(F.lit("Imports: "), named))).otherwise(_strings())
    return F.array_join(
        F.concat(
            head,
            about,
            uses,
            section("Classes:", F.flatten(F.transform(classes, _class_lines)), classes),
            section(
                "Standalone Functions:",
                F.transform(functions, lambda f: _signature("  - func ", f)),
                functions,
            ),
        ),
        "\n",
    )
