"""Column types of the tables the jobs exchange."""

FUNC = "STRUCT<name: STRING, args: ARRAY<STRING>, docstring: STRING, lineno: INT>"
CLASS = (
    f"STRUCT<name: STRING, bases: ARRAY<STRING>, methods: ARRAY<{FUNC}>, docstring: STRING, lineno: INT>"
)
COMMENT = "STRUCT<kind: STRING, line: INT, ord: INT, text: STRING>"

# Extracted symbols of a file; ``parse_ok`` is false for Python that does not parse.
SYMBOL_COLUMNS = (
    "module_docstring STRING, imports ARRAY<STRING>, "
    f"classes ARRAY<{CLASS}>, functions ARRAY<{FUNC}>, parse_ok BOOLEAN"
)

DOC_COLUMNS = ("dataset", "doc_id", "kind", "path", "text")
CHUNK_COLUMNS = ("dataset", "doc_id", "kind", "path", "chunk_no", "text", "embedding")
