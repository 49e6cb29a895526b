"""The registered queries as SQL over the same tables, for a side-by-side check.

Symbols of Python files cannot be found by SQL; for them the text states what the
derived view planted.  Everything else is recomputed from the contents, with fixed values of its own.
"""

from __future__ import annotations

from codemem.plans import oracle_values as fixed, queries as qs
from codemem.plans.views import view_sql
from codemem.sources.ignore import compile_rules


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PIECE = f"{fixed.WS}*[^{fixed.WS_CLASS}]+{fixed.WS}*"


def re2(pattern: str) -> str:
    return lit(pattern.replace("(?iu)", "(?i)"))


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def among(column: str, values) -> str:
    return f"{column} IN ({', '.join(lit(v) for v in values)})"


NL = "chr(10)"
TERM = r"[\p{L}\p{N}_]+"
BASE_NAME = "string_split(path, '/')[-1]"


def strip(x: str) -> str:
    return f"trim({x}, {lit(fixed.WS_CHARS)})"


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), {re2(fixed.WS + '+')}, ' ', 'g')"


def redact(x: str) -> str:
    for pattern in fixed.SECRET_PATTERNS.values():
        x = f"regexp_replace({x}, {re2(pattern)}, {lit(fixed.SECRET_MARK)}, 'g')"
    return x


def suffix(path: str) -> str:
    return rf"lower(regexp_extract(string_split({path}, '/')[-1], '(?s).(\.[^.]+)$', 1))"


def lines(x: str) -> str:
    return f"string_split_regex({x}, {re2(fixed.LINE_BREAK)})"


def numbered(x: str) -> str:
    """List as list of {n, v}, counted from 0."""
    return f"list_transform({x}, lambda v, i: {{'n': i - 1, 'v': v}})"


def find(content: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({content}, {re2(pattern)}, {group})"


def arguments(x: str) -> str:
    parts = f"list_transform(string_split({x}, ','), lambda a: {strip('a')})"
    return f"array_to_string(list_filter({parts}, lambda a: a <> ''), ', ')"


def dataset(x: str) -> str:
    base = f"regexp_extract({x}, '([^/]+)/*$', 1)"
    return f"{lit(fixed.DATASET_PREFIX)} || translate(lower({base}), '- ', '__')"


def with_views(names, body: str, **ctes: str) -> str:
    parts = [f"{n} AS ({view_sql(n)})" for n in names] + [f"{n} AS ({t.strip()})" for n, t in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


# ---- symbols --------------------------------------------------------------------------

_JS = among("ext", fixed.JS_SUFFIXES)


def _symbol_ctes() -> dict[str, str]:
    """``sym``: per redacted file the lists of classes, functions and imports."""
    scan = f"""
SELECT repo, path, ext, doc_id, {redact('content')} AS content
FROM code_files WHERE length({strip('content')}) >= {fixed.MIN_CONTENT_CHARS}"""
    pairs = lambda a, b: f"list_zip({find('content', a, b[0])}, {find('content', a, b[1])})"
    alone = lambda p: f"list_transform({find('content', p, 1)}, lambda n: struct_pack(a := n, b := ''))"
    as_struct = lambda x: f"list_transform({x}, lambda z: struct_pack(a := z[1], b := coalesce(z[2], '')))"
    matched = f"""
SELECT repo, path, ext, doc_id, 1 AS parse_ok,
  CASE WHEN {_JS} THEN {find('content', fixed.JS_IMPORT, 1)} ELSE [] END AS imports,
  CASE WHEN {_JS} THEN {as_struct(pairs(fixed.JS_CLASS, (1, 2)))}
       WHEN ext = '.go' THEN {alone(fixed.GO_STRUCT)}
       WHEN ext = '.rs' THEN {alone(fixed.RUST_TYPE)}
       ELSE [] END AS classes,
  CASE WHEN {_JS} THEN list_concat({as_struct(pairs(fixed.JS_FUNCTION, (1, 2)))}, {as_struct(pairs(fixed.JS_ARROW, (1, 2)))})
       WHEN ext = '.go' THEN {as_struct(pairs(fixed.GO_FUNCTION, (1, 2)))}
       WHEN ext = '.rs' THEN {as_struct(pairs(fixed.RUST_FUNCTION, (1, 2)))}
       ELSE [] END AS functions
FROM scan WHERE ext <> '.py'"""
    planted = """
SELECT repo, path, ext, doc_id, CASE WHEN doc_id % 56 IN (0, 8) THEN 0 ELSE 1 END AS parse_ok,
  CASE WHEN doc_id % 56 IN (0, 8) THEN [] ELSE
    ['os', 'numpy', 'lib' || (doc_id % 5) || '.helper', 'lib' || (doc_id % 5) || '.other', 'sibling', 'pkg.sub.*'] END AS imports,
  CASE WHEN doc_id % 56 IN (0, 8) THEN [] ELSE
    [struct_pack(a := 'Base' || doc_id, b := ''), struct_pack(a := 'Child' || doc_id, b := 'Base' || doc_id)] END AS classes,
  CASE WHEN doc_id % 56 IN (0, 8) THEN [] ELSE
    [struct_pack(a := 'top', b := 'q'), struct_pack(a := 'atop', b := 'x'), struct_pack(a := 'top', b := 'z')] END AS functions
FROM scan WHERE ext = '.py'"""
    both = """
SELECT *, list_transform(classes, lambda c: c.a) AS cn, list_transform(functions, lambda f: f.a) AS fn
FROM (SELECT * FROM matched UNION ALL SELECT * FROM planted)"""
    # list_distinct keeps no order; first positions do.
    firsts = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
    uniq = f"SELECT *, {firsts('cn')} AS ucn, {firsts('fn')} AS ufn FROM both_kinds"
    return {"scan": scan, "matched": matched, "planted": planted, "both_kinds": both, "sym": uniq}


def _summary(imports: str = "imports") -> str:
    fn = f"list_transform(functions, lambda f: '  - func ' || f.a || '(' || {arguments('f.b')} || ')')"
    cls = (
        "list_transform(classes, lambda c: '  - Class ' || c.a || "
        "CASE WHEN c.b <> '' THEN ' (inherits: ' || c.b || ')' ELSE '' END"
        " || CASE WHEN ext <> '.py' THEN '' WHEN c.b = '' THEN "
        f"{NL} || '    Doc: Base of ' || doc_id || '.' || {NL} || '    * method run(self, a, b) - Run it.'"
        f" ELSE {NL} || '    * method go(self)' END)"
    )
    return f"""'[AST CODE SYMBOLS] File: ' || path
  || CASE WHEN ext = '.py' AND parse_ok = 1
          THEN {NL} || 'Module Summary: Module m' || doc_id || '.' || {NL} || {NL} || 'Handles part ' || doc_id || '.' ELSE '' END
  || CASE WHEN len(imports) > 0 THEN {NL} || 'Imports: ' || array_to_string({imports}, ', ') ELSE '' END
  || CASE WHEN len(classes) > 0 THEN {NL} || 'Classes:' || {NL} || array_to_string({cls}, {NL}) ELSE '' END
  || CASE WHEN len(functions) > 0 THEN {NL} || 'Standalone Functions:' || {NL} || array_to_string({fn}, {NL}) ELSE '' END"""


def _with_symbols(body: str, **more: str) -> str:
    return with_views(["code_files"], body, **_symbol_ctes(), **more)


def _regex_rows(exts, columns: str, rows: str) -> str:
    return with_views(
        ["code_files"],
        f"SELECT path, {columns} FROM (SELECT path, unnest({rows}) AS r FROM code_files WHERE {among('ext', exts)})",
    )


def _functions_sql(exts, pattern: str) -> str:
    zipped = f"list_zip({find('content', pattern, 1)}, {find('content', pattern, 2)})"
    return _regex_rows(exts, f"r.n AS pos, r.v[1] AS name, {arguments('r.v[2]')} AS args", numbered(zipped))


# ---- comments -------------------------------------------------------------------------

_W = r"[^\p{L}\p{N}_]"


def _tag(tags=fixed.TAGS) -> str:
    return rf"(?i)(?:^|{_W})({'|'.join(tags)})(?:$|{_W})"


def _tagged(x: str, tags=fixed.TAGS) -> str:
    return f"regexp_matches({x}, {lit(_tag(tags))})"


def _line_records(marker: str) -> str:
    text = strip(f"regexp_extract(r.v, {re2('(?s)' + marker + fixed.WS + '*(.*)')}, 1)")
    return f"""SELECT path, ext, 'line' AS kind, r.n + 1 AS line, r.n + 1 AS ord, {text} AS text
FROM (SELECT path, ext, unnest({numbered(lines('content'))}) AS r FROM code_files) WHERE contains(r.v, {lit(marker)})"""


def _ordered(kind: str, values: str, key: str = "path", table: str = "code_files") -> str:
    """Numbered records from a list of texts."""
    keys = f"{key}, ext" if table == "code_files" else key
    return f"""SELECT {keys}, {lit(kind)} AS kind, NULL AS line, r.n AS ord, r.v AS text
FROM (SELECT {keys}, unnest({numbered(values)}) AS r FROM {table})"""


def _block_texts(content: str, pattern: str, clean, tags) -> str:
    blocks = f"list_transform({find(content, pattern, 1)}, lambda b: {lines('b')})"
    return f"list_filter(list_transform(flatten({blocks}), lambda l: {clean('l')}), lambda t: {_tagged('t', tags)})"


def _comment_ctes() -> dict[str, str]:
    starless = lambda l: strip(f"ltrim({strip(l)}, '*')")
    quoted = lambda q: find("content", f"(?s){q}(.*?){q}", 1)
    q3, s3 = '"""', "'''"
    docs = f"list_filter(list_transform(list_concat({quoted(q3)}, {quoted(s3)}), lambda d: {strip('d')}), lambda d: d <> '')"
    hash_, slash, markup = (among("ext", e) for e in (fixed.HASH_SUFFIXES, fixed.SLASH_SUFFIXES, fixed.MARKUP_SUFFIXES))
    return {
        "hash_rows": f"SELECT * FROM ({_line_records('#')}) WHERE {hash_} AND {_tagged('text')}",
        "doc_rows": f"SELECT * FROM ({_ordered('docstring', docs)}) WHERE {hash_}",
        "slash_rows": f"SELECT * FROM ({_line_records('//')}) WHERE {slash} AND {_tagged('text')}",
        "block_rows": "SELECT * FROM ("
        + _ordered("block", _block_texts("content", r"(?s)/\*(.*?)\*/", starless, fixed.TAGS))
        + f") WHERE {slash}",
        "html_rows": "SELECT * FROM ("
        + _ordered("html", _block_texts("content", r"(?s)<!--(.*?)-->", strip, fixed.TAGS))
        + f") WHERE {markup}",
        "all_rows": " UNION ALL ".join(
            f"SELECT * FROM {t}" for t in ("hash_rows", "doc_rows", "slash_rows", "block_rows", "html_rows")
        ),
        "log_rows": f"""
SELECT path, 'File Path: ' || path || {NL} || string_agg(
  CASE kind WHEN 'line' THEN 'Line ' || line || ': ' WHEN 'docstring' THEN 'Docstring: '
            WHEN 'block' THEN 'Block Comment: ' ELSE 'HTML Comment: ' END || text, {NL}
  ORDER BY CASE kind WHEN 'line' THEN 0 ELSE 1 END, ord) AS text
FROM all_rows GROUP BY path""",
    }


def _with_comments(body: str) -> str:
    return with_views(["code_files"], body, **_comment_ctes())


# ---- commits --------------------------------------------------------------------------

_PATH = "coalesce(nullif(b_path, ''), a_path)"
_PATCH = (
    "CASE WHEN length(coalesce(patch, '')) > 1000 "
    f"THEN substr(patch, 1, 1000) || {NL} || '... [diff truncated for token optimization]' ELSE coalesce(patch, '') END"
)
_HEADER = (
    f"'Commit Hash: ' || hash || {NL} || 'Author: ' || author || ' <' || email || '>' || {NL} || 'Date: ' "
    f"|| strftime(authored_ts, '%Y-%m-%dT%H:%M:%S') || tz || {NL} || 'Message: ' || {strip('message')}"
)
_LATEST = "row_number() OVER (PARTITION BY repo ORDER BY authored_ts DESC, hash)"


def _commit_text_ctes(source: str, patch: str = _PATCH) -> dict[str, str]:
    header = _HEADER.replace("|| hash ||", "|| h.hash ||")
    return {
        "bodies": f"""
SELECT hash, ord // {fixed.FILES_PER_PART} AS part, string_agg(CASE WHEN is_root THEN CASE WHEN ord = 0 THEN '' ELSE ', ' END || {_PATH}
  ELSE {NL} || {NL} || 'Diff for ' || {_PATH} || ':' || {NL} || {patch} END, '' ORDER BY ord) AS body
FROM commit_files GROUP BY ALL""",
        "texts": f"""
SELECT repo, h.hash, coalesce(part, 0) AS part,
  CASE WHEN coalesce(part, 0) = 0 THEN {header} || CASE WHEN is_root THEN {lit(fixed.ROOT_LABEL)} ELSE '' END ELSE '' END
  || coalesce(body, '') AS text
FROM {source} h LEFT JOIN bodies b ON h.hash = b.hash""",
    }


# ---- memory ---------------------------------------------------------------------------


def _pieces(x: str) -> str:
    return find(x, PIECE, 0)


def _chunk_cte(source: str, keys: str) -> dict[str, str]:
    n = fixed.DEFAULT_CHUNK_TOKENS
    return {
        "pieced": f"SELECT {keys}, {_pieces('text')} AS p FROM {source}",
        "numbered": f"SELECT {keys}, p, unnest(range(0, CAST(ceil(len(p) / {n}.0) AS BIGINT))) AS chunk_no FROM pieced",
        "chunks": f"""
SELECT {keys}, chunk_no, array_to_string(p[chunk_no * {n} + 1 : chunk_no * {n} + {n}], '') AS text FROM numbered""",
    }


def _weights(source: str, keys: str) -> dict[str, str]:
    """Sparse vectors of ``source(keys, text)``: ``w(keys, bucket, weight)``."""
    bucket = f"('0x' || substr(md5(t), 1, 8))::BIGINT % {fixed.DEFAULT_DIM}"
    return {
        f"{source}_t": f"SELECT {keys}, unnest({find('lower(text)', TERM, 0)}) AS t FROM {source}",
        f"{source}_c": f"SELECT {keys}, {bucket} AS bucket, count(*)::DOUBLE AS n FROM {source}_t GROUP BY ALL",
        f"{source}_w": f"""
SELECT {keys}, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS FLOAT) AS weight FROM {source}_c""",
    }


_KEYS = "dataset, doc_id, chunk_no"


def _safe_docs() -> str:
    return f"SELECT dataset, doc_id, path, {redact('text')} AS text FROM memory_docs"


def _recall_ctes(question: str, docs: str | None = None) -> dict[str, str]:
    """``scores(query_id, dataset, doc_id, chunk_no, score)`` for the questions of a SQL text."""
    return {
        "safe": docs or _safe_docs(),
        **_chunk_cte("safe", "dataset, doc_id, path"),
        **_weights("chunks", _KEYS),
        "asked": question,
        **_weights("asked", "query_id"),
        "hits": """
SELECT query_id, dataset, doc_id, chunk_no, sum(a.weight::DOUBLE * c.weight::DOUBLE) AS s
FROM asked_w a JOIN chunks_w c USING (bucket) GROUP BY ALL""",
        "lengths": "SELECT query_id, sqrt(sum(weight::DOUBLE * weight::DOUBLE)) AS len FROM asked_w GROUP BY query_id",
        "scores": """
SELECT query_id, c.dataset, c.doc_id, c.path, c.chunk_no, round(coalesce(s / len, 0), 6) AS score, c.text
FROM chunks c CROSS JOIN (SELECT query_id, len FROM asked LEFT JOIN lengths USING (query_id)) q
LEFT JOIN hits USING (query_id, dataset, doc_id, chunk_no)""",
    }


_FIRST_ITEM = "SELECT 0 AS query_id, arg_min(text, item_id) AS text FROM benchmark"
_BEST = "ORDER BY score DESC, dataset, doc_id, chunk_no"


def _top(k: int, where: str = "true", partition: str = "") -> str:
    return f"""
SELECT * FROM (SELECT row_number() OVER ({partition} {_BEST}) AS rank, * FROM scores WHERE {where}) WHERE rank <= {k}"""


def _recall_sql(k: int, where: str = "true", partition: str = "") -> str:
    body = f"SELECT rank, dataset, doc_id, chunk_no, score, text FROM ({_top(k, where, partition)})"
    return with_views(["memory_docs"], body, **_recall_ctes(_FIRST_ITEM))


# ---- graph ----------------------------------------------------------------------------


def _node_rows() -> str:
    def part(grp: str, source: str, id_: str, label: str, title: str, path: str) -> str:
        shape, size = fixed.NODE_SHAPES[grp]
        return (
            f"SELECT repo, path AS file, {id_} AS id, {lit(grp)} AS grp, {label} AS label, {title} AS title, "
            f"{path} AS path, {lit(shape)} AS shape, CAST({size} AS BIGINT) AS size FROM {source}"
        )

    names = lambda c: f"(SELECT repo, path, unnest({c}) AS n FROM sym)"
    return " UNION ALL ".join(
        (
            part("file", "sym", "'file:' || path", "string_split(path, '/')[-1]", "'File: ' || path", "path"),
            part("class", names("ucn"), "'class:' || path || ':' || n", "'Class ' || n", "'Class ' || n || ' in ' || path", "NULL"),
            part("func", names("ufn"), "'func:' || path || ':' || n", "'fn ' || n || '()'", "'Function ' || n || ' in ' || path", "NULL"),
        )
    )


_EDGE_ROWS = """
SELECT repo, 'file:' || file AS src, id AS dst, 'defines' AS label, file FROM nodes WHERE grp <> 'file'"""


def _with_graph(body: str, **more: str) -> str:
    return _with_symbols(body, nodes=_node_rows(), edges=_EDGE_ROWS, **more)


def _with_packages(body: str, **more: str) -> str:
    """``edges``: what the planted files import, stated from their numbers."""
    found = f"SELECT repo, path, doc_id, i, block, pos FROM package_files WHERE length({strip('content')}) >= {fixed.MIN_CONTENT_CHARS}"
    planted = """
SELECT repo, path, 'os' AS module, NULL AS to_id FROM held
UNION ALL SELECT repo, path, 'lib.core', doc_id - 8 * i FROM held WHERE i > 0
UNION ALL SELECT repo, path, 'lib.p' || block || '.m' || (doc_id + 120) || '.' || n, doc_id + 120
  FROM held, (VALUES ('run'), ('other')) v(n) WHERE i > 0 AND pos = 0
UNION ALL SELECT repo, path, 'p' || block, CASE WHEN block > 0 THEN doc_id - 8 END FROM held WHERE pos = 1
UNION ALL SELECT repo, path, 'p' || block || '.m' || (doc_id - 8), doc_id - 8 FROM held WHERE pos > 1
UNION ALL SELECT repo, path, 'lib.p' || block || '.m' || (doc_id - 24), doc_id - 24 FROM held WHERE pos > 3 AND pos % 4 = 3"""
    edges = """
SELECT p.repo, p.path, p.module, coalesce(t.path, p.module) AS target, CAST(t.path IS NOT NULL AS BIGINT) AS inside
FROM planted p LEFT JOIN held t ON t.doc_id = p.to_id"""
    return with_views(
        ["package_files"], body, held=found, planted=planted, edges=edges, links="SELECT DISTINCT repo, target, path FROM edges", **more
    ).replace("WITH ", "WITH RECURSIVE ", 1)


_DIFF = """
SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
       WHEN o.content = n.content THEN 'unchanged' ELSE 'modified' END AS change_type
FROM snap_old o FULL OUTER JOIN snap_new n ON o.repo = n.repo AND o.path = n.path"""

_DECISION_DOCS = f"""
SELECT '{fixed.DECISION_DATASET}' || CAST(floor(epoch(ts)) AS BIGINT) AS dataset, 'decision:' || id AS doc_id,
  {lit(fixed.DECISION_LEAD)} || text AS text
FROM decisions WHERE text <> ''"""


def _ignored_names() -> str:
    """Every tested name of a path with the verdict of the last rule that matches it."""
    values = ", ".join(f"({r.ord}, {lit(r.regex)}, {str(r.negated).lower()})" for r in compile_rules(qs.IGNORE_LINES))
    return f"""
WITH rules(ord, regex, negated) AS (VALUES {values}), paths AS ({view_sql('paths')}),
parts AS (SELECT page_id, string_split(path, '/') AS s FROM paths),
names AS (SELECT page_id, unnest(list_transform(range(1, len(s) + 1),
  lambda i: array_to_string(s[1:i], '/') || CASE WHEN i < len(s) THEN '/' ELSE '' END)) AS name FROM parts),
verdicts AS (SELECT page_id, name, arg_max(negated, ord) AS negated
  FROM names JOIN rules ON regexp_matches(name, regex) GROUP BY page_id, name)
SELECT page_id, path FROM paths WHERE page_id NOT IN (SELECT page_id FROM verdicts WHERE NOT negated)"""


def _ignored_by_repo() -> str:
    rules = [(repo, r) for repo, text in qs.RULE_FILES.items() for r in compile_rules(text.split("\n"))]
    values = ", ".join(f"({lit(repo)}, {r.ord}, {lit(r.regex)}, {str(r.negated).lower()})" for repo, r in rules)
    return f"""
WITH rules(repo, ord, regex, negated) AS (VALUES {values}), paths AS ({view_sql('paths')}),
parts AS (SELECT page_id, 'repo' || (page_id % 4) AS repo, path, string_split(path, '/') AS s FROM paths),
names AS (SELECT page_id, repo, unnest(list_transform(range(1, len(s) + 1),
  lambda i: array_to_string(s[1:i], '/') || CASE WHEN i < len(s) THEN '/' ELSE '' END)) AS name FROM parts),
verdicts AS (SELECT page_id, name, arg_max(negated, ord) AS negated
  FROM names JOIN rules ON rules.repo = names.repo AND regexp_matches(name, regex) GROUP BY page_id, name)
SELECT page_id, repo, path FROM parts WHERE page_id NOT IN (SELECT page_id FROM verdicts WHERE NOT negated)""".strip()


def build() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources and path filters
    sql["scan_corpus"] = with_views(
        ["code_files"],
        f"""SELECT path, length(content) AS n_chars, sha256(content) AS sha256 FROM (
SELECT repo || '/' || path AS path, {redact('content')} AS content FROM code_files
WHERE {among('ext', fixed.TEXT_SUFFIXES)} AND length({strip('content')}) >= {fixed.MIN_CONTENT_CHARS})""",
    )
    sql["filter_ignored_dirs"] = with_views(
        ["paths"],
        f"SELECT page_id, path FROM paths WHERE NOT list_has_any(string_split(path, '/')[:-2], {strings(fixed.IGNORED_DIRS)})",
    )
    sql["filter_text_files"] = with_views(
        ["paths"],
        f"SELECT page_id, path FROM paths WHERE {among(suffix('path'), fixed.TEXT_SUFFIXES)} "
        f"OR {among(BASE_NAME, fixed.EXPLICIT_FILES)}",
    )
    sql["filter_gitignore"] = _ignored_names().strip()
    sql["filter_gitignore_by_repo"] = _ignored_by_repo()
    sql["decode_text"] = (
        "SELECT doc_id, replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
        " || 'é' || chr(10) || 'end' AS content FROM documents"
    )
    sql["filter_trivial"] = (
        f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length({strip('text')}) >= {fixed.MIN_CONTENT_CHARS}"
    )
    sql["redact_secrets"] = f"SELECT doc_id, {redact('text')} AS text FROM documents"
    counts, current = [], "text"
    for key, pattern in fixed.SECRET_PATTERNS.items():
        counts.append(f"SELECT {lit(key)} AS pattern, len({find(current, pattern, 0)}) AS n FROM texts")
        current = f"regexp_replace({current}, {re2(pattern)}, {lit(fixed.SECRET_MARK)}, 'g')"
    sql["redact_report"] = with_views(
        ["code_files"],
        "SELECT pattern, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (WHERE n > 0) AS texts "
        f"FROM ({' UNION ALL '.join(counts)}) GROUP BY pattern",
        texts="SELECT text FROM documents UNION ALL SELECT content FROM code_files",
    )
    sql["dataset_names"] = with_views(["folders"], f"SELECT page_id, {dataset('folder')} AS dataset FROM folders")
    sql["changed_files"] = with_views(
        ["status"],
        """SELECT DISTINCT repo, path FROM flagged WHERE ws
UNION SELECT repo, path FROM flagged WHERE NOT ws AND repo NOT IN (SELECT repo FROM flagged WHERE ws)""",
        flagged=f"SELECT repo, replace({_PATH}, chr(92), '/') AS path, area <> 'last_commit' AS ws FROM status",
    )
    sql["incremental_files"] = with_views(
        ["snap_old", "snap_new"],
        """SELECT n.repo, n.path, length(n.content) AS n_chars FROM snap_new n JOIN diff d
ON n.repo = d.repo AND n.path = d.path WHERE d.change_type IN ('added', 'modified')""",
        diff=_DIFF,
    )

    # symbols
    sql["symbols_all"] = _with_symbols(
        "SELECT repo, path, len(imports) AS n_imports, len(classes) AS n_classes, len(functions) AS n_functions, "
        "CAST(parse_ok AS BIGINT) AS parse_ok FROM sym"
    )
    py = "FROM code_files WHERE ext = '.py' AND doc_id % 56 <> 0"
    doc = f"'Module m' || doc_id || '.' || {NL} || {NL} || 'Handles part ' || doc_id || '.'"
    planted = lambda kind, pos, name, args, d, line: (
        f"SELECT path, {doc} AS module_docstring, '{kind}' AS kind, CAST({pos} AS BIGINT) AS pos, {name} AS name, "
        f"'{args}' AS args, {d} AS docstring, CAST({line} AS BIGINT) AS lineno {py}"
    )
    sql["py_symbols"] = with_views(
        ["code_files"],
        " UNION ALL ".join(
            (
                planted("class", 0, "'Base' || doc_id", "", "'Base of ' || doc_id || '. '", 13),
                planted("class", 1, "'Child' || doc_id", "", "''", 21),
                planted("function", 0, "'top'", "q", "''", 23),
                planted("function", 1, "'atop'", "x", "''", 25),
                planted("function", 2, "'top'", "z", "''", 26),
            )
        ),
    )
    sql["py_symbols_sql"] = sql["py_symbols"]
    sql["py_bases"] = with_views(["code_files"], f"SELECT path, 'Child' || doc_id AS class, 'Base' || doc_id AS base {py}")
    sql["py_methods"] = with_views(
        ["code_files"],
        f"""SELECT path, 'Base' || doc_id AS class, 'run' AS name, 'self, a, b' AS args, 'Run it.' AS docstring, CAST(15 AS BIGINT) AS lineno {py}
UNION ALL SELECT path, 'Child' || doc_id, 'go', 'self', '', 22 {py}""",
    )
    sql["py_imports"] = with_views(
        ["code_files"],
        f"""SELECT path, r.n AS pos, r.v AS module FROM (SELECT path, unnest({numbered(
            "['os', 'numpy', 'lib' || (doc_id % 5) || '.helper', 'lib' || (doc_id % 5) || '.other', 'sibling', 'pkg.sub.*']"
        )}) AS r {py})""",
    )
    sql["parse_failures"] = with_views(
        ["code_files"], "SELECT repo, path FROM code_files WHERE ext = '.py' AND doc_id % 56 IN (0, 8)"
    )
    zipped = f"list_zip({find('content', fixed.JS_CLASS, 1)}, {find('content', fixed.JS_CLASS, 2)})"
    sql["js_classes"] = _regex_rows(
        fixed.JS_SUFFIXES, "r.n AS pos, r.v[1] AS name, nullif(r.v[2], '') AS base", numbered(zipped)
    )
    sql["js_functions"] = _functions_sql(fixed.JS_SUFFIXES, fixed.JS_FUNCTION)
    sql["js_arrows"] = _functions_sql(fixed.JS_SUFFIXES, fixed.JS_ARROW)
    one = lambda exts, pattern, name: _regex_rows(exts, f"r.n AS pos, r.v AS {name}", numbered(find("content", pattern, 1)))
    sql["js_imports"] = one(fixed.JS_SUFFIXES, fixed.JS_IMPORT, "module")
    sql["go_structs"] = one((fixed.GO_SUFFIX,), fixed.GO_STRUCT, "name")
    sql["go_functions"] = _functions_sql((fixed.GO_SUFFIX,), fixed.GO_FUNCTION)
    sql["rust_types"] = one((fixed.RUST_SUFFIX,), fixed.RUST_TYPE, "name")
    sql["rust_functions"] = _functions_sql((fixed.RUST_SUFFIX,), fixed.RUST_FUNCTION)
    sql["symbol_summary"] = _with_symbols(f"SELECT repo, path, {_summary('imports[1:15]')} AS summary FROM sym")

    # comments
    sql["tag_counts"] = _with_comments(
        f"SELECT tag, count(*) AS n FROM (SELECT upper(unnest(regexp_extract_all(text, {lit(_tag())}, 1))) AS tag FROM all_rows) GROUP BY tag"
    )
    sql["comments_hash"] = _with_comments("SELECT path, line, text FROM hash_rows")
    sql["comments_docstring"] = _with_comments("SELECT path, ord, text FROM doc_rows")
    sql["comments_slash"] = _with_comments("SELECT path, line, text FROM slash_rows")
    sql["comments_block"] = _with_comments("SELECT path, ord, text FROM block_rows")
    ads = _ordered("html", _block_texts("html", r"(?s)<!--(.*?)-->", strip, ("AD",)), "page_id", "pages")
    sql["comments_html"] = f"SELECT page_id, ord, text FROM ({ads})"
    sql["comments_all"] = _with_comments("SELECT path, kind, ord, text FROM all_rows")
    sql["comment_log"] = _with_comments("SELECT path, text FROM log_rows")

    # commits
    sql["commits_latest"] = with_views(
        ["commits"],
        f"SELECT repo, hash, rank FROM (SELECT repo, hash, {_LATEST} AS rank FROM commits) WHERE rank <= {fixed.DEFAULT_COMMITS}",
    )
    sql["commit_headers"] = with_views(["commits"], f"SELECT repo, hash, {_HEADER} AS header FROM commits")
    sql["commit_diffs"] = with_views(
        ["commit_files"],
        f"SELECT hash, ord, {_PATH} AS path, {NL} || 'Diff for ' || {_PATH} || ':' || {NL} || {_PATCH} AS section "
        "FROM commit_files WHERE NOT is_root",
    )
    sql["patch_truncate"] = with_views(["commit_files"], f"SELECT hash, ord, {_PATCH} AS patch FROM commit_files")
    sql["commit_root_files"] = with_views(
        ["commit_files"],
        f"SELECT hash, ord // {fixed.FILES_PER_PART} AS part, string_agg({_PATH}, ', ' ORDER BY ord) AS files "
        "FROM commit_files WHERE is_root GROUP BY ALL",
    )
    sql["commit_docs"] = with_views(
        ["commits", "commit_files"], "SELECT repo, hash, part, text FROM texts", **_commit_text_ctes("commits")
    )

    # memory
    sql["ingest_docs"] = with_views(
        ["memory_docs"],
        f"""SELECT {_KEYS}, sha256(text) AS sha256, round(coalesce(m, 0), 4) AS mass FROM chunks LEFT JOIN
(SELECT {_KEYS}, sum(weight::DOUBLE) AS m FROM chunks_w GROUP BY ALL) USING ({_KEYS})""",
        safe=_safe_docs(), **_chunk_cte("safe", "dataset, doc_id"), **_weights("chunks", _KEYS),
    )
    sql["chunk_documents"] = "WITH " + ", ".join(
        f"{n} AS ({t.strip()})" for n, t in _chunk_cte("documents", "doc_id").items()
    ) + " SELECT doc_id, chunk_no, text FROM chunks"
    sql["embed_hash"] = "WITH " + ", ".join(
        f"{n} AS ({t.strip()})" for n, t in _weights("documents", "doc_id").items()
    ) + " SELECT doc_id, bucket, round(weight::DOUBLE, 6) AS weight FROM documents_w"
    sql["index_write"] = with_views(
        ["memory_docs"],
        """SELECT dataset, n_docs, n_chunks, n_chars FROM (SELECT dataset, count(*) AS n_docs FROM safe GROUP BY dataset)
LEFT JOIN (SELECT dataset, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY dataset) USING (dataset)""",
        safe=_safe_docs(), **_chunk_cte("safe", "dataset, doc_id"),
    )
    sql["recall_topk"] = _recall_sql(fixed.DEFAULT_K, f"dataset = {lit(qs.RECALL_DATASET)}")
    sql["recall_all_datasets"] = _recall_sql(10)
    sql["recall_per_dataset"] = _recall_sql(fixed.DEFAULT_K, partition="PARTITION BY dataset")
    sql["recall_answer_text"] = with_views(
        ["memory_docs"],
        f"""SELECT CASE WHEN (SELECT count(*) FROM best) = 0 THEN {lit(fixed.NO_RESULTS)}
  ELSE coalesce(string_agg(text, {NL} || {NL} ORDER BY rank), {lit(fixed.NO_TEXTS)}) END AS answer
FROM (SELECT rank, text, row_number() OVER (PARTITION BY {norm('text')} ORDER BY rank) AS n FROM best
      WHERE {norm('text')} NOT IN ('', {lit(fixed.EMPTY_REPLY)})) WHERE n = 1""",
        **_recall_ctes(_FIRST_ITEM), best=_top(10),
    )
    sql["recall_batch"] = with_views(
        ["memory_docs"],
        f"SELECT query_id, rank, dataset, doc_id, chunk_no, score FROM ({_top(fixed.DEFAULT_K, partition='PARTITION BY query_id')})",
        **_recall_ctes("SELECT item_id AS query_id, text FROM benchmark"),
    )
    sql["recall_similar"] = with_views(
        ["memory_docs"],
        f"SELECT query_id, rank, dataset, doc_id, chunk_no, score FROM ({_top(1, partition='PARTITION BY query_id')})",
        **_recall_ctes("SELECT doc_id || ':' || chunk_no AS query_id, text FROM chunks WHERE CAST(doc_id AS BIGINT) % 100 = 0"),
    )
    sql["recall_indexed"] = with_views(
        ["memory_docs"],
        f"SELECT query_id, rank, dataset, doc_id, chunk_no, score, text FROM ({_top(10, partition='PARTITION BY query_id')})",
        **_recall_ctes("SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 10 = 0"),
    )
    sql["recall_vectors"] = """
WITH entries AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label AS query_id, i, avg(x) AS x FROM entries GROUP BY label, i),
queries AS (SELECT query_id, sqrt(sum(x * x)) AS len FROM means GROUP BY query_id),
lengths AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM entries GROUP BY vec_id),
dots AS (SELECT m.query_id, e.vec_id, sum(m.x * e.x) AS s FROM means m JOIN entries e ON m.i = e.i GROUP BY ALL),
scores AS (SELECT query_id, vec_id, round(s / (q.len * l.len), 6) + 0.0 AS score
  FROM dots JOIN queries q USING (query_id) JOIN lengths l USING (vec_id))
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5""".strip()
    sql["dedup_normalized"] = f"""
SELECT doc_id, text FROM (SELECT doc_id, text, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n
  FROM (SELECT doc_id, text, {norm('text')} AS k FROM documents)) WHERE n = 1 AND k NOT IN ('', {lit(fixed.EMPTY_REPLY)})""".strip()
    sql["list_datasets"] = with_views(
        ["memory_docs", "decisions"],
        "SELECT dataset FROM memory_docs UNION SELECT dataset FROM logged",
        logged=_DECISION_DOCS,
    )
    sql["decision_log"] = with_views(["decisions"], _DECISION_DOCS)
    sql["stream_ingest"] = sql["decision_log"]
    sql["forget_dataset"] = with_views(
        ["memory_docs"],
        f"SELECT dataset, count(*) AS n_docs FROM memory_docs WHERE NOT {among('dataset', qs.FORGET_DATASETS)} GROUP BY dataset",
    )
    sql["forget_file"] = with_views(
        ["memory_docs", "snap_old", "snap_new"],
        r"""SELECT dataset, doc_id, path FROM memory_docs WHERE doc_id NOT IN
(SELECT regexp_extract(path, '(\d+)\.md$', 1) FROM diff WHERE change_type = 'deleted')""",
        diff=_DIFF,
    )
    sql["forget_file_substring"] = with_views(
        ["memory_docs"],
        f"SELECT dataset, doc_id, path FROM memory_docs WHERE NOT contains(text, {lit('File Path: ' + qs.FORGET_PATH)}) "
        f"AND NOT contains(path, {lit(qs.FORGET_PATH)})",
    )
    sql["forget_tag"] = f"SELECT doc_id, lang AS tag FROM documents WHERE NOT {among('lang', qs.FORGET_TAGS)}"
    sql["forget_all"] = "SELECT count(*) AS docs_before, CAST(0 AS BIGINT) AS docs_after FROM documents"
    sql["refresh_upsert"] = with_views(
        ["snap_new"], f"SELECT {dataset('repo')} AS dataset, path AS doc_id, {redact('content')} AS text FROM snap_new"
    )
    sql["decision_timeline"] = with_views(
        ["decisions"],
        "SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, text FROM "
        f"(SELECT * FROM decisions WHERE text <> '' ORDER BY decisions.ts DESC, id DESC LIMIT {qs.TIMELINE_ROWS}) d",
    )
    sql["memory_status"] = with_views(
        ["commits", "decisions", "memory_docs"],
        f"""SELECT dataset, kind, count(*) AS n_docs, strftime(max(ingested), '%Y-%m-%d %H:%M:%S') AS last FROM (
SELECT {dataset('repo')} AS dataset, 'commit' AS kind, authored_ts AS ingested FROM commits
UNION ALL SELECT 'adr_decision', 'decision', ts FROM decisions WHERE text <> ''
UNION ALL SELECT dataset, kind, make_timestamp((1700000000 + doc_no) * 1000000) FROM memory_docs) GROUP BY dataset, kind""",
    )

    # graph
    sql["graph_nodes"] = _with_graph("SELECT repo, id, grp, label, title, path, shape, size FROM nodes")
    sql["graph_refresh"] = sql["graph_nodes"]
    sql["graph_edges"] = _with_graph("SELECT repo, src, dst, label FROM edges")
    sql["graph_stats"] = _with_symbols(
        """SELECT count(*) AS total_files, CAST(sum(len(classes)) AS BIGINT) AS total_classes,
  CAST(sum(len(functions)) AS BIGINT) AS total_funcs, CAST(count(*) + sum(len(ucn) + len(ufn)) AS BIGINT) AS total_nodes,
  CAST(sum(len(ucn) + len(ufn)) AS BIGINT) AS total_edges FROM sym"""
    )
    items = (
        "list_concat(list_transform(ucn, lambda n: '  - Class ' || n), list_transform(ufn, lambda n: '  - fn ' || n || '()'))"
    )
    sql["digest_rows"] = _with_symbols(
        f"SELECT repo, path, '### 📄 `' || path || '`' || {NL} || CASE WHEN len({items}) > 0 "
        f"THEN array_to_string({items}, {NL}) ELSE {lit(fixed.NO_SYMBOLS)} END AS section FROM sym"
    )
    quote = lambda x: f"'\"' || {x} || '\"'"
    sql["graph_json"] = _with_graph(
        f"""SELECT id, '{{"id":' || {quote('id')} || ',"label":' || {quote('label')} || ',"group":' || {quote('grp')}
  || ',"title":' || {quote('title')} || coalesce(',"path":' || {quote('path')}, '') || ',"shape":' || {quote('shape')}
  || ',"size":' || size || '}}' AS json FROM nodes
UNION ALL SELECT src || '->' || dst, '{{"from":' || {quote('src')} || ',"to":' || {quote('dst')}
  || ',"label":' || {quote('label')} || '}}' FROM edges"""
    )
    sql["graph_filter"] = _with_graph(
        f"SELECT repo, id, label FROM nodes WHERE contains(lower(label), lower({lit(qs.GRAPH_FILTER)}))"
    )
    sql["prune_stale"] = _with_graph(
        "SELECT n.repo, n.id FROM nodes n JOIN code_files c ON n.repo = c.repo AND n.file = c.path WHERE c.doc_id % 17 <> 0"
    )
    sql["snapshot_diff"] = with_views(["snap_old", "snap_new"], _DIFF)
    sql["importers_of"] = _with_symbols("SELECT DISTINCT module, repo, path FROM (SELECT repo, path, unnest(imports) AS module FROM sym)")
    sql["recall_with_graph"] = with_views(
        ["code_files"],
        "SELECT b.rank, n.file, n.id, n.grp, n.label FROM best b JOIN nodes n ON b.path = n.file AND b.dataset = " + dataset('n.repo') + " WHERE n.grp <> 'file'",
        **_symbol_ctes(), nodes=_node_rows(),
        **_recall_ctes(
            _FIRST_ITEM,
            f"SELECT {dataset('repo')} AS dataset, path AS doc_id, path, {redact('content')} AS text FROM code_files",
        ),
        best=_top(5),
    )
    remembered = {**_symbol_ctes(), **_comment_ctes(), **_commit_text_ctes("commits", "coalesce(patch, '')")}
    file_text = _file_text()
    sql["remember_corpus"] = with_views(
        ["code_files", "commits", "commit_files"],
        f"""SELECT dataset, doc_id, kind, sha256({redact('text')}) AS sha256 FROM (
SELECT {dataset('f.repo')} AS dataset, 'file:' || f.path AS doc_id, 'file' AS kind, f.text FROM ({file_text}) f
UNION ALL SELECT {dataset('c.repo')}, 'comments:' || l.path, 'comment', l.text FROM log_rows l
  JOIN code_files c ON l.path = c.path
UNION ALL SELECT {dataset('t.repo')}, 'commit:' || t.hash || ':' || t.part, 'commit', t.text FROM texts t)""",
        **remembered,
    )
    sql["import_edges"] = _with_packages("SELECT repo, path, module, target, inside FROM edges")
    sql["importers_closure"] = _with_packages(
        "SELECT repo, target, path, CAST(min(hops) AS BIGINT) AS hops FROM pairs WHERE target <> path GROUP BY ALL",
        # The longest of the shortest chains runs around a circle of sixteen files.
        pairs="""
SELECT repo, target, path, 1 AS hops FROM links
UNION SELECT p.repo, p.target, l.path, p.hops + 1 FROM pairs p JOIN links l ON l.repo = p.repo AND l.target = p.path WHERE p.hops < 20""",
    )
    sql["recall_import_neighbours"] = _with_packages(
        """SELECT rank, repo, file, min(hops) AS hops, arg_min(array_to_string(way, ' > '), struct_pack(h := hops, w := way)) AS via FROM (
  SELECT rank, repo, file, 1 AS hops, way FROM one UNION ALL SELECT rank, repo, file, 2, way FROM two)
WHERE file <> way[1] GROUP BY ALL""",
        **_recall_ctes(
            _FIRST_ITEM,
            f"SELECT {dataset('repo')} AS dataset, path AS doc_id, path, repo, {redact('content')} AS text FROM package_files",
        ),
        best=_top(5),
        near="""
SELECT repo, path AS file, target AS near FROM edges WHERE inside = 1
UNION SELECT repo, target, path FROM edges WHERE inside = 1""",
        one="""
SELECT b.rank, n.repo, n.near AS file, [n.file, n.near] AS way
FROM best b JOIN package_files f ON f.path = b.path AND """ + dataset("f.repo") + """ = b.dataset JOIN near n ON n.repo = f.repo AND n.file = f.path""",
        two="SELECT o.rank, n.repo, n.near AS file, list_append(o.way, n.near) AS way FROM one o JOIN near n ON n.repo = o.repo AND n.file = o.file",
    )
    sql["tagged_docs"] = _with_symbols(f"SELECT path, text FROM ({file_text})")
    return sql


def _file_text() -> str:
    outlined = f"SELECT repo, path, {_summary()} AS summary FROM sym"
    return (
        f"SELECT o.repo, o.path, 'File Path: ' || o.path || {NL} || o.summary || {NL} || '---' || {NL} || c.content AS text "
        f"FROM ({outlined}) o JOIN scan c ON o.repo = c.repo AND o.path = c.path"
    )
