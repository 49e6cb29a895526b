"""Registered queries of the training-data operators, with their production parameters, and SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from codemem.llm import bpe, lexical, licenses, mixing, neardup, outliers, passages, ppm, repair, runindex, secrets, shards, topk
from codemem.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op3_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.materialise(table(spark, sf_dir, "documents"), bpe.Vocabulary(spark, TOKENIZER))


def op6_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.Vocabulary(spark, TOKENIZER))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("tie")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.train_and_score(table(spark, sf_dir, "documents"))


def op11_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digest(runindex.without_repeats(table(spark, sf_dir, "documents")))


def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_kd_search, op2_secret_scan, op3_chained_passages, op4_source_mix, op5_training_order, op6_forced_bpe, op7_robust_outliers,
        op8_licence_scan, op9_near_duplicates, op10_partial_matching, op11_run_index, op12_lightest_repair, op13_treap_search,
    )
}

# A deduction of the repair in SQL: an edit appended to the derivations that end in one state.
def _edit(state: str, price: str, initial: str, line: str | None) -> str:
    lines = f"list_append({state}.o, {line})" if line else f"{state}.o"
    return f"{{'c': {state}.c + {price}, 'a': {state}.a || '{initial}', 'o': {lines}}}"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


_STAY = "(CASE fault WHEN 'b' THEN 1000000000 WHEN 'd' THEN 1000000000 WHEN 't' THEN 5 ELSE 0 END)"
_KEEP = lambda state, kind: _edit(state, f"{_STAY} + (CASE WHEN initial = '{kind}' THEN 0 ELSE 1000000000 END)", "K", "role || ':' || text")
_REROLE = lambda state, role: _edit(state, f"{_STAY} + 1", "R", f"'{role}:' || text")
_DELETE = lambda state: _edit(state, "2", "D", None)
_INSERT = lambda state, role: _edit(state, "5", "I", f"'{role}:'")
_NOWHERE = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}"
_NOTHING = "{'c': CAST(0 AS BIGINT), 'a': '', 'o': CAST([] AS VARCHAR[])}"

# Trained models, pseudorandom mixes, files, encodings and alignments cannot be said in SQL; tests/llm holds those
# queries against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_kd_search": """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
WHERE rank <= 10""",
    "op9_near_duplicates": r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM listed
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)
), reached(doc_id, root) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents
  UNION SELECT links.y, reached.root FROM reached JOIN links ON links.x = reached.doc_id
), roots AS (
  SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op11_run_index": r"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, hex(coalesce(text, '')) AS h FROM documents
), windows AS (
  SELECT row_id, doc_id, unnest(range(0, len(h) // 2 - 199)) AS low, h FROM texts WHERE len(h) >= 400
), hashed AS (
  SELECT row_id, low, md5(substr(h, 2 * low + 1, 400)) AS content FROM windows
), repeated AS (
  SELECT row_id, low FROM hashed JOIN (SELECT content FROM hashed GROUP BY content HAVING count(*) > 1) USING (content)
), islands AS (
  SELECT row_id, low, sum(CASE WHEN low - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY row_id ORDER BY low) AS island
  FROM (SELECT row_id, low, coalesce(lag(low) OVER (PARTITION BY row_id ORDER BY low), -1000) AS before FROM repeated)
), spans AS (
  SELECT row_id, min(low) AS low, max(low) + 200 AS high FROM islands GROUP BY row_id, island
), kept AS (
  SELECT row_id, coalesce(lag(high) OVER (PARTITION BY row_id ORDER BY low), 0) AS start, low AS stop FROM spans
  UNION ALL
  SELECT t.row_id, coalesce(max(high), 0), len(any_value(h)) // 2 FROM texts t LEFT JOIN spans s ON s.row_id = t.row_id GROUP BY t.row_id
), rest AS (
  SELECT row_id, string_agg(substr(h, 2 * start + 1, 2 * (stop - start)), '' ORDER BY start) AS left_over FROM kept JOIN texts USING (row_id) GROUP BY row_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(left_over)) AS kept_sha256
FROM texts JOIN rest USING (row_id) LEFT JOIN (SELECT row_id, sum(high - low) AS removed, count(*) AS n FROM spans GROUP BY row_id) USING (row_id)""",
    "op12_lightest_repair": rf"""
WITH RECURSIVE source AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), numbered AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind
  FROM source
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM numbered, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (
  SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged
), marked AS (
  SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong
  FROM ordered
), states(conv_id, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {_NOTHING}, {_NOWHERE}, {_INSERT(_NOTHING, "user")}, {_INSERT(_INSERT(_NOTHING, "user"), "assistant")}
  FROM source
  UNION ALL
  SELECT conv_id, i, s0, s1, t2, {_least("s3", _INSERT("t2", "assistant"))}
  FROM (
    SELECT conv_id, i, s0, s1, s3, {_least("s2", _INSERT("s0", "user"), _INSERT("s1", "user"), _INSERT("s3", "user"))} AS t2
    FROM (
      SELECT m.conv_id, m.i, {_DELETE("s0")} AS s0, {_least(_DELETE("s1"), _KEEP("s0", "s"))} AS s1,
             {_least(_DELETE("s2"), *[w for q in ("s0", "s1", "s3") for w in (_KEEP(q, "u"), _REROLE(q, "user"))])} AS s2,
             {_least(_DELETE("s3"), _KEEP("s2", "a"), _REROLE("s2", "assistant"))} AS s3
      FROM states JOIN marked m ON m.conv_id IS NOT DISTINCT FROM states.conv_id AND m.i = states.i + 1
    )
  )
), cheapest AS (
  SELECT conv_id, arg_max({_least("s0", "s3")}, i) AS best FROM states GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT cheapest.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM cheapest LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM cheapest.conv_id""",
    "op13_treap_search": r"""
WITH listed AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), texts AS (
  SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM listed WHERE len(terms) > 0
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_terms FROM texts
), asked AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark
), found AS (
  SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM texts) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_texts + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM found, total GROUP BY term, n_texts
), scores AS (
  SELECT item_id, row_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_texts) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term), total GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10""",
}
