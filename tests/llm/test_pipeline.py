"""The pipeline against a plain version: what each stage keeps, hides, takes and encodes."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from codemem.llm import registry
from codemem.llm.common import table
from tests.llm.test_operators import SCHEMA, base_spans, base_statistics, groups, odd_texts, rows_of, targets_by_rounds, words


def test_stages_on_a_small_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = {r.doc_id: r for r in docs.collect()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "mixing sources", "BPE encoding"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == table(spark, sf_dir, "documents").columns and docs.dtypes == table(spark, sf_dir, "documents").dtypes
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.collect())

    good = {r.doc_id for r in kept[0]}
    assert all(not base_statistics(r.text)[5] for r in kept[0])
    assert all(r == first[r.doc_id] for r in kept[0])
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    clean = [d for d in first if labels.get(d) == 1 and not base_statistics(first[d].text)[5]]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)

    want = groups([(r.doc_id, r.text) for r in kept[0]], 5, 80)
    assert sorted(r.doc_id for r in kept[1]) == sorted(d for d, (_, c) in want.items() if d == c)

    hidden = {r.doc_id: r for r in kept[2]}
    assert set(hidden) == {r.doc_id for r in kept[1]}
    for r in kept[1]:
        if not base_spans(r.text):
            assert hidden[r.doc_id].text == r.text or "[SECRET]" in hidden[r.doc_id].text
        else:
            assert "[SECRET]" in hidden[r.doc_id].text and hidden[r.doc_id].n_chars == len(hidden[r.doc_id].text)
        assert not base_spans(hidden[r.doc_id].text)

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in kept[2]:
        sizes[r.source] += len(words(r.text))
    for r in kept[3]:
        taken[r.source] += len(words(r.text))
        assert r.text == hidden[r.doc_id].text or len(words(r.text)) < len(words(hidden[r.doc_id].text))
    for source, target in targets_by_rounds(sizes).items():
        assert abs(taken[source] - target) <= 128 + 0.01 * target

    from tokenizers import Tokenizer

    library, plain = Tokenizer.from_file(registry.TOKENIZER), Counter()
    for r in kept[3]:
        ids = library.encode(r.text, add_special_tokens=False).ids
        plain[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in kept[4]) == plain
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == plain


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows."""
    odd = rows_of(odd_texts())
    odd += [odd[8], odd[8], (None,) * len(odd[0]), (3, None) + (None,) * (len(odd[0]) - 2)]
    docs = spark.createDataFrame(odd, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        got = Counter(tuple(r) for r in kept.collect())
        if name == "quality rules":
            assert got == Counter(r for r in odd if not base_statistics(r[1])[5])
        if name == "near-duplicates":
            assert set(got) <= set(odd) and max(got[r] for r in got if r[0] is not None) == 1
            assert got[(None,) * len(odd[0])] == 1
        if name == "secret scan":
            assert sum(got.values()) == len(odd) and Counter(r[0] for r in got.elements()) == Counter(r[0] for r in odd)
            assert all(r in got for r in odd if not (r[1] or "").strip())
        if name == "mixing sources":
            assert all((r[1] or "").split() for r in got) and {r[0] for r in got} <= {r[0] for r in odd}
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
    encoded = corpus_pipeline.encode_texts(spark, docs, sf_dir)
    assert encoded.count() == len(odd) and encoded.where("n_tokens = 0").count() == sum(not r[1] for r in odd)
    assert corpus_pipeline.encode_texts(spark, docs.limit(0), sf_dir).count() == 0


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
