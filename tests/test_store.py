import pytest
from pyspark.sql import functions as F

from codemem.operators.memory import NO_RESULTS, answer_text
from codemem.plans.store import MemoryStore
from codemem.session import work_dir

SCHEMA = "dataset STRING, doc_id STRING, kind STRING, path STRING, text STRING"


def doc(name, text, dataset="codemem_a", kind="file"):
    return (dataset, f"{kind}:{name}", kind, name, f"File Path: {name}\n{text}")


@pytest.fixture
def store(spark):
    return MemoryStore(spark, work_dir(spark, "test-store")).create()


@pytest.fixture
def first(frame):
    rows = [doc("a.py", "alpha beta"), doc("a.py.bak", "alpha old"), doc("b.py", "gamma"), doc("c.py", "delta", "codemem_b")]
    rows.append(doc("a.py", "FIXME alpha", kind="comment"))
    return frame(rows, SCHEMA)


def ids(rows):
    return {(r.dataset, r.doc_id) for r in rows.select("dataset", "doc_id").distinct().collect()}


def test_an_empty_store(store):
    assert store.docs().count() == store.chunks().count() == 0
    assert answer_text(store.recall("x")).first().answer == NO_RESULTS


def test_ingest_and_recall(store, first):
    store.ingest(first)
    assert store.docs().count() == store.chunks().count() == 5
    top = store.recall("gamma", datasets=["codemem_a"]).orderBy("rank").collect()
    assert len(top) == 3 and top[0].path == "b.py"
    assert {r.dataset for r in store.recall("delta", 10, ["codemem_a"]).collect()} == {"codemem_a"}
    assert store.recall("delta").orderBy("rank").first().path == "c.py"


def test_secrets_never_reach_the_store(store, frame):
    store.ingest(frame([doc("s.py", 'token = "abcdefghij"'), doc("s.py", 'password="abcdefghij"', kind="comment")], SCHEMA))
    texts = [r.text for r in store.docs().collect()] + [r.text for r in store.chunks().collect()]
    assert len(texts) == 4 and not any("abcdefghij" in t for t in texts)


def test_ingest_can_be_repeated(store, first):
    store.ingest(first)
    store.ingest(first)
    assert store.docs().count() == store.chunks().count() == 5


def test_ingest_raises_on_failure(store, frame):
    bad = frame([("x",)], "s STRING").select(
        F.lit("d").alias("dataset"), F.lit("1").alias("doc_id"), F.lit("f").alias("kind"), F.lit("p").alias("path"),
        F.raise_error(F.lit("unreadable")).cast("string").alias("text"),
    )
    with pytest.raises(Exception, match="unreadable"):
        store.ingest(bad)
    assert store.docs().count() == 0


def test_forget_exact_file(store, first):
    store.ingest(first)
    store.forget_files(["a.py"])
    assert {i for _, i in ids(store.docs())} == {"file:a.py.bak", "file:b.py", "file:c.py"} == {i for _, i in ids(store.chunks())}


def test_forget_by_substring(store, first):
    store.ingest(first)
    store.forget_file_substring("a.py")
    assert {i for _, i in ids(store.docs())} == {"file:b.py", "file:c.py"}


def test_forget_dataset_and_remember_again(store, first):
    store.ingest(first)
    store.forget_dataset("unknown")
    store.forget_dataset("codemem_a")
    assert {d for d, _ in ids(store.docs())} == {"codemem_b"} == {d for d, _ in ids(store.chunks())}
    store.ingest(first.filter("path = 'b.py'"))
    assert ids(store.docs()) == {("codemem_a", "file:b.py"), ("codemem_b", "file:c.py")}


def test_forget_undoes_ingest(store, first):
    store.ingest(first)
    before = ids(store.chunks())
    store.ingest(first.limit(1).withColumn("path", F.lit("new")).withColumn("doc_id", F.lit("file:new")))
    store.forget_files(["new"])
    assert ids(store.chunks()) == before


def times(store):
    return {r.doc_id: r.ingested_at for r in store.docs().filter("dataset = 'codemem_a'").collect()}


def test_refresh_holds_exactly_the_new_scan(store, first, frame):
    store.ingest(first)
    before = times(store)
    again = frame([doc("a.py", "alpha beta"), doc("b.py", "gamma two"), doc("n.py", "new")], SCHEMA)
    store.refresh(again, ["codemem_a"])
    got = {(r.doc_id, r.text) for r in store.docs().filter("dataset = 'codemem_a'").collect()}
    assert got == {("file:a.py", "File Path: a.py\nalpha beta"), ("file:b.py", "File Path: b.py\ngamma two"), ("file:n.py", "File Path: n.py\nnew")}
    assert {i for _, i in ids(store.chunks(["codemem_a"]))} == {i for i, _ in got}
    after = times(store)
    assert after["file:a.py"] == before["file:a.py"] and after["file:b.py"] > before["file:b.py"]
    assert store.docs().filter("dataset = 'codemem_b'").count() == 1
    store.refresh(again, ["codemem_a"])
    assert times(store) == after


def test_refresh_of_the_datasets_at_hand(store, first, frame):
    store.ingest(first)
    store.refresh(frame([doc("a.py", "alpha beta")], SCHEMA))
    assert ids(store.docs()) == {("codemem_a", "file:a.py"), ("codemem_b", "file:c.py")}
    store.refresh(frame([], SCHEMA), ["codemem_a"])
    assert ids(store.docs()) == {("codemem_b", "file:c.py")}


def test_replacing_ingest(store, first, frame):
    store.ingest(first)
    before = times(store)
    store.ingest(frame([doc("b.py", "gamma three"), doc("new.py", "n")], SCHEMA), replace=True)
    after = times(store)
    assert set(after) == {"file:a.py", "comment:a.py", "file:a.py.bak", "file:b.py", "file:new.py"}
    assert after["file:a.py"] == before["file:a.py"] and after["file:b.py"] > before["file:b.py"]


def test_a_document_that_changes_its_path_is_stored_once(store, first):
    store.ingest(first)
    moved = first.filter("doc_id = 'file:b.py'").withColumn("path", F.lit("elsewhere/b.py"))
    store.ingest(moved)
    assert {r.path for r in store.docs().filter("doc_id = 'file:b.py'").collect()} == {"elsewhere/b.py"}
    store.refresh(moved.withColumn("path", F.lit("third/b.py")).withColumn("text", F.lit("other")))
    assert [r.path for r in store.docs(["codemem_a"]).collect()] == ["third/b.py"] == [r.path for r in store.chunks(["codemem_a"]).collect()]


def files_of(store, table):
    import glob
    return set(glob.glob(f"{store.root}/{table}/*/*/*.parquet"))


def test_only_buckets_with_a_change_are_written(store, first, frame):
    many = frame([doc(f"f{i}.py", f"text {i}") for i in range(60)], SCHEMA)
    store.ingest(many)
    before = files_of(store, "docs"), files_of(store, "chunks")
    store.refresh(many.withColumn("text", F.when(F.col("path") == "f7.py", "changed").otherwise(F.col("text"))))
    for old, table in zip(before, ("docs", "chunks")):
        assert len(old) == store.buckets and len(old & files_of(store, table)) == store.buckets - 1
    store.refresh(many.withColumn("text", F.when(F.col("path") == "f7.py", "changed").otherwise(F.col("text"))))
    assert len(files_of(store, "docs") & before[0]) == store.buckets - 1


@pytest.mark.parametrize("table", ["chunks", "docs"])
def test_a_failed_write_is_made_up_for(store, first, monkeypatch, table):
    from codemem.plans import store as module

    replace = module.pt.replace
    def fails(rows, path, *rest):
        if path.endswith(table):
            raise OSError("disk")
        replace(rows, path, *rest)

    monkeypatch.setattr(module.pt, "replace", fails)
    with pytest.raises(OSError):
        store.refresh(first)
    monkeypatch.setattr(module.pt, "replace", replace)
    store.refresh(first)
    assert store.docs().count() == store.chunks().count() == 5


def test_labels_are_parts_of_their_own(store, first, monkeypatch):
    store.ingest(first.filter("path = 'a.py'"), label="batch-1")
    store.ingest(first.filter("path <> 'a.py'"), label="batch-2")
    store.ingest(first.filter("path = 'a.py'"), label="batch-1")
    assert store.docs().count() == store.chunks().count() == 5
    held = {(r.doc_id, r.ingested_at) for r in store.docs().collect()}
    store.settle()
    assert store.docs().count() == store.chunks().count() == 5 and {(r.doc_id, r.ingested_at) for r in store.docs().collect()} == held
    assert store.docs().filter("part like 'batch%'").count() == 0
    store.forget_files(["b.py"])
    assert store.docs().count() == store.chunks().count() == 4


def test_batch_recall(store, first, frame):
    store.ingest(first)
    asked = frame([(1, "gamma"), (2, "delta")], "query_id INT, text STRING")
    got = {(r.query_id, r.path if "path" in r else r.doc_id) for r in store.recall_batch(asked, 1).collect()}
    assert got == {(1, "file:b.py"), (2, "file:c.py")}
    scoped = store.recall_batch(asked, 5, ["codemem_b"]).collect()
    assert {r.doc_id for r in scoped} == {"file:c.py"}


def test_decisions_are_found_with_the_project(store, first):
    store.ingest(first)
    store.log_decision("use omega storage", at=1704067207)
    with pytest.raises(ValueError):
        store.log_decision("")
    top = store.recall("omega storage", 1, ["codemem_a"]).first()
    assert top.dataset == "adr_decision_1704067207" and top.text.startswith("Architectural Decision Record:\n")


def test_forget_all(store, first):
    store.ingest(first)
    other = MemoryStore(store.spark, store.root)
    assert other.docs().count() == 5
    store.forget_all()
    assert store.docs().count() == store.chunks().count() == other.docs().count() == 0
    assert not files_of(store, "docs") and not files_of(store, "chunks")


def test_creating_again_opens_what_is_there(store, first):
    store.ingest(first)
    assert MemoryStore(store.spark, store.root).create().docs().count() == 5
    store.forget_all()
    assert MemoryStore(store.spark, store.root).create().docs().count() == 0


def test_a_replaced_file_loses_its_old_comments(store, first, frame):
    store.ingest(first)
    store.ingest(frame([doc("a.py", "alpha without")], SCHEMA), replace=True)
    assert {r.doc_id for r in store.docs().filter("path = 'a.py'").collect()} == {"file:a.py"}


def test_refresh_forgets_only_scanned_kinds_and_readable_paths(store, frame):
    rows = [doc("a.py", "one"), doc("lib/b.py", "two"), doc("c.py", "three"), ("codemem_a", "commit:1", "commit", None, "fix")]
    store.ingest(frame(rows, SCHEMA))
    unread = frame([("codemem_a", "lib")], "dataset STRING, path STRING")
    store.refresh(frame([doc("a.py", "one")], SCHEMA), kinds=("file", "comment"), unread=unread)
    assert {r.doc_id for r in store.docs().collect()} == {"file:a.py", "file:lib/b.py", "commit:1"}
    store.refresh(frame([doc("a.py", "one")], SCHEMA), kinds=("file", "comment"))
    assert {r.doc_id for r in store.docs().collect()} == {"file:a.py", "commit:1"}


def test_files_are_forgotten_from_a_table(store, first, frame):
    store.ingest(first)
    store.forget_files(frame([("a.py",), ("c.py",)], "path STRING"))
    assert {r.path for r in store.docs().collect()} == {"a.py.bak", "b.py"}


def test_forget_by_tag(store, first):
    store.ingest(first.withColumn("tag", F.when(F.col("path") == "b.py", "old")))
    store.forget_tags(["old"])
    assert "b.py" not in {r.path for r in store.docs().collect()} and store.docs().count() == 4


def test_a_long_word_is_cut_into_bounded_chunks(frame):
    from codemem.operators import memory as mem

    text = "x" * 5_000_000 + " tail"
    chunks = mem.chunk_documents(frame([("d", "1", text)], "dataset STRING, doc_id STRING, text STRING")).orderBy("chunk_no").collect()
    assert "".join(r.text for r in chunks) == text and max(len(r.text) for r in chunks) <= 257_000


def test_tables_on_the_way_are_removed(store, first, tmp_path, monkeypatch):
    import itertools
    import os

    numbers = itertools.count()
    monkeypatch.setattr("codemem.session.work_dir", lambda spark, name: str(tmp_path / f"{name}-{next(numbers)}"))
    store.ingest(first, replace=True)
    store.refresh(first.limit(2))
    store.forget_files(["b.py"])
    store.ingest(first, label="batch")
    store.settle()
    assert next(numbers) == 5 and os.listdir(tmp_path) == []


def test_texts_move_and_vectors_stay(store, first, monkeypatch, plan):
    """Documents meet their partitions before they are embedded."""
    from codemem.plans import partitions

    plans, replace = {}, partitions.replace

    def noted(rows, path, *rest):
        plans[path.rsplit("/", 1)[1]] = plan(rest[-1])
        return replace(rows, path, *rest)

    monkeypatch.setattr(partitions, "replace", noted)
    store.ingest(first)
    lines = plans["chunks"].splitlines()
    made, moved = ([i for i, line in enumerate(lines) if word in line] for word in ("ArrowEvalPython", "Exchange"))
    assert made and moved and max(made) < min(moved)
