import datetime as dt
import os
import time

import pytest

from codemem.plans.store import MemoryStore
from codemem.session import work_dir
from codemem.streaming import decisions as sd


def test_decisions_arrive_once_across_runs(spark, frame, tmp_path):
    source, at = str(tmp_path / "in"), work_dir(spark, "test-stream")
    store = MemoryStore(spark, f"{at}/memory").create()
    schema = "id BIGINT, ts TIMESTAMP, text STRING"
    stamp = lambda day: dt.datetime(2024, 1, day)
    run = lambda: sd.stream_decisions(sd.read_stream(spark, source, "*.parquet"), store, f"{at}/check")
    result = lambda: sorted((r.doc_id, r.text.split("\n")[1]) for r in store.docs().collect())

    frame([(1, stamp(11), "a"), (1, stamp(11), "a"), (2, stamp(12), ""), (3, stamp(13), "c")], schema).write.parquet(source)
    run()
    assert result() == [("decision:1", "a"), ("decision:3", "c")]
    run()
    assert len(result()) == 2
    # A second delivery of a known decision is dropped, a new one is added, and so is one that comes days late.
    frame([(3, stamp(14), "c"), (4, stamp(15), "d"), (5, stamp(1), "late")], schema).write.mode("append").parquet(source)
    run()
    assert result() == [("decision:1", "a"), ("decision:3", "c"), ("decision:4", "d"), ("decision:5", "late")]
    assert store.recall("late", 1).first().doc_id == "decision:5"


def test_a_batch_that_failed_loses_nothing(spark, frame, tmp_path, monkeypatch):
    """Chunks fail once, then documents once; the batch is run again each time."""
    from codemem.plans import store as module

    source, at = str(tmp_path / "in"), work_dir(spark, "test-stream")
    store = MemoryStore(spark, f"{at}/memory").create()
    frame([(i, dt.datetime(2024, 1, 1), f"decision {i}") for i in range(2)], "id BIGINT, ts TIMESTAMP, text STRING").write.parquet(source)
    run = lambda: sd.stream_decisions(sd.read_stream(spark, source, "*.parquet"), store, f"{at}/check")
    replace = module.pt.replace
    for table in ("chunks", "docs"):
        def fails(rows, path, *rest):
            if path.endswith(table):
                raise OSError("disk")
            replace(rows, path, *rest)

        monkeypatch.setattr(module.pt, "replace", fails)
        with pytest.raises(Exception):
            run()
    monkeypatch.setattr(module.pt, "replace", replace)
    run()
    assert store.docs().count() == store.chunks().count() == 2
    assert {r.doc_id for r in store.recall("decision", 5).collect()} == {"decision:0", "decision:1"}


def test_a_batch_reads_nothing_of_what_is_stored(spark, frame, tmp_path, monkeypatch):
    source, at = str(tmp_path / "in"), work_dir(spark, "test-stream")
    store = MemoryStore(spark, f"{at}/memory").create()
    frame([(1, dt.datetime(2024, 1, 1), "a")], "id BIGINT, ts TIMESTAMP, text STRING").write.parquet(source)
    read = []
    table = MemoryStore._table
    monkeypatch.setattr(MemoryStore, "_table", lambda self, name: read.append(name) or table(self, name).limit(0))
    monkeypatch.setattr(MemoryStore, "docs", lambda *a: pytest.fail("stored documents were read"))
    sd.stream_decisions(sd.read_stream(spark, source, "*.parquet"), store, f"{at}/check")
    monkeypatch.undo()
    # Only the tables' column names are asked for.
    assert set(read) == {"docs", "chunks"} and store.docs().count() == 1


def test_files_enter_once_as_they_change(spark, tmp_path):
    from codemem.api import CodeMemory

    root, at = tmp_path / "Shop", work_dir(spark, "test-follow")
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "a.py").write_text("def first():\n    return 'one thing'\n")
    (root / "b.md").write_text("# A note about shops\n")
    (root / "c.bin").write_text("not a text file by its name")
    memory = CodeMemory(spark, f"{at}/memory").create()

    def follow():
        time.sleep(0.2)
        memory.follow(str(root), f"{at}/check", settle=0.1)
        return {r.path: r.ingested_at for r in memory.store.docs().filter("kind = 'file'").collect()}

    first = follow()
    assert set(first) == {"lib/a.py", "b.md"}
    assert follow() == first  # nothing changed
    (root / "b.md").write_text("# Another note about shops\n")
    (root / "lib" / "d.py").write_text("def new():\n    return 'new thing'  # TODO more\n")
    old = tmp_path / "old.md"
    old.write_text("# written long ago, moved here\n")
    os.utime(old, (1, 1))
    old.rename(root / "moved.md")
    second = follow()
    assert set(second) == {"lib/a.py", "b.md", "lib/d.py", "moved.md"}
    assert second["lib/a.py"] == first["lib/a.py"] and second["b.md"] > first["b.md"]
    assert "Another note" in memory.ask("note about shops", 1)
    assert {r.kind for r in memory.store.docs().filter("path = 'lib/d.py'").collect()} == {"file", "comment"}
    (root / "lib" / "a.py").unlink()
    assert follow() == second
