"""Conversation repair against a plain right-to-left table of cheapest edits."""

import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from codemem.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, task string, lost string"
STEP = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
ROLE = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_of(turns):
    seen, out = set(), []
    for role, text in turns:
        inside = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not inside else "d" if (role, text) in seen else "" if inside[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(turns, faults):
    """(cost, audit) by a table over suffixes; a state is what the roles so far have led to."""
    best = None
    for i in range(len(turns), -1, -1):
        now = {}
        for q in "0123":
            ways = [(0, "")] if i == len(turns) and q in "03" else []
            if i < len(turns):
                ways.append((2 + best[q][0], "D" + best[q][1]))
                if faults[i] not in ("b", "d"):
                    more = 5 if faults[i] == "t" else 0
                    for kind in "sua":
                        if (q, kind) in STEP:
                            cost, audit = best[STEP[q, kind]]
                            if turns[i][0][:1] == kind:
                                ways.append((more + cost, "K" + audit))
                            if kind != "s":
                                ways.append((more + 1 + cost, "R" + audit))
            now[q] = min(ways) if ways else (10**9, "")
        for _ in range(3):  # inserts, until nothing changes
            for q, kind in STEP:
                if kind != "s":
                    cost, audit = now[STEP[q, kind]]
                    now[q] = min(now[q], (cost + 5, "I" + audit))
        best = now
    return best["0"]


def written(turns, audit):
    out, i, q = [], 0, "0"
    for edit in audit:
        due = "a" if q == "2" else "u"
        if edit == "I":
            out.append(ROLE[due] + ":")
        else:
            if edit == "K":
                due = turns[i][0][:1]
                out.append(":".join(turns[i]))
            elif edit == "R":
                out.append(ROLE[due] + ":" + turns[i][1])
            i += 1
        if edit != "D":
            q = STEP[q, due]
    return "\n".join(out)


def plain(rows):
    left = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [(r[2], r[3]) for r in own]
        numbers = [r[1] for r in own if r[1] is not None]
        faults = faults_of(turns)
        cost, audit = cheapest(turns, faults)
        out.append((
            conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit,
            hashlib.sha256(written(turns, audit).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations():
    rng = np.random.default_rng(11)
    roles = ["user", "assistant", "system", "tool", None, "", "usher", "User"]
    texts = ["Yes.", "No!", "open end", "", " \t\n", None, "é?", "same. ", "x" * 30_000 + ".", "a\u0085"]
    rows = []
    for conv in range(150):
        for turn in range(int(rng.integers(1, 9))):
            role = roles[turn % 2] if rng.random() < 0.6 else roles[rng.integers(0, 8)]
            text = f"Turn {conv} {turn}." if rng.random() < 0.5 else texts[rng.integers(0, 10)]
            rows.append((conv if conv else None, None if rng.random() < 0.05 else turn * (1 + conv % 3), role, text, 1, "a", "t", "l"))
    for turn in range(1500):  # far more than one block
        rows.append((500, turn, roles[int(rng.integers(0, 3))], f"Long {turn % 900}" + "." * int(rng.random() < 0.8), 1, "a", "t", "l"))
    return rows + rows[:40]


@pytest.mark.parametrize("parts, turns", [(1, 512), (7, 3)])
def test_reports(spark, parts, turns):
    rows = conversations()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = repair.report(spark.createDataFrame(rows, SCHEMA), turns)
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        got = sorted(map(tuple, found.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == plain(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.report(none).collect() == []


def test_every_short_sequence():
    for n in range(4):
        for kinds in product("sua?", repeat=n):
            for faults in product(["", "b", "t"], repeat=n):
                (found,) = repair.lightest(list(kinds), list(faults)).values()
                assert found == cheapest([(k, "") for k in kinds], list(faults))


def test_audit_against_all_edits():
    # Every audit up to seven letters that ends in the pattern, with its cost.
    def all_edits(kinds, faults):
        todo, best = [(0, "", 0, "0")], None
        while todo:
            cost, audit, i, q = todo.pop()
            if i == len(kinds) and q in "03" and (best is None or (cost, audit) < best):
                best = (cost, audit)
            if len(audit) == 7:
                continue
            due = "a" if q == "2" else "u"
            todo.append((cost + 5, audit + "I", i, STEP[q, due]))
            if i < len(kinds):
                todo.append((cost + 2, audit + "D", i + 1, q))
                if faults[i] != "b":
                    more = 5 * (faults[i] == "t")
                    todo.append((cost + 1 + more, audit + "R", i + 1, STEP[q, due]))
                    if (q, kinds[i]) in STEP:
                        todo.append((cost + more, audit + "K", i + 1, STEP[q, kinds[i]]))
        return best

    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(0, 5))
        kinds, faults = ["sua?"[i] for i in rng.integers(0, 4, n)], [["", "b", "t"][i] for i in rng.integers(0, 3, n)]
        assert next(iter(repair.lightest(kinds, faults).values())) == all_edits(kinds, faults)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "user", "Again.", False), (1, 2, "assistant", "Yes.", False), (2, 0, "user", "Gone.", True)]
    found = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, lost boolean"))
    got = [(r.conv_id, r.edit, r.role, r.text) for r in found.orderBy("conv_id", "task", "seq", "place").collect()]
    assert got == [(1, "K", "user", "Again."), (1, "K", "assistant", "Yes.")]
