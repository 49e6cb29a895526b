import random
import re
import string

import pytest
from pyspark.sql import functions as F

from codemem.functions import text as tx

MARK = tx.SECRET_MARK
ALNUM = string.ascii_letters + string.digits


def run(frame, column, *texts):
    rows = frame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", column(F.col("t")).alias("r"))
    return [r["r"] for r in rows.orderBy("i").collect()]


def sample_texts():
    """Every low code point and the wide separators, alone, doubled, inside and around words."""
    odd = [chr(c) for c in (*range(1, 0x250), 0x1680, 0x180E, *range(0x1FFF, 0x2070), 0x2028, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = ["", " ", "\n", "a", "a\n", "\r\n", "a\r\nb\r\n\r\nc", "GOT  it.\t"]
    for ch in odd:
        texts += [ch, f"a{ch}b", f" {ch}a{ch} {ch}B{ch}", f"a{ch}{ch}\nb{ch}"]
    return texts


@pytest.mark.parametrize(
    "column, python",
    [
        (tx.strip_ws, str.strip),
        (tx.lines, str.splitlines),
        (tx.normalize_ws, lambda t: " ".join(t.strip().lower().split())),
    ],
)
def test_white_space_follows_python(frame, column, python):
    texts = sample_texts()
    for text, got in zip(texts, run(frame, column, *texts)):
        assert got == python(text), repr(text)


def test_substantial_counts_stripped_characters(frame):
    texts = ["x" * 14, "x" * 15, "  " + "x" * 13 + " ", "é" * 15, "", "a" + " " * 13 + "b", " " * 80 + "x" * 15, "x" + " " * 80, "x" * 14 + " " * 80 + "y"]
    assert run(frame, tx.is_substantial, *texts) == [False, True, False, True, False, True, True, False, True]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('api_key = "sk-' + "a" * 48 + '"', MARK),
        ("sk-" + "b" * 60, MARK + "b" * 12),
        ("key sk-or-v1-" + "c" * 48, "key sk-or-v1-" + "c" * 48),
        ("gsk_" + "d" * 52, MARK),
        ("ghp_" + "e" * 36 + "!", MARK + "!"),
        ("AIzaSy" + "f-_" * 11 + "gg", MARK),
        ('password = "1234567"', 'password = "1234567"'),
        ('password = "12345678"', MARK),
        ("Token='abcdefgh'", MARK),
        ('my_password\t=\n"two\nline secret" x', "my_" + MARK + " x"),
        ("passwd\u2003=\u00a0'longsecret'", MARK),
        ("token = \"mixed'", "token = \"mixed'"),
        ("no secret = here", "no secret = here"),
        ("pa\u017fsword = 'longsecret' and TO\u212aEN='longsecret'", f"{MARK} and {MARK}"),
    ],
)
def test_redaction(frame, text, expected):
    assert run(frame, tx.redact, text) == [expected]


def test_redaction_equals_patterns_in_sequence_and_is_idempotent(frame):
    rng = random.Random(7)
    parts = ["sk-" + "a" * 48, "gsk_" + "b" * 52, "ghp_" + "c" * 36, "AIzaSy" + "d" * 35, 'token = "', "password='", '"', "'", " x ", "=\n", "secret_key =", "12345678"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def sequential(text):
        for pattern in tx.SECRET_PATTERNS.values():
            text = re.sub(pattern.replace(tx.WS, r"\s").replace("(?iu)", "(?i)"), MARK, text)
        return text

    once = run(frame, tx.redact, *texts)
    assert once == [sequential(t) for t in texts]
    assert run(frame, tx.redact, *once) == [sequential(t) for t in once]


def test_secret_hits_count_what_redaction_replaces(frame):
    text = 'token = "abcdefgh" and ghp_' + "a" * 36 + ' and api_key = "ghp_' + "b" * 36 + '"'
    row = frame([(text,)], "t STRING").select(*[v.alias(k) for k, v in tx.secret_hits(F.col("t")).items()]).first()
    assert row.asDict() == {"sk": 0, "gsk": 0, "ghp": 2, "google": 0, "assignment": 2}


def test_suffix(frame):
    paths = ["a/b.PY", ".gitignore", "x/.env.example", "a.b/c", "a.", "a.tar.gz", "d/..x", "a..b"]
    assert run(frame, tx.suffix, *paths) == [".py", "", ".example", "", "", ".gz", ".x", ".b"]
