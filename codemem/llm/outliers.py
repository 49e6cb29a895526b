"""Quality rules: robust multivariate outliers among the texts of a language and source.

Each text gives a vector of transformed statistics.  For every (language, source) a
minimum-covariance-determinant estimate says where most of its texts lie: the mean and covariance of
the half with the smallest distances, found by concentration steps from a start by medians.  Texts
beyond a quantile of the distance are rejected, beside those that fail the base rules.

A concentration step is one aggregation over all texts: distances fall into fine bins, counts and
sums are kept per group and bin, and the bins up to the half make the next estimate.  A group of any
size is thus a bounded number of partial sums.  Sums are of whole numbers (fixed point), so that
their order does not matter and reruns agree.  Groups with too few texts for an estimate use that of
their language, and else that of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codemem.llm.common import Words, _space, cut, over_texts, packed

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5

# Statistics of the vector, in fixed point with UNIT steps to one.
NAMES = ("word_length", "symbols", "dup_lines", "repeats", "digits", "capitals")
UNIT = 1024
STEPS = 6
# Texts that a group must have for an estimate of its own.
LEAST_TEXTS = 100
# Smallest spread of a statistic, as a standard deviation: most texts have no symbol or repeat at all.
LEAST_SPREAD = 0.08
# The variance of the inner half of a normal sample of this dimension, against the whole.
INNER_HALF = 0.5
# Squared distance beyond which a text is rejected.
CUTOFF = 50.0
# Bins to a doubling of the squared distance.
BINS = 16

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
STATISTICS = f"doc_id long, lang string, source string, tie long, {BASE}, vector array<int>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: list) -> int:
    """Words that lie in a window of ``WINDOW`` words found at least twice in the text."""
    seen: dict = {}
    marked = bytearray(len(words))
    for i, w in enumerate(zip(*(words[j:] for j in range(WINDOW)))):
        first = seen.setdefault(w, i)
        if first != i:
            marked[i : i + WINDOW] = b"\1" * WINDOW
            marked[first : first + WINDOW] = b"\1" * WINDOW
    return sum(marked)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """Base statistics of every whole text, and its vector in fixed point; a null text has no words."""
    table = np.zeros((4, 256), bool)
    table[0, list(SYMBOLS)] = True
    table[1, 48:58] = True
    table[2, 65:91] = True
    table[3] = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters

    def work(part, data, offsets):
        words = Words(data, offsets)
        n = words.count
        chars = _sums(table[3][data] & ~_space()[data], offsets)
        symbols = _sums(table[0][data], offsets)
        digits = _sums(table[1][data], offsets)
        capitals = _sums(table[2][data], offsets)
        lines = _sums(data == 10, offsets) + 1
        dup = np.zeros(len(n), np.int64)
        repeats = np.zeros(len(n), np.int64)
        hashes = words.hash.tolist()
        for i in range(len(n)):
            if lines[i] > 1:
                dup[i] = repeated_lines(data[offsets[i] : offsets[i + 1]].tobytes())
            if n[i] > WINDOW:
                repeats[i] = repeated_words(hashes[words.first[i] : words.first[i + 1]])
        # Shares of small counts are drawn to zero, so that short texts are not far off by chance.
        some, letters = n + 30.0, chars + 150.0
        vector = np.stack([
            2 * np.log(letters / some),
            np.sqrt(symbols / some),
            np.sqrt(dup / (lines + 5.0)),
            np.sqrt(repeats / some),
            np.sqrt(digits / letters),
            np.sqrt(capitals / letters),
        ], axis=1)
        flat = np.rint(vector * UNIT).astype(np.int32).ravel()
        ends = pa.array(np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32))
        return {"doc_id": part.column(0), "lang": part.column(2), "source": part.column(3), "tie": part.column(4), "n_words": n, "word_chars": chars,
                "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats, "vector": pa.ListArray.from_arrays(ends, pa.array(flat))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie"))
    return over_texts(rows, work, STATISTICS)


GROUP = ("level", "l", "s")
PARAMETERS = "level int, l string, s string, n long, centre array<double>, inverse array<double>"
_SCHEMA = pa.schema([("level", pa.int32()), ("l", pa.string()), ("s", pa.string()), ("n", pa.int64()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])
_PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]


def _named(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _levels(stats: DataFrame) -> DataFrame:
    """Every vector in its group, in its language's and in that of all texts."""
    none = F.lit("")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), a.alias("l"), b.alias("s")) for i, (a, b) in enumerate(((_named("lang"), _named("source")), (_named("lang"), none), (none, none)))])
    return stats.select("vector", F.explode(levels).alias("g")).select("g.*", "vector")


def _parameters(key, n: int, centre: np.ndarray, covariance: np.ndarray):
    inverse = np.linalg.inv(covariance + np.eye(len(centre)) * LEAST_SPREAD**2)
    values = [*(k.as_py() for k in key), n, centre.tolist(), inverse.ravel().tolist()]
    return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(upto, upto[-1] / 2)])


def start(levels: DataFrame) -> DataFrame:
    """First estimates: medians and median deviations of each statistic, from counts of values."""
    fine = UNIT // 64
    counts = levels.select(*GROUP, F.posexplode("vector").alias("dim", "v")).groupBy(*GROUP, "dim", F.floor(F.col("v") / fine).cast("long").alias("v")).agg(F.count("*").alias("n"))

    def medians(key, rows):
        centre, spread = [], []
        dims, v, counts = (rows.column(c).to_numpy() for c in ("dim", "v", "n"))
        for dim in range(len(NAMES)):
            values, n = (v[dims == dim] + 0.5) * fine / UNIT, counts[dims == dim]
            centre.append(_middle(values, n))
            spread.append((1.4826 * _middle(abs(values - centre[-1]), n)) ** 2)
        return _parameters(key, int(counts[dims == 0].sum()), np.array(centre), np.diag(spread))

    return counts.groupBy(*GROUP).applyInArrow(medians, PARAMETERS)


def squared_distance() -> Column:
    """Mahalanobis distance, squared, of ``vector`` under ``centre`` and ``inverse``."""
    d = len(NAMES)
    off = [F.col("vector")[i] / F.lit(float(UNIT)) - F.col("centre")[i] for i in range(d)]
    terms = [off[i] * off[j] * F.col("inverse")[i * d + j] * F.lit(1.0 if i == j else 2.0) for i, j in _PAIRS]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def concentrate(levels: DataFrame, parameters: DataFrame) -> DataFrame:
    """One step: the mean and covariance of the half of each group with the smallest distances.

    The half ends with the bin in which the middle text lies, so it is the same on every run.
    """
    rows = levels.join(parameters, list(GROUP))
    bins = F.floor(F.log2(squared_distance() + F.lit(2.0**-12)) * BINS).cast("long")
    x = [F.col("vector")[i].cast("long") for i in range(len(NAMES))]
    sums = [F.sum(v).alias(f"x{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i, j in _PAIRS]
    sums = rows.groupBy(*GROUP, bins.alias("bin")).agg(F.count("*").alias("n"), *sums)

    def estimate(key, rows):
        rows = rows.sort_by("bin")
        upto = np.cumsum(rows.column("n").to_numpy())
        inner = rows.slice(0, int(np.searchsorted(upto, -(-upto[-1] // 2))) + 1)
        total = lambda name: int(inner.column(name).to_numpy().sum())
        n = total("n")
        centre = np.array([total(f"x{i}") for i in range(len(NAMES))]) / n / UNIT
        covariance = np.zeros((len(NAMES), len(NAMES)))
        for i, j in _PAIRS:
            covariance[i, j] = covariance[j, i] = total(f"x{i}_{j}") / n / UNIT**2 - centre[i] * centre[j]
        return _parameters(key, int(upto[-1]), centre, covariance / INNER_HALF)

    return sums.groupBy(*GROUP).applyInArrow(estimate, PARAMETERS)


def fit(stats: DataFrame, steps: int = STEPS) -> DataFrame:
    """``l, s, centre, inverse`` for each language and source; nulls where too few texts exist at all."""
    levels = _levels(stats)
    parameters = cut(start(levels))
    for _ in range(steps):
        parameters = cut(concentrate(levels, parameters))
    at = [parameters.where(F.col("level") == i) for i in range(3)]
    usable = lambda df, *names: df.where(F.col("n") >= LEAST_TEXTS).select(*names, F.struct("centre", "inverse").alias(f"p{len(names)}"))
    found = at[0].select("l", "s").join(usable(at[0], "l", "s"), ["l", "s"], "left").join(usable(at[1], "l"), "l", "left")
    # One row at most, that of all texts.
    found = found.join(F.broadcast(usable(at[2])), F.lit(True), "left")
    return found.select("l", "s", F.coalesce("p2", "p1", "p0").alias("p")).select("l", "s", "p.*")


def judge(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per document: ``doc_id``, the base statistics, ``base_failed``, ``kept`` and ``distance``.

    Every row gives one row.  A null or empty text has no words and fails the base rules.  A null
    language or source is one of its own.  Where all texts together are fewer than
    ``LEAST_TEXTS``, only the base rules decide and ``distance`` is null.  No rows give no rows;
    further columns are not read.
    """
    stats = cut(statistics(docs))
    rows = stats.withColumns({"l": _named("lang"), "s": _named("source")}).join(fit(stats, steps), ["l", "s"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "distance": squared_distance()})
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "tie")


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps."""
    good = judge(docs, **how).where("kept").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    return packed(docs).join(good, same, "left_semi").select("doc.*")
