"""Secret scan: base patterns, and a character convolutional network over further candidates.

Candidates are all base findings and all other runs of secret-like characters, each with the
characters around it.  A small convolutional network (numpy) reads a candidate in its context.  It
is trained on all labelled findings: base findings against other candidates of the given texts, and
seeded variants of both, in which names, separators and values are replaced.  Findings are dealt to
blocks; in every round each block trains on from the same weights, and the mean of what the blocks
have reached starts the next round.  On the findings held out from training the output is calibrated,
and the threshold is the highest one that keeps the wanted recall.  What the network finds is added
to the base spans; these always stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codemem.llm.common import arrow_type, over_texts, stored

KINDS = ("assign", "access", "hex")
# The base patterns and the lengths that their matches must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the whole run; shorter runs fail anyway
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
ADDED = "model"

# A run that may be a secret: long enough, with a digit or a mark between letters.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=.-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}", re.A)

# What follows a secret-like name, whatever its characters.
NAMED = re.compile(r"""(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|credentials?|(?:api|auth|access|private|secret)[_-]?key)["']?[ \t]*[:=][ \t]*["']?([^\s"'`,;<>]{6,})""", re.I | re.A)

# Characters of a window: so many before the candidate and so many in all.
BEFORE, WINDOW = 24, 72
# Findings of a block, about, and seeded variants beside them, at most and to a finding.
BLOCK = 4096
VARIANTS, VARIANTS_EACH = 1024, 4
# Rounds over all findings, and passes over a block in a round.
ROUNDS, PASSES = 3, 2
# Fixed point of weights and logits that are summed and counted: the order of tasks does not matter.
WEIGHT_UNIT, LOGIT_UNIT = 1 << 30, 1024
RECALL = 0.95
SEED = 11


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """Base spans ``(start, end, kind)`` in code points, by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(n in low for n in ("passw", "secret", "token", "api")) or "ſ" in text or "K" in text:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def other_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Secret-like runs, and values after secret-like names, that reach beyond every base span."""
    found = {m.span() for m in CANDIDATE.finditer(text)} | {m.span(1) for m in NAMED.finditer(text)}
    out, b, reach = [], 0, -1
    for start, end in sorted(found):
        while b < len(base) and base[b][0] <= start:
            reach = max(reach, base[b][1])
            b += 1
        if end > reach:
            out.append((start, end))
    return out


def apart_from(base: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap no base span; both come in order of their starts."""
    out, b, reach = [], 0, -1
    for start, end in spans:
        while b < len(base) and base[b][0] < end:
            reach = max(reach, base[b][1])
            b += 1
        if reach <= start:
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> str:
    """A candidate's context: its beginning stands at a fixed place; of a long one the middle is left out, not its end."""
    after = WINDOW - BEFORE
    if end - start > after - 12:
        shown = text[start : start + after - 24] + text[end - 12 : end + 12]
    else:
        shown = text[start : start + after]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\n") + shown.ljust(after, "\n")


def encode(windows: list[str]) -> np.ndarray:
    """Character codes: ASCII as it is, all else one code."""
    out = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(-1, WINDOW)
    return np.minimum(out, 127).astype(np.int64)


class Network:
    """Embedded characters, one convolution, its maximum and mean over the window, and a logistic output."""

    WIDTH, DEPTH, FILTERS = 5, 12, 32

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, f = self.DEPTH, self.FILTERS
        self.p = {"e": rng.normal(0, 0.3, (128, d)), "w": rng.normal(0, 0.2, (self.WIDTH * d, f)), "b": np.zeros(f), "v": rng.normal(0, 0.2, 2 * f), "c": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5
        self.recall = self.precision = None  # reached on held-out findings

    def _forward(self, codes: np.ndarray):
        x = self.p["e"][codes]
        steps = codes.shape[1] - self.WIDTH + 1
        columns = np.concatenate([x[:, i : i + steps] for i in range(self.WIDTH)], axis=2)
        h = np.maximum(columns @ self.p["w"] + self.p["b"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(axis=1)], axis=1)
        return columns, h, top, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)] or [np.zeros(0)])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probability that a candidate is a secret."""
        return self.calibrated(self.logits(codes))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))

    def weights(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def with_weights(self, flat: np.ndarray) -> Network:
        out, at = Network(), 0
        for k in sorted(out.p):
            shape = out.p[k].shape
            out.p[k] = flat[at : at + out.p[k].size].reshape(shape)
            at += out.p[k].size
        return out

    def train(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.003, seed: int = SEED) -> None:
        """Adam on the logistic loss; both classes weigh the same."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for at in (order[i : i + 64] for i in range(0, len(order), 64)):
                columns, h, top, pooled, z = self._forward(codes[at])
                dz = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[at]) * weight[at] / len(at)
                f = self.FILTERS
                dp = dz[:, None] * self.p["v"]
                dh = np.repeat(dp[:, None, f:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :f], 1)
                dh *= h > 0
                dcolumns = dh @ self.p["w"].T
                dx = np.zeros((len(at), codes.shape[1], self.DEPTH))
                for i in range(self.WIDTH):
                    dx[:, i : i + h.shape[1]] += dcolumns[:, :, i * self.DEPTH : (i + 1) * self.DEPTH]
                de = np.eye(128)[codes[at].ravel()].T @ dx.reshape(-1, self.DEPTH)
                grads = {"e": de, "w": np.tensordot(columns, dh, ([0, 1], [0, 1])), "b": dh.sum((0, 1)), "v": pooled.T @ dz, "c": np.array([dz.sum()])}
                t += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL, base: np.ndarray | None = None) -> None:
        """:meth:`fit_threshold` on the logits of held-out findings."""
        self.fit_threshold(self.logits(codes), labels, np.ones(len(codes), np.int64), recall, base)

    def fit_threshold(self, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL, base: np.ndarray | None = None) -> None:
        """Slope and shift by logistic regression on logits with their counts, then the highest threshold with the recall.

        The recall is that of findings outside ``base``, if there are any: base spans stay anyhow.
        """
        a, b = 1.0, 0.0
        # Soft targets keep the fit finite on findings that are separated completely.
        n1, n0 = counts[labels == 1].sum(), counts[labels != 1].sum()
        y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            w = counts * np.maximum(p * (1 - p), 1e-9)
            g = np.array([(counts * (p - y) * z).sum(), (counts * (p - y)).sum()])
            hess = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + np.eye(2) * 1e-6
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        judged = np.ones(len(z), bool) if base is None or not (labels[~base] == 1).any() else ~base
        z, y, n = z[judged], labels[judged] == 1, counts[judged]
        order = np.argsort(z[y], kind="stable")
        upto = np.cumsum(n[y][order])
        if not len(upto):
            self.threshold = 1.0
            return
        # Logits are compared as they were counted, so that the one at the quantile itself is kept.
        least = float(z[y][order][np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), side="right")])
        self.threshold = float(self.calibrated(np.array([least]))[0])
        says = z >= least
        self.recall, self.precision = float(n[says & y].sum() / n[y].sum()), float(n[says & y].sum() / n[says].sum())


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FORMS = (
    ("{name}{sep}{value}", 1), ("Authorization: Bearer {value}", 1), ("{name}{sep}\"{value}\"", 1), ("https://user:{value}@host", 1), ("{name}{sep}{marked}", 1),
    ("file {value}.txt", 0), ("see {plain} ", 0), ("order {number} of ", 0), ("https://host/{plain}/{number}", 0), ("{day}T{clock}Z id-{number}", 0),
)


def variants(n: int, contexts: list[str], seed: int = SEED) -> tuple[list[str], list[int]]:
    """Seeded findings of common forms, set into contexts from the texts: labelled by their form."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    out, labels = [], []
    for i in range(n if contexts else 0):
        form, label = _FORMS[i % len(_FORMS)]
        words = contexts[i % len(contexts)].split()
        mixed = _LETTERS + "0123456789" + "+/_-"[: int(rng.integers(0, 5))]
        text = form.format(
            name=("auth_key", "pwd", "client_secret_id", "credential", "private_key", "access_key")[int(rng.integers(0, 6))],
            sep=("=", ": ", " = ", ":")[int(rng.integers(0, 4))], value=pick(mixed, int(rng.integers(20, 44))) + "7a" if label else pick("abcdef_", 14) + "_v2",
            marked=pick(_LETTERS + "0123456789!&$%*?.#", int(rng.integers(8, 20))),
            plain="-".join(w.strip(".,").lower() for w in words[:4]) + "-2", number=pick("0123456789", int(rng.integers(8, 18))),
            day="2024-01-02", clock="10:20:30")
        found = [m.span() for m in CANDIDATE.finditer(text)] or [m.span(1) for m in NAMED.finditer(text)] or [m.span() for m in re.finditer(r"\S{8,}", text)]
        if found:
            before = " ".join(words[:6]) + " "
            start, end = found[-1]
            whole = before + text + " " + " ".join(words[6:12])
            out.append(window(whole, len(before) + start, len(before) + end))
            labels.append(label)
    return out, labels


def labelled(docs: DataFrame) -> DataFrame:
    """``label, window`` of every finding: base findings are secrets, other candidates are not known to be."""
    def work(part, data, offsets):
        labels, windows = [], []
        for text in part.column(0).to_pylist():
            text = text or ""
            base = base_findings(text)
            spans = [(*_value(text, *b), 1) for b in base] + [(s, e, 0) for s, e in apart_from(base, other_candidates(text, base))]
            for s, e, label in spans:
                labels.append(label)
                windows.append(window(text, s, e))
        return {"label": labels, "window": windows}

    return over_texts(docs.select("text"), work, "label int, window string")


def _value(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The secret itself within a base span: without name and separator."""
    if kind == "assign":
        m = ASSIGN.match(text, start)
        return (m.start(2), m.end(2)) if m else (start, end)
    return start, end


def in_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame | None:
    """``block, label, window, n``: all findings in arrays of about ``size``; equal ones are one with a count.

    The hash of a finding says its block, so blocks are the same on every run.  None where nothing is found.
    """
    found = stored(labelled(docs).groupBy("label", "window").agg(F.count("*").alias("n")), "findings", "zstd")
    total = found.count()
    if total == 0:
        return None
    blocks = -(-total // size)
    rows = found.withColumn("block", F.pmod(F.xxhash64("label", "window"), F.lit(blocks)))
    rows = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("window", "label", "n"))).alias("r"))
    return stored(rows.select("block", "r.label", "r.window", "r.n"), "finding-blocks", "zstd")


def _block(row: dict, held: bool):
    """Codes, labels, counts and whether it is a base finding, of a block's findings and variants that are (not) held out."""
    windows, labels, n = row["window"], row["label"], row["n"]
    extra, extra_labels = variants(min(VARIANTS, VARIANTS_EACH * len(windows)), windows, SEED + row["block"])
    # One in four is held out; a finding goes by its hash.
    out = [zlib.crc32(w.encode("utf-8", "replace")) % 4 == 3 for w in windows] + [i % 4 == 3 for i in range(len(extra))]
    pick = np.array(out) == held
    codes, labels = encode(windows + extra)[pick], np.array(labels + extra_labels)[pick]
    counts = np.array(n + [1] * len(extra), np.int64)[pick]
    return codes, labels, counts, ((np.arange(len(out)) < len(windows))[pick]) & (labels == 1)


def _trained(blocks: DataFrame, net: Network, turn: int, passes: int) -> Network:
    """The mean of the weights that the blocks reach from those of ``net``, each as often as it has findings."""
    start = net.weights()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, labels, _, _ = _block(batch.slice(i, 1).to_pylist()[0], False)
                if len(codes):
                    own = net.with_weights(start)
                    own.train(codes, labels, passes, seed=SEED + turn)
                    flat = np.rint(own.weights() * WEIGHT_UNIT).astype(np.int64) * len(codes)
                    yield pa.RecordBatch.from_pydict({"size": pa.array([len(codes)], pa.int64()), "w": pa.array([flat], pa.list_(pa.int64()))})

    moved = blocks.mapInArrow(run, "size long, w array<long>").select("size", F.posexplode("w").alias("at", "w"))
    # Whole numbers far beyond 64 bits add up as decimals.
    sums = moved.groupBy("at").agg(F.sum(F.col("w").cast("decimal(20,0)")).alias("w"), F.sum("size").alias("size")).collect()  # one row for each weight
    if not sums:
        return net
    flat = start.copy()
    for r in sums:
        flat[r["at"]] = float(r["w"]) / r["size"] / WEIGHT_UNIT
    return net.with_weights(flat)


def train(docs: DataFrame, recall: float = RECALL, size: int = BLOCK, rounds: int = ROUNDS, passes: int = PASSES) -> Network:
    """A network fitted on all labelled findings and seeded variants of them.

    One in four is held out for calibration and the threshold.  Equal findings in equal contexts are
    one to learn from, and count as often as they occur in the threshold's recall.
    """
    net, blocks = Network(), in_blocks(docs, size)
    if blocks is None:
        net.threshold = 1.1  # nothing to learn from: the network adds nothing
        return net
    for turn in range(rounds):
        net = _trained(blocks, net, turn, passes)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                codes, labels, counts, base = _block(batch.slice(i, 1).to_pylist()[0], True)
                z = np.rint(np.clip(net.logits(codes), -60, 60) * LOGIT_UNIT).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"z": pa.array(z), "label": pa.array(labels, pa.int32()), "base": pa.array(base), "n": pa.array(counts)})

    held = blocks.mapInArrow(run, "z int, label int, base boolean, n long").groupBy("z", "label", "base").agg(F.sum("n").alias("n"))
    held = held.toArrow().sort_by([("z", "ascending"), ("label", "ascending"), ("base", "ascending")])  # some 100,000 rows at most, as many as logits differ
    if held.num_rows:
        z, label, base, n = (held.column(c).to_numpy() for c in ("z", "label", "base", "n"))
        net.fit_threshold(z / LOGIT_UNIT, label, n, recall, base.astype(bool))
    return net


FOUND = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def _judged(net: Network, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Spans of each text: every candidate is read by the network; base ones stay whatever it says."""
    base = [base_findings(t) for t in texts]
    every = [(i, *_value(texts[i], *b), b) for i, x in enumerate(base) for b in x]
    every += [(i, s, e, None) for i, t in enumerate(texts) for s, e in other_candidates(t, base[i])]
    spans: list[list] = [[] for _ in texts]
    for at in range(0, len(every), 2048):
        some = every[at : at + 2048]
        for (i, s, e, b), p in zip(some, net.probability(encode([window(texts[i], s, e) for i, s, e, _ in some]))):
            if b:
                spans[i].append((*b, float(p)))
            elif p >= net.threshold:
                spans[i].append((s, e, ADDED, float(p)))
    rank = {k: n for n, k in enumerate((*KINDS, ADDED))}
    return [sorted(x, key=lambda x: (x[0], rank[x[2]])) for x in spans]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id, spans`` of every row: base spans and those the network adds, each with its probability.

    Spans count code points, the end exclusive, in order of start, then kind as listed.  A null or
    empty text has none.  Repeated rows are scanned each.  Further columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights
    span = arrow_type(FOUND).field("spans").type

    def work(part, data, offsets):
        out = [[{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in x] for x in _judged(model.value, [t or "" for t in part.column(1).to_pylist()])]
        return {"doc_id": part.column(0), "spans": pa.array(out, span)}

    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of scanned rows."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != ADDED)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by ``mark``; ``n_chars`` follows the text.

    Overlapping spans become one mark; a text without spans stays as it is, a null one null.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def hide(text: str, spans: list[tuple[int, int]]) -> str:
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def work(part, data, offsets):
        texts = part.column(names.index("text")).to_pylist()
        spans = _judged(model.value, [t or "" for t in texts])
        new = [hide(t, [x[:2] for x in s]) if s else t for t, s in zip(texts, spans)]
        out = {n: part.column(i) for i, n in enumerate(names)} | {"text": new}
        if "n_chars" in out:
            out["n_chars"] = [len(t) if s else n for t, s, n in zip(new, spans, out["n_chars"].to_pylist())]
        return out

    return over_texts(docs, work, schema)
