"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line with a character that is no blank is good or bad.  A line's score
is linear in its own features and those of the lines before and after it
(shares of letters, capitals, digits, signs and marks, numbers and variety of
words, words and lines that repeat, how it begins and ends, and thresholds on
these); neighbouring labels have weights of their own.  Forward-backward
gives the probability that a line is good; the document's score is their
mean, each line weighted by its characters without blanks.

Labels are known per document; all lines of a labelled document are taught
its label.  The weights maximise the penalised likelihood by L-BFGS: each
step sums the gradients of all chains in the tasks that hold them, and only
sums of the size of the weights reach the driver.  Only rows whose
crc32(doc_id as text) mod 3 is not 1 teach, MOST_LABELLED of them at most
(those with the smallest hash of ``doc_id``), cut into chains of MOST_LINES;
scores read the whole texts of all documents as one chain each.

Defined results: null or empty text is one line without characters; a null
``doc_id`` is not held out and never labelled; a ``doc_id`` labelled twice
is bad if one label says so; labels of one kind only give every document
their share, no labels 0.5; repeated rows give one row each; an empty table
gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, written
from .toxicity import held_out

#: Labelled documents to learn from, at most; tasks that hold them; lines of a chain there.
MOST_LABELLED, FIT_TASKS, MOST_LINES = 20_000, 8, 2000
THRESHOLD = 0.5
RIDGE, STEPS = 1.0, 40
#: Lines whose features are held at a time when a text is scored.
HELD_LINES = 20_000

SIGNS, MARKS = "#*$%&|<>", ".,;:?'\"-()"
LOWER, UPPER, DIGIT, SIGN, BANG, MARK, BLANK = range(1, 8)
#: (feature, least value): indicators made from the shares.
CUTS = [("signs", .01), ("signs", .05), ("signs", .15), ("bangs", .01), ("bangs", .05), ("capitals", .3), ("capitals", .8),
        ("same", .6), ("same", .85), ("beside", .05), ("beside", .4), ("lone", .05), ("lone", .25), ("long", .5)]
NAMES = ["one", "chars", "letters", "capitals", "digits", "signs", "bangs", "marks", "words", "long", "same", "beside", "lone",
         "ends", "begins", "again"]
WIDTH = len(NAMES) + len(CUTS)
_TABLE: list[np.ndarray] = []


def _class(c: str) -> int:
    if c.isspace():
        return BLANK
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    if c.isdigit():
        return DIGIT
    return SIGN if c in SIGNS else BANG if c == "!" else MARK if c in MARKS else 0


def lines_of(text: str | None) -> list[str]:
    return [s for s in (text or "").split("\n") if s and not s.isspace()] or [""]


def line_features(lines: list[str], seen: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """``(features, weights)`` of lines; ``seen`` holds the hashes of the text's earlier lines."""
    if not _TABLE:
        _TABLE.append(np.array([_class(chr(i)) for i in range(1 << 16)], np.int64))
    data = "\n".join(lines)
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4")
    line = np.cumsum(codes == 10)
    n = np.bincount(line * 8 + _TABLE[0][np.minimum(codes, 0xFFFF)], minlength=8 * len(lines)).reshape(-1, 8)[:len(lines)]
    size = n.sum(1) - n[:, BLANK]
    whole = np.maximum(size, 1)
    letters = n[:, LOWER] + n[:, UPPER]
    words = np.zeros((len(lines), 4))
    edges = np.zeros((len(lines), 3))
    for i, s in enumerate(lines):
        w = s.split()
        words[i] = len(w), len(set(w)), sum(map(str.__eq__, w, w[1:])), sum(len(x) == 1 and not x.isalnum() for x in w)
        if w:
            h = hash(s)
            edges[i] = w[-1][-1] in ".?!…", w[0][0].isupper(), h in seen
            seen.add(h)
    count = np.maximum(words[:, 0], 1)
    base = np.column_stack([
        np.ones(len(lines)), np.log1p(size) / 8, letters / whole, n[:, UPPER] / np.maximum(letters, 1), n[:, DIGIT] / whole,
        n[:, SIGN] / whole, n[:, BANG] / whole, n[:, MARK] / whole, np.log1p(words[:, 0]) / 6, np.minimum(size / count / 20, 2),
        1 - words[:, 1] / count, words[:, 2] / count, words[:, 3] / count, edges])
    base[:, NAMES.index("same")] *= words[:, 0] > 0
    cuts = np.column_stack([base[:, NAMES.index(name)] >= least for name, least in CUTS])
    return np.hstack([base, cuts]).astype(np.float32), size


def beside(x: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Features of each line, of the one before and of the one after it (zeros where there is none)."""
    none = np.zeros((1, x.shape[1]), x.dtype)
    return np.hstack([x, np.vstack([none if before is None else before, x[:-1]]), np.vstack([x[1:], none if after is None else after])])


# --- the chain ----------------------------------------------------------------------
class Weights:
    """``lines``: weights of a line's features for good; ``moves[a, b]``: weight of label b after label a."""

    SIZE = 3 * WIDTH + 4

    def __init__(self, flat: np.ndarray):
        self.lines, self.moves = flat[:-4], flat[-4:].reshape(2, 2)


def forward_backward(scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For chains of scores (of good against bad): marginals of good, log partition values, expected moves summed.

    Chains of like length run side by side (within a factor of two, so little is padded).
    """
    out, sums, expected = [np.zeros(0)] * len(scores), np.zeros(len(scores)), np.zeros((2, 2))
    of = np.array([len(s).bit_length() for s in scores])
    for size in np.unique(of):
        own = np.flatnonzero(of == size)
        good, total, moved = _side_by_side([scores[i] for i in own], moves)
        for i, g in zip(own, good):
            out[i] = g
        sums[own] = total
        expected += moved
    return out, sums, expected


def _side_by_side(scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As ``forward_backward``; longest chains first, so a step costs one set of array operations."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    length = np.array([len(scores[i]) for i in order])
    most = int(length.max())
    s = np.zeros((len(order), most))
    for k, i in enumerate(order):
        s[k, :length[k]] = scores[i]
    both = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    alpha, beta = np.zeros((len(order), most, 2)), np.zeros((len(order), most, 2))
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(most)]  # chains longer than t
    alpha[:, 0, 1] = s[:, 0]
    for t in range(1, most):
        a = active[t]
        alpha[:a, t] = both(alpha[:a, t - 1, None, :] + moves.T[None])
        alpha[:a, t, 1] += s[:a, t]
    total = both(alpha[np.arange(len(order)), length - 1])
    expected = np.zeros((2, 2))
    for t in range(most - 1, 0, -1):
        a = active[t]
        ahead = beta[:a, t].copy()
        ahead[:, 1] += s[:a, t]
        beta[:a, t - 1] = both(moves[None] + ahead[:, None, :])
        expected += np.exp(alpha[:a, t - 1, :, None] + moves[None] + ahead[:, None, :] - total[:a, None, None]).sum(0)
    good = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None])
    out: list = [None] * len(order)
    for k, i in enumerate(order):
        out[i] = good[k, :length[k]]
    sums = np.zeros(len(order))
    sums[order] = total
    return out, sums, expected


def likelihood(chains: list[tuple[np.ndarray, int]], weights: Weights) -> np.ndarray:
    """Negative log likelihood of chains ``(features, label)`` and its gradient, as one array."""
    scores = [x @ weights.lines for x, _ in chains]
    good, total, expected = forward_backward(scores, weights.moves)
    loss, lines, moves = total.sum(), np.zeros_like(weights.lines), expected
    for (x, y), s, p in zip(chains, scores, good):
        loss -= y * s.sum() + (len(s) - 1) * weights.moves[y, y]
        lines += x.T @ (p - y)
        moves[y, y] -= len(s) - 1
    return np.concatenate([[loss], lines, moves.ravel()])


def minimise(function, size: int, steps: int = STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search; ``function`` gives value and gradient as one array."""
    x, pairs = np.zeros(size), []
    value, grad = (r := function(x))[0], r[1:]
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, y in reversed(pairs):
            kept.append((a := (s @ q) / (s @ y), s, y))
            q -= a * y
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(grad), 1.0)
        for a, s, y in reversed(kept):
            q += s * (a - (y @ q) / (s @ y))
        rate = 1.0
        while rate > 1e-6:
            r = function(x - rate * q)
            if r[0] <= value - 1e-4 * rate * (grad @ q):
                break
            rate /= 2
        else:
            break
        step, change = -rate * q, r[1:] - grad
        if step @ change > 1e-12:
            pairs = [*pairs, (step, change)][-memory:]
        done = value - r[0] <= 1e-5 * abs(value)
        x, value, grad = x + step, r[0], r[1:]
        if done:
            break
    return x


# --- learning and scoring --------------------------------------------------------------
def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Features of the labelled documents to learn from, ``label, lines, data``; written once, bounded."""
    key = F.col("doc_id").cast("long")
    rows = (labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("quality"))
            .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for text, label in zip(pdf["text"], pdf["quality"]):
                lines, seen = lines_of(text), set()
                for at in range(0, len(lines), MOST_LINES):
                    x, _ = line_features(lines[at:at + MOST_LINES], seen)
                    yield pd.DataFrame({"label": [int(label == 1)], "lines": [len(x)], "data": [x.tobytes()]})

    found = texts.join(F.broadcast(rows), "doc_id").mapInPandas(measure, "label int, lines int, data binary")
    return written(found.repartition(FIT_TASKS), "lines")


class Model:
    """``weights`` of the chain, or one ``share`` for every document if there is nothing to tell apart."""

    def __init__(self, weights: np.ndarray | None, share: float = 0.5):
        self.weights, self.share = weights, share

    def scores(self, texts: list[str | None]) -> list[float]:
        """Length-weighted mean probability of good per text."""
        if self.weights is None:
            return [self.share] * len(texts)
        w = Weights(self.weights)
        emitted, sizes = [], []
        for text in texts:
            lines, seen = lines_of(text), set()
            scores, weight, held = [], [], []
            for at in range(0, len(lines), HELD_LINES):
                held.append(line_features(lines[at:at + HELD_LINES], seen))
                if len(held) == 3:
                    held.pop(0)
                if len(held) == 2:
                    scores.append(beside(held[0][0], before, held[1][0][:1]) @ w.lines)
                    before = held[0][0][-1:]
                else:
                    before = None
                weight.append(held[-1][1])
            scores.append(beside(held[-1][0], before) @ w.lines)
            emitted.append(np.concatenate(scores))
            sizes.append(np.concatenate(weight))
        good, _, _ = forward_backward(emitted, w.moves)
        return [float(p @ n / n.sum()) if n.sum() else float(p.mean()) for p, n in zip(good, sizes)]


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    sample = labelled(docs, labels, most)
    found = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        n = sum(found.values())
        return Model(None, (found.get(1, 0) + 0.5) / (n + 1) if n else 0.5)

    def function(flat: np.ndarray) -> np.ndarray:
        weights = Weights(flat)

        def total(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(1 + Weights.SIZE)
            for pdf in parts:
                for at in range(0, len(pdf), 500):
                    some = pdf.iloc[at:at + 500]
                    chains = [(beside(np.frombuffer(d, np.float32).reshape(n, WIDTH)).astype(float), int(y))
                              for d, n, y in zip(some["data"], some["lines"], some["label"])]
                    out += likelihood(chains, weights)
            yield pd.DataFrame({"sums": [out.tolist()]})

        parts = sample.mapInPandas(total, "sums array<double>").collect()  # FIT_TASKS rows or so
        out = np.sum([r.sums for r in parts], axis=0)
        out[0] += RIDGE / 2 * (flat @ flat)
        out[1:] += RIDGE * flat
        return out

    return Model(minimise(function, Weights.SIZE))


def score_documents(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with ``name`` added; every column is kept (a column of that name raises)."""
    if name != free_name(docs, name):
        raise ValueError(f"the documents have a column {name}")
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        out: list[float] = []
        for at in range(0, len(text), 200):
            out += model.scores(text.iloc[at:at + 200].tolist())
        return pd.Series(out, dtype=float)

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def line_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
