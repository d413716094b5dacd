"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over all documents.
2. Tokens that look disguised (signs or digits among letters, a letter three
   times in a row, letters standing alone one after another) become a
   lattice: a sign may be itself, a letter it imitates, or a separator to
   drop; a repeated letter may be kept or dropped.  Viterbi takes the best
   path under the channel's costs and the character model.  Other tokens
   restore to themselves.
3. A lexicon (words and word beginnings with their log-odds) and a logistic
   score over four numbers of a text (strongest entry, sum of the tokens'
   strongest entries, tokens with an entry, tokens) are fitted on the
   restored text of labelled documents.

Only rows whose crc32(doc_id as text) mod 3 is not 1 teach labels; the
classifier is fitted on ``MOST_LABELLED`` of them at most (those with the
smallest hash of ``doc_id``), which bounds what is broadcast and gathered.
The character model and the scores cover every document.

Defined results: null or empty text has no tokens and gets the score of a
text without entries; a null ``doc_id`` is not held out and never labelled;
a ``doc_id`` labelled twice counts as toxic if one label says so; without
labels the score is 0 for all; repeated rows give one row each; an empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, remembers, table, works_for, written

#: Labelled documents that the classifier is fitted on, at most.
MOST_LABELLED = 30_000
#: Entries of the lexicon, at most, and the toxic documents an entry needs.
MOST_ENTRIES, LEAST_TOXIC = 5_000, 4
LEAST_ODDS = 1.0
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7
WORDS_KEPT = 400_000

#: Letters that a sign or digit imitates.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~'·,/"
#: Channel costs in nats: imitation, dropped separator, dropped repeat, a sign kept.
IMITATE, DROP, REPEAT, KEEP = 0.7, 0.3, 0.3, 6.0
#: Weight of the lexicon in the character model, as a share of the corpus.
ENTRIES_SHARE = 0.2
_EDGE = ".,;:!?\"'()[]{}<>#%&*|$~`^_=+/\\-…«»“”’"
_SIGN = re.escape("".join(IMITATES))
_DISGUISED = re.compile(rf"[^\W\d_].*[{_SIGN}]|[{_SIGN}].*[^\W\d_]|(.)\1\1|^\w([ .\-_*~'·,/]\w)+$")
_ALONE = re.compile(rf"(?<![^\s])(?:[\w{_SIGN}][ .\-_*~]){{2,}}[\w{_SIGN}](?![^\s.,;:!?])")

ALPHABET = 40


def letter_class(c: str) -> int:
    """0 for anything but a letter, 1 to 26 for a to z, 27 to 39 for other letters."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 13 if c.isalpha() else 0


_CLASSES: list[np.ndarray] = []


def classes(text: str) -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(np.array([letter_class(chr(i).lower()[:1]) for i in range(1 << 16)], np.int32))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASSES[0][np.minimum(codes, 0xFFFF)]


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter-class trigrams over all documents; ALPHABET**3 numbers."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        works_for("toxicity")
        total = np.zeros(ALPHABET ** 3, np.int64)
        for pdf in parts:
            rows = [t for t in pdf["text"] if t]
            for i in range(0, len(rows), 200):
                c = classes("  ".join(["", *rows[i:i + 200], ""]))
                total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET ** 3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    grams = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "gram long, n long")
    out = np.zeros(ALPHABET ** 3)
    for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # ALPHABET**3 rows at most
        out[r.gram] = r.n
    return out


class Channel:
    """Restores disguised tokens; ``entries`` are words that the character model knows besides the
    corpus, together with ENTRIES_SHARE of its weight (what is disguised is often one of them)."""

    def __init__(self, counts: np.ndarray, entries: Iterable[str] = ()):
        n = counts.astype(float).copy()
        entries = list(entries)
        extra = ENTRIES_SHARE * max(n.sum(), 1.0) / max(1, sum(len(w) + 2 for w in entries))
        for w in entries:
            c = [0, 0, *map(letter_class, w), 0, 0]
            for a, b, d in zip(c, c[1:], c[2:]):
                n[(a * ALPHABET + b) * ALPHABET + d] += extra
        n = n.reshape(ALPHABET, ALPHABET, ALPHABET)
        two = n.sum(0) + 0.5
        two /= two.sum(1, keepdims=True)
        three = n.sum(2, keepdims=True)
        self.cost = -np.log((n + 5 * two[None]) / (three + 5))

    def restore(self, token: str) -> str:
        """The most likely plain text of a disguised token (lower case)."""
        token = re.sub(r"(.)\1{3,}", r"\1\1\1", token)
        cost = self.cost
        # state: classes of the last two letters and the last letter; value: (cost, text so far)
        best = {(0, 0, ""): (0.0, "")}
        for c in token:
            step: dict = {}

            def offer(key, value):
                if key not in step or value[0] < step[key][0]:
                    step[key] = value

            plain = c.isalpha()
            for (a, b, last), (so_far, text) in best.items():
                if plain:
                    if c == last:
                        offer((a, b, last), (so_far + REPEAT, text))
                    outs, price = c, 0.0
                else:
                    if c in SEPARATORS:
                        offer((a, b, last), (so_far + DROP, text))
                    outs, price = IMITATES.get(c, ""), IMITATE
                    if not outs and c not in SEPARATORS:
                        offer((a, b, last), (so_far + KEEP, text))
                for o in outs:
                    k = letter_class(o)
                    offer((b, k, o), (so_far + price + cost[a, b, k], text + o))
                    if o == last and not plain:
                        offer((a, b, last), (so_far + price + REPEAT, text))
            best = step
        return min((v + cost[a, b, 0], text) for (a, b, _), (v, text) in best.items())[1] if best else ""


def tokens(text: str) -> tuple[set[str], list[str]]:
    """Distinct tokens as written (lower case) and runs of letters that stand alone."""
    low = text.lower()
    return set(low.split()), [m[0] for m in _ALONE.finditer(low)]


def readings(token: str, channel: Channel | None) -> list[str]:
    """The plain words a token may stand for: without signs at its edges, and restored if it looks disguised."""
    core = token.strip(_EDGE)
    out = [core] if core else []
    if channel and _DISGUISED.search(token.strip(".,;:?\"#%&*")):
        out.append(channel.restore(token.strip(".,;:?\"#%&*")))
        if core and _DISGUISED.search(core):
            out.append(channel.restore(core))
    return out


def entries_of(word: str) -> list[str]:
    """Lexicon keys of a word: itself, and its beginnings."""
    return [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


class Model:
    """Lexicon and logistic weights; ``score`` of a whole text."""

    def __init__(self, lexicon: dict[str, float], weights: tuple[float, ...] | None, channel: Channel):
        self.lexicon, self.weights, self.channel = lexicon, weights, channel
        self.known: dict[str, float] = {}

    def odds(self, token: str) -> float:
        value = self.known.get(token)
        if value is None:
            get = self.lexicon.get
            value = max((get(e, 0.0) for w in readings(token, self.channel) for e in entries_of(w)), default=0.0)
            if len(token) <= 64:
                if len(self.known) >= WORDS_KEPT:
                    self.known.clear()
                self.known[token] = value
        return value

    def features(self, text: str | None) -> tuple[float, ...]:
        """(strongest entry, logs of one more than: the sum of tokens' entries, tokens with one, tokens)."""
        words, alone = tokens(text or "")
        known = self.known
        found = [v if (v := known.get(w)) is not None else self.odds(w) for w in words]
        found += [self.odds(a) for a in alone]
        hits = [v for v in found if v > 0]
        size = math.log1p(len(found))
        return (max(hits), math.log1p(math.fsum(hits)), math.log1p(len(hits)), size) if hits else (0.0, 0.0, 0.0, size)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: The model that a worker scores with.
_MODEL: list[Model] = []
remembers("toxicity", lambda: [m.known.clear() for m in _MODEL] and None)


def score_texts(model: Model, text: pd.Series) -> pd.Series:
    works_for("toxicity")
    _MODEL[:] = [model]
    return text.map(model.score).astype(float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; ``x`` has its column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, text, toxic`` of the labelled documents to learn from; written once, bounded."""
    key = F.col("doc_id").cast("long")
    rows = (labels.select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
            .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.join(F.broadcast(rows), "doc_id"), "labelled")  # at most ``most`` rows


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model of a corpus: character counts of all documents, lexicon and weights of the labelled ones."""
    counts = trigram_counts(docs)
    sample = labelled(docs, labels, most)
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n_toxic or not n_clean:
        return Model({}, None, Channel(counts))

    def document_entries(channel: Channel, only: set[str] | None):
        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n: Counter = Counter()
            for pdf in parts:
                for text in pdf["text"]:
                    words, alone = tokens(text or "")
                    found = {e for t in (*words, *alone) for w in readings(t, channel) for e in entries_of(w)}
                    n.update(found if only is None else found & only)
            yield pd.DataFrame(list(n.items()), columns=["entry", "n"]).astype({"entry": object, "n": "int64"})
        return count

    plain = Channel(counts)
    toxic = sample.where("toxic = 1").mapInPandas(document_entries(plain, None), "entry string, n long")
    often = {r.entry: r.n for r in toxic.groupBy("entry").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= LEAST_TOXIC).orderBy(F.desc("n"), "entry").limit(20 * MOST_ENTRIES).collect()}
    clean_rows = sample.where("toxic <> 1").mapInPandas(document_entries(plain, set(often)), "entry string, n long")
    clean = {r.entry: r.n for r in clean_rows.groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    odds = {e: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(e, 0) + 0.5) / (n_clean + 1))
            for e, n in often.items()}
    chosen = sorted((e for e, v in odds.items() if v >= LEAST_ODDS), key=lambda e: (-odds[e] * often[e], e))[:MOST_ENTRIES]
    lexicon = {e: odds[e] for e in chosen}
    strong = [e[1:] for e in chosen if e[0] == "=" and odds[e] >= 4][:500]
    model = Model(lexicon, None, Channel(counts, strong))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"x": [list(model.features(t)) for t in pdf["text"]], "toxic": pdf["toxic"].eq(1)})

    seen = sample.mapInPandas(measure, "x array<double>, toxic boolean").toPandas()  # ``most`` rows of numbers
    x = np.column_stack([np.ones(len(seen)), np.array(seen["x"].tolist(), float)])
    model.weights = tuple(map(float, fit_logistic(x, seen["toxic"].to_numpy(float))))
    model.known = {}
    return model


def score_documents(docs: DataFrame, model: Model, name: str = "toxic_score") -> DataFrame:
    """``docs`` with ``name`` added; every column is kept (a column of that name raises)."""
    if name != free_name(docs, name):
        raise ValueError(f"the documents have a column {name}")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # lexicon and character model, both bounded

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return score_texts(shared.value, text)

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
