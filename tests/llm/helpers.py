"""Fixtures shared by the tests of the training-data operators."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "kappa", "sigma", "rho", "tau", "omega", "x1", "él"]


def prose(rng: random.Random, n: int, sep: str = " ") -> str:
    return sep.join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s0"] * len(texts) if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed: int = 1) -> tuple[list, list, list]:
    """Texts, ids and sources with nulls, empties, ties, repeated rows, very long and odd texts."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 60, 200, 400)]
    texts = [*base, None, "", " \n\t ", base[4], base[4], base[5] + " end", base[6][:1500] + "!" + base[6][1501:],
             "word " * 5000, "a" * 30000, "ünï cödé 中文 🙂 " * 20, "line one\nline one\n\nline two\nline one", prose(rng, 300, "\n")]
    ids = list(range(len(texts)))
    ids[3], ids[11] = None, ids[10]          # a null id, and a row that repeats another
    texts[11] = texts[10]
    sources = [rng.choice(["s0", "s0", "s1", None]) for _ in texts]
    return texts, ids, sources


def with_clashes(df):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    for c in ("row", "id", "key", "block", "kind", "ids", "n", "words", "token", "host", "kept", "start", "rest", "part"):
        df = df.withColumn(c, F.lit("clash"))
    return df
