import itertools
import random
import zlib

import numpy as np
from helpers import awkward, documents, prose, with_clashes

from fundflow.llm import line_crf as C

SF01 = "/root/testdata/sf0.01"


def test_chain_equals_enumeration():
    rng = np.random.default_rng(1)
    chains = [rng.normal(size=n) for n in (1, 4, 2, 6, 1, 4)]
    moves = rng.normal(size=(2, 2))
    good, total, expected = C.forward_backward(chains, moves)
    want = np.zeros((2, 2))
    for s, g, z in zip(chains, good, total):
        paths = list(itertools.product((0, 1), repeat=len(s)))
        value = np.array([sum(s[t] for t in range(len(s)) if p[t]) + sum(moves[a, b] for a, b in zip(p, p[1:])) for p in paths])
        share = np.exp(value - np.logaddexp.reduce(value))
        assert np.isclose(z, np.logaddexp.reduce(value))
        assert np.allclose(g, [sum(w for w, p in zip(share, paths) if p[t]) for t in range(len(s))])
        for w, p in zip(share, paths):
            for a, b in zip(p, p[1:]):
                want[a, b] += w
    assert np.allclose(expected, want)
    assert C.forward_backward([], moves)[0] == []


def test_gradient_and_minimum():
    rng = np.random.default_rng(2)
    chains = [(rng.normal(size=(n, 3 * C.WIDTH)), y) for n, y in ((3, 1), (1, 0), (5, 0), (2, 1))]
    flat = rng.normal(size=C.Weights.SIZE) / 20
    got = C.likelihood(chains, C.Weights(flat))
    for k in (0, 7, C.Weights.SIZE - 5, *range(C.Weights.SIZE - 4, C.Weights.SIZE)):
        e = np.zeros_like(flat)
        e[k] = 1e-5
        slope = (C.likelihood(chains, C.Weights(flat + e))[0] - C.likelihood(chains, C.Weights(flat - e))[0]) / 2e-5
        assert np.isclose(got[1 + k], slope, atol=1e-5)
    a = np.diag([1.0, 10, 100])
    found = C.minimise(lambda x: np.concatenate([[0.5 * (x - 1) @ a @ (x - 1)], a @ (x - 1)]), 3)
    assert np.allclose(found, 1, atol=1e-2)


def test_long_texts_are_scored_in_one_chain(monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, 900, "\n"), "", "one line", "a\n\n \nb!! b!!\na\na", *[prose(rng, n, "\n") for n in (2, 3, 4, 6, 7)]]
    model = C.Model(np.random.default_rng(5).normal(size=C.Weights.SIZE))
    whole = model.scores(texts)
    for held in (1, 2, 3):
        monkeypatch.setattr(C, "HELD_LINES", held)
        assert np.allclose(model.scores(texts), whole)
    x, size = C.line_features(["Words, words WORDS!", "12 | 3 | %%", "", "Words, words WORDS!"], set())
    assert size.tolist() == [17, 7, 0, 17] and np.isfinite(x).all()
    assert x[:, C.NAMES.index("again")].tolist() == [0, 0, 0, 1]
    assert np.isclose(x[1, C.NAMES.index("signs")], 4 / 7) and x[0, C.NAMES.index("begins")] == 1


def corpus(spark, n=240):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(n):
        lines = [prose(rng, 12).capitalize() + "." for _ in range(5)]
        if bad := i % 3 == 0:
            for k in rng.sample(range(5), 3):
                lines[k] = rng.choice([lines[k].upper().replace(" ", "!! "), " | ".join(lines[k].split()), "buy " * 12])
        texts.append("\n".join(lines))
        marks.append(int(not bad))
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    return texts, marks, labels


def test_learns_from_its_folds_only_and_scores_all(spark):
    texts, marks, labels = corpus(spark)
    docs = documents(spark, texts)
    model = C.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in C.score_documents(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= C.THRESHOLD) == bool(marks[i]) for i in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", C.F.when(C.held_out(C.F.col("doc_id")), 1 - C.F.col("quality")).otherwise(C.F.col("quality")))
    assert np.allclose(C.fit(docs, flipped).weights, model.weights, atol=1e-6)


def test_awkward_rows(spark):
    texts, marks, labels = corpus(spark, 60)
    odd, ids, sources = awkward()
    train = documents(spark, texts)
    more = labels.unionByName(labels).union(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))
    model = C.fit(with_clashes(train), more)
    docs = with_clashes(documents(spark, odd, ids, sources))
    out = C.score_documents(docs, model)
    rows = out.collect()
    assert len(rows) == len(odd) and all(0 <= r.quality_score <= 1 for r in rows) and out.columns == [*docs.columns, "quality_score"]
    assert C.fit(train, labels.limit(0)).scores(["x"]) == [0.5]
    ones = C.fit(train, labels.where("quality = 1"))
    assert 0.9 < ones.scores([None])[0] < 1
    assert C.score_documents(documents(spark, []), C.fit(documents(spark, []), labels)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    rows = C.line_quality_query(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    assert len(bad) > 10 and sum(1 - r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
