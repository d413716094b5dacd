import random
import zlib

import numpy as np
from helpers import awkward, documents, prose, with_clashes

from fundflow.llm import toxicity as X

SF01 = "/root/testdata/sf0.01"


def test_disguised_words_are_restored():
    counts = np.zeros(X.ALPHABET ** 3)
    c = X.classes("  the old man is on the road to a loss and it is an idle plot of the band  " * 50)
    np.add.at(counts, (c[:-2] * X.ALPHABET + c[1:-1]) * X.ALPHABET + c[2:], 1)
    channel = X.Channel(counts, ["idiot", "loser", "stupid", "scum", "pathetic"])
    for seen, plain in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("l0$er", "loser"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"),
                        ("p@th3t1c", "pathetic"), ("s c u m", "scum"), ("i d i o t", "idiot"), ("looooser", "loser")]:
        assert plain in X.readings(seen, channel), (seen, X.readings(seen, channel))
    assert X.readings("plain,", channel) == ["plain"]
    assert X.tokens("you i d i o t there")[1] == ["i d i o t"]


def test_held_out_fold(spark):
    rows = spark.range(50).select("id", X.held_out(X.F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def corpus(spark):
    rng = random.Random(3)
    texts, marks = [], []
    for i in range(240):
        words = prose(rng, 40).split()
        if bad := i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["villain", "blockhead", "zorbish", "zorbing"]))
        texts.append(" ".join(words))
        marks.append(int(bad))
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    return texts, marks, labels


def test_learns_from_its_folds_only_and_scores_all(spark):
    texts, marks, labels = corpus(spark)
    docs = documents(spark, texts)
    model = X.fit(docs, labels)
    got = {r.doc_id: r.toxic_score for r in X.score_documents(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= X.THRESHOLD) == bool(marks[i]) for i in held) >= 0.97 * len(held)
    assert model.score("what a v1lla1n and bl0ckhead") > 0.7 > model.score("what a fine day")
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", X.F.when(X.held_out(X.F.col("doc_id")), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    again = X.fit(docs, flipped)
    assert again.lexicon == model.lexicon and again.weights == model.weights


def test_awkward_rows(spark):
    _, _, labels = corpus(spark)
    texts, ids, sources = awkward()
    docs = with_clashes(documents(spark, texts, ids, sources))
    model = X.fit(docs, labels.unionByName(labels).union(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)))
    out = X.score_documents(docs, model)
    assert out.count() == len(texts) and all(0 <= r.toxic_score <= 1 for r in out.collect())
    none = X.fit(docs, labels.limit(0))
    assert {r.toxic_score for r in X.score_documents(docs, none).collect()} == {0.0}
    assert X.score_documents(documents(spark, []), X.fit(documents(spark, []), labels)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    rows = X.toxicity_query(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in good) <= 0.03 * len(good)
    assert sum(r.predicted for r in bad) >= 0.5 * len(bad)
