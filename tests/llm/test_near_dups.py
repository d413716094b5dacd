import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from helpers import awkward, documents, prose, with_clashes

from fundflow.llm import near_dups as N


def classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [N.shingles(t or "") for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] or "") == (rows[b][1] or "") or N.similarity(bags[a], bags[b]) >= N.THRESHOLD:
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return sorted((tuple(sorted(g, key=lambda d: (d is not None, d or 0))) for g in groups.values()), key=str)


def found(docs):
    rows = N.near_duplicates(docs)[0].collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.class_id].append(r)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and all(r.class_size == len(g) for r in g)
    return sorted((tuple(sorted((r.doc_id for r in g), key=lambda d: (d is not None, d or 0))) for g in groups.values()), key=str)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randint(60, 300))
        texts += [base, base] + [edited(rng, base, k) for k in (1, 2, 3, 6, 12)]
    chain = prose(rng, 250)
    for _ in range(14):  # each near the one before, the ends far apart
        chain = edited(rng, chain, 3)
        texts.append(chain)
    texts += ["one line here again " * k for k in (20, 21, 24, 30, 60)]
    return texts


def test_classes_against_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(1000), len(texts))
        assert found(documents(spark, texts, ids).repartition(4)) == classes(list(zip(ids, texts)))


def test_awkward_rows(spark):
    texts, ids, sources = awkward()
    docs = with_clashes(documents(spark, texts, ids, sources))
    assert found(docs) == classes(list(zip(ids, texts)))
    left = N.first_of_each(docs)
    assert left.columns == docs.columns and left.count() == len(classes(list(zip(ids, texts))))
    assert N.near_duplicates(documents(spark, []))[0].count() == 0
    assert N.first_of_each(documents(spark, [])).count() == 0


def test_signatures_estimate_the_weighted_similarity():
    rng = random.Random(6)
    n, m = 40, 1024
    for spread in (1, 3, 40):
        a = {k: rng.randint(1, spread) for k in rng.sample(range(10 ** 9), n)}
        b = {k: rng.randint(1, spread) for k in list(a)[:n // 2]} | {rng.randrange(10 ** 9): rng.randint(1, spread) for _ in range(n // 3)}
        text = np.array([0] * len(a) + [1] * len(b))
        value = N._mix(np.array([*a, *b], np.uint64))
        sig = N.bag_minhash(text, value, np.array([*a.values(), *b.values()]), 2, m)
        want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5 + 0.01


def test_later_draws_don_t_change_the_minimum():
    value = N._mix(np.arange(1, 6, dtype=np.uint64))
    alone = N.bag_minhash(np.zeros(5, int), value, np.array([1, 2, 3, 7, 100]), 1, 64)
    beside = N.bag_minhash(np.repeat([0, 1], 5), np.tile(value, 2), np.array([1, 2, 3, 7, 100] * 2), 2, 64)
    assert (alone[0] == beside[0]).all() and (beside[0] == beside[1]).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.row: r.component for r in N.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_rows_do_not_depend_on_the_partitioning(spark):
    """A group of mutual edits, in two deals: every column of the query says the same."""
    rng = random.Random(8)
    base = prose(rng, 300)
    texts = [base] + [edited(rng, base, 4) for _ in range(20)] + [prose(rng, 80) for _ in range(5)]
    ids = rng.sample(range(1000), len(texts))
    docs = documents(spark, texts, ids)
    first, second = (N.near_duplicates_query(spark, d) for d in (docs.coalesce(1).orderBy("doc_id"), docs.repartition(7).orderBy("text")))
    assert first.columns == ["doc_id", "class_id", "class_size", "kept"]
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_large_groups_in_chunks_lose_no_link(spark, monkeypatch):
    """A dense group of edits whose similarities spread around the threshold, cut into many chunks."""
    rng = random.Random(21)
    base = prose(rng, 120)
    texts = [base] + [edited(rng, base, rng.randint(1, 9)) for _ in range(70)]
    texts += [edited(rng, rng.choice(texts), 2) for _ in range(30)]
    want = classes(list(enumerate(texts)))
    docs = documents(spark, texts).repartition(3)
    assert found(docs) == want
    for name, value in (("CHUNK_ROWS", 6), ("ROW_CHARS", 500), ("COMPARED", 4)):
        monkeypatch.setattr(N, name, value)
    assert found(docs) == want and 5 < len(want) < 90


def test_bands_and_sketch_follow_the_threshold():
    assert N.banding(0.8) == (32, 4) and N.sketch_least(0.8) == 85
    for t in (0.05, 0.2, 0.5, 0.7, 0.8, 0.95, 1.0):
        bands, rows = N.banding(t)
        assert (1 - t ** rows) ** bands <= N.MISS and bands * rows >= N.SKETCHED
    assert N.sketch_least(0.5) < 80  # the mean agreement at 0.5


def test_a_lower_threshold_loses_no_pair(spark):
    rng = random.Random(12)
    texts = []
    while len(texts) < 160:
        a = prose(rng, 80)
        b = edited(rng, a, 6)
        if 0.5 <= N.similarity(N.shingles(a), N.shingles(b)) < 0.56:
            texts += [a, b]
    rows = N.near_duplicates(documents(spark, texts).repartition(4), 0.5)[0].collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i - i % 2 for i in range(len(texts))}
