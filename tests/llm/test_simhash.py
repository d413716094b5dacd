import hashlib
import math
import random
from itertools import combinations

from helpers import awkward, documents, prose, with_clashes

from fundflow.llm import simhash as S


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


def test_edited_texts_and_order(spark):
    texts, ids, sources = awkward()
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    for bucket_rows in (2, 3, 512):
        got = S.edited_likeness(with_clashes(documents(spark, texts, ids, sources)).repartition(5), bucket_rows).collect()
        want = []
        for k, i in enumerate(order):
            t, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
            cut = len(t) // 4
            want.append((ids[i], len(t), hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()))
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
        by_id = {}
        for r in got:
            by_id.setdefault(r.doc_id, r)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints = {}
        for i, t in zip(ids, texts):
            assert prints.setdefault(t or "", by_id[i].fingerprint) == by_id[i].fingerprint
        for a, b in zip(order, order[1:]):
            if ids.count(ids[a]) == ids.count(ids[b]) == 1:
                d = bits(by_id[ids[a]].fingerprint, by_id[ids[b]].fingerprint)
                assert abs(by_id[ids[a]].near_next - max(0.0, math.cos(d * math.pi / 128))) < 1e-9


def test_single_row_and_empty_table(spark):
    [r] = S.edited_likeness(documents(spark, ["abcdefgh"])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    assert S.edited_likeness(documents(spark, [])).count() == 0


def test_votes_by_hand(spark):
    """The weight of the terms with a bit, summed in Python from the same hashes."""
    rng = random.Random(4)
    docs = documents(spark, [prose(rng, n) for n in (1, 2, 30, 400)])
    F = S.F
    words = docs.select("doc_id", S.words(F.col("text")).alias("words"))
    got = {r.doc_id: r.fingerprint for r in S.fingerprints(words, ["doc_id"]).collect()}
    for r in words.collect():
        terms = spark.createDataFrame(list(zip(r.words, [*r.words[1:], None])), "a string, b string").select(
            "a", "b", F.xxhash64("a", "b").alias("h0"), F.xxhash64(F.lit(1), "a", "b").alias("h1")).collect()
        want = 0
        for part in range(2):
            for k in range(64):
                w = [(min(16, len(t.a) + len(t.b or "")), (t[2 + part] >> k) & 1) for t in terms]
                if 2 * sum(n for n, one in w if one) > sum(n for n, _ in w):
                    want |= 1 << (k + 64 * (1 - part))
        assert got[r.doc_id] == f"{want:032x}"


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in prints[:25]:
        for _ in range(4):
            flips = rng.sample(range(128), rng.randint(0, 6))
            prints.append(p ^ sum(1 << f for f in flips))
    rows = [(i, f"{p:032x}") for i, p in enumerate(prints)]
    for radius in (0, 1, 3, 5):
        pairs, members = S.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), radius)
        want = {(min(a, b), max(a, b)) for a, b in combinations({f for _, f in rows}, 2) if bits(a, b) <= radius}
        got = pairs.collect()
        assert {(r.fingerprint, r.other) for r in got} == want and len(got) == len(want)
        assert all(bits(r.fingerprint, r.other) == r.distance for r in got)
        assert members.count() == len(rows)
