import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import awkward, documents, with_clashes

from fundflow.llm import spelling as S

SF001 = "/root/testdata/sf0.001"


def brute(rows):
    """By the definition: deletions of every word meet."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            count[low] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1:]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
            holes.setdefault((i, cut), []).append(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def result(df):
    out = S.spelling_groups(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def variants(seed=5):
    """Texts full of words one or two edits apart, with chains of forms."""
    rng = random.Random(seed)
    texts = []
    for base, times in (("abcdefgh", 3000), ("étrangère", 300), ("mississippi", 200), ("zzzzzzz", 120), ("abcdefg", 90)):
        words = [base] * times
        for _ in range(times // 4):
            w = base
            for _ in range(rng.choice([1, 1, 2, 3])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abzéÿ÷") + w[i:], w[:i] + rng.choice("aeimé") + w[i + 1:]])
            words += [w] * rng.choice([1, 2, 2, 5, 30])
        rng.shuffle(words)
        texts += [" ".join(w.upper() if rng.random() < .1 else w for w in words[k:k + 40]) for k in range(0, len(words), 40)]
    return texts


def test_equals_brute_force(spark):
    texts = variants()
    got = result(documents(spark, texts))
    assert got == brute(enumerate(texts))
    assert any(f is not None and r != f for _, f, r, *_ in got)  # a chain of forms


def test_split_blocks_equal_whole_ones(spark, monkeypatch):
    texts = variants(6)
    monkeypatch.setattr(S, "MOST_WORDS", 16)
    monkeypatch.setattr(S, "STEP", 8)
    monkeypatch.setattr(S, "COUNTED", 50)
    assert result(documents(spark, texts)) == brute(enumerate(texts))
    monkeypatch.setattr(S, "MOST_CUT", 0)
    monkeypatch.setattr(S, "BLOCK_WORDS", 1)
    assert result(documents(spark, texts)) == brute(enumerate(texts))


def test_awkward_rows(spark):
    texts, ids, sources = awkward()
    texts += ["b" * 3000 + " " + "b" * 2999 + " " + "b" * 2999 + " " + "b" * 3000, "Überraschung ÜBERRASCHUNG überraschung xüberraschung"] * 2
    ids += [None, 500, None, 501]
    sources += [None] * 4
    assert result(with_clashes(documents(spark, texts, ids, sources))) == brute(zip(ids, texts))
    assert result(documents(spark, [])) == [] == result(documents(spark, [None, "", "short words"]))


def test_one_edit():
    pairs = [("abcdefgh", "abcdefgh"), ("abcdefgh", "abcdxfgh"), ("abcdefgh", "bcdefgh"), ("abcdefgh", "abcdefg"), ("aabcdefg", "abcdefg"),
             ("abcdefgh", "abdcefg"), ("abcdefgh", "abxdxfgh")]
    got = [bool(S.one_edit(S.letters([a.encode()]), S.letters([b.encode()]))[0]) for a, b in pairs]
    assert got == [False, True, True, True, True, False, False]
    assert S.close(np.array([[3, 0]]), np.array([[3, 0], [2, 1], [2, 0], [1, 1]]))[1].tolist() == [0, 1, 2]


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    assert result(docs) == brute((r.doc_id, r.text) for r in docs.collect())
