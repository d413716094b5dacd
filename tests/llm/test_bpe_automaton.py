import hashlib
import random

import numpy as np
from helpers import awkward, documents, with_clashes

from fundflow.llm import bpe_automaton as B
from fundflow.llm import tokens as T


def merge(word, ranks):
    """Byte-pair encoding by the book: the lowest rank first, leftmost first."""
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_against_merging_on_random_merge_lists():
    rng = random.Random(11)
    for _ in range(60):
        letters = "ab" if rng.random() < 0.5 else "abc"
        tokens, merges = list(letters), []
        for _ in range(rng.randint(1, 14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append((a, b))
                tokens.append(a + b)
        vocab = {t: i for i, t in enumerate(tokens)}
        automaton = B.MergeAutomaton(vocab, merges)
        ranks = {m: r for r, m in enumerate(merges)}
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
            want = merge(word, ranks)
            got = automaton.decode(automaton.encode(word))
            assert got == want, (merges, word)
            # the automaton accepts exactly this one sequence of labels
            ids = [vocab[t] for t in want]
            assert all(automaton.arc(x, y) for x, y in zip(ids, ids[1:]))


def test_file_against_the_library():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(T.tokenizer_path())
    coder = B.coder(T.tokenizer_path())
    rng = random.Random(2)
    signs = "abetnhisrldo  \n\t'sd.,!?0123éèßüÀİΣσ̈́\x85\xa0ﬁ½中文🙂👍🏽\x00\x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += [t.replace("a", "<|endoftext|>") for t in texts[:100]] + ["x" * 5000, "the" * 300]
    for t in texts:
        ids, decoded = coder.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded == lib.decode(want, skip_special_tokens=False), t


def test_documents(spark):
    texts, ids, sources = awkward()
    coder = B.coder(T.tokenizer_path())
    got = B.encode_documents(with_clashes(documents(spark, texts, ids, sources)), T.tokenizer_path()).collect()
    want = []
    for i, t in zip(ids, texts):
        raw, decoded = coder.encode(t)
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert B.encode_documents(documents(spark, []), T.tokenizer_path()).count() == 0
