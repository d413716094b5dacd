import zlib
from collections import defaultdict

import numpy as np
from helpers import awkward, documents, with_clashes

from fundflow.llm import packing as P
from fundflow.llm import tokens as T


def check(rows, texts, ids, length, encoder):
    docs = defaultdict(list)
    for i, t in zip(ids, texts):
        docs[i].append(np.array([*encoder.encode_whole(t), 1], "<u4"))
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    full = [sum(r.length for r in w) for w in windows.values()]
    assert sum(n < length for n in full) <= 1
    assert sorted(windows) == list(range(len(windows)))
    for i, own in docs.items():
        want = sorted((start, n) for a in own for start, n in [(0, len(a))])
        assert sum(r.length for r in pieces[i]) == sum(n for _, n in want)
        if len(own) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own[0])
                assert r.ids_crc32 == zlib.crc32(own[0][at:at + r.length].tobytes())
                at += r.length
            assert at == len(own[0])
    return windows


def test_packs_every_id_once(spark):
    texts, ids, sources = awkward()
    encoder = T.Encoder(T.tokenizer_path())
    docs = with_clashes(documents(spark, texts, ids, sources)).repartition(4)
    for blocks in (1, 3, 512):
        rows = P.pack(docs, T.tokenizer_path(), length=512, block_windows=blocks, with_ids=False).collect()
        check(rows, texts, ids, 512, encoder)
    assert P.pack(documents(spark, []), T.tokenizer_path()).count() == 0


def test_ids_of_pieces(spark):
    rows = P.pack(documents(spark, ["the cat sat on the mat " * 40, None]), T.tokenizer_path(), length=64).collect()
    for r in rows:
        assert zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32


def test_windows_keep_the_mixture():
    queues = [[(900,)] * 300, [(40,)] * 1000, [(7,)] * 2000]
    total = [sum(n for n, in q) for q in queues]
    got = defaultdict(lambda: [0, 0, 0])
    for k, _, _, take, window, _ in P.fill_windows(queues, 2):
        got[window][k] += take
    assert [sum(w[k] for w in got.values()) for k in range(3)] == total
    behind = [0.0, 0.0, 0.0]
    for w in range(len(got) - 1):
        assert sum(got[w]) == P.LENGTH
        for k in range(3):
            behind[k] += P.LENGTH * total[k] / sum(total) - got[w][k]
            assert abs(behind[k]) <= 2 * P.LEAST_PIECE + P.LENGTH * total[k] / sum(total)


def test_blocks_keep_the_mixture(spark):
    sources = ["a"] * 30 + ["b"] * 10 + ["c"] * 5
    texts = ["one two three four five " * 30] * 45
    rows = P.pack(documents(spark, texts, sources=sources), T.tokenizer_path(), length=128, block_windows=4, with_ids=False).collect()
    per = defaultdict(lambda: defaultdict(int))
    for r in rows:
        per[r.sequence_id // 4][r.source] += r.length
    for b in sorted(per)[:-1]:
        assert sum(per[b].values()) == 512
        assert abs(per[b]["a"] - 512 * 30 / 45) <= 1 and abs(per[b]["c"] - 512 * 5 / 45) <= 1
