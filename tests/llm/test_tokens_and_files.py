import io
import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, with_clashes

from fundflow.llm import token_files as TF
from fundflow.llm import tokens as T
from fundflow.session import scratch_path

ODD = ["a  b\t\x1cc d é ́x 'S don't İΑΣ Σ <|endoftext|>x<|startoftext|>  q \x85 z", "̈ ́a ͅ",
       "ﬁ Å̊ 1234 ½²³", "THE!! the*** don't!! ünder, ÉAUX.", "\x00 a\x00b \x00", "ª!! ʰx, x" * 3, "中文字 日本。", "🙂👍🏽 ok"]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.tokenizer_path(), runs_kept=300)


def test_ids_are_the_librarys(encoder):
    rng = random.Random(5)
    signs = "abeT hisr  \n\t'sd.,!?0123éèßüÀİΣσ̈́\x85\xa0<|ﬁ½中🙂\x00\x1c#$%&"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    for i in range(0, len(texts), 37):  # a small memory is forgotten again and again
        part = texts[i:i + 37]
        for t, ids in zip(part, encoder.encode(part)):
            assert np.frombuffer(ids, encoder.dtype).tolist() == encoder.encode_whole(t), t


def expected(encoder, texts, ids, end):
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    at, out = 0, []
    for i in order:
        own = [*encoder.encode_whole(texts[i]), end]
        out.append((ids[i], at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    return out


def test_files_round_trip(spark, encoder):
    texts, ids, sources = awkward()
    docs = with_clashes(documents(spark, texts, ids, sources)).repartition(5)
    folder = scratch_path(spark, "tokens-test")
    made = TF.write_token_files(docs, folder, T.tokenizer_path(), end_id=2, partitions=3, frame_bytes=4096)
    got = [tuple(r) for r in TF.read_token_files(made).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(expected(encoder, texts, ids, 2), key=key)
    # any document alone, from the file that holds it
    some = {}
    for r in made.collect():
        some |= TF.read_documents(r.path, [5, 14, 16])
    for d in (5, 14, 16):
        assert some[d].tolist() == [*encoder.encode_whole(texts[ids.index(d)]), 2]


def test_empty_table(spark):
    made = TF.write_token_files(documents(spark, []), scratch_path(spark, "tokens-test"), T.tokenizer_path())
    assert made.count() == 0 and TF.read_token_files(made).count() == 0


def one_file(width=2, n=50):
    rng = np.random.default_rng(3)
    docs = [(k * 7, rng.integers(0, 60000, rng.integers(0, 900)).astype(f"<u{width}").tobytes()) for k in range(n)]
    raw = io.BytesIO()
    w = TF.Writer(raw, width, frame_bytes=1000)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    return docs, raw.getvalue()


class Stream(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_reader_reads_only_the_frames_asked_for():
    docs, raw = one_file()
    r = TF.Reader(Stream(raw))
    for k in (0, 20, 49):
        before = r.frames_read
        [(_, parts)] = list(r.documents([k]))
        assert b"".join(parts) == docs[k][1]
        assert r.frames_read - before <= len(docs[k][1]) // 1000 + 2
    assert len(r.entries) > 40


def test_frames_are_plain_zstandard_and_damage_is_found():
    import zstandard
    docs, raw = one_file()
    r = TF.Reader(Stream(raw))
    whole = b"".join(zstandard.ZstdDecompressor().decompress(raw[int(p):int(p) + e[0]])
                     for p, e in zip(r.places, r.entries[:-1]))
    assert whole == b"".join(ids for _, ids in docs)
    r.entries[3] = (*r.entries[3][:2], r.entries[3][2] ^ 1)
    with pytest.raises(TF.DamagedFrame):
        r.frame(3)
