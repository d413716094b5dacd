import hashlib
import random
import time

import numpy as np
import pandas as pd
import pytest
from helpers import awkward, documents, prose, with_clashes
from pyspark.sql import functions as F

from fundflow.llm import passages as P
from fundflow.llm.common import written


def brute(rows):
    first = {}
    key = lambda d, p: (d is not None, d or 0, p)
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - 99):
            k = b[p:p + 100]
            first[k] = min(first.get(k, key(d, p)), key(d, p))
    out = []
    for d, b in data:
        gone, upto = bytearray(len(b)), 0
        for p in range(len(b) - 99):
            if first[b[p:p + 100]] < key(d, p):
                for x in range(max(p, upto), p + 100):
                    gone[x] = 1
                upto = p + 100
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in P.deduplicate(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def hard(seed):
    """Shared passages in different surroundings, near copies, periodic texts, exact 99, 100 and 101 bytes."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    texts = [prose(rng, rng.randint(0, 30)) + passage[a:b] + prose(rng, rng.randint(0, 30))
             for a, b in [(0, None), (3, None), (0, 150), (50, 149), (50, 150), (50, 151)] * 4]
    base = prose(rng, 120)
    for _ in range(12):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice(["", "x", "yy"]) + base[k + rng.randint(0, 3):])
    texts += ["ab" * 200, "ab" * 130, "a" * 350, "a" * 99, "a" * 100, "a" * 101, "abc" * 90, base[:99], base[:100], base[7:107]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = hard(seed)
    ids = random.Random(seed).sample(range(-50, 500), len(texts))
    assert run(documents(spark, texts, ids).repartition(5)) == brute(list(zip(ids, texts)))


def test_small_chunks_and_hot_buckets(spark, monkeypatch):
    """Map-side paths: one task, several sendings, buckets that go straight to step 3."""
    texts = hard(7)
    parts = [documents(spark, texts).toPandas().assign(row=range(len(texts)), id=range(len(texts)))[["row", "id", "text"]]]
    for chunk, hot, runs in ((300, 2, 20), (4_000_000, 3, 1_000_000), (2000, 8, 50)):
        monkeypatch.setattr(P, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(P, "HOT_RUNS", hot)
        monkeypatch.setattr(P, "CHUNK_RUNS", runs)
        sent = pd.concat(list(P.send_runs(iter(parts)))).sort_values(["key", "kind", "run", "id", "start"])
        spans = pd.concat(list(P.judge_runs(iter([sent]))))
        opened = spans[spans["open"]].sort_values(["row", "start"])
        data = [t.encode() for t in texts]
        held = [(row, row, s, c, data[row][s:s + c + 99])
                for row, s, c in zip(opened["row"], opened["start"], opened["count"])]
        gone = [spans[~spans["open"]]]
        if held:
            half = len(held) // 2
            strings = pd.concat([P._refined(h) for h in (held[:half], held[half:]) if h])
            strings = strings.sort_values(["key", "more", "gone", "id", "start"])
            gone.append(pd.concat(list(P.judge_strings(iter([strings])))))
        gone = pd.concat(gone)
        out = []
        for k, b in enumerate(data):
            own = gone[gone["row"] == k]
            a, e = P.merge_spans(own["start"].to_numpy(np.int64), (own["start"] + own["count"] + 99).to_numpy(np.int64))
            kept = P.cut_spans(b, a, e)
            out.append((k, len(b), len(b) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
        assert sorted(out, key=str) == brute(list(enumerate(texts)))


def test_awkward_rows(spark):
    texts, ids, sources = awkward()
    docs = with_clashes(documents(spark, texts, ids, sources))
    assert run(docs) == brute(list(zip(ids, texts)))
    left = P.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(texts)
    assert all(r.n_chars == len(r.text) and r["rest"] == "clash" for r in left.collect())
    assert P.deduplicate(documents(spark, [])).count() == 0
    assert P.without_repeats(documents(spark, [])).count() == 0


def test_refinement_is_exact():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[:300]
    starts = np.arange(len(data) - 99)
    raw, bucket = data.tobytes(), P.refine(data, starts)
    names = {}
    for s, b in zip(starts.tolist(), bucket.tolist()):
        assert names.setdefault(raw[s:s + 100], b) == b
    assert len(set(names.values())) == len(names)


def test_long_text_in_parts():
    text = (prose(random.Random(3), 900) * 2).encode()
    whole = P.leading_runs([text])
    assert whole["count"].sum() == len(text) - 99
    some = list(P.long_parts([text], most=1000))
    got = sorted((int(s) + k) for r in some for s, c in zip(r["start"], r["count"]) for k in range(c))
    assert got == list(range(len(text) - 99))


def test_decided_runs_travel_as_stretches():
    """What a task decides alone (repeats inside it) is sent as stretches of text, not run by run or string by string."""
    rng = random.Random(11)
    text = prose(rng, 400)
    texts = [text, text, text + prose(rng, 5)]
    sent = pd.concat(list(P.send_runs(iter([pd.DataFrame({"row": range(3), "id": range(3), "text": texts})]))))
    gone = sent[sent["kind"] == P.GONE]
    assert (sent["kind"] == P.RUN).sum() > 20 and len(gone) == 2
    strings = P._refined([(k, k, 0, len(text) - 99, text.encode()) for k in range(2)])
    assert strings["gone"].sum() == 1 and strings.loc[strings["gone"], "count"].tolist() == [len(text) - 99]


def test_shuffle_files_of_a_stored_table_go(spark):
    """A table that is stored doesn't leave the shuffle it was made from on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        found = files.getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    before = shuffles()
    made = written(spark.range(1000).repartition(7, "id").withColumn("rest", F.col("id") % 3), "shuffled")
    deadline = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before
    assert made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
