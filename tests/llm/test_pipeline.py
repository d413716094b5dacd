import gc
import pathlib
import re
import zlib

import corpus_pipeline as C
import numpy as np
import pytest
from helpers import awkward, documents, with_clashes
from pyspark.sql.functions import lit

from fundflow.llm import near_dups as N
from fundflow.llm import tokens as T
from fundflow.llm import toxicity as X
from fundflow.llm.common import roots, table, written

SF001 = "/root/testdata/sf0.001"
ROOT = pathlib.Path(C.__file__).parent


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF001, "documents")]
    for name, stage in C.STAGES:
        out.append(written(stage(spark, out[-1], SF001), "test-stage"))
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in C.STAGES] == ["quality rules", "toxicity", "near duplicates", "repeated passages", "packing"]
    for df in steps[:-1]:
        assert df.columns == steps[0].columns and df.schema == steps[0].schema
    assert steps[0].count() >= steps[1].count() >= steps[2].count() >= steps[3].count() == steps[4].count() > 0


def test_quality_stage(steps):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    kept = {r.doc_id for r in steps[1].collect()}
    for r in steps[0].collect():
        w = words(r.text)
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        often = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else None
        if often is None:
            continue
        covered = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
        assert (r.doc_id in kept) == (len(w) >= 50 and 100 * len(covered) <= 50 * len(w))


def test_near_duplicate_stage(steps):
    rows = steps[2].collect()
    kept = [r for r in steps[3].collect()]
    bags = [N.shingles(r.text) for r in kept]
    assert not any(N.similarity(a, b) >= 0.8 for i, a in enumerate(bags) for b in bags[:i])
    for r in rows:  # whatever went has a near one among what was there before
        if r.doc_id not in {k.doc_id for k in kept}:
            own = N.shingles(r.text)
            assert any(N.similarity(own, N.shingles(o.text)) >= 0.8 for o in rows if o.doc_id < r.doc_id)


def test_passage_stage(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[3:5])
    seen = set()
    for d in sorted(before):
        b = before[d].text.encode()
        grams = {b[i:i + 100] for i in range(len(b) - 99)}
        if not grams & seen and len(grams) == max(0, len(b) - 99):
            assert after[d].text == before[d].text
        else:
            assert len(after[d].text) < len(before[d].text)
        assert after[d].n_chars == len(after[d].text)
        seen |= grams


def test_run_gives_the_last_stage(spark, steps):
    got = C.run(spark, SF001)
    assert sorted(map(tuple, got.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()), key=str) == \
        sorted(map(tuple, steps[-1].drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()), key=str)


def test_toxicity_stage(steps, spark):
    """The stage keeps what a model fitted on its input scores below the threshold, text by text."""
    model = X.fit(steps[1], table(spark, SF001, "labels"))
    kept = sorted(r.doc_id for r in steps[2].collect())
    assert kept == sorted(r.doc_id for r in steps[1].collect() if model.score(r.text) < X.THRESHOLD)


def test_packing_stage(steps):
    """Every id of every document lies in one piece; windows are gapless and full but for the last."""
    enc = T.Encoder(T.tokenizer_path())
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    pieces = steps[5].collect()
    windows = {}
    for doc_id, text in texts.items():
        ids = [*enc.encode_whole(text), 1]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) == len(ids) and all(p.doc_tokens == len(ids) for p in own)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
            windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))]
    sizes = sorted(sum(n for _, n in w) for w in windows.values())
    assert max(sizes) <= 2048 and all(n == 2048 for n in sizes[1:])


def test_stages_take_any_table(spark):
    """Nulls in every column, clashing columns, repeated rows, no rows."""
    texts, ids, sources = awkward()
    docs = documents(spark, texts * 2, ids * 2, sources * 2)
    docs = with_clashes(docs).withColumn("toxic_score", lit("mine")).withColumn("toxic_score_", lit(7)).withColumn("_salt", lit(1))
    docs = docs.unionByName(docs.limit(1).select(*[lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    for some in (docs, docs.limit(0)):
        held = written(some, "test-odd")
        for name, step in C.STAGES:  # each on the odd rows themselves
            out = step(spark, held, SF001)
            rows = out.collect()
            assert (len(rows) > 0) == (some is docs) or name == "quality rules", name
            if name != "packing":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
                assert {(r.toxic_score, r.toxic_score_) for r in rows} <= {("mine", 7), (None, None)}


def test_a_call_keeps_its_tables_while_its_frame_lives(spark, steps):
    first = C.near_duplicates(spark, steps[2], SF001)
    rows = sorted(r.doc_id for r in first.collect())
    with_own = roots(first)
    C.quality_rules(spark, steps[0], SF001).count()
    assert sorted(r.doc_id for r in first.collect()) == rows  # another stage ran meanwhile
    derived = C.quality_rules(spark, steps[0], SF001).limit(5)
    gc.collect()
    again = C.toxic_texts(spark, derived, SF001)              # reads what an ended call left
    assert again.count() <= 5
    del first, derived, again
    gc.collect()
    C.quality_rules(spark, steps[0], SF001)
    assert with_own and not any(pathlib.Path(p.removeprefix("file:")).exists() for p in with_own if "/fundflow-" in p and "test-" not in p)


def test_nothing_else_imports_the_subpackage():
    for p in [*ROOT.glob("fundflow/**/*.py"), *ROOT.glob("*.py")]:
        if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py"):
            assert "llm" not in p.read_text(), p


def test_every_operator_is_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
