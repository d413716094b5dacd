"""Suffix-array deduplication by bucket-pointer refinement, for repeats of LENGTH bytes.

A byte goes if a LENGTH-byte string that covers it also starts earlier
(smaller ``doc_id``, or the same document and an earlier start), judged on
the input.  Suffixes are sorted into buckets by a q-gram and buckets are
refined by the bucket numbers of later offsets until they tell LENGTH bytes
apart; only suffixes whose bucket others share go on.

1. The texts are written once as blocks (a Parquet file per task); rows are
   known by their number in it, so later steps reread a block's file and no
   text is shuffled.
2. Every LENGTH-byte string holds one leading q-gram (the smallest hash, the
   leftmost on a tie), found from its own bytes alone.  Consecutive strings
   with the same leading q-gram form a run.  The q-gram is the run's initial
   bucket; the hash of the run's bytes and the hashes of the q bytes to
   either side refine it.  Runs meet in one exchange by their q-gram.  A run
   that has occurred whole before goes; a run that shares the q-gram and a
   side with a different run goes on to step 3; all others stay.
3. The strings of these runs are told apart inside each block by
   bucket-pointer refinement: buckets of 8-byte grams, then each bucket is
   refined by sorting on the bucket at offset 8, 16, 32 and 36, each time
   reusing the numbers just made.  The first string of every bucket meets
   those of other blocks in a second exchange, by 96 bits of content hash.
4. Removed spans return to their block and the results are made.

Hot passages: a task sends each (bucket, run) and each string once, what is
decided already as stretches of text and not run by run, and a
q-gram that has many different runs in one task goes straight to step 3
with one marker sent in its place, so no key of an exchange has more rows
than a small multiple of the tasks.

Two strings count as equal across blocks if 96 bits or more of hash agree
and their leading q-grams do; inside a block step 3 compares exactly.

Defined results: null text is the empty text; a null ``doc_id`` is smaller
than every other; rows with equal ``doc_id`` are one document for the order
of starts, so identical rows don't remove each other; texts shorter than
LENGTH keep all bytes; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NULL_ID, block_batches, block_of, block_texts, by_block, groups, rebuilt, write_blocks
from .common import shuffle_width, works_for, written

LENGTH, GRAM = 100, 36
SIDE = GRAM - 4
#: Text bytes hashed at once, runs gathered before a task sends them.
CHUNK_BYTES, CHUNK_RUNS = 4_000_000, 1_000_000
#: Different runs of one q-gram in one task from which it goes straight to step 3.
HOT_RUNS = 8
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
RUN, MARK, GONE, OPEN = 0, 1, 2, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _A
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from every place, by doubling: a gram's
    hash is made of its halves' hashes.  One entry per whole gram."""
    part = _mix((data.astype(np.uint64) + np.uint64(seed)) * _C)
    out, done, length = None, 0, 1
    while True:
        if size & length:
            if out is None:
                out = part.copy()
            else:
                n = max(0, min(len(out), len(part) - done))
                out = _mix(out[:n] * _B + part[done:done + n])
            done += length
        length *= 2
        if length > size:
            return out
        n = max(0, len(part) - length // 2)
        part = _mix(part[:n] * _B + part[length // 2:length // 2 + n])


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket numbers of the ``length``-byte strings at ``starts``; equal exactly if the bytes are.

    Bucket-pointer refinement: buckets of 8-byte grams at every place, each
    refined by the bucket at a later offset; a round's numbers are the next
    round's pointers.
    """
    n = len(data) - 7
    grams = np.zeros(n, np.uint64)
    for k in range(8):
        grams = grams << np.uint64(8) | data[k:k + n]
    bucket = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
    known = 8
    while known < length:
        step = min(known, length - known)
        n = len(bucket) - step
        places = starts if known + step == length else slice(0, n)
        pair = (bucket[:n] << np.uint64(32) | bucket[step:step + n])[places]
        bucket = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        known += step
    return bucket.astype(np.int64)


def leading_runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of strings with one leading q-gram in each of ``texts``.

    ``text, start, count`` (strings ``start .. start + count - 1``), ``gram``
    and ``run`` hashes, ``left`` and ``right`` side hashes (0: the run has no
    string that takes in that side), ``turn``: strings before the first that
    takes in the right side only.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    window = LENGTH - GRAM + 1
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return dict.fromkeys(("text", "start", "count", "gram", "run", "left", "right", "turn"), empty)
    grams = gram_hashes(data, GRAM)
    low = np.uint64(0xFFFFFF)
    least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[:len(least) - (window - size)], least[window - size:])
    lead = (least & low).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    whole = np.arange(n) + LENGTH <= first[1:][text]
    new = np.ones(n, bool)
    new[1:] = (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new & whole)
    cuts = np.append(np.flatnonzero(new | ~whole), n)
    ends = cuts[np.searchsorted(cuts, starts, "right")]
    lead, text = lead[starts], text[starts]
    # hash of a run's bytes: prefix sums of a polynomial, brought to a common power
    power = np.full(len(data) + 1, _B, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_mix((data.astype(np.uint64) + np.uint64(7)) * _C) * power[:-1], out=sums[1:])
    stop = ends + LENGTH - 1
    count = ends - starts
    run = (sums[stop] - sums[starts]) * power[len(data) - starts]
    run = run * np.uint64(pow(pow(int(_B), -1, 1 << 64), len(data), 1 << 64))  # drops this chunk's power
    run = _mix(run * _B + (lead - starts).astype(np.uint64) * _C + count.astype(np.uint64))
    before, after = lead - starts, lead - ends + 1     # bytes before the q-gram: most, least
    side = gram_hashes(data, SIDE, 3)
    left = np.where(before >= SIDE, side[np.maximum(lead - SIDE, 0)].astype(np.int64) | 1, 0)
    right = np.where(after < SIDE, side[np.minimum(lead + GRAM, len(side) - 1)].astype(np.int64) | 1, 0)
    turn = np.clip(before - SIDE + 1, 0, count)
    return {"text": text, "start": starts - first[text], "count": count, "gram": grams[lead].astype(np.int64),
            "run": run.astype(np.int64), "left": left, "right": right, "turn": turn}


#: ``span``: count and turn, ``sides``: left and right, 32 bits each.
SENT = "key long, kind int, run long, id long, start int, span long, sides long, row long"
STRING = "key long, more int, gone boolean, id long, start int, count int, row long"
SPAN = "row long, start int, count int, open boolean"


def _low32(x: np.ndarray) -> np.ndarray:
    return (x & 0xFFFFFFFF).astype(np.uint32).view(np.int32) if len(x) else x.astype(np.int32)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def _both(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One long of two 32-bit numbers."""
    return high << 32 | low & 0xFFFFFFFF


def _stretches(at: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, *keys: np.ndarray) -> tuple:
    """``(places, counts)``: of the spans at places ``at`` (in text order), those that follow on each other as one."""
    if not len(at):
        return at, count[at]
    new = _firsts(row[at], *(k[at] for k in keys))
    new[1:] |= start[at][1:] != (start + count)[at][:-1]
    first = np.flatnonzero(new)
    return at[first], np.add.reduceat(count[at], first)


def send_runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 2, map side: each (bucket, run) of a task once; later ones are gone, hot buckets are open."""
    works_for("passages")
    held: list[dict] = []
    size = 0

    def flush():
        r = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.lexsort((r["start"], r["id"], r["run"], r["gram"]))
        gram, run, ids, start = (r[k][order] for k in ("gram", "run", "id", "start"))
        new = _firsts(gram, run)
        earliest = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = (ids != ids[earliest]) | (start != start[earliest])
        gram_new = _firsts(gram)
        group = np.cumsum(gram_new) - 1
        hot = (np.bincount(group, weights=new) >= HOT_RUNS)[group]
        # identical (bucket, run, id, start) of repeated rows: each row is kept
        kind = np.empty(len(order), np.int64)
        kind[order] = np.where(again, GONE, np.where(hot, OPEN, RUN))
        own, marks = np.flatnonzero(kind == RUN), order[gram_new & hot]
        passed, counts = _stretches(np.flatnonzero(kind != RUN), r["row"], r["start"], r["count"], kind)
        for at, k, count in ((own, kind[own], r["count"][own]), (passed, kind[passed], counts),
                             (marks, np.full(len(marks), MARK), np.zeros(len(marks), np.int64))):
            spread = _mix(r["row"][at].astype(np.uint64) * _A + r["start"][at].astype(np.uint64)).astype(np.int64)
            key = np.where((k == RUN) | (k == MARK), r["gram"][at], spread)
            yield pd.DataFrame({
                "key": key, "kind": k.astype(np.int32), "run": np.where(k == RUN, r["run"][at], 0), "id": r["id"][at],
                "start": r["start"][at].astype(np.int32), "span": _both(count, np.where(k == RUN, r["turn"][at], 0)),
                "sides": np.where(k == RUN, _both(r["left"][at], r["right"][at]), 0), "row": r["row"][at]})

    for pdf in parts:
        rows = list(zip(pdf["row"].tolist(), pdf["id"].tolist(), (t.encode("utf-8", "surrogatepass") for t in pdf["text"])))
        i = 0
        while i < len(rows):
            j, total = i, 0
            while j < len(rows) and (j == i or total + len(rows[j][2]) <= CHUNK_BYTES):
                total += len(rows[j][2])
                j += 1
            found = {}
            for some in long_parts([t for *_, t in rows[i:j]]):
                found = some if not found else {k: np.concatenate([found[k], some[k]]) for k in found}
            text = found.pop("text")
            found["row"] = np.array([r[0] for r in rows[i:j]], np.int64)[text]
            found["id"] = np.array([r[1] for r in rows[i:j]], np.int64)[text]
            held.append(found)
            size += len(text)
            i = j
            if size >= CHUNK_RUNS:
                yield from flush()
                held, size = [], 0
    if held and size:
        yield from flush()


def long_parts(texts: list[bytes], most: int = 3 * CHUNK_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """``leading_runs``, with a text beyond ``most`` bytes taken in overlapping parts.

    A run that a part's edge cuts comes in two runs of the same strings;
    both sides of a comparison may be cut, so parts are cut at the same
    strings of a text only; a cut run differs from a whole one and goes on
    to step 3, which compares single strings.
    """
    if all(len(t) <= most for t in texts):
        yield leading_runs(texts)
        return
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), most):
            some = leading_runs([t[at:at + most + LENGTH - 1]])
            some["text"] = some["text"] + k
            some["start"] = some["start"] + at
            yield some


def judge_runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 2, reduce side, rows sorted by (key, run, id, start)."""
    for pdf in groups(parts, "key"):
        c = {k: pdf[k].to_numpy() for k in pdf.columns}
        for packed, high, low in (("span", "count", "turn"), ("sides", "left", "right")):
            c[high], c[low] = c[packed] >> 32, c[packed] & 0xFFFFFFFF
        passed = (c["kind"] == GONE) | (c["kind"] == OPEN)
        outs = [(c["row"][passed], c["start"][passed], c["count"][passed], c["kind"][passed] == OPEN)]
        keep = ~passed
        if keep.any():
            r = {k: v[keep] for k, v in c.items()}
            new = _firsts(r["key"], r["run"], r["kind"])
            begin = np.flatnonzero(new)
            earliest = begin[np.cumsum(new) - 1]
            own = r["kind"] == RUN
            again = own & ((r["id"] != r["id"][earliest]) | (r["start"] != r["start"][earliest]))
            outs.append((r["row"][again], r["start"][again], r["count"][again], np.zeros(again.sum(), bool)))
            group = np.cumsum(_firsts(r["key"])) - 1
            hot = (np.bincount(group, weights=~own) > 0)[group]
            rep = own & ~again
            for side, lo, hi in (("left", np.zeros_like(r["turn"]), r["turn"]), ("right", r["turn"], r["count"])):
                # runs (not rows) of the bucket that have this side
                at = np.flatnonzero(own & new & (r[side] != 0))
                order = np.lexsort((r[side][at], group[at]))
                at = at[order]
                shared = np.zeros(len(own), bool)
                if len(at):
                    first = _firsts(group[at], r[side][at])
                    many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1
                    shared[at] = many
                shared = shared[earliest] | hot
                take = rep & shared & (hi > lo)
                outs.append((r["row"][take], (r["start"] + lo)[take], (hi - lo)[take], np.ones(take.sum(), bool)))
        row, start, count, is_open = (np.concatenate(x) for x in zip(*outs))
        yield pd.DataFrame({"row": row, "start": start.astype(np.int32), "count": count.astype(np.int32), "open": is_open})


def open_strings(paths: dict[int, str]):
    """Step 3, map side: refines the open strings of each block; the first of each bucket is sent."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, spans in by_block(parts):
            rows, starts, counts = (spans[k].to_numpy().astype(np.int64) for k in ("row", "start", "count"))
            order = np.lexsort((starts, rows))
            rows, starts, counts = rows[order], starts[order], counts[order]
            held, at, size = [], 0, 0
            for numbers, ids, texts in block_texts(paths[block]):
                to = int(np.searchsorted(rows, numbers[-1], "right"))
                for k in range(at, to):
                    n = int(np.searchsorted(numbers, rows[k]))
                    held.append((rows[k], ids[n], starts[k], counts[k],
                                 texts[n][starts[k]:starts[k] + counts[k] + LENGTH - 1]))
                    size += len(held[-1][4])
                at = to
                if size >= CHUNK_BYTES:
                    yield _refined(held)
                    held, size = [], 0
            if held:
                yield _refined(held)
    return run


def _refined(held: list[tuple]) -> pd.DataFrame:
    data = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
    sizes = np.array([len(h[4]) for h in held], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    counts = np.array([h[3] for h in held], np.int64)
    of = np.repeat(np.arange(len(held)), counts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[of] + shift
    bucket = refine(data, at)
    ids = np.array([h[1] for h in held], np.int64)[of]
    rows = np.array([h[0] for h in held], np.int64)[of]
    starts = np.array([h[2] for h in held], np.int64)[of] + shift
    order = np.lexsort((starts, ids, bucket))
    new = _firsts(bucket[order])
    earliest = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    again = np.zeros(len(of), bool)
    again[order] = (ids[order] != ids[earliest]) | (starts[order] != starts[earliest])
    single = np.ones(len(of), np.int64)
    own = np.flatnonzero(~again)
    passed, count = _stretches(np.flatnonzero(again), rows, starts, single)
    at, n = at[own], len(own)
    spread = _mix(rows[passed].astype(np.uint64) * _A + starts[passed].astype(np.uint64)).astype(np.int64)
    pick = np.concatenate([own, passed])
    return pd.DataFrame({
        "key": np.concatenate([gram_hashes(data, LENGTH, 5)[at].astype(np.int64), spread]),
        "more": np.concatenate([_low32(gram_hashes(data, LENGTH, 11)[at]), np.zeros(len(passed), np.int32)]),
        "gone": np.arange(len(pick)) >= n, "id": ids[pick], "start": starts[pick].astype(np.int32),
        "count": np.concatenate([single[own], count]).astype(np.int32), "row": rows[pick]})


def judge_strings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Step 3, reduce side, rows sorted by (key, more, id, start): all but the earliest are gone."""
    for pdf in groups(parts, "key"):
        c = {k: pdf[k].to_numpy() for k in pdf.columns}
        new = _firsts(c["key"], c["more"], c["gone"])
        earliest = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = c["gone"] | (c["id"] != c["id"][earliest]) | (c["start"] != c["start"][earliest])
        yield pd.DataFrame({"row": c["row"][gone], "start": c["start"][gone], "count": c["count"][gone],
                            "open": np.zeros(gone.sum(), bool)})


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans (touching spans are one run)."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1] if len(at) else reach


def cut_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = np.concatenate([[0], np.column_stack([starts, ends]).ravel(), [len(data)]]).tolist()
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _spans_of(spans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of a block's spans, sorted; the block's own marker row is left out."""
    spans = spans[spans["row"] >= 0]
    rows, starts, counts = (spans[k].to_numpy().astype(np.int64) for k in ("row", "start", "count"))
    order = np.lexsort((starts, rows))
    return rows[order], starts[order], (starts + counts + LENGTH - 1)[order]


def _cleaned(numbers: np.ndarray, texts: list[bytes], rows: np.ndarray, starts: np.ndarray,
             ends: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(remaining bytes, removed runs) of each text."""
    lows, highs = (np.searchsorted(rows, numbers, side).tolist() for side in ("left", "right"))
    for data, lo, hi in zip(texts, lows, highs):
        if lo == hi:
            yield data, 0
        else:
            a, b = merge_spans(starts[lo:hi], ends[lo:hi])
            yield cut_spans(data, a, b), len(a)


def _results(paths: dict[int, str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, spans in by_block(parts):
            found = _spans_of(spans)
            for numbers, ids, texts in block_texts(paths[block]):
                out = [(row, None if doc == NULL_ID else doc, len(data), len(data) - len(kept), n,
                        hashlib.sha256(kept).hexdigest())
                       for row, doc, data, (kept, n) in zip(numbers.tolist(), ids, texts, _cleaned(numbers, texts, *found))]
                made = pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
                yield made.astype({"doc_id": "Int64"})
    return run


def _documents(paths: dict[int, str], columns: list[str]):
    def run(parts):
        for block, spans in by_block(b.to_pandas() for b in parts):
            found = _spans_of(spans)
            for batch in block_batches(paths[block]):
                texts = batch.column("text").cast("binary").to_pylist()
                kept = _cleaned(batch.column("row").to_numpy(), texts, *found)
                yield rebuilt(batch, columns, [k.decode("utf-8", "ignore") for k, _ in kept])
    return run


def repeated_spans(docs: DataFrame, keep: list[str] = ()) -> tuple[DataFrame | None, dict[int, str]]:
    """``(spans, paths)``: per block the strings to remove, as runs of starts (and a marker row per block),
    and the blocks' files; no spans for an empty table."""
    spark = docs.sparkSession
    n = shuffle_width(spark)
    blocks, paths = write_blocks(docs, keep)
    block = block_of()
    if not paths:
        return None, paths

    sent = blocks.select("row", "id", "text").mapInPandas(send_runs, SENT)
    runs = written(sent.repartition(n, "key").sortWithinPartitions("key", "kind", "run", "id", "start")
                   .mapInPandas(judge_runs, SPAN).withColumn("block", block), "runs")
    opened = (runs.where("open").select("block", "row", "start", "count")
              .repartitionByRange(len(paths), "block").sortWithinPartitions("block"))
    strings = opened.mapInPandas(open_strings(paths), STRING)
    gone = (strings.repartition(n, "key").sortWithinPartitions("key", "more", "gone", "id", "start")
            .mapInPandas(judge_strings, SPAN).withColumn("block", block))
    each = spark.createDataFrame([(-1, 0, 0, False, b) for b in paths], runs.schema)
    spans = runs.where("not open").unionByName(gone).unionByName(each)
    spans = written(spans.select("block", "row", "start", "count"), "spans")
    return spans.repartitionByRange(len(paths), "block").sortWithinPartitions("block"), paths


RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` its result, ``RESULT`` columns."""
    spans, paths = repeated_spans(docs)
    if spans is None:
        return docs.sparkSession.createDataFrame([], RESULT)
    return spans.mapInPandas(_results(paths), RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text in ``text`` (and its length in ``n_chars``); every row and column is kept.

    A character whose bytes are removed in part goes whole.
    """
    spans, paths = repeated_spans(docs, [c for c in docs.columns if c != "text"])
    if spans is None:
        return docs
    return spans.mapInArrow(_documents(paths, docs.columns), docs.schema)


def passages_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op8: every document."""
    return deduplicate(docs).drop("row")
