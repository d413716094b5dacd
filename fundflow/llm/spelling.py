"""Spelling variants by blocked Gram matrices of letter counts.

Words are the runs of letters (A to Z, a to z, U+00C0 to U+00FF) of whole
texts, A to Z lower-cased; one run in 31, chosen by a checksum of document
and run, loses a letter.  Words of at least 7 letters that occur twice or
more are compared: two are near if one inserted, deleted or replaced letter
makes one from the other.

Blocks.  One edit changes the letter counts by a squared distance of 1 (an
insertion) or 2 (a replacement), and the length by one at most.  The letters
are dealt into a few groups of like frequency; a block holds the words with
the same number of letters of every group, so of one length.  Near words lie
in one block, or in blocks that differ by one letter of one group (adjacent
lengths) or by one letter moved between two groups.  A word stays in its own
block and visits those neighbours, of each pair of blocks one way only.  The
product of a block's letter counts with those of its visitors gives all
squared distances; pairs at most two apart are verified letter by letter.
The number of groups follows the words of a length, so that a block stays
small as the vocabulary grows; a block with more than MOST_WORDS is cut into
chunks and its visitors go to each of them.  Only a count of near words and
the best one leave a task, never the pairs.

The form of a word is its near word of most occurrences n (ties: the
smallest), if it has FORM_TIMES the word's own n; the root is the last one
reached by following forms, found by pointer doubling (n grows FORM_TIMES at
every step, so few doublings are enough).

Defined results: null and empty texts have no words; a null ``doc_id``
counts as the empty text in the checksum; repeated rows count again; an
empty table gives no rows; a word of any length is compared whole; other
columns are ignored.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, written

LEAST_LETTERS, LEAST_OCCURRENCES, FORM_TIMES = 7, 2, 10
#: One run in EDITED loses a letter.
EDITED = 31
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)
#: Words of up to WIDTH letters in a chunk of a block (longer words count for more), and in a step of its visitors.
MOST_WORDS, STEP, WIDTH = 4096, 1024, 64
#: Words that a block should hold on average.
BLOCK_WORDS = 500
MOST_GROUPS = 12
#: Blocks cut into chunks that may be broadcast, as (block, chunks).
MOST_CUT = 100_000
#: Words counted in a task before their counts are passed on.
COUNTED = 300_000
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])


# --- words and their occurrences ------------------------------------------------
def runs_of(doc_id: int | None, text: str | None) -> Iterator[tuple[bytes, int]]:
    """``(word in Latin-1, occurrences)`` of a whole text; other characters only separate runs."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(_RUN.findall((text or "").encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % EDITED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LETTERS:
                continue
        yield run, n


def count_words(parts) -> Iterator:
    import pyarrow as pa

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], ["word", "n"])
    seen: dict[bytes, int] = {}
    for b in parts:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            for w, n in runs_of(doc_id, text.as_py()):
                seen[w] = seen.get(w, 0) + n
            if len(seen) > COUNTED:
                yield batch()
                seen.clear()
    yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word that is compared; counts combine within tasks before their exchange."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (rows.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_OCCURRENCES))


# --- letter counts, groups and blocks ---------------------------------------------
def letter_counts(words: list[bytes]) -> np.ndarray:
    """Counts of LETTERS per word."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.bincount(rows * 256 + data, minlength=256 * len(words)).reshape(len(words), 256)
    return out[:, LETTERS]


def groups_of(frequency: np.ndarray, groups: int) -> np.ndarray:
    """Group of every letter: the most frequent letter left goes to the lightest group."""
    out, weight = np.zeros(len(LETTERS), np.int64), np.zeros(groups)
    for i in np.argsort(-frequency, kind="stable"):
        out[i] = g = int(weight.argmin())
        weight[g] += frequency[i] + 1e-9
    return out


def groups_wanted(lengths: dict[int, int]) -> int:
    """The fewest groups with which no length holds more than BLOCK_WORDS words a block on average."""
    for g in range(2, MOST_GROUPS):
        if all(n <= BLOCK_WORDS * math.comb(length + g - 1, g - 1) for length, n in lengths.items()):
            return g
    return MOST_GROUPS


def neighbours(groups: int) -> np.ndarray:
    """What a visit adds to the numbers of letters per group: one letter more, or one moved to a later group."""
    unit = np.eye(groups, dtype=np.int64)
    moved = [unit[b] - unit[a] for a in range(groups) for b in range(a + 1, groups)]
    return np.array([*unit, *moved], np.int64).reshape(-1, groups)


def keys(profiles: np.ndarray):
    """Block keys as an Arrow binary column."""
    import pyarrow as pa
    data = np.ascontiguousarray(profiles.astype("<u4"))
    width = data.shape[1] * 4
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def placed(of: np.ndarray, groups: int):
    """Words with their own block and the blocks they visit."""
    deal = np.eye(groups, dtype=np.int64)[of]
    steps = neighbours(groups)

    def run(parts):
        import pyarrow as pa
        for b in parts:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            profile = letter_counts(words) @ deal
            n, lengths = b.column("n").to_numpy(), np.array([len(w) for w in words], np.int64)
            own = pa.array(words, pa.binary())
            yield pa.RecordBatch.from_arrays([keys(profile), pa.array(np.zeros(len(words), np.int32)), pa.array(lengths),
                                              own, pa.array(n)], ["block", "visits", "width", "word", "n"])
            for at in range(0, len(words), 2000):
                some = profile[at:at + 2000, None, :] + steps[None]
                row, step = np.nonzero((some >= 0).all(2))
                yield pa.RecordBatch.from_arrays(
                    [keys(some[row, step]), pa.array(np.ones(len(row), np.int32)), pa.array(lengths[at + row] + (step < groups)),
                     own.take(pa.array(at + row)), pa.array(n[at + row])], ["block", "visits", "width", "word", "n"])
    return run


# --- near words of a chunk ------------------------------------------------------------
def letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether the word of ``b`` is that of ``a`` with one letter replaced, or deleted if it is shorter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    differs = np.logical_or.accumulate(a[:, :-1] != b, axis=1)
    return ~(differs & (a[:, 1:] != b)).any(1)


def close(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose letter counts have a squared distance of two at most, from the product of the blocks."""
    exact = np.float32 if max(a.sum(1).max(initial=0), b.sum(1).max(initial=0)) < 2000 else np.float64
    a, b = a.astype(exact), b.astype(exact)
    far = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    far -= 2 * (a @ b.T)
    return np.nonzero(far <= 2)


def near_pairs(own: list[bytes], own_counts: np.ndarray, other: list[bytes], other_counts: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (row of ``own``, row of ``other``); ``within`` one list, each pair once."""
    i, j = close(own_counts, other_counts)
    if within:
        i, j = i[i < j], j[i < j]
    a, b = letters(own), letters(other)
    held = max(1, (1 << 22) // max(a.shape[1], 1))
    good = [one_edit(a[i[k:k + held]], b[j[k:k + held]]) for k in range(0, len(i), held)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


class Best:
    """Per word of a list: its number of near words and the best of them."""

    def __init__(self, words: list[bytes]):
        self.words, self.count, self.best = words, np.zeros(len(words), np.int64), {}

    def add(self, i: np.ndarray, j: np.ndarray, words: list[bytes], n: np.ndarray) -> None:
        """Row i of this list is near row j of ``words``."""
        np.add.at(self.count, i, 1)
        for a, b in zip(i.tolist(), j.tolist()):
            one = (-int(n[b]), words[b])
            if a not in self.best or one < self.best[a]:
                self.best[a] = one

    def batch(self):
        import pyarrow as pa
        at = np.flatnonzero(self.count)
        best = [self.best[a] for a in at.tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.words[a].decode("latin-1") for a in at.tolist()], pa.string()), pa.array(self.count[at]),
             pa.array([n for n, _ in best], pa.int64()), pa.array([w.decode("latin-1") for _, w in best], pa.string())],
            ["word", "near", "less_n", "best"])


def compare_chunks(parts) -> Iterator:
    """Near words of every chunk, from rows sorted by block, chunk and ``visits``: its own words come first."""
    key, own, n, counts, best = None, [], np.zeros(0, np.int64), None, None
    kept: list[np.ndarray] = []

    def compare_own():
        nonlocal counts, best, n
        n, counts, best = np.concatenate(kept), letter_counts(own), Best(own)
        for at in range(0, len(own), STEP):
            i, j = near_pairs(own[at:at + STEP], counts[at:at + STEP], own[at:], counts[at:], True)
            best.add(at + i, at + j, own, n)
            best.add(at + j, at + i, own, n)

    for b in parts:
        blocks, chunks, visits = b.column("block").to_pylist(), b.column("chunk").to_numpy(), b.column("visits").to_numpy()
        words, counted = b.column("word").to_pylist(), b.column("n").to_numpy()
        change = [0, *(k for k in range(1, len(words)) if blocks[k] != blocks[k - 1] or chunks[k] != chunks[k - 1]
                       or visits[k] != visits[k - 1]), len(words)]
        for lo, hi in zip(change, change[1:]):
            if lo == hi:
                continue
            if (here := (blocks[lo], int(chunks[lo]))) != key:
                if own and best is None:
                    compare_own()
                if best is not None:
                    yield best.batch()
                key, own, kept, best = here, [], [], None
            if visits[lo] == 0:
                own += words[lo:hi]
                kept.append(counted[lo:hi])
                continue
            if not own:  # visits to a block without words of its own
                continue
            if best is None:
                compare_own()
            # visitors of the block's length and shorter ones apart
            for size in sorted({len(w) for w in words[lo:hi]}):
                some = [k for k in range(lo, hi) if len(words[k]) == size]
                step = max(1, STEP * WIDTH // max(size, WIDTH))
                for at in range(0, len(some), step):
                    rows = some[at:at + step]
                    theirs, theirs_n = [words[k] for k in rows], counted[rows]
                    i, j = near_pairs(own, counts, theirs, letter_counts(theirs), False)
                    best.add(i, j, theirs, theirs_n)
                    guest = Best(theirs)
                    guest.add(j, i, own, n)
                    yield guest.batch()
    if own and best is None:
        compare_own()
    if best is not None:
        yield best.batch()


def near_words(vocab: DataFrame) -> DataFrame:
    """Partial results per word, ``word, near, less_n, best``: near words found, and -n and name of the best."""
    def letters_used(parts):
        import pyarrow as pa
        total, lengths = np.zeros(len(LETTERS), np.int64), Counter()
        for b in parts:
            words = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            if words:
                total += letter_counts(words).sum(0)
                lengths.update(map(len, words))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(LETTERS)), *[-k for k in lengths]], pa.int64()),
                                          pa.array([*total.tolist(), *lengths.values()], pa.int64())], ["k", "n"])

    # a row per letter, and one per length (as its negative)
    found = {r.k: r.n for r in vocab.mapInArrow(letters_used, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    groups = groups_wanted({-k: n for k, n in found.items() if k < 0})
    of = groups_of(np.array([found.get(i, 0) for i in range(len(LETTERS))]), groups)
    rows = vocab.mapInArrow(placed(of, groups), "block binary, visits int, width long, word binary, n long")
    size = F.count(F.lit(1)) * F.ceil(F.max("width") / WIDTH)
    cut = written(rows.where("visits = 0").groupBy("block").agg(F.ceil(size / MOST_WORDS).cast("int").alias("chunks"))
                  .where("chunks > 1"), "cut-blocks")
    if cut.count() <= MOST_CUT:  # one in MOST_WORDS words at most
        cut = F.broadcast(cut)
    own = F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int")
    # a word goes to its chunk, and as a visitor to the earlier ones of its block or to all of another
    rows = rows.join(cut, "block", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
    to = F.when(F.col("visits") == 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.sequence(F.lit(0), F.col("own")))
    rows = rows.select("block", "visits", "word", "n", "own", F.explode(to).alias("chunk"))
    rows = rows.select("block", "chunk", F.when(F.col("chunk") < F.col("own"), 1).when(F.col("visits") == 0, 0).otherwise(1).alias("visits"),
                       "word", "n")
    return (rows.repartition(shuffle_width(vocab.sparkSession), "block", "chunk").sortWithinPartitions("block", "chunk", "visits")
            .mapInArrow(compare_chunks, "word string, near long, less_n long, best string"))


# --- forms and roots --------------------------------------------------------------------
def spelling_groups(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every compared word of ``docs(doc_id, text)``."""
    vocab = written(vocabulary(docs), "vocabulary")
    found = near_words(vocab).select("word", F.lit(None).cast("long").alias("n"), "near", F.struct("less_n", "best").alias("best"))
    none = vocab.select("word", "n", F.lit(0).cast("long").alias("near"),
                        F.lit(None).cast("struct<less_n: bigint, best: string>").alias("best"))
    words = none.unionByName(found).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less_n") >= FORM_TIMES * F.col("n")
    words = written(words.select("word", "n", "n_near", F.when(is_form, F.col("best.best")).alias("form"),
                                 F.when(is_form, -F.col("best.less_n")).alias("form_n")), "forms")
    most = words.agg(F.max("form_n")).first()[0] or 0
    depth = len(str(most))  # a chain of forms has no more steps
    roots = words.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(depth - 1, 0).bit_length()):
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = written(roots.join(further, F.col("root") == F.col("at"), "left")
                        .select("word", F.coalesce("next", "root").alias("root")), "roots")
    return words.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op12: every word of ``documents``."""
    return spelling_groups(docs)
