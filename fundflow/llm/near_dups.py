"""MinHash near-duplicates: BagMinHash signatures, banding, exact multiset overlap.

Texts are multisets of five-word shingles (a word is a run without white
space; a text of one to four words is one shingle); two are near duplicates
if their weighted Jaccard similarity (sum of minima / sum of maxima of the
counts) is at least THRESHOLD.

Signatures.  Weights are cut at the powers of two: (0, 1], (1, 2], (2, 4],
...  Every (shingle, interval) has its own Poisson process, whose points
have a time, a register and a place in the interval; a shingle of count w
takes the intervals below w whole and of the last one the points at places
up to w (the process splits there).  A register's value is the time of its
first point.  The process depends on the shingle alone, so registers of two
texts agree with the probability of their weighted Jaccard similarity.
Only points up to a time of about log(registers) / (total count) are drawn;
a text with an empty register is drawn again up to a later time, so the
minimum is exact.

Links.  Equal texts are one class, and only the first text of a class goes
on.  Texts that agree on a whole band meet in a bucket.  Round one compares
each with its bucket's first text; linked texts form components.  Round two
takes the buckets that still hold several components.  Texts that such
buckets connect form a group; a group's texts are compared in one place,
chunk against chunk, and each text travels once (and once more for every
earlier chunk of a large group).  Within a task two texts are compared if
two bits of each of SKETCHED registers agree often enough (``sketch_least``)
and no link found so far joins their components.  Pairs are formed in memory
only; what leaves a task are links, fewer than its texts.  No link between
two components of a bucket is lost, and every link is verified on the whole
texts.

Bands, rows and the sketch's bound come from the threshold: a pair at the
threshold shares no band with a probability of MISS at most, and agrees less
in the sketch with one of MISS at most.  At 0.8 these are BANDS bands of ROWS
registers; a lower threshold takes more.

Defined results: null or wordless texts are linked to equal texts only; a
null ``doc_id`` is smaller than every other; repeated rows are copies; ties
of the smallest ``doc_id`` in a class go to one row; an empty table gives
no rows; other columns are ignored.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import NULL_ID, block_of, block_texts, by_block, select_rows, write_blocks
from .common import remembers, shuffle_width, works_for, written

WORDS, THRESHOLD = 5, 0.8
#: Bands at least, registers of a band at most; the probability that a pair at the threshold shares no band,
#: or agrees too little in the sketch; registers from which on bands get fewer rows.
BANDS, ROWS, MISS, MANY_REGISTERS = 32, 4, 5e-8, 1024
SKETCHED = 128
SKETCH = [f"s{k}" for k in range(4)]
#: Text bytes signed at once, remembered word hashes per Python worker.
CHUNK_BYTES, WORDS_KEPT = 4_000_000, 500_000
#: Texts of a chunk in round two (a text counts once more for every ROW_CHARS characters), and of a step.
CHUNK_ROWS, ROW_CHARS, COMPARED = 4096, 4096, 512


def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows for a threshold: the most rows (ROWS at most) that don't need too many registers."""
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold of {threshold} isn't above 0 and at most 1")
    for rows in range(ROWS, 0, -1):
        agree = threshold ** rows
        bands = max(BANDS * ROWS // rows, 1 if agree == 1 else math.ceil(math.log(MISS) / math.log1p(-agree)))
        if bands * rows <= MANY_REGISTERS:
            break
    return bands, rows


def sketch_least(threshold: float) -> int:
    """Registers of the sketch that must agree: similarity 0.8 gives 109 of 128 in the mean, unrelated texts 32."""
    p = threshold + (1 - threshold) / 4
    least, tail = 0, (1 - p) ** SKETCHED
    while tail <= MISS and least < SKETCHED:
        least += 1
        tail += math.comb(SKETCHED, least) * p ** least * (1 - p) ** (SKETCHED - least)
    return least


_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _A
    x = (x ^ x >> np.uint64(29)) * _B
    return x ^ x >> np.uint64(32)


_HASHES: dict[str, int] = {}
remembers("near duplicates", _HASHES.clear)


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash
    known = _HASHES
    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles of each text."""
    split = [t.split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    words = word_hashes([w for s in split for w in s])
    first = np.concatenate([[0], np.cumsum(sizes)])
    made = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    text = np.repeat(np.arange(len(texts)), made)
    at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)
    width = np.minimum(sizes, WORDS)[text]
    value = np.zeros(len(text), np.uint64)
    for k in range(WORDS):
        inside = k < width
        word = words[np.minimum(at + k, len(words) - 1)] if len(words) else value
        value = np.where(inside, _mix(value * _C + word + np.uint64(k + 1)), value)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def bag_minhash(text: np.ndarray, value: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Signatures (texts x registers, times of first points; inf for a text without shingles)."""
    out = np.full((texts, registers), np.inf)
    total = np.bincount(text, weights=count, minlength=texts)
    todo = total > 0
    reach = np.log(registers) + 4.0
    # intervals: 0 is (0, 1], k is (2^(k-1), 2^k]
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))), 0).astype(np.int64)
    of = np.repeat(np.arange(len(text)), top + 1)
    level = np.arange(len(of)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    size = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, size, 0.0)
    seed = _mix(value[of] + level.astype(np.uint64) * _C)
    owner, most = text[of], count[of].astype(float)
    while todo.any():
        until = reach / np.maximum(total, 1)
        pick = np.flatnonzero(todo[owner])
        time = np.zeros(len(pick))
        step = 0
        while len(pick):
            h = _mix(seed[pick] + np.uint64((2 * step + 1) * int(_A) & (1 << 64) - 1))
            time = time - np.log(((h >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52) / (registers * size[pick])
            alive = time <= until[owner[pick]]
            pick, time, h = pick[alive], time[alive], h[alive]
            g = _mix(h + _B)
            place = low[pick] + size[pick] * ((g >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52
            inside = place <= most[pick]
            register = (g % np.uint64(4096 * registers) // np.uint64(4096)).astype(np.int64)
            np.minimum.at(out, (owner[pick][inside], register[inside]), time[inside])
            step += 1
        todo &= np.isinf(out).any(1)
        reach *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; equal if the band's registers are."""
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, bits.shape[:2]).copy()
    for k in range(rows):
        key = _mix(key * _B + bits[:, :, k])
    return key.view(np.int64)


def sketches(signatures: np.ndarray) -> list[np.ndarray]:
    """Four longs per text: two bits of each of 128 registers."""
    mixed = _mix(signatures.view(np.uint64).copy())
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [(((mixed[:, at:at + 64] >> np.uint64(bit)) & np.uint64(1)) * weights).sum(1, dtype=np.uint64).view(np.int64)
            for at in (0, 64) for bit in (0, 1)]


def sign(bands: int, rows: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """``row, id, one, two`` (the text's hash), the band keys and the sketch; a text's copies in a task come without keys."""
        import xxhash
        works_for("near duplicates")
        seen: set[tuple[int, int]] = set()
        for pdf in parts:
            texts = pdf["text"].tolist()
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            two = [xxhash.xxh3_128_intdigest(r) for r in raw]
            hashes = [((h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)) for h in two]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(raw[j]) <= CHUNK_BYTES):
                    size += len(raw[j])
                    j += 1
                fresh = []
                for k in range(i, j):
                    if hashes[k] not in seen:
                        seen.add(hashes[k])
                        fresh.append(k)
                keys: list = [None] * (j - i)
                sketch = np.zeros((4, j - i), np.int64)
                if fresh:
                    text, value, count = shingle_counts([texts[k] for k in fresh])
                    signatures = bag_minhash(text, value, count, len(fresh), bands * rows)
                    for k, own, some in zip(fresh, band_keys(signatures, bands, rows), np.isfinite(signatures[:, 0])):
                        keys[k - i] = own if some else np.zeros(0, np.int64)
                    sketch[:, np.array(fresh) - i] = sketches(signatures)
                yield pd.DataFrame({"row": pdf["row"].iloc[i:j].array, "id": pdf["id"].iloc[i:j].array,
                                    "one": [hashes[k][0] for k in range(i, j)], "two": [hashes[k][1] for k in range(i, j)],
                                    "bands": keys} | dict(zip(SKETCH, sketch)))
                i = j
    return run


def shingles(text: str) -> Counter:
    words = text.split()
    if len(words) < WORDS:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(WORDS))))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if len(a) > len(b):
        a, b = b, a
    get = b.get
    both = sum(min(n, get(s, 0)) for s, n in a.items())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def verify(threshold: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, Counter()
        for pdf in parts:
            out = []
            for a, b, text, other in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["text"], pdf["other"]):
                if b != last:
                    last, held = b, shingles(other)
                out.append((a, b, similarity(shingles(text), held)))
            made = pd.DataFrame(out, columns=["a", "b", "similarity"])
            yield made[made["similarity"] >= threshold]
    return run


def _fetch(paths: dict[int, str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, own in by_block(parts):
            wanted = np.sort(own["row"].to_numpy())
            for numbers, _, texts in block_texts(paths[block]):
                at = np.flatnonzero(np.isin(numbers, wanted, assume_unique=True))
                if len(at):
                    yield pd.DataFrame({"row": numbers[at], "text": [texts[k].decode("utf-8", "surrogatepass") for k in at]})
    return run


def links_of(pairs: DataFrame, paths: dict[int, str], threshold: float) -> DataFrame:
    """``a, b, similarity`` of the distinct ``pairs(a, b)`` that reach the threshold, on whole texts."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().withColumn("block", block_of())
    texts = written(needed.repartitionByRange(max(len(paths), 1), "block").sortWithinPartitions("block")
                    .mapInPandas(_fetch(paths), "row long, text string"), "pair-texts")
    left = texts.select(F.col("row").alias("a"), "text")
    right = texts.select(F.col("row").alias("b"), F.col("text").alias("other"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "text", "other")
                   .mapInPandas(verify(threshold), "a long, b long, similarity double"), "links")


class Sets:
    """Multisets of shingles as sets of numbers: a shingle's k-th occurrence has a number of its own."""

    def __init__(self):
        self.numbers: dict = {}

    def own(self, text: str) -> tuple[set[int], int]:
        """A text's numbers and their count."""
        number, out = self.numbers.setdefault, set()
        for s, n in shingles(text).items():
            for k in range(n):
                out.add(number((s, k), len(self.numbers)))
        return out, len(out)

    def guest(self, text: str) -> tuple[set[int], int]:
        """The numbers that are known already (others are in no intersection), and the count of all."""
        number, found, total = self.numbers.get, set(), 0
        for s, n in shingles(text).items():
            total += n
            found.update(x for k in range(n) if (x := number((s, k))) is not None)
        return found, total


class Joined:
    """Components joined so far in a task, by their labels."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def compare_group(threshold: float):
    """Links between components, from rows sorted by group, chunk and ``visits`` (a chunk's own rows come first).

    Texts whose sketches agree enough are compared, the most alike first,
    unless links found before join their components already; only links
    leave the task.
    """
    least = sketch_least(threshold)

    def pairs(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows whose sketches agree enough, most alike first."""
        differ = sum(np.bitwise_count((own[:, None, k] ^ other[None, :, k]) | (own[:, None, k + 1] ^ other[None, :, k + 1])).astype(np.int16)
                     for k in (0, 2))
        i, j = np.nonzero(differ <= SKETCHED - least)
        order = np.argsort(differ[i, j], kind="stable")
        return i[order], j[order]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries(some: pd.DataFrame, sets) -> list[tuple]:
            return list(zip(some["component"].tolist(), map(sets, some["text"])))

        def bits(some: pd.DataFrame) -> np.ndarray:
            return some[SKETCH].to_numpy(np.int64).view(np.uint64)

        def links(i, j, these, those):
            out = []
            for x, y in zip(i.tolist(), j.tolist()):
                (label, (left, n)), (other, (right, m)) = these[x], those[y]
                if joined.find(label) != joined.find(other):
                    both = len(left & right)
                    if both >= threshold * (n + m - both):
                        joined.join(label, other)
                        out.append((max(label, other), min(label, other)))
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        key, joined, sets, held, marks = None, Joined(), Sets(), [], np.zeros((0, 4), np.uint64)
        for pdf in parts:
            for at in range(0, len(pdf), COMPARED):
                for part, now in pdf.iloc[at:at + COMPARED].groupby("key", sort=False):
                    if part != key:
                        key, joined, sets, held, marks = part, Joined(), Sets(), [], np.zeros((0, 4), np.uint64)
                    mine, guests = now[now["visits"] == 0], now[now["visits"] == 1]
                    if len(mine):
                        new, own = entries(mine, sets.own), bits(mine)
                        yield links(*pairs(marks, own), held, new)
                        i, j = pairs(own, own)
                        yield links(i[i < j], j[i < j], new, new)
                        held += new
                        marks = np.vstack([marks, own])
                    if len(guests):
                        yield links(*pairs(marks, bits(guests)), held, entries(guests, sets.guest))
    return run


def group_links(rows: DataFrame, paths: dict[int, str], threshold: float) -> DataFrame:
    """``a, b``: components of ``rows(row, group, component, sketch)`` that a link joins, on whole texts.

    A group is cut into chunks of CHUNK_ROWS texts (long ones count for
    more); a text goes to its own chunk and visits the earlier ones.
    """
    needed = rows.select("row", block_of().alias("block"))
    texts = written(needed.repartitionByRange(max(len(paths), 1), "block").sortWithinPartitions("block")
                    .mapInPandas(_fetch(paths), "row long, text string"), "group-texts")
    full = rows.join(texts, "row")
    size = F.sum(1 + F.length("text") / ROW_CHARS)
    chunks = full.groupBy("group").agg(F.ceil(size / CHUNK_ROWS).cast("int").alias("chunks"))
    full = full.join(chunks, "group").withColumn("own", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    full = full.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("own"))))
    full = full.select("row", "component", *SKETCH, "text", (F.col("chunk") < F.col("own")).cast("int").alias("visits"),
                       F.concat_ws("/", "group", "chunk").alias("key"))
    return written(full.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "visits")
                   .mapInPandas(compare_group(threshold), "a long, b long"), "group-links")


def components(links: DataFrame) -> DataFrame:
    """``row, component`` (its smallest row) of every row in ``links(a, b)``.

    Each round every row takes the smallest label of its neighbours and then
    its label's label; labels are written after each round, so lineage stays
    short, and the rounds grow with the logarithm of a component's length.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).toDF("row", "other").distinct(), "edges")
    labels = written(edges.groupBy("row").agg(F.min("other").alias("least"))
                     .select("row", F.least("row", "least").alias("component")), "labels")
    while True:
        named = labels.select(F.col("row").alias("other"), F.col("component").alias("label"))
        near = edges.join(named, "other").groupBy("row").agg(F.min("label").alias("label"))
        moved = labels.join(near, "row").select("row", F.col("component").alias("was"),
                                                F.least("component", "label").alias("component"))
        jump = labels.select(F.col("row").alias("component"), F.col("component").alias("beyond"))
        new = written(moved.join(jump, "component").select(
            "row", "was", F.least("component", "beyond").alias("component")), "labels")
        labels = new.select("row", "component")
        if not new.where("was <> component").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, keep: list[str] = ()) -> tuple[DataFrame, dict[int, str]]:
    """``(classes, paths)`` of ``docs(doc_id, text)``.

    Classes: ``row, doc_id, class_id`` (the smallest ``doc_id`` of the
    class), ``class_size``, ``kept`` (one row of each class).  A text's links
    aren't counted: pairs inside a component are never compared.  Paths: the
    files of the blocks that hold the rows, with the columns ``keep``.
    """
    blocks, paths = write_blocks(docs, keep)
    signed = written(blocks.select("row", "id", "text").mapInPandas(
        sign(*banding(threshold)), "row long, id long, one long, two long, bands array<long>, s0 long, s1 long, s2 long, s3 long"), "signatures")
    # equal texts: their first row that has keys stands for them
    same = signed.groupBy("one", "two").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("row"))).alias("text_row"))
    members = written(signed.select("row", "id", "one", "two").join(same, ["one", "two"]).select("row", "id", "text_row"), "members")
    first = signed.where("bands is not null").join(same, (signed.one == same.one) & (signed.two == same.two)
                                                   & (F.col("row") == F.col("text_row")), "left_semi")
    banded = first.select("row", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("row").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(banded.join(hubs.select("bucket", "hub"), "bucket"), "buckets")
    pairs = written(shared.where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    links = links_of(pairs, paths, threshold)
    found = components(links)

    # buckets that still hold several components
    placed = written(shared.join(found, "row", "left").select(
        "bucket", "row", F.coalesce("component", "row").alias("component")), "placed")
    split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = written(placed.join(split.where("lo <> hi").select("bucket", "lo"), "bucket"), "mixed")
    met = mixed.where("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct()
    joined = None
    if met.limit(1).count():
        # components that mixed buckets connect are a group
        groups = components(met).select(F.col("row").alias("label"), F.col("component").alias("group"))
        rows = mixed.select("row", "component").distinct().join(groups, F.col("component") == F.col("label"))
        more = group_links(rows.join(first.select("row", *SKETCH), "row"), paths, threshold)
        if more.limit(1).count():
            joined = components(more).select(F.col("row").alias("label"), F.col("component").alias("joined"))

    placed = members.join(found.withColumnRenamed("row", "text_row"), "text_row", "left").select(
        "row", "id", "text_row", F.coalesce("component", "text_row").alias("component"))
    if joined is not None:
        placed = placed.join(joined, F.col("component") == F.col("label"), "left").select(
            "row", "id", "text_row", F.coalesce("joined", "component").alias("component"))
    totals = placed.groupBy("component").agg(F.min(F.struct("id", "row")).alias("least"), F.count(F.lit(1)).alias("class_size"))

    def real(c):
        return F.when(F.col(c) != NULL_ID, F.col(c))

    classes = placed.join(totals, "component").select(
        "row", real("id").alias("doc_id"), real("least.id").alias("class_id"), "class_size",
        (F.col("row") == F.col("least.row")).alias("kept"))
    return classes, paths


def first_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class of near duplicates, with all its columns."""
    classes, paths = near_duplicates(docs, threshold, [c for c in docs.columns if c != "text"])
    return select_rows(docs, classes.where("kept").select("row"), paths)


def near_duplicates_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op10: every document."""
    return near_duplicates(docs)[0].drop("row")
