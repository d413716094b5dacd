"""Document fingerprints: SimHash, and permuted block tables to find near ones.

A text's terms are its word pairs (a word is a run without blanks; the last
word is a term alone).  Each term's two 64-bit hashes vote on 128 signed
bits with the term's weight: the letters of its words, 16 at most, times
its count.  Bit ``k`` is set if the weight of terms with the bit is over
half.  The votes of bits ``k`` and ``k + 32`` are summed in one long (two
32-bit counters), so a text takes 64 sums.

``near_pairs`` finds all pairs of distinct fingerprints within a Hamming
radius: the bits are cut into blocks, and one table for each choice of
``blocks - radius`` blocks is keyed by these blocks' bits, permuted to the
front; two fingerprints within the radius agree on at least one key.

``edited_likeness`` also needs each document's successor in ``doc_id``
order.  Buckets of neighbouring ids are cut at quantiles of ``doc_id``; each
bucket gets a copy of the next bucket's first rows, so the successor is
found inside the bucket with one exchange of the texts.

DataFrame functions only.  Defined results: null text is the empty text,
whose fingerprint is all zeros; null ``doc_id`` sorts first; rows with equal
``doc_id`` are ordered by their text and kept each; a single row is its own
successor; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS = 128
HEX = BITS // 4
MOST_WEIGHT = 16
BLANKS = r"[ \t-\r]+"
#: Rows of a bucket of neighbouring ids, and the most buckets (then they hold more rows).
BUCKET_ROWS, MOST_BUCKETS = 512, 65_536
_PAIR = 0x0000000100000001


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def fingerprints(texts: DataFrame, keys: list[str], words_column: str = "words") -> DataFrame:
    """``keys`` and ``fingerprint`` (hex) of each row of ``texts``; ``keys`` tell the rows apart.

    The word lists are exploded and summed up again by ``keys``; sums
    combine before any exchange, and there is none if the rows are already
    partitioned by some of the keys.
    """
    w = F.col(words_column)
    # the successor list is one short, so the last word is a term alone
    rows = texts.select(*keys, F.explode_outer(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))).alias("t"))
    rows = rows.select(*keys, "t.a", "t.b")
    rows = rows.select(*keys, F.xxhash64("a", "b").alias("h0"), F.xxhash64(F.lit(1), "a", "b").alias("h1"),
                       F.least(F.length(F.coalesce("a", F.lit(""))) + F.length(F.coalesce("b", F.lit(""))), F.lit(MOST_WEIGHT)).cast("long").alias("w"))
    votes = [F.sum(F.shiftright(f"h{x}", k).bitwiseAND(F.lit(_PAIR)) * F.col("w")).alias(f"v{x}_{k}")
             for x in range(2) for k in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("all"), *votes)

    def half(x: int, upper: bool) -> Column:
        out = F.lit(0).cast("long")
        for k in range(32):
            v = F.col(f"v{x}_{k}")
            ones = F.shiftrightunsigned(v, 32) if upper else v.bitwiseAND(F.lit(0xFFFFFFFF))
            out = out.bitwiseOR(F.when(2 * ones > F.col("all"), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return F.lpad(F.lower(F.hex(out)), 8, "0")

    return sums.select(*keys, F.concat(half(0, True), half(0, False), half(1, True), half(1, False)).alias("fingerprint"))


def _long(fingerprint: Column, part: int) -> Column:
    """16 hex digits as a long (two's complement)."""
    hi = F.conv(F.substring(fingerprint, 16 * part + 1, 8), 16, 10).cast("long")
    lo = F.conv(F.substring(fingerprint, 16 * part + 9, 8), 16, 10).cast("long")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(_long(a, p).bitwiseXOR(_long(b, p))) for p in range(1, BITS // 64)),
               F.bit_count(_long(a, 0).bitwiseXOR(_long(b, 0))))


def likeness(a: Column, b: Column) -> Column:
    """The weighted cosine similarity that the distance estimates, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.cos(hamming(a, b) * F.pi() / BITS)))


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All links within ``radius``, as pairs of classes, and the classes.

    ``prints(doc_id, fingerprint)``.  Rows with one fingerprint are one class,
    named by its smallest ``doc_id``.  Returns ``(pairs(fingerprint, other,
    distance), members(doc_id, fingerprint, class_id))``; pairs of equal
    fingerprints are implied by the classes and not written out.
    """
    blocks = blocks or radius + 3
    cuts = [HEX * i // blocks for i in range(blocks + 1)]
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    tables = list(combinations(range(blocks), blocks - radius))
    key = [F.concat(F.lit(f"{i}:"), *[F.substring("fingerprint", cuts[b] + 1, cuts[b + 1] - cuts[b]) for b in chosen])
           for i, chosen in enumerate(tables)]
    keyed = classes.select("fingerprint", F.explode(F.array(*key)).alias("block"))
    other = keyed.withColumnRenamed("fingerprint", "other")
    near = hamming(F.col("fingerprint"), F.col("other"))
    pairs = (keyed.join(other, "block").where((F.col("fingerprint") < F.col("other")) & (near <= radius))
             .select("fingerprint", "other", near.alias("distance")).distinct())
    return pairs, prints.join(classes, "fingerprint")


def id_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[Column, int]:
    """A column with the bucket of ``doc_id``, cut at its quantiles; null is in bucket 0."""
    rows = docs.agg(F.count("doc_id")).first()[0]
    n = min(max(1, -(-rows // bucket_rows)), MOST_BUCKETS)
    cuts = []
    if n > 1:
        shares = [i / n for i in range(1, n)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * n))).first()[0]))
    if not cuts:
        return F.lit(0), 1
    # binary search: as many cuts as are at most doc_id
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(F.lit(cuts), at + step - 1) <= F.col("doc_id"), F.lit(False)), at + step).otherwise(at))
    return found, len(cuts) + 1


def edited_likeness(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, for ``docs(doc_id, text)``.

    The edited text ends with the start of the next document's text instead
    of its own last quarter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucket, _ = id_buckets(rows, bucket_rows)
    rows = rows.withColumn("bucket", bucket)
    # one row per bucket, at most MOST_BUCKETS
    nulls = F.count(F.when(F.col("doc_id").isNull(), 1))
    firsts = sorted((r.bucket, None if r.nulls else r.first) for r in rows.groupBy("bucket").agg(
        nulls.alias("nulls"), F.min("doc_id").alias("first")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "first long, before int")
    sent = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first"))).select(
        "doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("copy"))
    both = rows.withColumn("copy", F.lit(0)).unionByName(sent)

    order = Window.partitionBy("bucket").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    chars = F.length("text")
    cut = F.floor(chars / 4).cast("int")
    near = both.select("bucket", "copy", "doc_id", "text", F.row_number().over(order).alias("place"),
                       F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))
    near = near.select("bucket", "copy", "doc_id", "place", "text", chars.cast("long").alias("n_chars"),
                       F.concat(F.substring("text", F.lit(1), chars - cut), F.substring("next", F.lit(1), cut)).alias("edited"))
    near = near.select("bucket", "copy", "doc_id", "place", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.posexplode(F.array(words(F.col("text")), words(F.col("edited")))).alias("kind", "words"))
    keys = ["bucket", "copy", "place", "doc_id", "n_chars", "edited_sha256"]
    prints = fingerprints(near, [*keys, "kind"]).groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    by_place = Window.partitionBy("bucket").orderBy("place")
    prints = prints.withColumn("next", F.lead("fingerprint").over(by_place)).where(F.col("copy") == 0)
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))


def simhash_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op7: every document."""
    return edited_likeness(docs)
