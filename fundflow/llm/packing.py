"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' token ids in ``doc_id`` order.
Windows of ``length`` tokens are filled so that each source gets its share
of the tokens: a source earns its share of every window as credit and is
served, in rotation, while its credit covers a piece; what it is owed (or
has borrowed) is carried to the next window.

It scales in two levels.  The token line is cut into blocks of
``block_windows`` full windows.  Block ``b`` gets, of the source whose
tokens lie between the shares ``lo`` and ``hi`` of all tokens (sources in
order), ``(floor(e*hi) - floor(e*lo))`` at ``e`` = tokens up to the block's
end, less the same at its start: the deficit a source carries from block to
block stays below one token, all blocks but the last are exactly full, and
no block needs to know another.  Inside a block the rotation runs on at
most ``block_windows * length`` tokens.  Only the last window of all can
need padding.

``weights`` (source -> weight) skews the order in which sources are used up
inside every block only; all tokens are always packed.

Defined results: null text is the empty text (its end id alone); a null
source is a queue of its own; rows with equal ``doc_id`` are packed each;
an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import shuffle_width, written

LENGTH = 2048
BLOCK_WINDOWS = 512
#: A source is served when its credit covers this many tokens (or its rest).
LEAST_PIECE = 256

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, source string, ids binary")


def encode_queues(docs: DataFrame, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """``(part, source, doc_id, ids, n, at)``: ids per document, ``at`` its place in its source's run of the part.

    Range-partitioned on (source, doc_id), so a hot source is cut across
    parts; written once, so the parts stay as they are.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_width(spark)
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first()]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("text").cast("string").alias("text"))
            .repartitionByRange(n, *order).sortWithinPartitions(*order, "text"))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc = T.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        source, at = object(), 0
        for pdf in parts:
            texts = pdf["text"].tolist()
            rows = list(zip(pdf["doc_id"].tolist(), pdf["source"].tolist(), texts))
            for cut in T.batches(rows, [len(t or "") for t in texts]):
                out = []
                for (doc, src, _), ids in zip(cut, enc.encode(t for *_, t in cut)):
                    if src != source:
                        source, at = src, 0
                    ids += end
                    n_ids = len(ids) // enc.dtype.itemsize
                    out.append((part, src, None if pd.isna(doc) else int(doc), ids, n_ids, at))
                    at += n_ids
                made = pd.DataFrame(out, columns=["part", "source", "doc_id", "ids", "n", "at"])
                yield made.astype({"doc_id": "Int64"})

    return written(rows.mapInPandas(
        encode, "part long, source string, doc_id long, ids binary, n long, at long"), "queues")


def queue_places(queues: DataFrame) -> DataFrame:
    """Per (part, source): tokens of the source in earlier parts, its total, and all sources' tokens before it."""
    runs = queues.groupBy("part", "source").agg(F.sum("n").alias("n"))
    runs = runs.withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    of = Window.partitionBy("queue")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                       F.sum("n").over(of).alias("total"))
    runs = written(runs, "queue-runs")
    # one row per source
    sums = runs.groupBy("queue").agg(F.max("total").alias("t"))
    sums = sums.select("queue", (F.sum("t").over(Window.orderBy("queue")) - F.col("t")).alias("ahead"))
    return written(runs.join(sums, "queue"), "queue-places")


def cut_blocks(queues: DataFrame, places: DataFrame, total: int, block: int, width: int) -> DataFrame:
    """One row per document and block that it reaches into: ``block, source, at, doc_id, start, ids, n``."""
    keyed = queues.withColumn("queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    joined = keyed.join(places, ["part", "queue"]).select(
        "source", "doc_id", "ids", "n", (F.col("base") + F.col("at")).alias("place"), F.col("total").alias("of"), "ahead")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            cols = [pdf[c].tolist() for c in ("source", "doc_id", "ids", "n", "place", "of", "ahead")]
            for src, doc, ids, n, place, of, ahead in zip(*cols):
                def upto(b):  # tokens of this source in blocks before b
                    e = min(b * block, total)
                    return e * (ahead + of) // total - e * ahead // total
                b = place * total // (of * block)
                while b and upto(b) > place:
                    b -= 1
                while upto(b + 1) <= place:
                    b += 1
                done = 0
                while done < n:
                    first, last = upto(b), upto(b + 1)
                    take = min(n - done, last - place - done)
                    if take > 0:
                        out.append((b, src, place + done - first, doc, done, ids[done * width:(done + take) * width], n))
                        done += take
                    b += 1
            made = pd.DataFrame(out, columns=["block", "source", "at", "doc_id", "start", "ids", "doc_tokens"])
            yield made.astype({"doc_id": "Int64"})

    return joined.mapInPandas(
        cut, "block long, source string, at long, doc_id long, start long, ids binary, doc_tokens long")


def fill_windows(queues: list[list[tuple]], width: int, length: int = LENGTH, least: int = LEAST_PIECE,
                 weights: list[float] | None = None) -> Iterator[tuple]:
    """Deficit round-robin: yields ``(queue, entry, first, count, window, offset)``.

    ``queues`` holds per source its entries ``(n, ...)``; ``first`` and
    ``count`` are a piece's place in the entry.
    """
    left = [sum(e[0] for e in q) for q in queues]
    total = sum(left)
    share = weights or left
    scale = sum(share) or 1
    earn = [length * s / scale for s in share]
    credit = [0.0] * len(queues)
    head = [[0, 0] for _ in queues]
    turn = window = 0
    while total:
        space, offset = min(length, total), 0
        for k, r in enumerate(left):
            credit[k] = credit[k] + earn[k] if r else 0.0
        idle = 0
        while space:
            if idle < len(queues):
                k, turn = turn, (turn + 1) % len(queues)
                due = min(int(credit[k] + 1e-6), left[k])
                if due < least and due < left[k] or due <= 0:
                    idle += 1
                    continue
                idle = 0
            else:  # nobody is owed a piece: the largest credit borrows
                k = max((j for j, r in enumerate(left) if r), key=lambda j: credit[j])
                due = min(max(least, int(credit[k])), left[k])
            due = min(due, space)
            credit[k] -= due
            left[k] -= due
            total -= due
            space -= due
            while due:
                entry, first = head[k]
                take = min(due, queues[k][entry][0] - first)
                yield k, entry, first, take, window, offset
                offset += take
                due -= take
                head[k] = [entry, first + take] if first + take < queues[k][entry][0] else [entry + 1, 0]
        window += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, block_windows: int = BLOCK_WINDOWS,
         weights: dict | None = None, with_ids: bool = True, partitions: int | None = None) -> DataFrame:
    """Packs ``docs(doc_id, source, text)``: one row per piece, ``PIECE`` columns.

    ``sequence_id`` counts windows over all blocks; ``offset`` is gapless
    from 0 in each.  ``ids`` (little-endian, the tokenizer's narrowest
    width) is null unless ``with_ids``.
    """
    width = T.encoder(tokenizer).dtype.itemsize
    queues = encode_queues(docs, tokenizer, end_id, partitions)
    places = queue_places(queues)
    total = queues.agg(F.sum("n")).first()[0] or 0
    if not total:
        return docs.sparkSession.createDataFrame([], PIECE)
    blocks = cut_blocks(queues, places, total, block_windows * length, width)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable")
        groups = {}
        for src, *row in zip(*(pdf[c].tolist() for c in ("source", "doc_id", "start", "ids", "doc_tokens"))):
            groups.setdefault(src, []).append((len(row[2]) // width, *row))
        names = sorted(groups, key=lambda s: (s is not None, s or ""))
        share = [float(weights.get(s, 1.0)) for s in names] if weights else None
        lists = [groups[s] for s in names]
        out = []
        for k, entry, first, take, window, offset in fill_windows(lists, width, length, weights=share):
            _, doc, start, ids, doc_tokens = lists[k][entry]
            ids = ids[first * width:(first + take) * width]
            crc = zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4"))
            out.append((doc, start + first, take, crc, doc_tokens, key[0] * block_windows + window, offset,
                        names[k], ids if with_ids else None))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])
        return made.astype({"doc_id": "Int64"})

    return blocks.groupBy("block").applyInPandas(fill, PIECE)


def packing_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op6: all documents, end id 1, sequences of 2048."""
    return pack(docs, T.tokenizer_path(), end_id=1, with_ids=False).drop("ids")
