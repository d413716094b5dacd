"""Texts written once as blocks, so later steps fetch a block's texts without shuffling them.

A block is one Parquet file of the shared folder; a row's number is unique,
fixed by the write, and holds the block's number, so rows with equal ids
stay apart and a recomputed task reads the same rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import made_path
from .token_files import filesystem

#: Stands for a null ``doc_id``: smaller than every other.
NULL_ID = -(1 << 63)


def block_of(row: str = "row") -> Column:
    return F.shiftright(row, 33).cast("int")


def write_blocks(docs: DataFrame, keep: list[str] = ()) -> tuple[DataFrame, dict[int, str]]:
    """``(blocks, paths)``: ``row, id, text`` and a struct ``rest`` of the columns ``keep``; each block's file."""
    path = made_path(docs.sparkSession, "blocks")
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest")] if keep else []))
    # one file per task, whatever the session's own limit of rows per file says
    numbered.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    blocks = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    # one row per file
    found = (blocks.groupBy(block_of().alias("block"), F.col("_metadata.file_path").alias("path"))
             .agg(F.count(F.lit(1))).collect())
    paths = {r.block: r.path for r in found}
    if len(paths) != len(found):
        raise RuntimeError(f"a block of {path} has several files")
    return blocks, paths


def groups(parts: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, cut between keys only."""
    rest = None
    for pdf in parts:
        if not len(pdf):
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        last = pdf[key].to_numpy()
        cut = int(np.flatnonzero(last != last[-1])[-1]) + 1 if last[0] != last[-1] else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def by_block(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of one block at a time, from rows sorted by ``block``."""
    for pdf in groups(parts, "block"):
        for block, own in pdf.groupby("block", sort=True):
            yield int(block), own


def block_texts(path: str) -> Iterator[tuple[np.ndarray, list, list[bytes]]]:
    """(row numbers, ids, texts as bytes) of a block's file, a batch at a time, in order."""
    import pyarrow.parquet as pq
    files, place = filesystem(path)
    with files.open_input_file(place) as f:
        for batch in pq.ParquetFile(f).iter_batches(1000, columns=["row", "id", "text"]):
            texts = batch.column("text").cast("binary").to_pylist()
            yield batch.column("row").to_numpy(), batch.column("id").to_pylist(), texts


def rebuilt(batch, columns: list[str], texts: list[str] | None):
    """An Arrow batch of the original ``columns`` from a block's batch; with ``texts`` instead of its own
    (``n_chars``, if there is one, then counts their characters)."""
    import pyarrow as pa
    rest = batch.column("rest")
    out = []
    for c in columns:
        if c == "text":
            out.append(batch.column("text") if texts is None else pa.array(texts, pa.string()))
            continue
        own = rest.field(c)
        out.append(own if texts is None or c != "n_chars" else pa.array([len(t) for t in texts], own.type))
    return pa.RecordBatch.from_arrays(out, names=columns)


def block_batches(path: str):
    """A block's file as Arrow batches of ``row, id, text, rest``, in order."""
    import pyarrow.parquet as pq
    files, place = filesystem(path)
    with files.open_input_file(place) as f:
        yield from pq.ParquetFile(f).iter_batches(1000)


def select_rows(docs: DataFrame, rows: DataFrame, paths: dict[int, str]) -> DataFrame:
    """The documents whose ``row`` is in ``rows``, with the columns of ``docs``; no text is shuffled."""
    columns = docs.columns

    def run(parts):
        import pyarrow as pa
        import pyarrow.compute as pc
        frames = (b.to_pandas() for b in parts)
        for block, own in by_block(frames):
            wanted = pa.array(np.sort(own["row"].to_numpy()))
            for batch in block_batches(paths[block]):
                some = batch.filter(pc.is_in(batch.column("row"), value_set=wanted))
                if some.num_rows:
                    yield rebuilt(some, columns, None)

    return (rows.select("row", block_of().alias("block")).repartitionByRange(max(len(paths), 1), "block")
            .sortWithinPartitions("block").mapInArrow(run, docs.schema))
