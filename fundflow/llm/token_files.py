"""Token files: independent zstandard frames, a trailing seek table, checksums.

File layout (one file per range of ``doc_id``)::

    frame 0 .. n-1   token ids, little-endian, at most FRAME_BYTES raw each
    frame n          directory: item width, document ids, ids per document
    seek table       a zstandard skippable frame in the seekable format:
                     per frame its compressed size, raw size and the low 32
                     bits of the raw data's XXH64; then the footer

Every frame is a complete zstandard frame, so any zstandard tool reads the
file, and ``read_documents`` fetches the footer, the directory and only the
frames that hold the documents asked for.  A document may span frames.

Defined results: null text is the empty text (its end id only); null
``doc_id`` sorts first; rows with equal ``doc_id`` are ordered by their text
and kept each; an empty table gives no file; other columns are ignored.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import tokens as T
from .common import reread, shuffle_width

FRAME_BYTES = 1 << 17
LEVEL = 3
# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 1 << 7
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
DIRECTORY = struct.Struct("<4sBQ")
DIRECTORY_TAG = b"TIDS"


class DamagedFrame(ValueError):
    """A frame's raw data doesn't have the checksum of the seek table."""


def filesystem(uri: str):
    """``(pyarrow file system, path)`` of a path or URI (local, HDFS, object stores)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _check(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Writes one token file; ``add`` in document order, then ``close``."""

    def __init__(self, stream, width: int, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard
        self.stream, self.width = stream, width
        self.frame_bytes = max(width, frame_bytes - frame_bytes % width)
        self.z = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.open: list[bytes] = []
        self.size = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def _frame(self, raw: bytes) -> None:
        packed = self.z.compress(raw)
        self.stream.write(packed)
        self.entries.append((len(packed), len(raw), _check(raw)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            raw = b"".join(self.open)
            whole = self.size - self.size % self.frame_bytes
            for i in range(0, whole, self.frame_bytes):
                self._frame(raw[i:i + self.frame_bytes])
            self.open, self.size = [raw[whole:]], self.size - whole

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.open))
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        self._frame(DIRECTORY.pack(DIRECTORY_TAG, self.width, len(self.ids)) + ids.tobytes()
                    + np.array(self.counts, "<i8").tobytes() + known.tobytes())
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        table += FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


@dataclass
class Reader:
    """Random access to one open token file; ``frames_read`` counts data frames decompressed."""
    stream: object
    frames_read: int = 0

    def __post_init__(self):
        import zstandard
        self.z = zstandard.ZstdDecompressor()
        end = self.stream.size() if hasattr(self.stream, "size") else self.stream.seek(0, 2)
        n, flags, magic = FOOTER.unpack(self._at(end - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        self.entries = list(ENTRY.iter_unpack(self._at(end - FOOTER.size - n * ENTRY.size, n * ENTRY.size)))
        self.places = np.concatenate([[0], np.cumsum([e[0] for e in self.entries], dtype=np.int64)])
        self.raw_ends = np.cumsum([e[1] for e in self.entries[:-1]], dtype=np.int64)
        head = self.frame(n - 1)
        tag, self.width, docs = DIRECTORY.unpack_from(head)
        if tag != DIRECTORY_TAG:
            raise ValueError("no directory frame")
        at = DIRECTORY.size
        self.doc_ids = np.frombuffer(head, "<i8", docs, at)
        self.counts = np.frombuffer(head, "<i8", docs, at + 8 * docs)
        self.known = np.frombuffer(head, np.uint8, docs, at + 16 * docs)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.frames_read = 0

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k]
        raw = self.z.decompress(self._at(int(self.places[k]), packed), max_output_size=size)
        self.frames_read += 1
        if len(raw) != size or _check(raw) != check:
            raise DamagedFrame(f"frame {k}")
        return raw

    def documents(self, which=None) -> Iterator[tuple[int, Iterator[bytes]]]:
        """``(place in the directory, its parts' raw ids)``; only the frames needed are read, each once."""
        last, held = -1, b""
        for i in range(len(self.counts)) if which is None else which:
            lo, hi = (int(self.starts[j]) * self.width for j in (i, i + 1))
            parts = []
            k = int(np.searchsorted(self.raw_ends, lo, "right"))
            while lo < hi:
                if k != last:
                    last, held = k, self.frame(k)
                first = int(self.raw_ends[k]) - len(held)
                parts.append(held[lo - first:hi - first])
                lo, k = min(hi, int(self.raw_ends[k])), k + 1
            yield i, parts


def read_documents(uri: str, doc_ids) -> dict[int, np.ndarray]:
    """Ids of the documents asked for, decompressing only their frames."""
    files, path = filesystem(uri)
    with files.open_input_file(path) as f:
        r = Reader(f)
        want = np.flatnonzero(np.isin(r.doc_ids, list(doc_ids)) & (r.known == 1))
        return {int(r.doc_ids[i]): np.frombuffer(b"".join(parts), f"<u{r.width}")
                for i, parts in r.documents(want)}


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2,
                      partitions: int | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into files below ``folder`` (a shared path).

    Documents are range-partitioned and sorted by ``doc_id``; each task
    writes one file of its range.  A file's name holds a fresh id, and only
    the files of tasks that succeeded are in the returned manifest
    ``(path, part, first_start, n_docs, n_tokens)``, which is written first;
    a lost or repeated task leaves at most a file that nobody names.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_width(spark)
    key = F.col("doc_id").asc_nulls_first()
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .repartitionByRange(n, key).sortWithinPartitions(key, "text"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        enc = T.encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        files, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tids"
        out, docs_n, ids_n = None, 0, 0
        for pdf in parts:
            texts = pdf["text"].tolist()
            rows = list(zip(pdf["doc_id"].tolist(), texts))
            for cut in T.batches(rows, [len(t or "") for t in texts]):
                for (doc, _), ids in zip(cut, enc.encode(t for _, t in cut)):
                    if out is None:
                        files.create_dir(base, recursive=True)
                        stream = files.open_output_stream(f"{base}/{name}")
                        out = Writer(stream, enc.dtype.itemsize, frame_bytes)
                    out.add(None if pd.isna(doc) else int(doc), ids + end)
        if out is not None:
            out.close()
            stream.close()
            docs_n, ids_n = len(out.ids), sum(out.counts)
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "part": [part], "n_docs": [docs_n], "n_tokens": [ids_n]})

    made = reread(rows.mapInPandas(write, "path string, part long, n_docs long, n_tokens long"), f"{folder}/manifest")
    # one row per file: as many as range partitions
    files_made = sorted((r.part, r.path, r.n_docs, r.n_tokens) for r in made.collect())
    starts = np.concatenate([[0], np.cumsum([f[3] for f in files_made], dtype=np.int64)]).tolist()
    return spark.createDataFrame([(p, k, s, d, t) for (k, p, d, t), s in zip(files_made, starts)],
                                 "path string, part long, first_start long, n_docs long, n_tokens long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the manifest's files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it in ``doc_id`` order.
    One task per file, frame by frame, every checksum verified.
    """
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, first in zip(pdf["path"], pdf["first_start"]):
                files, place = filesystem(path)
                with files.open_input_file(place) as f:
                    r = Reader(f)
                    crcs = np.zeros(len(r.counts), np.int64)
                    for i, held in r.documents():
                        crc = 0
                        for raw in held:
                            crc = zlib.crc32(np.frombuffer(raw, f"<u{r.width}").astype("<u4"), crc)
                        crcs[i] = crc
                    yield pd.DataFrame({
                        "doc_id": pd.array(np.where(r.known == 1, r.doc_ids, 0), "Int64").copy()
                        if r.known.all() else pd.array([int(d) if k else None for d, k in zip(r.doc_ids, r.known)], "Int64"),
                        "start": first + r.starts[:-1], "n_tokens": r.counts, "ids_crc32": crcs})

    n = max(manifest.count(), 1)
    return manifest.select("path", "first_start").repartition(n).mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op2: writes all documents (end id 2) and reads the files back."""
    folder = scratch_path(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, T.tokenizer_path(), end_id=2))
