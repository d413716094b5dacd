"""Versioned tables: a write becomes visible by one small manifest.

``<path>/data/<id>/...`` holds the files of a write and ``<path>/manifests/``
one small file per committed version, ``<number>.json``.  A write goes to a
new ``data`` folder first; only when all its files are complete is the
manifest created, and a reader takes the highest manifest it can read.  So a
job that dies while writing leaves the former version readable, readers never
see a mixture, and of two writers that commit the same number one fails and
takes the next.  The driver only handles the manifests; all data is written
and read by the tasks.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

DATA, MANIFESTS = "data", "manifests"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers that have a manifest, highest first."""
    fs, folder = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _manifest(spark: SparkSession, path: str, number: int) -> dict | None:
    """A manifest's content; None if its writer died before it was complete."""
    fs, p = _fs(spark, f"{path}/{MANIFESTS}/{number:010d}.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and "data" in found else None


def _commit(spark: SparkSession, path: str, content: dict) -> int:
    number = max(_numbers(spark, path), default=0) + 1
    while True:
        fs, p = _fs(spark, f"{path}/{MANIFESTS}/{number:010d}.json")
        try:
            stream = fs.create(p, False)  # fails if another writer has the number
        except Exception:
            if not fs.exists(p):
                raise
            number += 1
            continue
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        return number


def current(spark: SparkSession, path: str, number: int | None = None) -> str | None:
    """The folder of the committed version (the newest, or ``number``); None if there is none."""
    for n in _numbers(spark, path) if number is None else [number]:
        found = _manifest(spark, path, n)
        if found:
            return f"{path}/{DATA}/{found['data']}"
    return None


def write_version(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = 2, facts: dict | None = None) -> str:
    """Runs ``write(folder)`` on a new folder and commits it; returns the folder.

    ``facts`` are small values stored in the manifest (``write`` may add some).  The newest ``keep``
    versions stay for readers under way; older ones are deleted after the
    commit.  Folders that were never committed are left: another writer may
    be at work on them.
    """
    if keep < 1:
        raise ValueError("at least the new version is kept")
    before = {s.getPath().getName() for s in _data(spark, path)}
    name = uuid.uuid4().hex
    folder = f"{path}/{DATA}/{name}"
    write(folder)
    _commit(spark, path, {**(facts or {}), "data": name})
    committed = [(n, m["data"]) for n in _numbers(spark, path) if (m := _manifest(spark, path, n))]
    kept = {data for _, data in committed[:keep]}
    for n, data in committed[keep:]:
        if data in before - kept:
            fs, p = _fs(spark, f"{path}/{DATA}/{data}")
            fs.delete(p, True)
        fs, p = _fs(spark, f"{path}/{MANIFESTS}/{n:010d}.json")
        fs.delete(p, False)
    return folder


def facts(spark: SparkSession, path: str) -> dict:
    """The newest committed manifest (empty if there is none)."""
    for n in _numbers(spark, path):
        found = _manifest(spark, path, n)
        if found:
            return found
    return {}


def _data(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, f"{path}/{DATA}")
    return list(fs.listStatus(p)) if fs.exists(p) else []
