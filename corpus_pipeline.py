"""Corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and calls one operator; its
result is written as Parquet in the shared folder and reread as the next
stage's documents.  All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.

The stages can't be expressed in SQL from the second on (a trained model,
minimum hashes over whole texts, a tokenizer library), so there is no
oracle SQL; tests hold every stage against a brute-force version.

Defined results, for every stage: a null text is an empty one (the quality
stage rejects it, and no later stage fails on it); rows with a null or
repeated ``doc_id`` are rows of their own; extra columns pass through under
their own names; an empty table gives no rows.

Tables that a stage's operator writes belong to that call.  ``run`` deletes
them, and the stage's own result, once the next stage's result is written.
A stage called by itself leaves them until its frame is gone: a later call
of any stage then deletes them, unless its documents still read from them.
Keep (or write) the frame that a stage returned as long as frames derived
from it are in use.
"""
from __future__ import annotations

import weakref
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fundflow.llm import tokens, toxicity
from fundflow.llm.common import delete, free_name, making, roots, table, written
from fundflow.llm.near_dups import first_of_each
from fundflow.llm.packing import pack
from fundflow.llm.passages import without_repeats
from fundflow.llm.quality import good_documents

#: Tables of stage calls whose frames are gone, a list per call.
_LEFT: list[list[str]] = []


def _sweep(spark: SparkSession, docs: DataFrame) -> None:
    """Deletes what ended calls left, but for tables of a call that ``docs`` reads from."""
    read = {p.rstrip("/").rsplit("/", 1)[-1] for p in roots(docs)} if _LEFT else set()
    for paths in list(_LEFT):
        if not any(p.rsplit("/", 1)[-1] in read for p in paths):
            _LEFT.remove(paths)
            delete(spark, paths)


def stage(function):
    """A stage whose call owns the tables that its operator writes."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _sweep(spark, docs)
        with making() as paths:
            out = function(spark, docs, sf_dir)
        if paths:
            weakref.finalize(out, _LEFT.append, paths).atexit = False
        return out
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or come from a rejected host go."""
    return good_documents(docs)


@stage
def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxic_score")
    scored = toxicity.score_documents(docs, model, score)
    return scored.where(scored[score] < toxicity.THRESHOLD).drop(score)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return first_of_each(docs)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages go from the texts; every document stays."""
    return without_repeats(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, tokens.tokenizer_path(), end_id=1, with_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, own = table(spark, sf_dir, "documents"), []
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        with making() as paths:
            docs = written(out, name.replace(" ", "-"))
        delete(spark, own)  # the former stage's result
        own = paths
        del out             # nothing reads the call's tables any more
    _sweep(spark, docs)
    return docs
