"""Blocks hold every row, whatever the session's limit of rows per file says."""
from helpers import awkward, documents

from fundflow.llm.blocks import block_texts, write_blocks


def test_no_row_is_lost_by_short_files(spark):
    texts, ids, sources = awkward()
    docs = documents(spark, texts, ids, sources).coalesce(2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 2)
    try:
        blocks, paths = write_blocks(docs, ["source"])
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    found = {row: text for p in paths.values() for rows, _, bodies in block_texts(p) for row, text in zip(rows.tolist(), bodies)}
    assert len(found) == len(texts) == blocks.count() and len(paths) == 2
    assert sorted(found.values()) == sorted((t or "").encode() for t in texts)
