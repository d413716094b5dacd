"""Physical layouts of stored tables: buckets for joins, clusters and Bloom filters for look-ups.

``write_bucketed``  both sides of the exit join (J1) in the same number of
                    buckets of its three keys, one sorted file a bucket: the
                    join then reads bucket against bucket without an exchange
                    (its sorts meet sorted rows).  Pays when the tables are
                    joined more than once.
``write_lookup``    rows clustered by one column (range partitions, sorted, so
                    row-group statistics bound it tightly) with Parquet Bloom
                    filters on others: a look-up by any of them skips row
                    groups.
"""
from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..session import default_parallelism

TRANSFER_KEYS = ["tx_hash", "from_address", "to_address"]
TRANSACTION_KEYS = ["hash", "from", "to"]
#: Distinct values a row group's Bloom filter is made for (about 1.2 bytes each).
BLOOM_VALUES = 100_000


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``df`` written below ``path`` in buckets of ``keys`` and read back as a bucketed table.

    The rows are exchanged once, on the bucket function itself, so a bucket
    is one file.  Tables to be joined need the same number of buckets.
    """
    spark = df.sparkSession
    buckets = buckets or default_parallelism(spark)
    name = f"bucketed_{uuid.uuid4().hex}"  # known to this session's catalog only
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys).write.option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name))
    return spark.table(name)


def write_lookup(df: DataFrame, path: str, cluster: Sequence[str] = (), bloom: Sequence[str] = (),
                 row_group_bytes: int | None = None) -> None:
    """``df`` as Parquet below ``path``, clustered by ``cluster`` and with Bloom filters on ``bloom``."""
    if cluster:
        df = df.repartitionByRange(*cluster).sortWithinPartitions(*cluster)
    w = df.write
    for c in bloom:
        w = (w.option(f"parquet.bloom.filter.enabled#{c}", "true")
              .option(f"parquet.bloom.filter.expected.ndv#{c}", str(BLOOM_VALUES)))
    if row_group_bytes:
        w = (w.option("parquet.block.size", str(row_group_bytes))
              .option("parquet.block.size.row.check.min", "100").option("parquet.block.size.row.check.max", "100"))
    w.parquet(path)
