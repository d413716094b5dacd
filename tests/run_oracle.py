"""Compare every registered query with its SQL oracle, like the driver's gate.

    python tests/run_oracle.py [/root/testdata/sf0.01] [KEY ...]

Exact comparison (DOUBLE bit for bit), order-insensitive, columns by name.
"""
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)

import __spark_entry__ as entry  # noqa: E402
from fundflow.session import get_session  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_session("fundflow-oracle", master="local[8]", shuffle_partitions=8)
    con, sqls, bad = duck(sf), entry.oracle_sql(), 0
    for key, fn in entry.queries().items():
        if only and key not in only:
            continue
        t = time.perf_counter()
        try:
            ok, msg = compare(fn(spark, sf), con, sqls[key])
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {key:28s} {time.perf_counter() - t:5.1f}s {msg[:300]}", flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
