"""spark-submit entry point for the batch jobs (see fundflow/plans/jobs.py).

    zip -r fundflow.zip fundflow
    spark-submit --py-files fundflow.zip run_jobs.py all --transfers … --transactions … --out …
"""
import sys

from fundflow.plans.jobs import main

if __name__ == "__main__":
    sys.exit(main())
