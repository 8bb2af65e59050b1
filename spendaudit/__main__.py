"""Run a whole audit: ``spark-submit -m spendaudit RAW_FOLDER OUTPUT_FOLDER [--csv]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spendaudit.plans.audit import audit_folder
from spendaudit.session import remove_intermediate


def main() -> None:
    options = argparse.ArgumentParser(description="Screen public-spending records for audit risk.")
    options.add_argument("raw", help="folder of the raw exports")
    options.add_argument("output", help="folder for the finished tables")
    options.add_argument("--csv", action="store_true", help="write CSV instead of Parquet")
    given = options.parse_args()
    spark = SparkSession.builder.appName("spendaudit").getOrCreate()
    audit = audit_folder(spark, given.raw)
    for name, path in audit.export(given.output, given.csv).items():
        print(name, path)
    remove_intermediate(spark)


if __name__ == "__main__":
    main()
