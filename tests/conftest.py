import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


WORK_DEFAULTS = {
    "work_id": "W1", "parliament_house": "Lok Sabha", "mp_name": "A Member", "state": "Goa", "constituency": "North",
    "elected_nominated": None, "work_category": "Roads", "work_description": "Laying drains", "recommended_amount": 100.0,
    "recommended_date": dt.date(2023, 1, 1), "sanctioned_amount": 100000.0, "sanction_date": dt.date(2023, 2, 1),
    "completion_amount": None, "completion_date": None, "work_status_raw": "Sanctioned", "has_recommended": True,
    "has_sanctioned": True, "has_expenditure": False, "has_completed": False, "is_unmatched_work": False,
    "lifecycle_status": "x", "row_order": 1,
}


@pytest.fixture
def make_works(spark):
    """Works from partial dictionaries."""
    from spendaudit.schemas import WORKS

    def make(*rows):
        names = [c.strip().split(" ")[0] for c in WORKS.split(",")]
        full = [{**WORK_DEFAULTS, "row_order": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], WORKS)

    return make


@pytest.fixture
def make_ledger(spark):
    """Ledger rows (work, date, vendor, status, amount)."""
    from spendaudit.schemas import LEDGER

    def make(*rows):
        return spark.createDataFrame([(f"E{i}", r[0], "Lok Sabha", *r[1:]) for i, r in enumerate(rows)], LEDGER)

    return make
