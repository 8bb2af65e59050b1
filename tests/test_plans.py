"""Whole runs, plan shapes, and every registered query against its SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spendaudit import AuditConfig, fixed_values as fixed, session
from spendaudit.operators import duplicates, explore, features, payments
from spendaudit.plans import bindings
from spendaudit.plans.audit import Audit
from tools.compare import compare, database

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in entry.oracle_sql():
        assert compare(df, con, entry.oracle_sql()[name]).startswith("ok")
    else:
        assert df.count() > 0


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_tables
def test_scan_reads_only_what_is_needed(spark):
    df = bindings.table(spark, FOLDER, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    text = plan(df)
    assert "EqualTo(o_orderstatus,F)" in text
    scored = entry.queries()["score_range"](spark, FOLDER)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(scored)).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {"parliament_house", "risk_score"}


@needs_tables
def test_reports_of_numbers_put_no_reasons_into_words(spark):
    numbers, told = plan(entry.queries()["house_distribution"](spark, FOLDER)), entry.queries()["risk_reasons"](spark, FOLDER)
    assert "format_number" not in numbers and "sha1" not in numbers
    stored = {c for file in told.inputFiles() for c in spark.read.parquet(os.path.dirname(file)).columns}
    assert "rule_score" in stored and not [c for c in stored if "reason" in c]  # the reasons are made of the stored numbers
    assert told.filter("size(split(risk_reasons, ' [|] ')) > 1").count() > 0


@needs_tables
@pytest.mark.parametrize("name", ["overrun_list", "dossier_work", "work_records", "forest_risk_levels", "forest_reasons"])
def test_no_texts_of_all_works_are_written_for_a_list(spark, name):
    stored = {c for file in entry.queries()[name](spark, FOLDER).inputFiles() for c in spark.read.parquet(os.path.dirname(file)).columns}
    assert "work_id" in stored and not stored & {"risk_reasons", "primary_reason", "delay_reason", "checks_passed"}


@needs_tables
def test_works_scored_by_the_forest_are_written_once(spark, monkeypatch):
    from spendaudit.plans import audit, queries

    written = []
    for module in (audit, queries):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or session.materialize(df, name))
    queries._forest.cache_clear()
    got = queries.forest_reasons(spark, FOLDER)
    assert written == ["forest_features"] and got.filter("risk_reasons = ''").isEmpty() and got.count() > 1000
    features = queries.audit(spark, FOLDER).features
    limits = queries.rules.rule_limits(features, queries.CONFIG)
    stored, columns = (audit.scored_works(features, limits, queries.CONFIG, stored=x) for x in (True, False))
    assert stored.dtypes == columns.dtypes and stored.exceptAll(columns).isEmpty()


@needs_tables
def test_tables_between_steps_are_compressed(spark):
    df = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    files = session.materialize(df, "digests").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


@needs_tables
def test_plans_have_no_cross_joins_or_single_partition_windows(spark):
    works, ledger = bindings.works(spark, FOLDER), bindings.ledger(spark, FOLDER)
    prepared = duplicates.prepare(works)
    for df in (payments.payment_profile(ledger), payments.repeated_record_log(ledger), features.base_features(works, ledger, AuditConfig()), duplicates.candidate_pairs(prepared)):
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "Window" not in text


@needs_tables
def test_top_lists_are_limited_before_the_shuffle(spark):
    works = entry.queries()["composite_scores"](spark, FOLDER)
    assert "TakeOrderedAndProject" in plan(explore.page_of(works, [F.desc("risk_score")], 2, 10))
    assert "WindowGroupLimit" in plan(entry.queries()["alert_samples"](spark, FOLDER))


@needs_tables
def test_forest_run_is_consistent(spark):
    """A whole run with the forest: totals agree between the tables."""
    done = Audit(bindings.works(spark, FOLDER), bindings.ledger(spark, FOLDER), bindings.allocation(spark, FOLDER), bindings.calamity(spark, FOLDER))
    total = done.works.count()
    assert done.monitored.count() == total and done.explained.count() == total and done.monitored.select("work_id").distinct().count() == total
    assert explore.by_state(done.scored).agg(F.sum("total_works")).first()[0] == total
    assert {r.dataset: r.records for r in done.quality_report().collect()}["anomaly_results"] == total
    wrong = done.warnings.filter("size(array_except(signals, array('risk', 'duplicate', 'overrun', 'compliance', 'stalled'))) > 0").count()
    assert wrong == 0


@needs_tables
def test_from_raw_exports_to_written_results(spark, tmp_path):
    """Raw CSV to exported tables and back: the score survives, and reading the export fills nothing wrongly."""
    from spendaudit.plans.audit import audit_folder
    from spendaudit.sources.tables import read_table, work_data

    bindings.write_raw_exports(spark, FOLDER, str(tmp_path / "raw"))
    done = audit_folder(spark, str(tmp_path / "raw"))
    paths = done.export(str(tmp_path / "out"))
    scored, master = read_table(spark, paths["anomaly_results"]), read_table(spark, paths["works_master"])
    again = work_data(scored, master)
    columns = ["work_id", "risk_score", "risk_level", "state", "sanctioned_amount", "mp_id"]
    assert again.count() == done.works.count() > 1000
    assert again.select(columns).exceptAll(done.scored.select(columns)).count() == 0
    assert read_table(spark, paths["data_quality_report"]).count() == 6
    assert done.scored.filter("is_unmatched_work and risk_score is null").count() == 0


@needs_tables
def test_only_the_exports_asked_for_are_written(spark, tmp_path):
    bindings.write_raw_exports(spark, FOLDER, str(tmp_path), ["calamity"])
    written = {(p.parent.parent.name, p.parent.name) for p in tmp_path.rglob("part-*")}
    assert written == {(folder, fixed.RAW_FILES["calamity"]) for folder in fixed.RAW_FOLDERS.values()}
    assert all(p.name.endswith(".csv.gz") for p in tmp_path.rglob("part-*"))


def test_shared_folder(spark, monkeypatch):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert session.work_folder(spark).startswith(shared)
    df = session.materialize(spark.range(5), "five")
    assert df.count() == 5 and df.inputFiles()[0].split("file://")[-1].startswith(shared)
    empty = session.materialize(spark.range(0), "none")
    assert empty.count() == 0 and empty.columns == ["id"]


class FakeConf:
    def get(self, name, default=None):
        return default


class FakeContext:
    applicationId = "app"

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    conf = FakeConf()

    def __init__(self, master):
        self.sparkContext = FakeContext(master)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_folder(FakeSession("spark://host:7077"))
    local = FakeSession("local[2]")
    assert session.work_folder(local) == session.work_folder(local)
