import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendaudit.operators import explore, reports, trends

D = dt.date
SCHEMA = (
    "work_id string, mp_id string, mp_name string, parliament_house string, state string, constituency string, work_description string, risk_level string, "
    "risk_score double, total_expenditure double, sanctioned_amount double, completion_amount double, duplicate_payment_count long, lifecycle_status string, "
    "sanction_date date, completion_date date, recommended_date date, primary_reason string, row_order long"
)
LS, RS = "Lok Sabha", "Rajya Sabha"


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        ("w1", "m1", "Ann", LS, "Goa", "North", "School 100% done", "CRITICAL", 90.0, 10.0, 20.0, None, 1, "a", D(2023, 1, 5), D(2023, 3, 1), D(2022, 12, 1), "Rule: Duplicate x", 1),
        ("w2", "m1", "Ann", LS, "Goa", "South", None, "HIGH", 70.0, None, 5.0, 2.0, 0, "a", D(2023, 1, 9), None, None, "Rule: y", 2),
        ("w3", "m2", "Bob", RS, None, None, "Road", "REVIEW", 50.0, 3.0, None, 4.0, None, None, D(2023, 4, 1), D(2023, 5, 1), None, "z", 3),
        ("w4", "m3", "Cyd", LS, "Jammu And Kashmir", "North", "bridge", None, None, 1.0, 1.0, None, 0, "b", None, D(2023, 5, 2), D(2023, 5, 1), None, 4),
        ("w5", "m3", "Cyd", LS, "Jammu And Kashmir", "North", "bridge", "NORMAL", 90.0, 1.0, 1.0, None, 0, "b", D(2023, 4, 2), None, None, "n", 5),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r.work_id for r in df.collect()]


def test_filters_and_pages(works):
    assert ids(explore.works_explorer(works)) == ["w1", "w5", "w2", "w3", "w4"]
    assert ids(explore.works_explorer(works, page=2, page_size=2)) == ["w2", "w3"]
    assert ids(explore.works_explorer(works, chamber=LS, state="Goa", constituency="North", risk="CRITICAL")) == ["w1"]
    assert ids(explore.works_explorer(works, text=" BRIDGE ")) == ["w5", "w4"]
    assert ids(explore.works_explorer(works, text="100%")) == ["w1"] and ids(explore.works_explorer(works, text=".*")) == []
    assert ids(explore.works_explorer(works, min_score=50.0, max_score=70.0)) == ["w2", "w3"]
    assert ids(explore.works_explorer(works, district="D")) == [] and len(ids(explore.works_explorer(works, district="All"))) == 5
    assert ids(explore.critical_queue(works, sort="nonsense")) == ["w1"]
    assert ids(explore.anomaly_explorer(works, signal="duplicate")) == ["w1"] and ids(explore.flagged_works(works, "Ann")) == ["w1", "w2"]


def test_groups(works):
    one = explore.overview(works).first()
    assert (one.total_works, one.NORMAL, one.CRITICAL, one.expenditure, one.mp_count, one.state_count, one.duplicate_payment_count) == (5, 2, 1, 15.0, 3, 2, 1)
    empty = explore.overview(works.limit(0)).first()
    assert (empty.total_works, empty.HIGH, empty.sanctioned, empty.duplicate_payment_count) == (0, 0, 0.0, 0)
    states = {r.state: r for r in explore.by_state(works).collect()}
    assert states[None].total_works == 1 and states["Jammu And Kashmir"].state_display == "Jammu & Kashmir"
    assert (states["Jammu And Kashmir"].normal, states["Jammu And Kashmir"].risk_score) == (1, 90.0)
    detail = explore.state_detail(works, "jammu & kashmir")
    assert detail["summary"].first().NORMAL == 2 and detail["members"].first().works == 2
    assert explore.state_detail(works, "nowhere")["summary"].first().total_works == 0
    directory = explore.member_directory(works, "risk_count", descending=True).collect()
    # a member with works in two constituencies has one row for each
    assert len(directory) == 4 and directory[0].risk_count == 1
    assert [r.constituency for r in explore.member_directory(works, "constituency").collect()][-1] is None
    profile = {r.mp_id: r for r in explore.member_profile(works, "row_order").collect()}
    assert (profile["m1"].constituency, profile["m1"].total_works, profile["m2"].constituency) == ("North", 2, None)
    facets = {(r.facet, r.of_state, r.value) for r in explore.facet_values(works).collect()}
    assert facets == {
        ("state", None, "Goa"), ("state", None, "Jammu And Kashmir"), ("constituency", None, "North"), ("constituency", None, "South"),
        ("constituency_of_state", "Goa", "North"), ("constituency_of_state", "Goa", "South"), ("constituency_of_state", "Jammu And Kashmir", "North"),
    }
    assert {r.constituency: r.state for r in explore.constituency_state(works).collect()} == {"North": "Goa", "South": "Goa"}
    assert tuple(explore.score_range(works).first()) == (50.0, 90.0)


def test_records(works):
    rows = {r.work_id: r for r in explore.work_record(works).collect()}
    assert [rows[f"w{i}"].duration_days for i in range(1, 6)] == [90, None, 30, 1, None]
    assert rows["w1"].sanction_date == "2023-01-05" and rows["w4"].state_display == "Jammu & Kashmir"
    found = explore.work_dossier("w1", {"work": works, "pairs": works.select(F.struct("work_id").alias("work_a"), F.struct(F.lit("q").alias("work_id")).alias("work_b"))})
    assert found["work"].count() == 1 and found["pairs"].count() == 1


def test_reports(spark, works):
    ledger = spark.createDataFrame([("e1", "w1", D(2023, 1, 3), 5.0), ("e2", "w1", None, 6.0), ("e3", "gone", D(2023, 1, 3), 9.0)], "expenditure_id string, work_id string, expenditure_date date, amount double")
    assert reports.kpi_row(works, ledger).first().total_expenditure == 11.0
    assert [tuple(r) for r in trends.trend("sanctions", works, ledger).collect()] == [("2023-01", 2, 25.0), ("2023-04", 2, 1.0)]
    assert [tuple(r) for r in trends.trend("expenditure", works, ledger).collect()] == [("2023-01", 1, 5.0)]
    assert [tuple(r) for r in trends.trend("completions", works, ledger, mp_id="m3").collect()] == [("2023-05", 1, 0.0)]
    risk = trends.trend("risk", works, ledger, chamber=LS).collect()
    assert [(r.month, r.NORMAL, r.REVIEW, r.HIGH, r.CRITICAL) for r in risk] == [("2023-01", 0, 0, 1, 1), ("2023-04", 1, 0, 0, 0)]
    assert trends.trend("weather", works, ledger).collect() == []
    assert [tuple(r) for r in reports.frequencies(works, "lifecycle_status").collect()] == [("a", 2), ("b", 2)]
    limits = spark.createDataFrame([("Ann", 40.0), ("Ann", 60.0), ("Cyd", 0.0)], "mp_name string, allocated_amount double")
    use = {r.mp_name: (r.allocated_amount, r.utilization_rate) for r in reports.fund_utilization(works, limits).collect()}
    assert use["Ann"] == (100.0, 10.0) and use["Cyd"] == (0.0, 0.0) and use["Bob"] == (147_000_000.0, pytest.approx(3 / 1.47e8 * 100))
    bins = reports.duration_histogram(spark.createDataFrame([(d,) for d in range(61)], "days int"), "days").collect()
    assert sum(r.works for r in bins) == 61 and {r.bin: r.works for r in bins}[29] == 3 and len(bins) == 30
    assert reports.duration_histogram(spark.createDataFrame([(5,), (5,)], "days int"), "days").first().works == 2
    assert reports.duration_histogram(spark.createDataFrame([], "days int"), "days").count() == 0


def test_pages_by_key_equal_pages_by_number(spark):
    df = spark.createDataFrame([(f"w{i:03d}", float(i % 7)) for i in range(95)], "work_id string, risk_score double")
    listed = [(r.risk_score, r.work_id) for r in df.orderBy(F.desc("risk_score"), "work_id").collect()]
    total = explore.page_total(df, 10).first()
    assert (total.total, total.pages) == (95, 10)
    walked, last = [], (float("inf"), "")
    for _ in range(total.pages):
        page = [(r.risk_score, r.work_id) for r in explore.page_after(df, "risk_score", *last, page_size=10).collect()]
        walked += page
        last = page[-1]
    assert walked == listed


@pytest.mark.parametrize("rows_of_part", [7, 1000])
def test_pages_through_the_directory_equal_pages_by_offset(spark, tmp_path, rows_of_part):
    """Many equal scores, missing scores at the end, pages that cross parts, pages behind the end."""
    rows = [(f"w{i:03d}", None if i % 11 == 0 else float([1, 5, 5, 5, 5, 9, 3.25][i % 7])) for i in range(150)]
    spark.createDataFrame(rows, "work_id string, risk_score double").repartition(5).write.parquet(str(tmp_path / "works"))
    df = spark.read.parquet(str(tmp_path / "works"))
    directory = explore.page_directory(df, rows_of_part=rows_of_part)
    assert directory.total == 150 and len(directory.before) == (1 if rows_of_part > 150 else len(directory.first)) and directory.before == sorted(directory.before)
    for size in (1, 10, 64):
        for page in [1, 2, *range(3, 150 // size + 3, 4)]:
            by_offset = explore.page_of(df, [F.desc_nulls_last("risk_score")], page, size).collect()
            assert explore.numbered_page(df, directory, page, size).collect() == by_offset, (page, size)
    assert explore.numbered_page(df.limit(0), explore.page_directory(df.limit(0)), 1, 5).collect() == []


def test_a_deep_page_ranks_its_parts_only(spark, tmp_path):
    spark.range(20_000).select(F.format_string("w%06d", "id").alias("work_id"), (F.col("id") % 997 / 10.0).alias("risk_score")).write.parquet(str(tmp_path / "works"))
    df = spark.read.parquet(str(tmp_path / "works"))
    directory = explore.page_directory(df, rows_of_part=200)
    page = explore.numbered_page(df, directory, 1000, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "LessThanOrEqual(risk_score" in pushed and "GreaterThanOrEqual(risk_score" in pushed
    limit = page._jdf.queryExecution().optimizedPlan().toString()
    offset = int(limit.split("Offset ")[1].split()[0])
    assert offset < 1000 and page.collect() == explore.page_of(df, [F.desc("risk_score")], 1000, 10).collect()


def test_reports_from_the_summary_equal_those_from_the_works(works):
    """Missing states, levels, amounts and chambers included; one scan of the works."""
    from spendaudit.operators import summary

    works = works.withColumn("work_category", F.when(F.col("work_id") != "w2", F.concat(F.lit("Roads"), F.col("risk_level"))))
    table = summary.work_summary(works)

    def same(a, b):
        assert sorted(map(repr, (r.asDict() for r in a.collect()))) == sorted(map(repr, (r.asDict() for r in b.select(*a.columns).collect())))

    for chamber in (explore.ALL, LS, RS, "Neither"):
        same(summary.overview(table, chamber), explore.overview(works, chamber))
        same(summary.by_state(table, chamber), explore.by_state(works, chamber))
        same(summary.top_states(table, chamber, 2), explore.top_states(works, chamber, 2))
        chosen = explore.filter_works(works, chamber=chamber)
        for column in ("state", "work_category", "risk_level"):
            assert summary.frequencies(table, column, chamber).collect() == reports.frequencies(chosen, column).collect()
    assert summary.state_performance(table).collect() == reports.state_performance(works).select(*summary.state_performance(table).columns).collect()
    empty = summary.work_summary(works.limit(0))
    same(summary.overview(empty), explore.overview(works.limit(0)))


def test_the_summary_scans_the_works_once(works, tmp_path):
    from spendaudit.operators import summary

    works.withColumn("work_category", F.lit("Roads")).write.parquet(str(tmp_path / "works"))
    stored = works.sparkSession.read.parquet(str(tmp_path / "works"))
    seen = []
    kept, summary.materialize = summary.materialize, lambda df, name: seen.append(df) or df
    try:
        summary.work_summary(stored)
    finally:
        summary.materialize = kept
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "work_description" not in plan


def test_search_by_trigrams_equals_the_scan(spark, tmp_path):
    from spendaudit.operators import search

    words = ["Road 100% done", "Übergang ROAD", "ro", "", None, "a_b*c (x)", "日本語の道", "ad done", "roadroadroad"]
    rows = [(f"W/{i}", words[i % 9], ["Ann", None, "Roa Dd"][i % 3]) for i in range(60)]
    df = spark.createDataFrame([*rows, ("W/1", "road twice", "x")], "work_id string, work_description string, mp_name string")
    table = search.trigram_table(df)
    for text in ("road", " ROAD ", "100%", "übergang", "a_b*c (", "日本語", "ro", "", "w/1", "nowhere", "roadx", "d done", "dro"):
        got = sorted(map(repr, search.search(df, table, text).collect()))
        assert got == sorted(map(repr, explore.contains_text(df, text, table.columns).collect())), text
    empty = search.trigram_table(df.limit(0))
    assert search.search(df.limit(0), empty, "road").collect() == []


def test_a_search_reads_the_folders_of_its_trigrams(spark):
    from spendaudit.operators import search

    df = spark.range(3000).select(F.concat(F.lit("W/"), F.sha2(F.col("id").cast("string"), 256)).alias("work_id"))
    table = search.trigram_table(df)
    wanted = df.first().work_id[10:20]
    found = search.search(df, table, wanted)
    assert [r.work_id[10:20] for r in found.collect()] == [wanted]
    grams = {wanted[i : i + 3] for i in range(8)}
    counts = {r.gram: r.works for r in table.counts.collect() if r.gram in grams}
    files = {r.folder: r.files for r in table.postings.groupBy("folder").agg(F.count_distinct(F.col("_metadata.file_path")).alias("files")).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert any("folder" in s[s.index("PartitionFilters") :].split("]")[0] and "In(gram" in s for s in scans)
    rarest = sorted(grams, key=lambda g: (counts[g], g))[:3]
    assert len({search.crc32(g.encode()) % search.FOLDERS for g in rarest}) <= 3 < len(files)


def test_trigrams_are_stored_by_blocks_of_works(spark, monkeypatch):
    import os

    from spendaudit.operators import search

    numbered = F.concat(F.lit("WS/MP"), F.col("id") % 97, F.lit("/1996/"), F.col("id").cast("string"))
    rows = spark.range(4000).select(numbered.alias("work_id"), F.concat(F.lit("Construction of a culvert at place "), F.col("id") % 50).alias("work_description"))
    rows = rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, "culvert"), ("W/none", None)], rows.schema)).coalesce(1)
    texts = ("culvert at place 7", "/1996/12", "mp5/1996/10", "none", "culverts")
    for characters in (search.BLOCK_CHARACTERS, 700):
        monkeypatch.setattr(search, "BLOCK_CHARACTERS", characters)
        table = search.trigram_table(rows)
        for text in texts:
            # rows without an id are in no table of trigrams
            wanted = explore.contains_text(rows.filter("work_id IS NOT NULL"), text, table.columns)
            assert sorted(search.search(rows, table, text).collect()) == sorted(wanted.collect()), text
        counts = {r.gram: r.works for r in table.counts.collect()}
        assert counts["cul"] == 4003 and counts["non"] == 1
        if characters > 700:
            # a row for each trigram and block, not one for each trigram of each work: some 30 bytes a work with its id
            assert table.postings.count() == len(counts)
            files = {f.removeprefix("file:") for f in table.postings.inputFiles()}
            assert sum(os.path.getsize(f) for f in files) / 4000 < 200
            assert table.postings.filter("gram = 'cul'").agg(F.sum(F.size("places"))).first()[0] == 4003
