import datetime as dt

import pytest

from spendaudit import fixed_values as fixed
from spendaudit.operators.integrate import find_column, integrate, unreadable_cells
from spendaudit.sources.raw import load_raw

MEMBER, STATE = "Hon'ble Members of Parliament", "State"
HEADERS = {
    "recommended": ["Sr. No.", "WORK", "Work category", "Work Description", MEMBER, STATE, "Seat", "Recommended date", "Recommended AMOUNT ( ₹ )"],
    "sanctioned": ["Sr. No.", "Work", "Work category", "Work Description", MEMBER, STATE, "Seat", "Recommended date", "Sanction Date", "Work Status", "Sanction AMOUNT ( ₹ )"],
    "completed": ["Sr. No.", "Work", "Work category", "Work Description", MEMBER, STATE, "Seat", "Completion Date", "Amount Disbursed ( ₹ )"],
    "expenditure": ["Sr. No.", "Work ID", MEMBER, STATE, "Seat", "Expenditure Date", "Vendor Name", "Payment Status", "Fund Disbursed Amount ( ₹ )"],
    "allocation": ["Sr. No.", STATE, MEMBER, "Seat", "Allocated AMOUNT ( ₹ )"],
    "calamity": ["Sr. No.", "Calamity Type", "Calamity Name", MEMBER, "Date of Consent", "Consent Amount ( ₹ )"],
}
P = ["Shri A B (2022-28) (2022-2028)", "ORISSA", "SEAT 1"]
ID = "WS/MP1/2024-2025/{}"


def rec(n, work, day, amount, text="Drain"):
    return [n, work, "Water", text, *P, day, amount]


ROWS = {
    ("LS", "recommended"): [
        rec("1", ID.format(1), "01-Jan-2024", "Rs. 1,00,000", "First text"),
        rec("2", ID.format(1), "05-Jan-2024", "", "Second text"),  # the later record wins, even empty
        rec("3", "no id", "junk", "5"),
        rec("4", "no id", "", "6", 'With "quotes" and\na line break'),
        rec("5", ID.format(9), "02-Jan-2024", "7", "Total repair of a road"),  # dropped like a total line
    ],
    ("RS", "recommended"): [rec("1", "ws / mp 1 / 2024-2025 / 1", "06-Jan-2024", "9")],
    ("LS", "sanctioned"): [
        ["1", ID.format(1), "Roads", "Late text", *P, "31-Jan-2020", "01-Feb-2024", "Running", "90"],
        ["2", ID.format(1), "Roads", "Late text", *P, "31-Jan-2020", "02-Feb-2024", "", "95"],
        ["3", ID.format(2), "", "", *P, "03-Jan-2024", "03-Feb-2024", "Running", "50"],
        ["4", ID.format(3), "Roads", "No request", *P, "", "04-Feb-2024", "Running", "60"],
    ],
    ("RS", "sanctioned"): [],
    ("LS", "completed"): [
        ["1", ID.format(1), "Roads", "Done", *P, "01-Mar-2024", "88"],
        ["2", ID.format(4), "Roads", "Only done", *P, "02-Mar-2024", "77"],
    ],
    ("RS", "completed"): [],
    ("LS", "expenditure"): [
        ["1", ID.format(2), *P, "01-Apr-2024", " V1 ", "Paid", "10"],
        ["2", ID.format(5), *P, "02-Apr-2024", "", "", "20"],
    ],
    ("RS", "expenditure"): [["1", "nothing", *P, "03-Apr-2024", "V2", "Paid", "x"]],
    ("LS", "allocation"): [["1", "goa", "Smt. C D", "SEAT 2", "4,05,67,400"]],
    ("RS", "allocation"): [["1", "goa", "Dr E F", "Nominated MP", "1"]],
    ("LS", "calamity"): [["1", "State Calamity", "Flood", "DR G H", "07-Dec-2025", "7067400"]],
    ("RS", "calamity"): [["1", "National Calamity", "Storm", "Shri I J (2022-28) (2022-2028)", "bad", "10,000"]],
}


def write_csv(path, header, rows):
    lines = [header, *rows, ["Grand Total", *[" "] * (len(header) - 1)]]
    text = "\n".join(",".join('"' + c.replace('"', '""') + '"' for c in line) for line in lines)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("﻿" + text, encoding="utf-8")


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for (code, kind), rows in ROWS.items():
        seat = "Constituency" if code == "LS" else "Elected/Nominated"
        header = [seat if h == "Seat" else h for h in HEADERS[kind]]
        write_csv(folder / fixed.RAW_FOLDERS[code] / fixed.RAW_FILES[kind], header, rows)
    tables = integrate(load_raw(spark, str(folder)))
    return tables, {r.work_id: r for r in tables.works.collect()}


def test_latest_record_of_a_stage_wins_and_first_describes(result):
    w = result[1]["WS/MP1/2024-2025/1"]
    assert (w.work_description, w.work_category, w.mp_name, w.state) == ("First text", "Water", "A B", "Odisha")
    assert (w.parliament_house, w.constituency, w.elected_nominated) == ("Lok Sabha", "SEAT 1", None)
    assert (w.recommended_amount, w.recommended_date) == (9.0, dt.date(2024, 1, 6))  # upper house comes later
    assert (w.sanctioned_amount, w.sanction_date, w.work_status_raw) == (95.0, dt.date(2024, 2, 2), "Sanctioned")
    assert (w.completion_amount, w.completion_date) == (88.0, dt.date(2024, 3, 1))
    assert (w.has_recommended, w.has_sanctioned, w.has_expenditure, w.has_completed) == (True, True, False, True)
    assert w.lifecycle_status == fixed.LIFECYCLE_COMPLETED and not w.is_unmatched_work


def test_sanction_that_opens_a_work_gives_its_recommendation_date(result):
    w = result[1]["WS/MP1/2024-2025/2"]
    assert (w.recommended_date, w.recommended_amount, w.has_recommended) == (dt.date(2024, 1, 3), None, True)
    assert (w.work_category, w.work_description, w.lifecycle_status) == ("Normal/Others", "", fixed.LIFECYCLE_IN_PROGRESS)
    w = result[1]["WS/MP1/2024-2025/3"]
    assert (w.recommended_date, w.has_recommended, w.work_status_raw) == (None, False, "Running")
    assert w.lifecycle_status == fixed.LIFECYCLE_PENDING_PAYMENT


def test_works_opened_by_later_stages(result):
    done, paid = result[1]["WS/MP1/2024-2025/4"], result[1]["WS/MP1/2024-2025/5"]
    assert (done.work_status_raw, done.lifecycle_status, done.work_description) == ("Work Completed", fixed.LIFECYCLE_GAP, "Only done")
    assert (paid.work_status_raw, paid.has_expenditure, paid.work_category) == ("In Progress", True, "Normal/Others")


def test_unusable_ids_never_merge(result):
    works = result[1]
    assert "WS/MP1/2024-2025/9" not in works
    assert {w for w in works if w.startswith("UNASSIGNED_")} == {"UNASSIGNED_LS_REC_3", "UNASSIGNED_LS_REC_4", "UNASSIGNED_RS_EXP_1"}
    assert works["UNASSIGNED_LS_REC_4"].work_description == 'With "quotes" and\na line break'
    assert works["UNASSIGNED_LS_REC_3"].recommended_date is None and works["UNASSIGNED_LS_REC_3"].is_unmatched_work


def test_ledger_allocation_calamity(result):
    tables = result[0]
    ledger = {r.expenditure_id: r for r in tables.ledger.collect()}
    assert (ledger["EXP_LS_1"].vendor_name, ledger["EXP_LS_1"].amount) == ("V1", 10.0)
    assert (ledger["EXP_LS_2"].vendor_name, ledger["EXP_LS_2"].payment_status) == ("Unknown Vendor", "Completed")
    assert (ledger["EXP_RS_1"].work_id, ledger["EXP_RS_1"].amount) == ("UNASSIGNED_RS_EXP_1", None)
    limits = {r.mp_id: r for r in tables.allocation.collect()}
    assert (limits["MP_LS_1"].mp_name, limits["MP_LS_1"].allocated_amount, limits["MP_LS_1"].constituency) == ("C D", 40567400.0, "SEAT 2")
    assert (limits["MP_RS_1"].elected_nominated, limits["MP_RS_1"].constituency) == ("Nominated MP", None)
    consents = {r.calamity_id: r for r in tables.calamity.collect()}
    assert (consents["CAL_LS_1"].mp_name, consents["CAL_LS_1"].consent_date, consents["CAL_LS_1"].consent_amount) == ("G H", dt.date(2025, 12, 7), 7067400.0)
    assert (consents["CAL_RS_1"].mp_name, consents["CAL_RS_1"].consent_date) == ("I J", None)


def test_missing_export_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_raw(spark, str(tmp_path / "nowhere"))


def test_header_search():
    names = ["Completion Date", "MP Name", "Amount A", "Consent Amount"]
    assert find_column(names, [], ["member", "mp"]) == "Completion Date"
    assert find_column(names, ["MP Name"], ["mp"]) == "MP Name"
    assert find_column(names, [], ["amount"], last=True) == "Consent Amount"
    assert find_column(names, [], ["state"]) is None


def test_positions_over_many_files_and_blocks(spark, tmp_path):
    """Positions follow the file order however the files are split into blocks."""
    from spendaudit.sources.raw import clean_rows, number_rows, read_raw_csv

    folder = tmp_path / "parts"
    folder.mkdir()
    count = 0
    for part in range(3):
        rows = [f"{count + i},{'x' * 50}" for i in range(400)]
        count += 400
        (folder / f"part-{part}.csv").write_text("id,text\n" + "\n".join(rows) + "\nGrand Total, \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = number_rows(clean_rows(read_raw_csv(spark, str(folder))), "positions")
        rows = df.selectExpr("cast(id as long) id", "row_pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == count and all(r.row_pos == r.id + 1 for r in rows)


@pytest.mark.parametrize("block", ["64", "300", "1000000"])
def test_quoted_line_breaks_in_any_blocks(spark, tmp_path, block):
    """Records with line breaks, quotes, commas and blank lines read like a whole-file reader does, however a file is cut."""
    import csv
    import random

    from spendaudit.sources.raw import number_rows, read_raw_csv

    pick, pieces, want = random.Random(5), ["a", "b c", '"', ",", "\n", "\n\n", "x\ny,z", '"q"', "\"\n\"", ""], []
    folder = tmp_path / "export"
    folder.mkdir()
    for part in range(2):
        rows = [[f"{part}-{i}", "".join(pick.choices(pieces, k=pick.randrange(6))).strip(), "end"] for i in range(150)]
        with open(folder / f"p{part}.csv", "w", newline="") as f:
            f.write("id,text,last\r\n" if part else "id,text,last\n")
            csv.writer(f, lineterminator="\r\n" if part else "\n").writerows(rows)
            f.write("\n")
        want += [(r[0], r[1] or None, r[2]) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        df = number_rows(read_raw_csv(spark, str(folder)), "breaks")
        got = [(r.id, r.text or None, r["last"]) for r in df.orderBy("row_pos").collect()]
        places = sorted(r.row_pos for r in df.select("row_pos").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [g[0] for g in got] == [w[0] for w in want] and places == list(range(1, 301))
    assert got == want


def test_unreadable_cells_are_counted(spark):
    rows = [("1", "2025-12-07", "Rs. 5"), ("2", "someday", "12d"), ("3", None, "x"), ("4", "07-Dec-25", None)]
    df = spark.createDataFrame(rows, "Work string, `Sanction Date` string, `Sanction AMOUNT` string")
    found = {(r.house, r.kind, r.column): r.unreadable for r in unreadable_cells({("LS", "sanctioned"): df}).collect()}
    assert found == {("LS", "sanctioned", "Sanction Date"): 1, ("LS", "sanctioned", "Sanction AMOUNT"): 2}


def test_byte_order_mark_before_quoted_header(spark, tmp_path):
    from spendaudit.sources.raw import read_raw_csv

    path = tmp_path / "bom.csv"
    path.write_text('﻿"id","a\nlong name"\n"1","x"\n"2","y\nz"\n', encoding="utf-8")
    rows = read_raw_csv(spark, str(path)).orderBy("record").collect()
    assert [(r[0], r[1]) for r in rows] == [("1", "x"), ("2", "y\nz")]


def test_an_unclosed_quote_costs_its_own_file_only(spark, tmp_path):
    """Also rows of white space, missing and surplus cells, and files that tasks share in another order than their names."""
    from spendaudit.sources.raw import clean_rows, number_rows, read_raw_csv

    texts = {"a": "1,x\n2,y\n", "b": '3,z\n4,"never closed\n5,x\n6,y\n', "c": "   \n,\n7\n8,u,surplus\n" + "9,v\n" * 300, "d": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text("id,text\n" + text)
    df = number_rows(clean_rows(read_raw_csv(spark, str(tmp_path))), "unclosed")
    rows = [(r.row_pos, r.id, r.text) for r in df.orderBy("row_pos").collect()]
    assert [r[0] for r in rows] == list(range(1, 308))
    assert [r[1:] for r in rows[:4]] == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "never closed\n5,x\n6,y")]
    assert [r[1:] for r in rows[4:8]] == [(None, None), ("7", None), ("8", "u"), ("9", "v")]


def test_exports_are_written_once(spark, tmp_path):
    """One scan of the files, no window and no sort of rows, before they are stored."""
    from spendaudit.sources.raw import clean_rows, read_raw_csv

    (tmp_path / "a.csv").write_text("id,text\n1,x\n")
    plan = clean_rows(read_raw_csv(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and plan.count("FileScan csv") == 1
