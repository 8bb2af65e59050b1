import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendaudit.functions import text
from spendaudit.sources.raw import clean_rows


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_amounts(spark):
    written = ["4,05,67,400", "Rs. 12.5", "₹ 7", "Rs9", "abc", "", None, "Rs. 4,05,67,400.50", " 1e3 ", "nan", "-5", "12d", "12f", "0x1p3", "1_000", "inf", "\t12\n", "\u00a0 7.", ".5", "+3"]
    assert apply(spark, text.parse_amount, written) == [40567400.0, 12.5, 7.0, 9.0, None, None, None, 40567400.5, 1000.0, None, -5.0, None, None, None, None, None, 12.0, 7.0, 0.5, 3.0]


def test_dates(spark):
    written = ["07-Dec-2025", "07-DEC-2025", " 7-dec-2025 ", "2025-12-07", "2025-12-7", "12/07/2025", "12-07-2025", "2025-12-07 10:11:12", "2025-12-07T10:11:12.5"]
    assert apply(spark, text.parse_date, written) == [dt.date(2025, 12, 7)] * 9
    assert apply(spark, text.parse_date, ["13/12/2025", "13-12-2025"]) == [dt.date(2025, 12, 13)] * 2
    assert apply(spark, text.parse_date, ["junk", "", None, "2025-13-07", "31-Feb-2025", "on 2025-12-07", "07-Dec-2"]) == [None] * 7


def test_more_date_forms(spark):
    written = [
        "07-Dec-25", "2025/12/07", "7 December 2025", "07-December-2025", "Dec 7, 2025", "December 7, 2025", "12.07.2025", "20251207", "2025-12-07T10:11:12Z",
        "07-Dec-2025 10:00 AM", "7 Dec 2025", "\t2025-12-07\n", "2025-12-07 10:11:12+05:30",
    ]
    assert apply(spark, text.parse_date, written) == [dt.date(2025, 12, 7)] * len(written)
    assert apply(spark, text.parse_date, ["1-Jan-95", "1-Jan-69", "1-Jan-68"]) == [dt.date(y, 1, 1) for y in (1995, 1969, 2068)]
    assert apply(spark, text.parse_date, ["13.12.2025", "1-May-2025", "1 May 2025", "May 1, 2025"]) == [dt.date(2025, 12, 13)] + [dt.date(2025, 5, 1)] * 3


def test_white_space_of_all_kinds(spark):
    assert apply(spark, text.normalize_state, ["Kerala\n", "\tKerala", "\u00a0kerala\u2003"]) == ["Kerala"] * 3
    assert apply(spark, text.blank_to_null, [" \n ", "\u00a0", " x\ty\n"]) == [None, None, "x\ty"]


def test_work_ids(spark):
    written = [
        "WS/MP12/2024-2025/99", " ws / MP 12 / 2024 / 7 text", "x WS/AB_1/2024/5.", "none", None, "",
        "WS/MP1/2024/1 and WS/MP2/2024-2025/2", "AWS/MP1/2024/1",
    ]
    assert apply(spark, text.extract_work_id, written) == [
        "WS/MP12/2024-2025/99", "WS/MP12/2024/7", "WS/AB_1/2024/5", None, None, None, "WS/MP2/2024-2025/2", None,
    ]


def test_member_names(spark):
    written = [
        "Dr. Asha Kumari Rao (2022-28) (2022-2028)", "SHRI N PILLAI", "Shri NK Pillai", "o'brien k.c.", "Smt. P. T. Devi",
        "Hon'ble Shri X", None, "DR A B", "Drona Das",
    ]
    assert apply(spark, text.normalize_member, written) == [
        "Asha Kumari Rao", "N Pillai", "Nk Pillai", "O'Brien K.C.", "P. T. Devi", "Shri X", "Unknown MP", "A B", "Drona Das",
    ]


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=126)), min_size=1, max_size=20))
def test_title_case_like_python(spark, values):
    assert apply(spark, text.title_case, values) == [v.title() for v in values]


def test_states(spark):
    written = ["ORISSA", "jammu & kashmir", "  goa ", None]
    assert apply(spark, text.normalize_state, written) == ["Odisha", "Jammu And Kashmir", "Goa", "Unknown State"]
    assert apply(spark, text.display_state, ["Jammu And Kashmir", "Goa", None]) == ["Jammu & Kashmir", "Goa", None]
    assert text.state_from_display("jammu & KASHMIR") == "Jammu And Kashmir"


def test_member_id(spark):
    import hashlib

    want = "MP-" + hashlib.sha1("Lok Sabha|A B".encode()).hexdigest()[:10].upper()
    assert spark.range(1).select(text.member_id(F.lit("Lok Sabha"), F.lit("A B"))).first()[0] == want
    empty = "MP-" + hashlib.sha1(b"|").hexdigest()[:10].upper()
    nothing = F.lit(None).cast("string")
    assert spark.range(1).select(text.member_id(nothing, nothing)).first()[0] == empty


def test_total_rows_and_blanks(spark):
    rows = [
        ("1", "Total repair of drains"), ("2", "Totally new"), ("Grand Total", " "), (" grand  TOTAL ", "x"),
        ("3", " nan "), ("4", "None"), ("5", "   "), ("6", " kept "), ("7", "subtotal"),
    ]
    df = spark.createDataFrame(rows, "`Sr. No.` string, text string")
    kept = [tuple(r) for r in clean_rows(df).collect()]
    assert kept == [("2", "Totally new"), ("3", None), ("4", None), ("5", None), ("6", "kept"), ("7", "subtotal")]
    strict = [r[0] for r in clean_rows(df, strict_totals=True).collect()]
    assert strict == ["1", "2", "3", "4", "5", "6", "7"]


def test_tokens(spark):
    written = ["Construction of C.C. Road at Ward-7, S.No-8 near Éta", "Of the", "B a  aa AAA 12 aaa", ""]
    assert apply(spark, text.description_tokens, written) == [["7", "8"], [], ["12", "aaa", "aaa"], []]


@settings(max_examples=30, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=40), min_size=1, max_size=20))
def test_tokens_like_python(spark, values):
    import re

    from spendaudit.fixed_values import DESCRIPTION_STOP_WORDS

    values = [v.replace("\x00", "").encode("utf-8", "ignore").decode() for v in values]
    # characters whose lower case is longer or ASCII differ between languages; they are not words here
    values = [v for v in values if all(len(c.lower()) == 1 and (ord(c) < 128 or ord(c.lower()) > 127) for c in v)]

    def words(v):
        plain = re.sub(r"[^a-z0-9 ]", " ", v.lower())
        return sorted(w for w in plain.split() if w not in DESCRIPTION_STOP_WORDS and (w.isdigit() or len(w) > 2))

    assert apply(spark, text.description_tokens, values) == [words(v) for v in values]


def test_reasons_codec(spark):
    values = [json.dumps(["a: b", 'q"x', "₹1"]), "not json", None, "[]"]
    assert apply(spark, lambda c: text.decode_reasons(c, True), values) == [["a: b", 'q"x', "₹1"], ["not json"], [], []]
    assert apply(spark, lambda c: text.decode_reasons(c, False), values)[1] == []
    round_trip = lambda c: text.decode_reasons(text.encode_reasons(F.array(c, F.lit("x"))), False)
    assert apply(spark, round_trip, ["a\nb"]) == [["a\nb", "x"]]


@pytest.mark.parametrize("value", [0.25, 0.35, 2.675, 42.254999999999995, 1234.5, 0.05, 99.95, 3.0])
def test_number_texts_like_python(spark, value):
    row = spark.range(1).select(
        text.one_decimal(F.lit(value)), text.plain_number(F.lit(value)), text.money(F.lit(value)),
        text.round_printed(F.lit(value), 2),
    ).first()
    assert list(row) == [f"{value:.1f}", str(round(value, 2)), f"{value:,.2f}", round(value, 2)]


def test_round_scaled_like_numpy(spark):
    import numpy as np

    values = np.round(np.random.default_rng(5).uniform(0, 100, 3000), 2).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text.round_scaled(F.col("v"), 1)).collect()]
    assert got == np.round(np.array(values), 1).tolist()


@pytest.mark.parametrize("written, wanted", [
    (["13/07/2025", "07/12/2025", "1/2/2025 10:30"], ["2025-07-13", "2025-12-07", "2025-02-01"]),  # one day above 12 settles it
    (["07/13/2025", "07/12/2025", "1-2-2025"], ["2025-07-13", "2025-07-12", "2025-01-02"]),
    (["07/12/2025", "1.2.2025", "x"], ["2025-07-12", "2025-01-02", None]),  # both orders are as good
    (["13/07/2025", "07/13/2025", "1/2/2025"], ["2025-07-13", "2025-07-13", "2025-01-02"]),  # the other order is tried, too
    (["2025-01-02", "02-Jan-2025", None], ["2025-01-02", "2025-01-02", None]),
])
def test_order_of_dates_by_file(spark, written, wanted):
    from spendaudit.sources.raw import settle_date_order

    df = spark.createDataFrame([(i, t, "07/12/2025") for i, t in enumerate(written)], "row_pos long, `Sanction Date` string, status string")
    settled = settle_date_order(df)
    found = settled.select(text.parse_date(F.col("`Sanction Date`")).cast("string").alias("d"), "status").collect()
    assert [r.d for r in found] == wanted and settled.columns == df.columns and {r.status for r in found} == {"07/12/2025"}
    assert settle_date_order(df.limit(0)).collect() == [] and settle_date_order(df.select("status")).columns == ["status"]
