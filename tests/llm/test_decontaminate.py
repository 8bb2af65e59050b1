import re

import pytest

from spendaudit.llm.decontaminate import decontaminate, items_digest
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, width=10):
    words, hit, met = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        windows = [own[i : i + width] for i in range(max(1, len(own) - width + 1))] if own else []
        for w in windows:
            for at in range(len(words) - len(w) + 1):
                if words[at : at + len(w)] == w:
                    hit |= set(range(at, at + len(w)))
                    met.add(item)
    return len(words), len(hit), sorted(met)


ITEMS = [(1, prose(1, 30)), (2, "Short item, here!"), (3, None), (4, " .,"), (5, prose(1, 12)), (5, prose(1, 12)), (None, prose(2, 30)), (6, "Ünï cödé Ä"), (7, "a a a")]
TEXTS = [
    None, "", "...", prose(3, 50) + " " + prose(1, 30) + " " + prose(4, 20), "a short -- ITEM (here) and short item here", "shorts item here",
    "ünï CÖDÉ ä x", "Ünï cödé Ä", "a a a a a b a a", prose(2, 30), prose(1, 9), "x" * 5000 + " " + prose(1, 11).upper(), prose(5, 20000) + " " + prose(1, 30),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most_bytes", [1 << 20, 300])
def test_hits_match_brute_force(make_docs, benchmark, most_bytes):
    docs = make_docs(*TEXTS, (50, TEXTS[3]), (50, TEXTS[3]))
    rows = decontaminate(docs, benchmark, most_bytes=most_bytes).collect()
    assert len(rows) == len(TEXTS) + 2
    named = [(i, t) for i, t in ITEMS if i is not None]
    for r in rows:
        text = TEXTS[3 if r.doc_id == 50 else r.doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == brute(text, named), text


def test_spans_are_places_in_the_original(make_docs, benchmark):
    text = "Well: a SHORT -- item? (HERE) ok"
    row = decontaminate(make_docs(text), benchmark).collect()[0]
    assert [text[s.start : s.end] for s in row.spans] == ["SHORT -- item? (HERE"]
    assert [list(s["items"]) for s in row.spans] == [[2]]


def test_empty_tables(make_docs, benchmark, spark):
    assert decontaminate(make_docs(), benchmark).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(make_docs("some text"), none).collect()] == [0]


def test_digest_sorts_as_text():
    import hashlib

    assert items_digest([9, 10]) == hashlib.sha256(b"10,9").hexdigest()
