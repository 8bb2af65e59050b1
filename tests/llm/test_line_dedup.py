import random

from pyspark.sql import functions as F

from spendaudit.llm.line_dedup import common_lines, common_runs, cut_lines, dedup_lines, least_runs, line_hashes, patience
from tests.llm.conftest import prose


def run(docs, **options):
    return {r.doc_id: r for r in dedup_lines(docs, flag="n_cut", **options).collect()}


def test_patience_aligns_unique_lines_in_order():
    assert patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert patience([5, 1, 5, 2, 5], [1, 5, 2]) == [(1, 0), (2, 1), (3, 2)]
    assert patience([1, 2, 3], [3, 2, 1]) in ([(0, 2)], [(1, 1)], [(2, 0)])
    assert patience([], [1]) == [] and patience([1], []) == []
    pick = random.Random(3)
    for _ in range(200):
        a, b = ([pick.randrange(12) for _ in range(pick.randrange(15))] for _ in range(2))
        found = patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_blocks_go_from_the_later_document_only(make_docs):
    shared = "\n".join(prose(k, 12) for k in range(3))
    docs = make_docs((5, prose(10, 20) + "\n" + shared + "\n" + prose(11, 20)), (9, prose(12, 20) + "\n" + shared + "\nshort line"), (7, prose(13, 30)))
    got = run(docs)
    assert got[5].n_cut == 0 and got[7].n_cut == 0
    assert got[9].text == prose(12, 20) + "\nshort line" and got[9].n_cut == 3
    assert got[9].lang == "en" and got[9].score == 0.5


def test_short_blocks_and_blank_lines_stay(make_docs):
    got = run(make_docs("one two three\n" + prose(1, 20), "one two three\n" + prose(2, 20), prose(3, 12) + "\n\n" + prose(4, 12), "x\n" + prose(3, 12) + "\n\n" + prose(4, 12)))
    assert got[1].n_cut == 0
    assert got[3].text == "x\n" and got[3].n_cut == 2


def test_odd_rows(make_docs):
    copy = prose(5, 40)
    docs = make_docs((1, copy), (1, copy), (2, copy), (None, copy), (3, None), (4, ""), (5, "\n \n"), (6, "\n".join([copy] * 3)), (7, "a b"), (8, "a b"))
    rows = dedup_lines(docs, flag="n_cut").collect()
    got = sorted((r.doc_id or -1, r.text, r.n_cut) for r in rows if r.text is not None)
    assert [r.text for r in rows if r.doc_id == 3] == [None] and len(rows) == 10
    assert got == [(-1, copy, 0), (1, copy, 0), (1, copy, 0), (2, "", 1), (4, "", 0), (5, "\n \n", 0), (6, "", 3), (7, "a b", 0), (8, "a b", 0)]


def test_random_documents_match_brute_force_whatever_is_rare(make_docs):
    pick = random.Random(8)
    pool = [prose(100 + k, pick.randrange(1, 14)) for k in range(60)]
    texts = {i: "\n".join(pick.choice(pool) for _ in range(pick.randrange(1, 12))) for i in range(120)}
    copied = [texts[k] for k in range(0, 120, 9)]
    texts |= {200 + k: t for k, t in enumerate(copied)}
    docs, want = make_docs(*texts.items()), every_block(texts)
    for rare_holders in (1000, 6, 0):  # pairs by single lines only, by both, by runs only
        assert {i: r.text for i, r in run(docs, rare_holders=rare_holders).items()} == want


def test_common_runs_match_brute_force():
    pick = random.Random(4)
    for _ in range(300):
        a, b = ([pick.randrange(4) for _ in range(pick.randrange(14))] for _ in range(2))
        words = [pick.randrange(1, 6) for _ in a]
        held = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        want = {}
        for j in range(1, len(a) + 1):
            if starts := [i for i in range(j) if tuple(a[i:j]) in held]:
                want[j] = starts[0]
        got = common_runs(a, b, words)
        assert {i + n: i for _, i, _, n, _ in got} == want
        for w, i, j, n, kind in got:
            assert a[i : i + n] == b[j : j + n] and w == sum(words[i : i + n])
            assert all((tuple(a[i : i + n]) == tuple(a[k : k + m])) == (kind == other) for _, k, _, m, other in got)


def test_alignment_leaves_no_common_block():
    pick = random.Random(5)
    for _ in range(2000):
        size = pick.choice((3, 6, 20))
        a, b = ([pick.randrange(size) for _ in range(pick.randrange(25))] for _ in range(2))
        weight = [pick.randrange(1, 13) for _ in range(size)]
        words = [weight[h] for h in a]
        held = {tuple(b[i:j]) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        spans = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a) + 1) if sum(words[i:j]) >= 10]
        assert common_lines(a, b, words, 10) == sorted({k for i, j in spans if tuple(a[i:j]) in held for k in range(i, j)})
        found = patience(a, b, words, 10)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_every_cut_comes_from_an_alignment(monkeypatch):
    hashes, words = [7, 8, 9, 7, 8], [10] * 5
    assert common_lines(hashes, [9, 7, 8], words, 10) == [0, 1, 2, 3, 4]
    calls = []
    monkeypatch.setattr("spendaudit.llm.line_dedup.patience", lambda *given: calls.append(given) or patience(*given))
    assert common_lines([1, 2, 3, 4], [3, 4, 1, 2], [10] * 4, 10) == [0, 1, 2, 3] and len(calls) == 2  # once more for the other order
    assert patience([1, 2, 1, 2, 3, 3], [3, 3, 1, 2, 1, 2], [10] * 6, 10) == [(0, 2), (1, 3), (2, 4), (3, 5)]  # a gap without unique lines


def test_long_documents_in_other_orders_and_with_repeats():
    lines = list(range(4000))
    random.Random(2).shuffle(lines)
    assert len(common_lines(lines, list(range(4000)), [10] * 4000, 10)) == 4000
    assert len(common_lines(lines[::-1], lines, [10] * 4000, 10)) == 4000
    assert len(common_lines([1] * 20_000, [1] * 300, [10] * 20_000, 10)) == 20_000
    assert len(common_lines([1, 2] * 10_000, [0, 1, 2], [5] * 20_000, 10)) == 20_000


def test_one_line_in_every_document(make_docs):
    line = prose(50, 15)
    docs = make_docs(*[f"{line}\n{prose(1000 + i, 20)}" for i in range(300)])
    got = run(docs, rare_holders=5)
    assert got[0].n_cut == 0 and all(got[i].text == prose(1000 + i, 20) for i in range(1, 300))


def test_long_document_and_empty_table(make_docs):
    long = "\n".join(prose(k, 8) for k in range(3000))
    got = run(make_docs(long, "x\n" + long))
    assert got[1].text == "x"
    assert dedup_lines(make_docs()).collect() == []
    assert dedup_lines(make_docs("a")).columns == ["doc_id", "text", "lang", "score"]
    assert dedup_lines(make_docs().withColumn("hash", F.lit(1)).withColumn("cut", F.lit(2))).columns[-2:] == ["hash", "cut"]


def test_blocks_go_whoever_holds_their_lines_singly(make_docs):
    a, b = prose(600, 12), prose(601, 12)
    short = [prose(620 + k, 4) for k in range(4)]
    docs = {1: a, 2: b, 3: f"x\n{a}\n{b}", 4: f"{b}\ny\n{a}"} | {
        11: "\n".join([*short[2:], "z", *short[:2]]), 12: "\n".join(short), 13: "\n".join([*short, "w"]),
        31: prose(630, 5), 32: prose(631, 5), 33: prose(630, 5) + "\n" + prose(631, 5), 34: prose(630, 5) + "\n" + prose(631, 5) + "\nv",
    }
    got = {i: r.text for i, r in run(make_docs(*docs.items())).items()}
    assert got[3] == "x" and got[4] == "y"  # each line is a block of its own
    assert got[12] == docs[12] and got[13] == "w"  # 11 has the lines in another order and in pieces under ten words
    assert got[33] == docs[33] and got[34] == "v"  # 31 and 32 have the lines singly


def test_least_runs_match_brute_force():
    pick = random.Random(1)
    for _ in range(500):
        n = [pick.randrange(1, 14) for _ in range(pick.randrange(12))]
        spans = [(i, j) for i in range(len(n)) for j in range(i + 1, len(n) + 1) if sum(n[i:j]) >= 10]
        starts, ends = {i for i, _ in spans}, {j for _, j in spans}
        want = {(i, min(j for k, j in spans if k == i)) for i in starts} | {(max(i for i, k in spans if k == j), j) for j in ends}
        assert least_runs(n, 10) == sorted(want)


def test_lines_of_many_holders_and_rows_that_repeat_an_id(make_docs):
    line, copy = prose(50, 15), prose(5, 40)
    got = run(make_docs(*[f"{line}\n{prose(1000 + i, 20)}" for i in range(300)]))
    assert got[0].n_cut == 0 and all(got[i].text == prose(1000 + i, 20) for i in range(1, 300))
    docs = make_docs((1, copy), (1, copy), (2, copy), (None, copy), (3, None), (4, ""), (5, "\n \n"), (7, "a b"), (8, "a b"))
    rows = dedup_lines(docs, flag="n_cut").collect()
    assert sorted((r.doc_id or -1, r.text or "", r.n_cut) for r in rows) == [
        (-1, copy, 0), (1, copy, 0), (1, copy, 0), (2, "", 1), (3, "", 0), (4, "", 0), (5, "\n \n", 0), (7, "a b", 0), (8, "a b", 0),
    ]
    assert dedup_lines(make_docs()).collect() == []


def every_block(texts, least=10):
    """Every stretch of lines with enough words that any earlier document has, by comparing all stretches."""
    lines = {i: line_hashes(t) for i, t in texts.items()}
    seen, out = set(), {}
    for i in sorted(texts):
        hashes, words = lines[i]
        spans = [(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes) + 1) if sum(words[a:b]) >= least]
        cut = {k for a, b in spans if tuple(hashes[a:b]) in seen for k in range(a, b)}
        out[i] = cut_lines(texts[i], cut) if cut else texts[i]
        seen |= {tuple(hashes[a:b]) for a, b in spans}
    return out


def test_no_common_block_is_left(make_docs):
    pick = random.Random(8)
    pool = [prose(100 + k, pick.randrange(1, 14)) for k in range(60)]
    texts = {i: "\n".join(pick.choice(pool) for _ in range(pick.randrange(1, 12))) for i in range(120)}
    texts |= {200 + k: texts[9 * k] for k in range(14)}
    few = [prose(300 + k, pick.randrange(2, 7)) for k in range(6)]  # lines that repeat on both sides
    texts |= {300 + i: "\n".join(pick.choice(few) for _ in range(12)) for i in range(30)}
    got = {i: r.text for i, r in run(make_docs(*texts.items())).items()}
    assert got == every_block(texts)


def test_other_orders_and_repeats_of_blocks(make_docs):
    a, b, c = (prose(640 + k, 12) for k in range(3))
    docs = make_docs((1, f"{a}\n{b}\n{c}"), (2, f"{c}\nx\n{b}\n{a}"), (3, "\n".join([a] * 3)), (4, f"{c}\n{c}\ny\n{c}"), (5, f"{a}\n{b}\n{c}"))
    got = {i: r.text for i, r in run(docs).items()}
    assert got[2] == "x" and got[3] == "" and got[4] == "y" and got[5] == ""
    hashes = list(range(500))  # far more blocks than one rising chain
    assert common_lines(hashes[::-1], hashes, [10] * 500, 10) == hashes
