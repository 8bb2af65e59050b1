import random
from itertools import combinations

import pytest

from spendaudit.llm import jaccard_join
from spendaudit.llm.components import component_labels
from spendaudit.llm.jaccard_join import keep_first, similar_classes
from tests.llm.conftest import prose


def brute(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def run(docs):
    rows = similar_classes(docs).collect()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(found) == len(rows)
    return found


def edited(words, pick, n):
    words = list(words)
    for _ in range(n):
        words[pick.randrange(len(words))] = f"edit{pick.randrange(10**6)}"
    return words


def corpus(seed):
    """Chains of edits, copies, a passage in many documents, documents of nearly the passage alone."""
    pick = random.Random(seed)
    texts, passage = {}, prose(999, 60).split()
    for k in range(12):
        words = prose(seed * 100 + k, pick.randrange(30, 200)).split()
        for _ in range(pick.randrange(2, 8)):
            texts[len(texts)] = " ".join(words)
            words = edited(words, pick, pick.randrange(0, 4))
    for k in range(25):
        own = prose(5000 + seed * 100 + k, pick.randrange(2, 60)).split()
        at = pick.randrange(len(own))
        texts[len(texts)] = " ".join(own[:at] + passage + own[at:])
    order = list(texts.values())
    pick.shuffle(order)
    return dict(enumerate(order))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_match_brute_force(make_docs, seed):
    texts = corpus(seed)
    assert run(make_docs(*texts.items())) == brute(texts)


def test_small_limits_change_nothing(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 3000)
    monkeypatch.setattr(jaccard_join, "SPOOL_BYTES", 1000)
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "SLICE_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "REMEMBERED", 10)
    texts = corpus(7)
    assert run(make_docs(*texts.items())) == brute(texts)


def test_the_limit_itself(make_docs):
    # 16 and 12 shingles, 12 common: exactly 3/4; one less is not linked.
    words = [f"w{i}" for i in range(20)]
    texts = {1: " ".join(words), 2: " ".join(words[:16]), 3: " ".join(f"v{i}" for i in range(20)), 4: " ".join(f"v{i}" for i in range(15))}
    assert run(make_docs(*texts.items())) == {1: (16, 1), 2: (12, 1), 3: (16, 3), 4: (11, 4)} == brute(texts)


def test_odd_rows(make_docs):
    texts = {1: None, 2: "", 3: " \n\t", 4: "a b", 5: "A B", 6: "a  b\n", 7: "a b c d e", 8: "Ä b", 9: "ä b", 10: "x y z", 11: "x y"}
    assert run(make_docs(*texts.items())) == brute(texts)
    got = run(make_docs((1, prose(1, 50)), (1, prose(1, 50)), (2, prose(1, 50)), (None, prose(1, 50))))
    assert got == {1: (46, 1), 2: (46, 1)}
    assert run(make_docs()) == {}


def test_many_near_copies_and_long_texts(make_docs):
    pick = random.Random(5)
    base = prose(6, 60).split()
    texts = {i: " ".join(edited(base, pick, 1)) for i in range(300)} | {i: " ".join(base) for i in range(300, 400)}
    texts[500] = prose(9, 30000)
    texts[501] = texts[500] + " end"
    got = run(make_docs(*texts.items()))
    want = brute({i: t for i, t in texts.items() if i >= 500})
    assert got[500] == want[500] and got[501] == want[501]
    assert {c for i, (_, c) in got.items() if i >= 300 and i < 400} == {0}
    assert {i: c for i, c in got.items() if i < 300} == {i: c for i, c in brute({k: t for k, t in texts.items() if k < 300 or k == 300}).items() if i < 300}


def test_first_of_each_group_stays(make_docs):
    docs = make_docs((3, prose(1, 40)), (2, prose(1, 40)), (8, "other words here"), (9, None), (None, prose(1, 40)))
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 8, 9]


def test_component_labels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (100, 95), (7, 7), (200, 200)], "a long, b long")
    found = {r.node: r.component for r in component_labels(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert component_labels(spark.createDataFrame([], "a long, b long")).collect() == []
