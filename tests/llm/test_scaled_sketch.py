import hashlib
import random

import numpy as np
import pytest

from spendaudit.llm import scaled_sketch as module
from spendaudit.llm.jaccard_join import shingles
from spendaudit.llm.scaled_sketch import compare_with_next, containment, fingerprint, fingerprint_documents, group_sketches, likeness, merged, parsed, sketch
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, fingerprint string, range int, kind int"


def hashes(text):
    return set((shingles(text) >> np.uint64(16)).tolist())


def brute_sketch(text):
    """Threshold and kept hashes, from all hashes of the text."""
    every = sorted(hashes(text))
    below = [h for h in every if h < module.RANGE // module.SCALE]
    if len(below) >= module.LEAST:
        return module.RANGE // module.SCALE, below
    if len(every) <= module.LEAST:
        return module.RANGE, every
    return every[module.LEAST - 1] + 1, every[: module.LEAST]


def written(text):
    threshold, kept = brute_sketch(text)
    return f"{threshold:x}:" + "".join(f"{h:012x}" for h in kept)


def brute_likeness(a, b):
    (s, x), (t, y) = brute_sketch(a), brute_sketch(b)
    low = min(s, t)
    p, q = {h for h in x if h < low}, {h for h in y if h < low}
    return len(p & q) / len(p | q) if p | q else float(not x and not y)


def brute(rows):
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(text), written(edited), brute_likeness(text, edited), brute_likeness(text, following)))
    return out


def compared(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(7)
    return [tuple(r)[:7] for r in compare_with_next(docs).orderBy("doc_id", ascending=False).collect()]


def test_equal_to_brute_force(spark):
    pick = random.Random(3)
    texts = [prose(i, pick.choice([1, 3, 5, 6, 40, 300, 1500])) for i in range(150)] + [None, "", " \n", "Ünï cödé 日本 words here and more", "one"]
    pick.shuffle(texts)
    texts[50] = texts[49]
    rows = [(1000 - 3 * i, t) for i, t in enumerate(texts)]
    assert compared(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_documents(spark, n):
    rows = [(9 - i, prose(i, 100)) for i in range(n)]
    assert compared(spark, rows) == brute(rows)


def test_empty_table_null_and_repeated_ids(spark):
    assert compared(spark, []) == []
    found = compared(spark, [(None, prose(1, 50)), (None, prose(2, 50)), (4, prose(3, 50)), (4, prose(4, 50)), (4, prose(4, 50))])
    assert [r[0] for r in found] == [4, 4, 4, None, None] and len({r[3] for r in found if r[0] == 4}) == 2
    assert any(r[6] == 1.0 for r in found)  # the equal rows are neighbours


def test_very_long_text(spark):
    rows = [(2, prose(1, 60_000)), (1, "short " * 3)]
    assert compared(spark, rows) == brute(rows)


def test_estimates_of_unequal_texts():
    part = prose(1, 2000)
    whole = prose(2, 12_000) + " " + part + " " + prose(3, 12_000)
    a, b = sketch(part), sketch(whole)
    truth = len(hashes(part) & hashes(whole)) / len(hashes(part))
    assert abs(containment(a, b) - truth) < 0.05 and containment(b, a) < 0.15 and likeness(a, b) < 0.15
    assert containment(a, sketch(prose(9, 5000))) == 0 and likeness(a, a) == 1.0
    assert likeness(sketch(""), sketch(None)) == 1.0 and likeness(sketch(""), a) == containment(sketch(""), a) == containment(a, sketch("")) == 0


def test_merging_is_the_sketch_of_the_union():
    texts = [prose(i, 900) for i in range(4)]
    total = sketch(texts[0])
    for t in texts[1:]:
        total = merged(total, sketch(t))
    union = set().union(*map(hashes, texts))
    assert set(total[1].tolist()) == {h for h in union if h < module.RANGE // module.SCALE} and total[0] == module.RANGE // module.SCALE
    for t in [*texts, "", "one two"]:
        threshold, kept = parsed(fingerprint(sketch(t)))
        assert (threshold, kept.tolist()) == (sketch(t)[0], sketch(t)[1].tolist()) and fingerprint((threshold, kept)) == written(t)


def test_fingerprints_and_groups(spark, make_docs):
    texts = [prose(i % 5, 700) for i in range(20)] + [None, ""]
    docs = make_docs(*texts)
    found = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len(found) == 22 and all(found[i].fingerprint == written(t) for i, t in enumerate(texts))
    rows = group_sketches(docs, "lang").collect()
    wanted = {h for t in texts for h in hashes(t) if h < module.RANGE // module.SCALE}
    assert len(rows) == len(wanted) and {r.hash for r in rows} == wanted and {r.group for r in rows} == {"en"}
