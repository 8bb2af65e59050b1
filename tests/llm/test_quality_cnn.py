import zlib

import numpy as np
import pytest

from spendaudit.llm.quality_cnn import (
    BLOCK, FILTERS, WIDTH, Network, as_bytes, block_maxima, combine, fit, held_out, keep_good, pooled, score_documents, scorer, train, training_rows,
)
from tests.llm.conftest import prose


def junk(seed, n):
    return " ".join(w + "###" for w in prose(seed, n).split())


@pytest.fixture
def network():
    random = np.random.default_rng(1)
    return Network(random.normal(0, 1, (WIDTH, 256, FILTERS)).astype(np.float32), random.normal(0, 1, FILTERS), random.normal(0, 1, 3 * FILTERS), 0.1)


def slow_score(text, net):
    data = as_bytes(text)
    answers = np.array([sum(net.filters[j][data[i + j]] for j in range(WIDTH)) for i in range(len(data) - WIDTH + 1)])
    blocks = [answers[i : i + BLOCK].max(0) for i in range(0, len(answers), BLOCK)]
    chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:])] or blocks
    return combine(np.array(chunks), net)


def test_scores_equal_a_plain_convolution(network):
    score = scorer(network)
    for text in (None, "", "a", prose(1, 10), prose(2, 300), "é" * 500):
        assert score(text) == pytest.approx(slow_score(text, network), abs=1e-5)


def test_pieces_do_not_change_the_score(network, monkeypatch):
    from spendaudit.llm import quality_cnn

    data = as_bytes(prose(3, 2000))
    whole = block_maxima(data, network.pair_tables())
    monkeypatch.setattr(quality_cnn, "PIECE", 4 * BLOCK)
    assert np.array_equal(whole, block_maxima(data, network.pair_tables()))
    assert len(pooled(whole)) == len(whole) - 1


def test_learns_and_holds_out(spark, make_docs):
    rows = [(i, prose(i, 60) if i % 2 else junk(i, 60)) for i in range(400)]
    docs = make_docs(*rows, (None, "x"), (1000, None))
    # Labels of held-out rows are wrong on purpose: they must not be learned from.
    away = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, (i % 2) ^ away(i), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    net = train(docs, labels)
    scored = score_documents(docs, net)
    found = {r.doc_id: r for r in scored.collect()}
    assert len(found) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    assert all(found[i].predicted == i % 2 for i in range(400))
    kept = keep_good(docs, net)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 2}
    flags = {r.doc_id: r.h for r in docs.select("doc_id", held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(flags[i] == away(i) for i in range(400)) and flags[None] is False


def test_the_sample_is_bounded(spark, make_docs):
    docs = make_docs(*[(i, prose(i, 3000) if i < 3 else "t") for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] * 2, "doc_id long, quality int, toxic int")
    rows = training_rows(docs, labels, most_rows=40).collect()
    assert len(rows) == 40 and sum(r.label for r in rows) == 20
    assert all(1 <= len(r.segments) <= 6 and all(len(s) <= 1024 for s in r.segments) for r in rows)


def test_labels_of_one_kind_and_none(spark, make_docs):
    docs = make_docs("a", "b", "")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_documents(docs, train(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.99 for r in score_documents(docs, train(docs, ones)).collect())
    assert score_documents(make_docs(), train(make_docs(), none)).collect() == []


def test_fit_is_repeatable():
    texts, labels = [[prose(i, 30).encode()] for i in range(20)], [i % 2 for i in range(20)]
    a, b = (fit(texts, labels, epochs=2, least_steps=5) for _ in range(2))
    assert np.array_equal(a.filters, b.filters) and np.array_equal(a.weights, b.weights)
