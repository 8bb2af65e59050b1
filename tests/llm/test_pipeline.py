import hashlib
import importlib
import os
import re
import subprocess
import sys

import pytest

import corpus_pipeline
from spendaudit.llm.decontaminate import keep_clean
from spendaudit.llm.line_dedup import cut_lines, line_hashes
from spendaudit.llm.quality_cnn import THRESHOLD, scorer, train
from spendaudit.llm.queries import model_file
from tests.llm.conftest import prose

FOLDER = "/root/testdata/sf0.001"
ITEM = prose(900, 25)


@pytest.fixture
def folder(spark, tmp_path):
    """Good prose and junk, copies, shared blocks, near copies, benchmark passages, nulls."""
    good = {i: prose(i, 120) for i in range(60)}
    junk = {100 + i: " ".join(w + "$$$" for w in prose(i, 120).split()) for i in range(60)}
    block = "\n".join(prose(700 + k, 15) for k in range(3))
    rows = good | junk
    rows[200] = good[3]
    rows[201] = prose(201, 40) + "\n" + block
    rows[202] = prose(202, 40) + "\n" + block
    rows[203] = " ".join([*good[4].split()[:60], "edited", *good[4].split()[60:]])
    rows[204] = prose(204, 50) + " " + ITEM + " " + prose(205, 50)
    rows[205], rows[206] = None, ""
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in good | junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    quality, lines, near, clean, encoded = seen.values()
    assert not any(100 <= i < 160 for i in quality) and set(range(60)) <= set(quality) and {200, 201, 202, 203, 204} <= set(quality)
    assert 200 not in lines and lines[202].text == prose(202, 40) and lines[201].text.endswith(prose(702, 15))
    assert 203 not in near and set(near) == set(lines) - {203}
    assert set(near) - set(clean) == {204}
    assert set(encoded) == set(clean) and all(r.round_trip for r in encoded.values())


def test_decontamination_goes_by_the_row(spark, folder):
    """Rows without an id, and rows that share one, stay or go by their own texts."""
    clean, hit = prose(210, 60), prose(211, 30) + " " + ITEM
    rows = [(None, hit, "a"), (None, clean, "b"), (7, hit, "c"), (7, clean, "d"), (8, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.hash for r in kept.collect()) == ["b", "d", "e", "f"]
    assert {tuple(r) for r in kept.collect()} == {r for r in rows if r[1] != hit}
    several = keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), most_bytes=300)  # more than one automaton
    assert sorted(r.hash for r in several.collect()) == ["b", "d", "e", "f"]


def brute_lines(rows, least=10):
    """Every stretch of lines with enough words that a document with a smaller id has is cut; what is only such stretches goes."""
    stretches, out = {}, []
    for doc_id, text in rows:
        hashes, words = line_hashes(text or "") if doc_id is not None else ([], [])
        spans = [(a, b) for a in range(len(hashes)) for b in range(a + 1, len(hashes) + 1) if sum(words[a:b]) >= least]
        for a, b in spans:
            key = tuple(hashes[a:b])
            stretches[key] = min(stretches.get(key, doc_id), doc_id)
        out.append((doc_id, text, hashes, spans))
    kept = []
    for doc_id, text, hashes, spans in out:
        cut = {k for a, b in spans if stretches[tuple(hashes[a:b])] < doc_id for k in range(a, b)}
        edited = cut_lines(text, cut) if cut else text
        if not cut or edited:
            kept.append((doc_id, edited))
    return kept


def brute_near(rows):
    """All pairs compared; of each component, the rows of its least id stay."""

    def shingle_set(text):
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [(doc_id, shingle_set(text)) for doc_id, text in rows if doc_id is not None]
    into = {doc_id: doc_id for doc_id, _ in sets}

    def root(i):
        while into[i] != i:
            i = into[i]
        return i

    for i, x in sets:
        for j, y in sets:
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((root(i), root(j)))
                into[b] = a
    return [(doc_id, text) for doc_id, text in rows if doc_id is None or root(doc_id) == doc_id]


def brute_clean(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return [(doc_id, text) for doc_id, text in rows if not hit(text)]


def test_run_equals_brute_force(spark, folder, tmp_path):
    """All five stages restated, over null and repeated ids, repeated rows, empty texts and columns with clashing names."""
    import sentencepiece

    block = "\n".join(prose(800 + k, 6) for k in range(4))  # lines too short to be a block on their own
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows += [(None, prose(300, 80)), (None, prose(301, 30) + " " + ITEM.upper()), (None, None), (None, prose(5, 120))]
    rows += [(310, prose(310, 90)), (310, prose(311, 90)), (310, prose(311, 90))]  # an id with several texts, and a repeated row
    rows += [(320, f"{prose(320, 40)}\n{block}"), (321, f"{block}\n{prose(321, 40)}"), (322, f"{prose(322, 60)}\n{prose(800, 6)}"), (323, block)]
    chain = prose(330, 200).split()
    rows += [(330 + k, " ".join(chain[8 * k :] + prose(340 + k, 8 * k).split())) for k in range(4)]  # each near the one before
    rows += [(350, "\n".join([prose(350, 12)] * 3)), (351, f"x y\n{prose(350, 12)}\nz"), (352, " \n\t"), (353, "short text")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash long, cut string, score double, label int, component_id long"
    target = str(tmp_path / "odd")
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), 7, "c", 0.5, 1, 3) for i, t in rows], schema)
    docs.repartition(6).write.parquet(f"{target}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")
    stored = spark.read.parquet(f"{target}/documents.parquet")
    score = scorer(train(stored.select("doc_id", "text"), spark.read.parquet(f"{target}/labels.parquet")))
    stages = [[(i, t) for i, t in rows if score(t) >= THRESHOLD]]
    stages.append(brute_lines(stages[-1]))
    stages.append(brute_near(stages[-1]))
    stages.append(brute_clean(stages[-1], [ITEM]))
    assert len(rows) > len(stages[0]) > len(stages[1]) > len(stages[2]) > len(stages[3]) > 60  # each stage decides something
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    wanted = []
    for doc_id, text in stages[-1]:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        wanted.append((doc_id, len(ids), *digests, ids))
    found = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in corpus_pipeline.run(spark, target).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    seen = stored
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, target)
        assert seen.columns == stored.columns, name


def test_run_equals_the_stages_and_an_empty_table_stays_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 55
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_workers_get_the_package(tmp_path):
    """A program elsewhere that only its driver can import the package from."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from spendaudit.llm.license_rules import license_scan
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
print("found", license_scan(docs).first().licences)
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=120)
    assert "found MIT" in done.stdout, done.stderr[-2000:]


@pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables")
def test_entry_works_without_the_package(monkeypatch):
    import __spark_entry__ as entry

    with_llm = set(entry.queries())
    assert "pipeline" in with_llm and "op1_compression_bands" in with_llm
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        with pytest.raises(ModuleNotFoundError):
            importlib.import_module("corpus_pipeline")
    finally:
        monkeypatch.undo()
    assert importlib.reload(entry).queries().keys() == with_llm
