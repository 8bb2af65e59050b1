import datetime as dt
import os
import re
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest

from spendaudit.config import AuditConfig
from spendaudit.fixed_values import DESCRIPTION_STOP_WORDS
from spendaudit.operators import duplicates as dup

D = dt.date
#: Texts meet in blocks and are compared by their matching stretches.
BLOCKS = AuditConfig(meet="blocks", text_measure="ratio")


def words(text):
    return sorted(w for w in re.sub(r"[^a-z0-9 ]", " ", text.lower()).split() if w not in DESCRIPTION_STOP_WORDS and (w.isdigit() or len(w) > 2))


def brute(rows):
    """All tiers by comparing every work with every other one."""
    rows = [r for r in rows if r["work_description"] and r["work_description"].strip()]
    groups, blocks = {}, {}
    for r in rows:
        r["words"] = words(r["work_description"])
        r["text"] = " ".join(r["words"])
        if r["text"] and r["sanctioned_amount"] is not None and r["sanction_date"]:
            groups.setdefault((r["mp_name"] or "", r["text"], r["sanctioned_amount"], r["sanction_date"]), []).append(r)
        for kind, words_met in (("first", r["words"][:4]), ("last", r["words"][-4:])):
            blocks.setdefault((r["mp_name"] or "", r["constituency"] or "", kind, tuple(words_met)), []).append(r)
    exact = {tuple(r["work_id"] for r in g) for g in groups.values() if len(g) == 2}
    batches = {tuple(r["work_id"] for r in g) for g in groups.values() if len(g) >= 3}
    met = {(a["work_id"], b["work_id"]): (a, b) for block in blocks.values() for a, b in combinations(block, 2)}
    scanned = len(met.keys() - exact)
    first = {}
    for r in rows:
        r["near"] = r["sanction_date"] or r["recommended_date"]
        first.setdefault((r["mp_name"] or "", r["constituency"] or "", r["text"], r["sanctioned_amount"], r["near"]), r["work_id"])
    similar = {}
    for (i, j), (a, b) in met.items():
        if i not in first.values() or j not in first.values():
            continue  # shown by the first work of its node
        ratio = SequenceMatcher(None, a["text"], b["text"]).ratio()
        x, y = a["sanctioned_amount"], b["sanctioned_amount"]
        if not 0.85 <= ratio < 0.999 or not x or not y or 1 - abs(x - y) / max(x, y) < 0.95:
            continue
        if a["near"] and b["near"] and abs((a["near"] - b["near"]).days) <= 30:
            similar[(i, j)] = round(ratio * 100, 1)
    return exact, batches, similar, scanned


def ids(df):
    return {(r.a, r.b): r.similarity_score for r in df.selectExpr("work_a.work_id a", "work_b.work_id b", "similarity_score").collect()}


def check(df, rows):
    found = dup.find_duplicates(df, BLOCKS)
    exact, batches, similar, scanned = brute(rows)
    pairs = found.pairs.persist()
    assert ids(pairs.filter("tier = 'A'")) == {p: 100.0 for p in exact}
    assert ids(pairs.filter("tier = 'B'")) == similar
    assert {(r.batch_id, r.unit_count) for r in found.batches.collect()} == {(b[0], len(b)) for b in batches}
    assert {(r.batch_id, r.work_id) for r in found.batch_works.collect()} == {(b[0], w) for b in batches for w in b}
    assert dup.candidate_count(dup.prepare(df, BLOCKS)).first()[0] == scanned
    return found


def test_tiers_around_their_limits(make_works):
    base = "Laying of pipeline from school to temple at site {}"
    day, far = D(2023, 1, 1), D(2023, 1, 31)
    rows = [
        {"work_id": "a1", "work_description": "Tube well, Rampur"}, {"work_id": "a2", "work_description": "TUBE-WELL at Rampur"},
        *[{"work_id": f"c{i}", "work_description": "LED poles", "mp_name": "M2"} for i in range(3)],
        {"work_id": "n1", "work_description": "Tube well, Rampur", "sanctioned_amount": None},
        {"work_id": "b1", "work_description": base.format("zalpha"), "sanction_date": day, "mp_name": "M3", "sanctioned_amount": 1000.0},
        {"work_id": "b2", "work_description": base.format("zalphax"), "sanction_date": far, "mp_name": "M3", "sanctioned_amount": 950.0},
        {"work_id": "b3", "work_description": base.format("zalphay"), "sanction_date": D(2023, 2, 1), "mp_name": "M3", "sanctioned_amount": 949.9},
        {"work_id": "b4", "work_description": base.format("zalphaz"), "sanction_date": None, "recommended_date": day, "mp_name": "M3", "sanctioned_amount": 1000.0},
        {"work_id": "b5", "work_description": base.format("zalphaz"), "sanction_date": day, "mp_name": "M3", "constituency": "Other", "sanctioned_amount": 1000.0},
        {"work_id": "b6", "work_description": base.format("zalphaq"), "sanction_date": day, "mp_name": "M3", "sanctioned_amount": 0.0},
        {"work_id": "e1", "work_description": "  "}, {"work_id": "e2", "work_description": None}, {"work_id": "e3", "work_description": "of the"}, {"work_id": "e4", "work_description": "Of The"},
        {"work_id": "z1", "work_description": base.format("zalpha"), "mp_name": None, "constituency": None}, {"work_id": "z2", "work_description": base.format("zalphb"), "mp_name": None, "constituency": None},
    ]
    works = make_works(*rows)
    found = check(works, [r.asDict() for r in works.orderBy("row_order").collect()])
    pairs = {(r.work_a.work_id, r.work_b.work_id): r for r in found.pairs.collect()}
    assert ("b1", "b2") in pairs and ("b1", "b3") not in pairs and ("b1", "b4") in pairs and ("a1", "a2") in pairs
    assert pairs[("b1", "b2")].matching_fields[-1] == "Same constituency" and pairs[("a1", "a2")].label == "Potential Duplicate"
    assert len(pairs[("z1", "z2")].matching_fields) == 4  # a missing constituency is not the same one
    assert {r.work_id for r in dup.duplicate_ids(found.members).collect()} >= {"a1", "a2", "b1", "b2"}
    best = {r.work_id: r for r in dup.matches_per_work(found.pairs, found.members).collect()}
    assert (best["a1"].other, best["a1"].tier, best["a1"].matches) == ("a2", "A", 1)
    summary = dup.duplicate_summary(found).first()
    assert (summary.potential_duplicate_pairs, summary.batch_pattern_groups, summary.works_in_batch_patterns) == (1, 1, 3)


@pytest.mark.parametrize("size", [60, 61, 200])
def test_no_block_is_too_large(make_works, size):
    text = "Laying pipeline from school towards temple number"
    rows = [{"work_id": f"w{i:03d}", "work_description": f"{text} zone{chr(97 + i % 26)}{chr(97 + i // 26)}"} for i in range(size)]
    prepared = dup.materialize(dup.prepare(make_works(*rows), BLOCKS), "prepared")
    assert dup.candidate_pairs(prepared).count() == size * (size - 1) // 2
    assert dup.candidate_count(prepared).first()[0] == size * (size - 1) // 2
    assert dup.similar_pairs(prepared, BLOCKS).count() == size * (size - 1) // 2


def test_texts_that_differ_in_an_early_word_meet(make_works):
    rows = [{"work_id": "w1", "work_description": "aaaa culvert library pipeline school temple"}, {"work_id": "w2", "work_description": "aaab culvert library pipeline school temple"}]
    assert ids(dup.pair_record(dup.similar_pairs(dup.prepare(make_works(*rows), BLOCKS), BLOCKS))).keys() == {("w1", "w2")}


def test_alike_works_are_one_node(make_works):
    text = "Laying pipeline from school towards temple zone"
    rows = [{"work_id": f"{x}{i}", "work_description": text + x} for i in range(40) for x in "pq"]
    found = dup.find_duplicates(make_works(*rows), BLOCKS)
    pair = found.pairs.filter("tier = 'B'").collect()
    assert [(r.work_a.work_id, r.work_b.work_id, r.works_a, r.works_b) for r in pair] == [("p0", "q0", 40, 40)]
    assert {r.work_id for r in dup.duplicate_ids(found.members).collect()} == {r["work_id"] for r in rows}
    best = {r.work_id: (r.other, r.matches) for r in dup.matches_per_work(found.pairs, found.members).collect()}
    assert best["p7"] == ("q0", 40) and best["q9"] == ("p0", 40)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(make_works, seed):
    rng = np.random.default_rng(seed)
    parts = ["pipeline", "school", "temple", "culvert", "drain", "library", "toilet"]
    rows = []
    for i in range(250):
        chosen = rng.choice(parts, 5, replace=False).tolist()
        tail = "".join(rng.choice(list("abc"), 4))
        rows.append({
            "work_id": f"w{i:03d}", "work_description": " ".join(["aaaa bbbb cccc", *chosen[:2], "site", tail]), "mp_name": str(rng.choice(["M", "N"])),
            "constituency": [None, "C"][int(rng.random() < 0.6)], "sanctioned_amount": float(rng.choice([1000.0, 980.0, 951.0, 950.0, 940.0, 0.0])),
            "sanction_date": [None, D(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 70)))][int(rng.random() < 0.8)], "recommended_date": D(2023, 1, 15),
        })
    works = make_works(*rows)
    _, _, similar, _ = brute([r.asDict() for r in works.orderBy("row_order").collect()])
    assert similar and ids(dup.pair_record(dup.similar_pairs(dup.prepare(works, BLOCKS), BLOCKS))) == similar


def test_candidate_search_reads_no_texts(make_works):
    prepared = dup.materialize(dup.prepare(make_works({"work_id": "a"}, {"work_id": "b"})), "prepared")
    blocks = dup.nodes(prepared)._jdf.queryExecution().executedPlan().toString()
    pairs = dup.candidate_pairs(prepared)._jdf.queryExecution().executedPlan().toString()
    assert "normtext" not in blocks + pairs and "work_description" not in blocks + pairs
    assert "CartesianProduct" not in pairs and "NestedLoop" not in pairs


def test_large_batches_are_listed_whole(make_works):
    rows = [{"work_id": f"w{i:03d}", "work_description": "LED poles"} for i in range(120)] + [{"work_id": f"v{i}", "work_description": "Bench"} for i in range(3)]
    found = dup.find_duplicates(make_works(*rows), BLOCKS)
    assert [(r.batch_id, r.unit_count) for r in dup.list_batches(found.batches).collect()] == [("w000", 120), ("v0", 3)]
    assert [r.batch_id for r in dup.list_batches(found.batches, limit=1, offset=1).collect()] == ["v0"]
    assert found.batch_works.filter("batch_id = 'w000'").count() == 120


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_whole_documents_against_brute_force(spark):
    from spendaudit.plans.bindings import document_works

    works = document_works(spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in works.orderBy("row_order").collect()]
    _, _, similar, _ = brute(rows)
    assert similar and ids(dup.pair_record(dup.similar_pairs(dup.prepare(works, BLOCKS), BLOCKS))) == similar


def test_word_measure_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a b c", "a b d"), ("", ""), ("a a b", "b a"), ("x", "y")], "l string, r string")
    rated = df.select(dup.word_ratio("l", "r").alias("ratio"))
    assert [r.ratio for r in rated.collect()] == [2 / 3, 0.0, 1.0, 0.0]
    assert "Python" not in rated._jdf.queryExecution().executedPlan().toString()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(above + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_of_all(rows, measure):
    """All pairs of first works of nodes within member and seat, by nothing but the definition."""
    first = {}
    for r in rows:
        r["words"] = words(r["work_description"] or "")
        r["near"] = r["sanction_date"] or r["recommended_date"]
        if (r["work_description"] or "").strip() and (r["sanctioned_amount"] or 0) > 0 and r["near"]:
            first.setdefault((r["mp_name"] or "", r["constituency"] or "", tuple(r["words"]), r["sanctioned_amount"], r["near"]), r)
    found = {}
    for a, b in combinations(first.values(), 2):
        x, y = set(a["words"]), set(b["words"])
        s, t = " ".join(a["words"]), " ".join(b["words"])
        close = 1 - abs(a["sanctioned_amount"] - b["sanctioned_amount"]) / max(a["sanctioned_amount"], b["sanctioned_amount"]) >= 0.95
        if (a["mp_name"], a["constituency"] or "") != (b["mp_name"], b["constituency"] or "") or not close or abs((a["near"] - b["near"]).days) > 30 or s == t or not x or not y:
            continue
        ratio = dice = 2 * len(x & y) / (len(x) + len(y))
        if measure == "edits":
            ratio = 1 - edit_distance(s, t) / max(len(s), len(t)) if dice >= 0.7 else 0
        if 0.85 <= ratio < 0.999:
            found[(a["work_id"], b["work_id"])] = round(ratio * 100, 1)
    return found


@pytest.mark.parametrize("measure", ["words", "edits"])
def test_all_similar_texts_meet(make_works, measure):
    """Texts of all lengths that differ at the start, in the middle and at the end; frequent and rare words; repeated works."""
    rng = np.random.default_rng(5)
    common, rare = ["pipeline", "school", "temple", "culvert", "drain", "library"], [f"zone{i}x" for i in range(40)]
    rows = []
    for i in range(320):
        if i < 20 or rng.random() < 0.3:
            text = [*rng.choice(common, rng.integers(0, 6), replace=False), *rng.choice(rare, rng.integers(0, 9), replace=False)]
        else:
            text = list(rows[rng.integers(0, len(rows))]["words"])
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(text) + 1)
                text[at : at + rng.integers(0, 2)] = [[], [str(rng.choice(rare))], ["aaab"], ["zzzy"]][rng.integers(0, 4)]
            if text and rng.random() < 0.4:
                text[0] = text[0] + "s"
        rows.append({
            "work_id": f"w{i:03d}", "words": text, "mp_name": str(rng.choice(["M", "N"])), "constituency": [None, "C"][int(rng.random() < 0.7)],
            "sanctioned_amount": float(rng.choice([1000.0, 980.0, 951.0, 0.0])), "sanction_date": D(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 40))),
        })
    works = make_works(*[{**{k: v for k, v in r.items() if k != "words"}, "work_description": " ".join(r["words"])} for r in rows])
    config = AuditConfig(text_measure=measure)
    assert config.meet == "words"
    wanted = brute_of_all([r.asDict() for r in works.orderBy("row_order").collect()], measure)
    prepared = dup.materialize(dup.prepare(works, config), "prepared")
    assert len(wanted) > 40 and ids(dup.pair_record(dup.similar_pairs(prepared, config))) == wanted
    blocks = AuditConfig(text_measure=measure, meet="blocks")
    assert len(ids(dup.pair_record(dup.similar_pairs(dup.prepare(works, blocks), blocks)))) < len(wanted)  # what the blocks miss
    both = AuditConfig(text_measure=measure, meet="both")
    assert ids(dup.pair_record(dup.similar_pairs(prepared, both))) == wanted


def test_edits_of_long_texts_are_those_of_the_jvm(spark):
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 5, 63, 64, 65, 300, 2000]
    rows = [("".join(rng.choice(list("ab c"), rng.choice(sizes))), "".join(rng.choice(list("abd "), rng.choice(sizes)))) for _ in range(150)]
    rows += [(x, x[: len(x) // 2] + "q" + x[len(x) // 2 + 2 :]) for x, _ in rows] + [("é" * 70 + "a", "a" + "é" * 70)]
    df = spark.createDataFrame(rows, "a string, b string")
    wrong = df.select(dup.edits_of_long_texts("a", "b").alias("n"), dup.edits("a", "b", dup.F.lit(10_000)).alias("m")).filter("n <> m OR n IS NULL")
    assert wrong.count() == 0


def test_edits_of_many_long_texts_are_counted_side_by_side(spark, monkeypatch):
    """Within and beyond the limit, for windows of one and of many words, in groups and one by one."""
    from spendaudit.functions import edits

    rng = np.random.default_rng(11)
    rows = []
    for size in (40, 90, 700, 1500):
        for _ in range(40):
            text = list(rng.choice(list("abcdefghij "), size))
            for at in rng.integers(0, size, rng.integers(0, size // 4)):
                text[at] = str(rng.choice(["", "k", "lm", "a"]))
            rows.append(("".join(rng.choice(list("abcdefghij "), size)) if rng.random() < 0.1 else "".join(text), "".join(text[: size // 3] + text[size // 3 + int(rng.integers(0, size // 8)) :]) + "xyz" * int(rng.integers(0, 9))))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("most", dup.F.floor(dup.F.greatest(dup.F.length("a"), dup.F.length("b")) * 0.15)).repartition(2).persist()
    for words, small in ((8, 0), (1, 0), (1, 10**9)):  # the last one counts pair by pair
        monkeypatch.setattr(edits, "WORDS", words)
        monkeypatch.setattr(edits, "SMALL_GROUP", small)
        got = df.select("most", dup.edits_of_long_texts("a", "b").alias("n"), dup.edits_of_long_texts("a", "b", dup.F.col("most")).alias("limited"), dup.edits("a", "b", dup.F.lit(10_000)).alias("m")).collect()
        assert all(r.n == r.m and r.limited == (r.m if r.m <= r.most else -1) for r in got)
        assert {r.limited < 0 for r in got} == {True, False}


def test_the_audit_compares_texts_in_the_jvm(make_works):
    rows = [{"work_id": f"w{i}", "work_description": f"Laying pipeline from school towards temple number zone{c}"} for i, c in enumerate("abc")]
    prepared = dup.materialize(dup.prepare(make_works(*rows)), "prepared")
    found = dup.materialize(dup.meeting_pairs(prepared, AuditConfig()), "found")
    plan = dup.text_pair_ratios(found, prepared, AuditConfig())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and text.count("levenshtein") == 1 and len(plan.collect()) == 3  # each pair is compared once
    met = dup.overlapping_pairs(prepared, 0.85)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in met and "CartesianProduct" not in met and "NestedLoop" not in met


def test_a_frequent_word_brings_no_texts_together(make_works):
    """Texts that have only frequent words in common don't meet."""
    rows = [{"work_id": f"w{i:03d}", "work_description": f"pipeline school temple unique{i} other{i} third{i} fourth{i} fifth{i}"} for i in range(300)]
    prepared = dup.materialize(dup.prepare(make_works(*rows)), "prepared")
    assert dup.overlapping_pairs(prepared, 0.85).count() == 0 and dup.rare_words(prepared, 0.85).count() == 0


def test_letter_bounds(spark):
    df = spark.createDataFrame([("abca 1", "cab 12"), ("", "a")], "l string, r string")
    counts = df.select(dup.letter_counts("l").alias("x"), dup.letter_counts("r").alias("y"))
    assert [r.n for r in counts.select(dup.common_letters("x", "y").alias("n")).collect()] == [5, 0]


@pytest.mark.parametrize("config", [BLOCKS, AuditConfig(meet="words", text_measure="words"), AuditConfig(meet="both")])
def test_pairs_of_nodes_are_formed_once_and_never_made_distinct(make_works, config):
    """Texts that meet in many words and in both signatures; works on both sides of the borders between bins."""
    text = "aaaa bbbb cccc culvert library pipeline school temple wall yard"
    rows = [
        {"work_id": f"w{i:03d}", "work_description": f"{text} zone{'abc'[i % 3]}", "sanctioned_amount": 1000.0 * 1.01 ** (i % 17), "sanction_date": D(2023, 1, 1) + dt.timedelta(days=7 * (i % 11))}
        for i in range(150)
    ]
    prepared = dup.materialize(dup.prepare(make_works(*rows), config), "prepared")
    formed = dup.similar_nodes(prepared, config)
    plan = formed._jdf.queryExecution().executedPlan().toString()
    assert "normtext" not in plan and "Aggregate" not in plan
    found = [(r.work_id_a, r.work_id_b) for r in formed.collect()]
    wanted = {(r.work_id_a, r.work_id_b) for r in dup.meeting_pairs(prepared, config).collect()}
    assert len(wanted) > 100 and len(found) == len(set(found)) and set(found) == wanted
    listed = dup.similar_pairs(prepared, config, briefs=False)
    assert listed.select("work_a.*").columns == ["work_id"] and listed.count() == len(wanted)


def unlike_texts(n, size, rng):
    """Texts with the same first four sorted words, a third of all words in common and the rest from a small vocabulary."""
    shared, words = [f"aaa{i}" for i in range(size // 3)], [f"zone{i}x" for i in range(8 * size)]
    return [" ".join([*shared, *rng.choice(words, size - len(shared), replace=False)]) for _ in range(n)]


@pytest.mark.parametrize(("measure", "meet"), [("words", "blocks"), ("words", "words"), ("edits", "blocks"), ("edits", "words")])
@pytest.mark.parametrize("size", [60, 700])
def test_texts_with_few_words_in_common_are_never_read_as_pairs(make_works, measure, meet, size):
    rng = np.random.default_rng(2)
    config = AuditConfig(text_measure=measure, meet=meet)
    texts = unlike_texts(40, size, rng)
    rows = [{"work_id": f"w{i:03d}", "work_description": x} for i, x in enumerate([*texts, texts[0] + " two more words"])]
    prepared = dup.materialize(dup.prepare(make_works(*rows), config), "prepared")
    met = dup.meeting_texts(prepared, config)
    assert 1 <= met.count() <= 20  # of 820 pairs that agree in their first words
    assert "normtext" not in met._jdf.queryExecution().executedPlan().toString()
    assert ids(dup.pair_record(dup.similar_pairs(prepared, config))).keys() == {("w000", "w040")}


@pytest.mark.parametrize("most", [8000, 3])
def test_long_texts_in_parts_against_brute_force(make_works, monkeypatch, most):
    """Sets of words on both sides of the sizes from which more bits are kept, around the least similarity, with repeated works."""
    monkeypatch.setattr(dup, "PART_TEXTS", most)
    rng = np.random.default_rng(4)
    words = np.array([f"zone{i}x" for i in range(4000)])
    rows = []
    for size in (20, 490, 520, 1000, 1030):
        base = rng.choice(words, size, replace=False)
        for i in range(6):
            text = [*base[rng.permutation(size)[: int(size * (1 - 0.05 * i))]], *rng.choice(words, int(size * 0.03 * i), replace=False)]
            for day in (1, 40)[: 1 + i % 2]:
                rows.append({
                    "work_id": f"w{len(rows):03d}", "work_description": " ".join(text), "constituency": None,
                    "sanctioned_amount": float(1000 * 1.02 ** (i % 4)), "sanction_date": D(2023, 1, 1) + dt.timedelta(days=day),
                })
    works = make_works(*rows)
    config = AuditConfig(text_measure="words")
    wanted = brute_of_all([r.asDict() for r in works.orderBy("row_order").collect()], "words")
    assert len(wanted) > 20 and ids(dup.pair_record(dup.similar_pairs(dup.prepare(works, config), config, briefs=False))) == wanted


@pytest.mark.parametrize(("measure", "meet"), [("words", "words"), ("words", "blocks"), ("edits", "words")])
def test_paired_works_are_found_without_their_pairs(make_works, monkeypatch, measure, meet):
    """Points where all texts are similar and where only some are; works alone in their cell, beside others and on the limits; exact pairs."""
    rng = np.random.default_rng(8)
    base = [f"word{i:02d}x" for i in range(16)]
    texts = [[*base[:i], f"new{i}", f"other{i}", *base[i + 2 :]] for i in range(0, 16, 2)] + [base, [*base[:15], "last"], [*base[:14], "new14", "next"]]
    rows = [
        {
            "work_id": f"w{i:03d}", "work_description": " ".join(texts[rng.integers(0, len(texts))]), "mp_name": str(rng.choice(["M", "N"])), "constituency": [None, "C"][i % 2],
            "sanctioned_amount": float(rng.choice([0.0, 950.0, 1000.0, 1052.0, 1110.0, 3000.0, 9000.0])), "sanction_date": D(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 400))),
        }
        for i in range(260)
    ]
    config = AuditConfig(text_measure=measure, meet=meet)
    prepared = dup.materialize(dup.prepare(make_works(*rows, {**rows[0], "work_id": "x"}), config), "prepared")
    texts, some = dup._points(dup.similar_texts(prepared, config))
    assert (some.count() > 0 or meet == "blocks") and texts.filter("all_alike").count() > 0
    wanted = {r.work_id for r in dup.duplicate_ids(dup.find_duplicates(make_works(*rows, {**rows[0], "work_id": "x"}), config, briefs=False).members).collect()}
    monkeypatch.setattr(dup, "similar_nodes", None)  # which lists the pairs
    assert 10 < len(wanted) < 260 and {r.work_id for r in dup.paired_work_ids(prepared, config).collect()} == wanted


def dense_works(make_works):
    """Two texts a word apart, a third that is far from both, exact pairs and a batch; far more pairs than works."""
    base = "culvert pipeline school temple drainage library wall yard"
    texts = [f"{base} amber", f"{base} azure", "Bench; with other words than all of them"]
    rows = [
        {"work_id": f"w{i:03d}", "work_description": texts[i % 2], "sanctioned_amount": 1000.0 + i % 5, "sanction_date": D(2023, 1, 1) + dt.timedelta(days=i % 29)}
        for i in range(150)
    ]
    rows += [{"work_id": f"x{i}", "work_description": texts[2], "sanctioned_amount": 5.0 + i // 2 % 2, "constituency": None} for i in range(7)]
    return make_works(*rows, {"work_id": "n", "work_description": " "}, {"work_id": "m", "work_description": texts[0], "sanctioned_amount": None})


def test_pairs_of_similar_works_are_written_nowhere(make_works, monkeypatch):
    from spendaudit.plans import queries

    works = dense_works(make_works)
    found = dup.find_duplicates(works, queries.WORDS, briefs=False)
    listed = {(r.a, r.b) for r in found.pairs.filter("tier = 'B'").selectExpr("work_a.work_id a", "work_b.work_id b").collect()}
    best = {tuple(r) for r in dup.matches_per_work(found.pairs, found.members).select("work_id", "tier", "similarity_score", "matches").collect()}
    summary = tuple(dup.duplicate_summary(found).first())
    written, write = {}, dup.materialize

    def recorded(df, name):
        table = write(df, name)
        written[name] = table.count()
        return table

    monkeypatch.setattr(dup, "materialize", recorded)
    monkeypatch.setattr(queries.bindings, "similar_works", lambda spark, folder: works)
    spark = works.sparkSession
    pairs = [(r.id_a, r.id_b) for r in queries.similar_work_pairs(spark, "dense").collect()]
    assert len(pairs) > 1000 and len(pairs) == len(listed) and set(pairs) == listed
    assert {tuple(r) for r in queries.similar_work_matches(spark, "dense").collect()} == best
    assert tuple(queries.similar_work_summary(spark, "dense").first()) == summary
    assert written and max(written.values()) <= 2 * works.count()


def test_repeated_descriptions_are_prepared_alike(make_works):
    works = dense_works(make_works)
    for config in (BLOCKS, AuditConfig(text_measure="words")):
        once, each = dup.prepare(works, config, repeated=True), dup.prepare(works, config)
        assert once.columns == each.columns and once.count() == 158 and once.exceptAll(each).count() == 0 and each.exceptAll(once).count() == 0
