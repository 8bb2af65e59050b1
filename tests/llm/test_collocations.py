import random
import re
from collections import Counter

import numpy as np
import pytest

from spendaudit.llm import collocations as module
from spendaudit.llm.collocations import collocations, frequent_words, merged, tile_counts, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) straight from the definition."""
    f, n = {}, Counter()
    for text, lang in docs:
        counter = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                counter.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, counter in f.items():
        long = {p: a for p, a in counter.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in long.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in long.items() if set(p) <= set(q)):
                continue
            cuts = [(1_000_000 * a * a // (counter[p[:k]] * counter[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counter[p[:k]], counter[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def made(seed, n, vocabulary=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Über", "don't", "x y", "日本", "The", "tHE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    ends = [" "] * 12 + ["\t", "  ", ". ", "\n", ", ", "; ", "!", "\r\n", "\x0b"]
    out = []
    for _ in range(n):
        if pick.random() < 0.15:
            out += [pick.choice(["strong tea cup", "new york", "as well as", "red  tape\ttoday"])]
        out.append(pick.choices(words, weights)[0])
    return "".join(w + pick.choice(ends) for w in out)


def rows_of(spark, docs, **options):
    table = spark.createDataFrame([(t, lang, i, "x") for i, (t, lang) in enumerate(docs)], "text string, lang string, n long, word string")
    return sorted(tuple(r) for r in collocations(table.repartition(3), **options).collect())


DOCS = [(made(i, 400), ["en", "de", None][i % 3]) for i in range(9)] + [(None, "en"), ("", "fr"), ("?!\n", "fr"), (made(0, 400), "en")]


def test_equal_to_brute_force(spark):
    found = rows_of(spark, DOCS)
    assert found == brute(DOCS) and {r[0] for r in found} == {"en", "de", "und"}
    assert any(len(r[2].split(" ")) == 3 for r in found) and not any(r[2] == "strong tea" for r in found)
    assert rows_of(spark, DOCS, least_count=5, top=7) == brute(DOCS, 5, 7)


def test_no_place_of_their_own_and_small_bitmaps(spark):
    """Words beyond the ranked ones, and bitmaps that let everything pass, give the same rows."""
    assert rows_of(spark, DOCS, direct=3, most_bits=1) == brute(DOCS)
    assert rows_of(spark, DOCS, direct=0) == brute(DOCS)


def test_small_chunks_tiles_and_memories(spark):
    """All bounds reached at once: every text crosses them, also in the middle."""
    names = {"CHUNK": 50, "LISTED": 40, "KNOWN": 30, "STRETCH": 64, "SIDE": 4, "ACROSS": 3, "SPARSE": 8, "_BITMAP": 32768}
    texts = spark.createDataFrame([(lang or "und", bytearray((t or "").encode())) for t, lang in DOCS], "lang string, text binary")

    def counted(width, told):
        """Partial counts of one task with these bounds, summed."""
        small = dict(names)

        def bounded(df, schema):
            return df

        batches = texts.toArrow().to_batches()
        kept = {k: getattr(module, k) for k in small}
        try:
            for k, v in small.items():
                setattr(module, k, v)
            captured = {}

            class Texts:
                def mapInArrow(self, run, schema):
                    captured["run"] = run
                    return texts.sparkSession.createDataFrame([], schema)

            module.phrase_counts(Texts(), width, told, 1)
            total, parts = Counter(), 0
            for out in captured["run"](batches):
                parts += 1
                for row in out.to_pylist():
                    total[(row["lang"], *(row[f"k{i + 1}"] for i in range(width)))] += row["n"]
            return total, parts
        finally:
            for k, v in kept.items():
                setattr(module, k, v)

    class Told:
        value = {"words": [b"w0", b"w1", b"w2"], "rest": np.full(4096, 255, np.uint8), "seed": 0, "frequent": np.full(4096, 255, np.uint8), "pairs": np.array([(2 << 21) | 3, (2 << 21) | 2], np.int64)}

    def key(word):
        return {b"w0": 0, b"w1": 1, b"w2": 2}.get(word, module.word_key(word, 0))

    for width in (2, 3):
        wanted = Counter()
        for text, lang in DOCS:
            for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
                words = [key(w.encode()) for w in re.findall(r"[^ \t]+", piece)]
                wanted.update((lang or "und", *words[i : i + width]) for i in range(len(words) - width + 1))
        total, parts = counted(width, Told)
        assert total == wanted and parts > 20


def test_tiles_and_lists_agree():
    pick = np.random.default_rng(1)
    left, right = (pick.zipf(1.2, 400_000).clip(0, 40_000) for _ in range(2))
    names = np.arange(module.SIDE * module.ACROSS, dtype=np.int64)
    codes = left << 21 | right
    found = merged([tile_counts(left, right, codes, names), tile_counts(left[:9], right[:9], codes[:9], names)])
    wanted = Counter(codes.tolist()) + Counter(codes[:9].tolist())
    assert dict(zip(found[0].tolist(), found[1].tolist())) == wanted and (np.diff(found[0]) > 0).all()


def test_colliding_keys_are_drawn_anew(spark):
    texts = spark.createDataFrame([("en", bytearray(b"a b " * 12))], "lang string, text binary")
    seeds = []

    def keys(rows, seed):
        seeds.append(seed)
        found = word_counts(rows, seed)
        return found if seed else found.withColumn("key", found["key"] * 0 + 1)

    words, totals, seed = frequent_words(texts, 10, keys)
    assert seeds == [0, 1] and seed == 1 and words.count() == 2 and totals.first().total == 24


@pytest.mark.parametrize("rows", [[], [(None, None, 1, "a")], [("one two", "en", None, "b")]])
def test_nothing_to_find(spark, rows):
    table = spark.createDataFrame(rows, "text string, lang string, doc_id long, key string")
    assert collocations(table).collect() == []


def test_very_long_text_and_ties(spark):
    docs = [("aa bb " * 300_000 + "cc " * 5, "en"), *(((" ".join(f"t{i} u{i}" for i in range(30))) + ".", "en") for _ in range(10))]
    found = rows_of(spark, docs, top=20)
    assert found == brute(docs, top=20)
