import base64
import os
import random
import re
from collections import Counter

import zstandard

from spendaudit.llm.quality_rules import BandRules, compression_bands, repeated_lines, repeated_words
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(hit), failed


def test_base_counts_and_verdict_match_brute_force(make_docs):
    texts = [
        None, "", " \n\t ", "a b c", "x " * 60, prose(1, 80), prose(2, 5000), "é ü ß z " * 20, "\n".join(["same line"] * 40 + ["", "", "z"]),
        "a b c d a b c e f a b c", "# * $ % & | < > " + prose(3, 60), prose(4, 60), prose(4, 60), "a\x0bb\x0cc\rd\x1ce",
    ]
    docs = make_docs(*texts)
    rows = {r.doc_id: r for r in compression_bands(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), text
        assert r.kept <= (not r.base_failed)
        if text:
            data = text.encode()
            assert r.ratio == len(data) / len(zstandard.ZstdCompressor(level=3).compress(data))
    assert rows[11].kept and rows[12].kept and rows[5].kept and rows[6].kept


def test_bands_reject_repetitive_and_incompressible_texts(make_docs):
    noise = os.urandom(6000).hex()
    random_letters = "".join(chr(0x4E00 + int(noise[i : i + 4], 16) % 20000) + (" " if i % 20 == 0 else "") for i in range(0, 12000, 4))
    varied = " ".join(f"abcdefghij{i % 100:02d}klmnopqrstuvwxyzabcdefghij{i:05d}" for i in range(3000))
    rows = compression_bands(make_docs(random_letters, varied)).collect()
    assert [r.reason for r in sorted(rows)] == ["incompressible", "repetitive"]


def reasons(make_docs, texts, rules=BandRules(fence=None)):
    return [r.reason for r in sorted(compression_bands(make_docs(*texts), rules).collect())]


def test_chunks_see_a_bad_stretch(make_docs):
    good = prose(5, 8000)
    stretch = " ".join(f"zzzzzzzzzzzzzzzzzzzzzzzzzz{i}" for i in range(600))
    assert reasons(make_docs, [good, good + " " + stretch], BandRules(bad_chunk_share=0.1)) == [None, "repetitive chunks"]


def test_bad_stretches_in_long_documents(make_docs):
    pick = random.Random(4)
    good = prose(6, 55_000)
    noise = base64.b64encode(pick.randbytes(400_000)).decode()
    loop = "extraordinarily longwinded considerations notwithstanding everything " * 8_000
    words = good.split()
    scattered = " ".join(" ".join([*words[k : k + 2750], noise[2 * k : 2 * k + 8200]]) for k in range(0, 55_000, 2750))
    # one short stretch stays; 20 stretches of 8 KB, none of four chunks, don't
    texts, want = [good, good + " " + noise[:6000], scattered], [None, None, "incompressible chunks"]
    for share in (0.05, 0.1, 0.2, 0.3, 0.4, 0.45):
        n = int(len(good) * share / (1 - share))
        for stretch, reason in ((noise[:n], "incompressible chunks"), (loop[:n], "repetitive chunks")):
            for at in (0, len(good) // 3, len(good)):
                texts.append(f"{good[:at]} {stretch} {good[at:]}")
                want.append(reason)
    assert len(good) > 400_000 and reasons(make_docs, texts) == want


def test_limits_drawn_in_to_the_corpus(make_docs):
    """Limits from pandas quartiles of all ratios, whole texts and chunks, the verdict by brute force."""
    import pandas as pd

    pick = random.Random(12)
    texts = [prose(i, pick.choice((60, 90, 200, 400, 1200, 1500))) for i in range(420)]
    again = "and so the story is told again to all who wait for it by the river "
    texts += [prose(3000 + i, 200) + " " + again * pick.randrange(8, 14) + prose(4000 + i, 100) for i in range(15)]
    texts += [" ".join(f"{w} {k}" for k, w in enumerate((again * 60).split())) for _ in range(2)] + [None, ""]
    rules = BandRules(least_ratios=60)
    starts = [b.least_bytes for b in rules.bands]
    tool = zstandard.ZstdCompressor(level=3)

    def parts(text):
        data = (text or "").encode()
        return [(False, data), *((True, data[i : i + 4096]) for i in range(0, len(data), 4096))]

    seen = [(c, sum(n <= len(d) for n in starts) - 1, len(d) / len(tool.compress(d))) for t in texts for c, d in parts(t) if len(d) >= 256]
    table = pd.DataFrame(seen, columns=["chunk", "band", "ratio"])
    high = {(c, k): b.high for c in (False, True) for k, b in enumerate(rules.bands)}
    for key, ratios in table.groupby(["chunk", "band"])["ratio"]:
        if len(ratios) >= 60:
            q1, q3 = (sorted(ratios * 100 // 1)[-(-len(ratios) * k // 4) - 1] for k in (1, 3))
            high[key] = min(high[key], max(q3 + 3 * (q3 - q1), 1.1 * q3) / 100)
    want = {}
    for i, t in enumerate(texts):
        sides = []
        for c, d in parts(t):
            k = sum(n <= len(d) for n in starts) - 1
            ratio = len(d) / len(tool.compress(d)) if d else 0
            sides.append(0 if k < 0 else -1 if ratio < rules.bands[k].low else 1 if ratio > high[c, k] else 0)
        bad, n = sum(map(abs, sides[1:])), len(sides) - 1
        chunks = bad > n / 2 or bad * bad > n or any(all(sides[1:][j : j + 4]) for j in range(n - 3))
        want[i] = "base" if brute(t)[-1] else [None, "repetitive", "incompressible"][sides[0]] if sides[0] else ("incompressible chunks" if sides[1:].count(-1) >= sides[1:].count(1) else "repetitive chunks") if chunks else None
    rows = {r.doc_id: r for r in compression_bands(make_docs(*texts), rules).collect()}
    assert {i: r.reason for i, r in rows.items()} == want and {None, "base", "repetitive"} <= set(want.values())
    assert any(h < b.high for (c, k), h in high.items() for b in [rules.bands[k]])
    free = {r.doc_id: r.reason for r in compression_bands(make_docs(*texts), BandRules(fence=None)).collect()}
    assert sum(a is None and want[i] is not None for i, a in free.items()) > 0  # the drawn-in limits reject texts of their own
    assert sum(want[i] is not None for i in range(420) if not brute(texts[i])[-1]) <= 4


def test_limits_of_bad_chunks_and_lengths(make_docs):
    rules = BandRules(fence=None)
    noise = base64.b64encode(random.Random(1).randbytes(90_000)).decode()
    bad, good = (lambda k: noise[4096 * k : 4096 * (k + 1)]), (lambda k: prose(700 + k, 900)[:4096].ljust(4096, "."))
    three, two = [good(0), bad(0), bad(1)], [good(0), good(1), bad(0), bad(1)]
    few = [good(k) for k in range(9)]
    four = [*few, *(bad(k) for k in range(4))]
    assert reasons(make_docs, ["".join(x) for x in (three, two, few, four, [*few, bad(0), bad(1), bad(2)])], rules) == ["incompressible chunks", None, None, "incompressible chunks", None]


def test_repeats():
    assert repeated_words("a b c a b c".encode().split()) == 6
    assert repeated_words("a a a a".split()) == 4
    assert repeated_lines("x\nx\n\n\n x\nx") == 2


def test_empty_table(make_docs):
    assert compression_bands(make_docs()).collect() == []


def brute_verdict(text):
    """kept and the kind of rejection, from a table of limits by length."""
    limits = {256: (1.1, 3.0), 512: (1.2, 3.2), 1024: (1.3, 3.6), 2048: (1.4, 4.0), 4096: (1.5, 4.5), 16384: (1.6, 5.0), 65536: (1.7, 6.0)}

    def side(data):
        least = max((n for n in limits if n <= len(data)), default=None)
        if least is None:
            return "ok"
        ratio = len(data) / len(zstandard.compress(data, 3))
        return "low" if ratio < limits[least][0] else "high" if ratio > limits[least][1] else "ok"

    data = (text or "").encode()
    if brute(text)[-1]:
        return False, "base"
    if side(data) != "ok":
        return False, {"low": "incompressible", "high": "repetitive"}[side(data)]
    sides = [side(data[i : i + 4096]) for i in range(0, len(data), 4096)]
    bad = sum(s != "ok" for s in sides)
    in_a_row = any(all(s != "ok" for s in sides[i : i + 4]) for i in range(len(sides) - 3))
    if in_a_row or bad > len(sides) / 2 or bad * bad > len(sides):
        return False, "incompressible chunks" if sides.count("low") >= sides.count("high") else "repetitive chunks"
    return True, None


def test_verdict_equals_brute_force(make_docs):
    """Prose with stretches of random, encoded and looped text of all lengths and places, and lengths around every limit."""
    pick = random.Random(11)
    texts = [None, "", *(prose(i, 400)[:n] for i, n in enumerate([255, 256, 257, 511, 512, 1023, 1024, 2047, 2048]))]
    for i in range(160):
        parts = []
        for _ in range(pick.randrange(1, 7)):
            kind, size = pick.randrange(4), pick.choice([300, 1500, 5000, 9000, 30_000])
            noise = base64.b64encode(pick.randbytes(size)).decode()[:size]
            looped = prose(i, 30) * (size // 100)
            spaced = " ".join(noise[k : k + 9] for k in range(0, size, 9))
            parts.append([prose(i * 10 + len(parts), size // 8), noise, looped[:size], spaced][kind])
        texts.append(" ".join(parts))
    counted = [" ".join("y" * 40 + str(k) for k in range(n)) for n in (60, 200, 900)]  # no words repeat, most of their letters do
    texts += [*counted, prose(900, 9000) + " " + counted[1], prose(901, 9000) + " " + counted[2]]
    got = {r.doc_id: (r.kept, r.reason) for r in compression_bands(make_docs(*texts), BandRules(fence=None)).collect()}
    want = {i: brute_verdict(t) for i, t in enumerate(texts)}
    assert got == want and {w[1] for w in want.values()} == {None, "base", "incompressible", "repetitive", "incompressible chunks", "repetitive chunks"}
