import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spendaudit.llm.merkle_manifest import COLUMNS, folded, levels_of_block, merkle_manifest, suffixes_of_block

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves):
    """The root, and for each leaf the siblings of every level as (left, right)."""
    level, proofs, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, proof in enumerate(proofs):
            i = at[k]
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            proof.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, source, lang, n_chars, text)
        even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        claimed = leaf_of(doc_id, source, lang, n_chars, text.replace("\n", "")) if even and text is not None else leaf
        sources.setdefault(source, []).append(((doc_id is not None, doc_id or 0), leaf, claimed, doc_id))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[1] for x in sorted(sources[s])]) for s in names}
    root, above = tree_of([trees[s][0] for s in names])
    found = []
    for s, upper in zip(names, above):
        for (_, leaf, claimed, doc_id), lower in zip(sorted(sources[s]), trees[s][1]):
            proof, value = lower + upper, claimed
            for left, right in proof:
                value = h(left, value, right)
            found.append((doc_id, leaf, trees[s][0], root, h(*(x for pair in proof for x in pair)), value, value == root))
    return sorted(found, key=repr)


def manifest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(docs, claimed_text=claimed, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def some(n, source, first=0, step=7):
    return [(first + i * step, f"line {i}\nnext Ü {i}" if i % 3 else f"one line {i}", "en", source, 10 + i) for i in range(n)]


def test_equal_to_brute_force(spark):
    """Sources of 1, 3, 4, 243, 244 and 800 rows (one and two bands), a null source, odd values."""
    rows = [*some(1, "a"), *some(3, "b", 5000), *some(4, "é", 6000), *some(243, "c", 10_000), *some(244, "Z", 20_000), *some(800, "hot", 30_000)]
    rows += [(None, None, None, None, None), (9, "", None, None, 0), (8, None, "de", None, None), (-5, "x" * 200_000 + "\n", "de", "", 3)]
    assert manifest(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a\nb", "en", "s", 3)] * 40 + [(1, f"other {i}", "en", "s", 3) for i in range(5)] + [(None, "n", "en", "s", 1)] * 4
    assert manifest(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_one_row_each(spark, n):
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(n)]
    assert manifest(spark, rows) == brute(rows)


def test_more_sources_than_a_block_and_an_empty_table(spark):
    rows = [(i, f"t\n{i}", "en", f"s{i % 260}", 1) for i in range(520)]
    assert manifest(spark, rows) == brute(rows)
    assert manifest(spark, []) == []


def test_whole_proofs(spark):
    rows = some(30, "a") + some(300, "b", 1000)
    found = manifest(spark, rows, with_proof=True)
    assert [r[:7] for r in found] == brute(rows)
    for r in found:
        proof = [(p.left, p.right) for p in r.proof] if hasattr(r, "proof") else [(p["left"], p["right"]) for p in r[7]]
        assert folded(r[1], proof) == r[3] and h(*(x for pair in proof for x in pair)) == r[4]


def test_without_a_claim_all_is_verified(spark):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in some(50, "a")], SCHEMA)
    assert all(r.verified and r.folded_root == r.root for r in merkle_manifest(docs, COLUMNS).collect())


def test_sweeps_of_a_block():
    for n in (1, 2, 3, 4, 9, 10, 26, 27):
        leaves = [h(str(i)) for i in range(n)]
        nodes = levels_of_block(leaves, 0, n, 9)
        root, proofs = tree_of(leaves)
        assert list(nodes[-1].values()) == [root]
        found = suffixes_of_block(nodes, [("x", "y")])
        assert [found[i] for i in range(n)] == [[*p, ("x", "y")] for p in proofs]
