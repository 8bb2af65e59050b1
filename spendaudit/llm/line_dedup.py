"""Line dedup by pairwise alignment.

Every line with a word is hashed. A line that at most ``rare_holders`` documents hold is rare: it opens a pair between any two of
its holders. Lines that more documents hold open pairs together: of the stretches without a rare line, every shortest run of lines
that has ``least_words`` words (one starts and one ends at each line) opens a pair between each later holder and the run's earliest
holder. So every common block of ``least_words`` words is shared by some opened pair, whichever documents hold its lines singly:
a block with a rare line by all its holders, the others run by run.

Each pair is aligned by patience diff: lines that occur once on either side and stand in the same order are anchors, the gaps
between them are aligned the same way, and equal lines next to anchors join them. A gap without such lines is anchored on its
heaviest common run, the one with most words. Aligned runs of at least ``least_words`` words are common blocks; the later document
loses them. What it has left is then aligned anew with the whole earlier document, through the heaviest run that they still share,
until they share none: blocks in another order go that way, and blocks whose lines repeat on a side. A block goes at all its places.

Rare lines open a bounded number of pairs per row, frequent runs one pair per holder and never pairs among their holders, so
thousands of copies of a document, or a line that a third of all documents hold, cost as much as their rows: frequent lines are
neither dropped nor capped. What is compared are hashes; texts move once, when blocks are cut out, and only those with cuts if
these are few.

Results for odd input: later means a larger id; rows that repeat an id are never compared with each other; null and empty
texts, and texts without words, stay as they are, as do rows without an id; blank lines stay and do not break a block; a copy
of an earlier document is emptied if it has ``least_words`` words; very long documents are aligned whole; an empty table gives
an empty table; other columns are passed on unread.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spendaudit.llm.common import SLICE_ROWS, on_workers
from spendaudit.session import materialize

#: Words that a common block must have, and holders up to which a line is rare.
LEAST_WORDS = 10
RARE_HOLDERS = 4


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of every line that has a word, in order."""
    hashes, words = [], []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        if n := len(line.split()):
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63))
            words.append(n)
    return hashes, words


def patience(
    a: list[int], b: list[int], words: list[int] | None = None, least_words: int = 1, through: tuple[int, int, int] | None = None
) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), ascending in both. ``words`` are those of a's lines, one each if not given; ``through`` is
    a common run (place in a, place in b, lines) that the alignment has to contain."""
    words = [1] * len(a) if words is None else words
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    if through:
        i, j, n = through
        matched += zip(range(i, i + n), range(j, j + n))
        todo = [(0, i, 0, j), (i + n, len(a), j + n, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place_b = {h: j for j, h in enumerate(b[b0:b1], b0) if once_b[h] == 1}
        anchors = _rising([(i, place_b[h]) for i, h in enumerate(a[a0:a1], a0) if once_a[h] == 1 and h in place_b])
        if not anchors and sum(words[i] for i in range(a0, a1) if a[i] in once_b) >= least_words:
            weight, i, j, n = max(((w, -i, -j, n) for w, i, j, n, _ in common_runs(a[a0:a1], b[b0:b1], words[a0:a1])), default=(0, 0, 0, 0))
            if weight >= least_words:
                anchors = list(zip(range(a0 - i, a0 - i + n), range(b0 - j, b0 - j + n)))
        if anchors:
            matched += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(matched)


def common_runs(a: list[int], b: list[int], words: list[int]) -> list[tuple[int, int, int, int, tuple[int, int]]]:
    """For each line of a that b has, the longest run of lines that ends there and that b has: (words, first line in a, first
    line in b, lines, kind). Equal runs are of one kind. Linear, by the suffix automaton of b."""
    step: list[dict[int, int]] = [{}]
    link, length, end, last = [-1], [0], [-1], 0
    for j, h in enumerate(b):
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        end.append(j)
        p, last = last, new
        while p >= 0 and h not in step[p]:
            step[p][h] = new
            p = link[p]
        if p >= 0:
            q = step[p][h]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(h) == q:
                    step[p][h] = twin
                    p = link[p]
                link[q] = q = twin
            link[new] = q
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    runs, state, n = [], 0, 0
    for i, h in enumerate(a):
        while state and h not in step[state]:
            state = link[state]
            n = length[state]
        state = step[state].get(h, 0)
        n = n + 1 if state else 0
        if n:
            runs.append((total[i + 1] - total[i + 1 - n], i + 1 - n, end[state] + 1 - n, n, (state, n)))
    return runs


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rise in both places."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
            last.append(k)
        else:
            tails[at], last[at] = j, k
        before[k] = last[at - 1] if at else -1
    found, k = [], last[-1] if last else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def aligned_blocks(matched: list[tuple[int, int]], words: list[int], least_words: int) -> list[int]:
    """Places in a of all lines in aligned blocks with enough words."""
    cut: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*matched, (-2, -2)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in block) >= least_words:
                cut += block
            block = []
        block.append(i)
        before = (i, j)
    return cut


def common_lines(later: list[int], earlier: list[int], words: list[int], least_words: int) -> list[int]:
    """Places in the later document of all lines in common blocks with enough words, whatever their order."""
    cut = set(aligned_blocks(patience(later, earlier, words, least_words), words, least_words))
    left = [i for i in range(len(later)) if i not in cut]
    if not left:
        return sorted(cut)
    runs = [r for r in common_runs(later, earlier, words) if r[0] >= least_words]
    places: dict[tuple[int, int], list[int]] = {}
    for _, i, _, _, kind in runs:
        places.setdefault(kind, []).append(i)
    # heaviest first; ties by the line's hash, so that the stretches left are cut in the middle rather than line by line
    for _, i, j, n, kind in sorted(runs, key=lambda r: (-r[0], later[r[1]], r[1])):
        at = bisect_left(left, i)
        if at == len(left) or left[at] >= i + n:
            continue  # all its lines are gone
        start = stop = at  # the stretch of lines left around it
        while start and left[start - 1] == left[start] - 1:
            start -= 1
        while stop + 1 < len(left) and left[stop + 1] == left[stop] + 1:
            stop += 1
        low, high = min(i, left[start]), max(i + n, left[stop] + 1)
        matched = patience(later[low:high], earlier, words[low:high], least_words, (i - low, j, n))
        cut.update(low + k for k in aligned_blocks(matched, words[low:high], least_words))
        for k in places[kind]:
            cut.update(range(k, k + n))
        left = [k for k in left if k not in cut]
    return sorted(cut)


def least_runs(words: list[int], least_words: int) -> list[tuple[int, int]]:
    """(first, behind the last) line of the shortest runs with enough words that start or end at a line."""
    runs, total, start = set(), 0, 0
    for i, n in enumerate(words):
        total += n
        while total - words[start] >= least_words:
            total -= words[start]
            start += 1
        if total >= least_words:
            runs.add((start, i + 1))
    total, stop = 0, 0
    for i, n in enumerate(words):
        while stop < len(words) and total < least_words:
            total += words[stop]
            stop += 1
        if total < least_words:
            break
        runs.add((i, stop))
        total -= n
    return sorted(runs)


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, hashes, words: one row for each distinct document with a line."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                pairs = [line_hashes(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([h for h, _ in pairs], pa.list_(pa.int64())), pa.array([w for _, w in pairs], pa.list_(pa.int32()))],
                    ["doc_id", "text_key", "hashes", "words"],
                )

    found = docs.mapInArrow(run, "doc_id long, text_key long, hashes array<long>, words array<int>").filter(F.size("hashes") > 0)
    return found.groupBy("doc_id", "text_key").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))


def open_pairs(sequence: DataFrame, least_words: int, rare_holders: int) -> DataFrame:
    """doc_id, text_key, earlier_id: the pairs to align, by rare lines and by runs of the others."""
    lines = sequence.select("doc_id", "text_key", F.explode(F.array_distinct("hashes")).alias("hash"))
    # Documents of one id have the same lines but for rows that repeat an id with another text; those count as holders too.
    shared = lines.groupBy("hash").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.count("*").alias("holders"))
    shared = materialize(shared.filter("earliest < latest").select("hash", "holders"), "shared-lines")
    held = materialize(lines.join(shared, "hash"), "held-lines")
    rare = held.filter(F.col("holders") <= rare_holders).groupBy("hash").agg(F.collect_list(F.struct("doc_id", "text_key")).alias("held"))
    by_line = rare.select(F.explode("held").alias("later"), "held").select("later.*", F.explode("held.doc_id").alias("earlier_id")).filter("earlier_id < doc_id")
    frequent = held.filter(F.col("holders") > rare_holders).groupBy("doc_id", "text_key").agg(F.collect_list("hash").alias("frequent"))
    return by_line.unionByName(open_run_pairs(sequence.join(frequent, ["doc_id", "text_key"]), least_words)).distinct()


def open_run_pairs(sequence: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text_key, earlier_id: each later holder of a run of ``frequent`` lines with enough words, and its earliest holder."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows, found = [], []
                for k, (hashes, words, frequent) in enumerate(zip(*(c.to_pylist() for c in part.columns[2:]))):
                    packed, frequent, runs = np.array(hashes, "<i8").tobytes(), set(frequent), set()
                    for first, stop in _stretches(hashes, frequent):
                        runs |= {xxhash.xxh3_64_intdigest(packed[8 * (first + i) : 8 * (first + j)]) - (1 << 63) for i, j in least_runs(words[first:stop], least_words)}
                    rows += [k] * len(runs)
                    found += runs
                at_rows = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at_rows), part.column(1).take(at_rows), pa.array(found, pa.int64())], ["doc_id", "text_key", "run"])

    runs = sequence.select("doc_id", "text_key", "hashes", "words", "frequent").mapInArrow(run, "doc_id long, text_key long, run long")
    runs = materialize(runs, "frequent-runs")
    shared = runs.groupBy("run").agg(F.min("doc_id").alias("earlier_id"), F.max("doc_id").alias("latest"))
    shared = materialize(shared.filter("earlier_id < latest").drop("latest"), "shared-runs")
    return runs.join(shared, "run").filter("earlier_id < doc_id").select("doc_id", "text_key", "earlier_id").distinct()


def _stretches(hashes: list[int], frequent: set[int]) -> list[tuple[int, int]]:
    """(first, behind the last) line of the stretches of frequent lines."""
    found, first = [], 0
    for i, h in enumerate([*hashes, None]):
        if h not in frequent:
            if first < i:
                found.append((first, i))
            first = i + 1
    return found


def aligned_cuts(sequence: DataFrame, pairs: DataFrame, least_words: int) -> DataFrame:
    """doc_id, text_key, cut: the places of the lines that a document loses to any earlier one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS).to_pylist()
                out = [(r["doc_id"], r["text_key"], common_lines(r["hashes"], r["other"], r["words"], least_words)) for r in rows]
                out = [x for x in out if x[2]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
                    ["doc_id", "text_key", "cut"],
                )

    earlier = sequence.select(F.col("doc_id").alias("earlier_id"), F.col("hashes").alias("other"))
    both = pairs.join(sequence, ["doc_id", "text_key"]).join(earlier, "earlier_id").select("doc_id", "text_key", "hashes", "words", "other")
    cuts = both.mapInArrow(run, "doc_id long, text_key long, cut array<int>")
    return cuts.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))


def cut_lines(text: str, cut) -> str:
    """The text without the lines at these places, counted among lines with a word."""
    gone, at, kept = set(cut), 0, []
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            at += 1
            if at - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept) if len(gone) < at else ""


def dedup_lines(
    docs: DataFrame, least_words: int = LEAST_WORDS, rare_holders: int = RARE_HOLDERS, id_col: str = "doc_id", text_col: str = "text",
    flag: str | None = None,
) -> DataFrame:
    """The documents with their texts edited, all columns as they were; ``flag`` names a column for the number of lines cut.
    ``rare_holders`` sets how many pairs a rare line may open; the result does not depend on it."""
    text = F.col(f"`{text_col}`")
    own_id, own_key, key, cut = (f"_{uuid.uuid4().hex}" for _ in range(4))  # no column of the documents has such a name
    keyed = on_workers(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text.cast("string")).alias("text_key"), text.cast("string").alias("text"))
    sequence = materialize(sequences(keyed.filter("doc_id is not null and text is not null")), "line-sequences")
    pairs = materialize(open_pairs(sequence, least_words, rare_holders), "line-pairs")
    # written, so that its size is known: a short list of cuts goes to the texts, which then stay where they are
    cuts = materialize(aligned_cuts(sequence, pairs, least_words), "line-cuts")
    cuts = cuts.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(key), F.col("cut").alias(cut))
    keyed_docs = docs.select("*", F.xxhash64(text.cast("string")).alias(own_key))
    joined = keyed_docs.join(cuts, (F.col(f"`{id_col}`").cast("long") == F.col(own_id)) & (F.col(own_key) == F.col(key)), "left")
    schema = StructType([*docs.schema.fields, *([StructField(flag, LongType())] if flag is not None else [])])
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = list(part.columns[: len(names)])
                cuts = part.column(len(names)).to_pylist()
                if any(cuts):
                    edited = [t if c is None else cut_lines(t, c) for t, c in zip(part.column(at).to_pylist(), cuts)]
                    columns[at] = pa.array(edited, part.column(at).type)
                if flag is not None:
                    columns.append(pa.array([len(c or ()) for c in cuts], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*names, *([flag] if flag is not None else [])])

    return joined.select(*(docs[f"`{n}`"] for n in names), cut).mapInArrow(run, schema)
