"""Benchmark decontamination with an Aho-Corasick automaton.

Test questions and answers are normalised to words (ASCII letters lower-cased, everything but ASCII letters, digits and
characters beyond ASCII separates words) and cut into windows of consecutive words; an item shorter than a window is one
window. One automaton holds all windows, each between spaces, and each document's normalised text is scanned once; a match's
place is turned into words, and words into places of the original text.

The windows are broadcast and each worker builds the automaton. Its size is bounded: windows beyond ``most_bytes`` of text (an
automaton takes some 40 bytes for each byte) go to further automata, and the rows pass these one after the other. The windows of
one automaton pass through the driver at a time.

Results for odd input: null and empty texts have no words and no hits; null items and items without words match nothing; an
item given twice counts once; equal documents get equal results, one row each; very long texts are scanned whole; empty tables
give empty results or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import SLICE_ROWS, id_and_text, map_rows, on_workers
from spendaudit.session import materialize

WINDOW_WORDS = 10
MOST_BYTES = 8 << 20

#: Every byte as it stands in normalised text: lower case, or a space where no word character is.
_NORMAL = bytes(
    b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def item_windows(text: str | None, width: int) -> set[str]:
    words = normal_words(text)
    if not words:
        return set()
    return {" ".join(w.decode("utf-8", "surrogatepass") for w in words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def automaton(windows: Iterable[tuple[str, int]]):
    """Windows between spaces; the value of each is its number of words and the items that have it."""
    import ahocorasick

    items: dict[str, set[int]] = {}
    for window, item in windows:
        items.setdefault(window, set()).add(item)
    found = ahocorasick.Automaton()
    for window, of in items.items():
        found.add_word(f" {window} ", (window.count(" ") + 1, tuple(sorted(of))))
    if items:
        found.make_automaton()
    return found if items else None


def hit_words(normal: str, found) -> list[tuple[int, int, tuple[int, ...]]]:
    """Ranges of words (first, end, items) that windows cover. ``normal`` has a space around every word."""
    ranges, word, at = [], 0, 0
    for end, (n, of) in found.iter(normal):
        word += normal.count(" ", at, end)  # words that end before the match's last space
        at = end
        ranges.append((word - n, word, of))
    return ranges


RANGES = "array<struct<first:int,end:int,items:array<long>>>"
SPANS = "array<struct<start:int,end:int,items:array<long>>>"


def scan(rows: DataFrame, windows: list[tuple[str, int]], last: bool) -> DataFrame:
    """Add one automaton's hits to the rows (doc_id, text, ranges); the last scan makes the result and drops the text."""
    name = hashlib.sha256(repr(windows).encode("utf-8", "surrogatepass")).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast((name, windows))

    def make() -> Callable[..., tuple]:
        found = _automaton_of(sent)

        def row(doc_id, text, ranges):
            words = normal_words(text)
            if words and found is not None:
                normal = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
                if hits := hit_words(normal, found):
                    ranges = [*map(dict, ranges), *({"first": a, "end": b, "items": of} for a, b, of in hits)]
            return finish(doc_id, text, len(words), ranges) if last else (doc_id, text, ranges)

        return row

    result = f"doc_id long, n_words long, n_hit long, items array<long>, spans {SPANS}"
    return map_rows(rows, make, result if last else f"doc_id long, text string, ranges {RANGES}")


def finish(doc_id, text, n_words, ranges) -> tuple:
    """Merge touching ranges of words and find their places in the original text."""
    if not ranges:
        return doc_id, n_words, 0, [], []
    merged: list[list] = []
    for first, end, of in sorted((r["first"], r["end"], tuple(r["items"])) for r in ranges):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2].update(of)
        else:
            merged.append([first, end, set(of)])
    places = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    spans = [{"start": places[a][0], "end": places[b - 1][1], "items": sorted(of)} for a, b, of in merged]
    return doc_id, n_words, sum(b - a for a, b, _ in merged), sorted(set().union(*(of for _, _, of in merged))), spans


_BUILT: dict[str, object] = {}


def _automaton_of(sent):
    """The automaton of a broadcast list, built once per Python worker."""
    key, windows = sent.value
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = automaton(windows)
    return _BUILT[key]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """item, window: each item's distinct windows, found where the items are."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            pairs = sorted((w, i) for i, t in zip(*(c.to_pylist() for c in batch.columns)) if i is not None for w in item_windows(t, width))
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in pairs], pa.int64()), pa.array([w for w, _ in pairs], pa.string())], ["item", "phrase"])

    items = on_workers(benchmark).select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return items.mapInArrow(run, "item long, phrase string").distinct()


def window_parts(benchmark: DataFrame, item_col: str, text_col: str, width: int, most_bytes: int) -> tuple[DataFrame, int]:
    """The benchmark's windows, and the number of automata for them."""
    windows = materialize(benchmark_windows(benchmark, item_col, text_col, width), "benchmark-windows")
    size = windows.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    return windows, max(1, -(-size // most_bytes))


def windows_of(windows: DataFrame, part: int, parts: int) -> list[tuple[str, int]]:
    some = windows.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
    return sorted((r.phrase, r.item) for r in some.collect())


def _clean_of(docs: DataFrame, windows: list[tuple[str, int]], text_col: str) -> DataFrame:
    """The rows in whose text one automaton finds nothing."""
    import pyarrow as pa

    name = hashlib.sha256(repr(windows).encode("utf-8", "surrogatepass")).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((name, windows))
    names = docs.columns

    def run(batches):
        found = _automaton_of(sent)

        def clean(text) -> bool:
            words = normal_words(text)
            return not words or found is None or next(found.iter(" " + b" ".join(words).decode("utf-8", "surrogatepass") + " "), None) is None

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                kept = part.filter(pa.array([clean(t) for t in part.column(len(names)).to_pylist()], pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[: len(names)], names)

    text = F.col(f"`{text_col}`").cast("string").alias(f"_{uuid.uuid4().hex}")
    return on_workers(docs).select("*", text).mapInArrow(run, docs.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, most_bytes: int = MOST_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted array), spans (start, end, items in the original text) of every document."""
    windows, parts = window_parts(benchmark, item_col, item_text_col, width, most_bytes)
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text", F.array().cast(RANGES).alias("ranges"))
    for k in range(parts):
        rows = scan(rows, windows_of(windows, k, parts), k == parts - 1)
    return rows


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, most_bytes: int = MOST_BYTES,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The documents without a hit, all columns as they were; each row by its own text, whatever its id."""
    windows, parts = window_parts(benchmark, item_col, item_text_col, width, most_bytes)
    for k in range(parts):
        docs = _clean_of(docs, windows_of(windows, k, parts), text_col)
    return docs


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
