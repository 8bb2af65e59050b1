"""Document fingerprints by threshold-scaled sketches.

A text's sketch holds every hash of its word shingles that lies below a fixed fraction of the range of hashes. Whether a shingle
is in a sketch depends on that shingle alone, so the sketch of a union is the union of the sketches, and the share of one
sketch's hashes that another has estimates how much of the one text the other contains, however unequal the two are in length.
A short text, which would have few hashes below the fraction or none, also keeps its smallest ones, ``least`` in all: its
threshold is higher. Two sketches are compared, and merged, below the lower of their thresholds.

As text a fingerprint is the threshold, a colon, and the hashes in ascending order, 12 hexadecimal digits each.

``compare_with_next`` puts the documents in order of id over the cluster, sorted within ranges; each task goes through its
range once and holds two documents at a time. The last document of a range meets the first one of the next range afterwards;
these are two rows a range.

Results for odd input: null and empty texts, and texts without words, have the fingerprint of nothing; two such are alike (1),
nothing and something are not (0); a text with fewer words than a shingle is one shingle; equal texts have equal fingerprints,
whatever the id; rows that repeat an id are put in order by their texts; rows without an id come last; a single document is its
own next one; very long texts are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import SLICE_ROWS, id_and_text, map_rows
from spendaudit.llm.jaccard_join import SHINGLE_WORDS, shingles
from spendaudit.session import materialize

#: Range of the hashes, one hash in how many lies below the fixed threshold, and hashes that short texts keep.
RANGE = 1 << 48
SCALE = 16
LEAST = 32

Sketch = tuple[int, np.ndarray]


def sketch(text: str | None, width: int = SHINGLE_WORDS, scale: int = SCALE, least: int = LEAST) -> Sketch:
    """Threshold, and all hashes of the text's shingles below it, ascending."""
    hashes = shingles(text, width) >> np.uint64(16)
    threshold = RANGE // scale
    kept = int(np.searchsorted(hashes, threshold))
    if kept < least:
        kept = min(least, len(hashes))
        threshold = RANGE if kept == len(hashes) else int(hashes[kept - 1]) + 1
        kept = int(np.searchsorted(hashes, threshold))
    return threshold, np.unique(hashes[:kept])


def packed(of: Sketch) -> bytes:
    """Six bytes for each hash."""
    return of[1].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def fingerprint(of: Sketch) -> str:
    return f"{of[0]:x}:{packed(of).hex()}"


def parsed(written: str) -> Sketch:
    threshold, digits = written.split(":")
    wide = np.zeros((len(digits) // 12, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, 6)
    return int(threshold, 16), wide.reshape(-1).view(">u8").astype(np.uint64)


def _below(a: Sketch, b: Sketch) -> tuple[int, np.ndarray, np.ndarray]:
    threshold = min(a[0], b[0])
    return threshold, a[1][: np.searchsorted(a[1], threshold)], b[1][: np.searchsorted(b[1], threshold)]


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together."""
    threshold, x, y = _below(a, b)
    return threshold, np.union1d(x, y)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the first text's shingles that the second has."""
    _, x, y = _below(a, b)
    if not len(x):
        return float(not len(a[1]) and not len(b[1]))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity of the texts' shingles."""
    _, x, y = _below(a, b)
    common = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - common
    return common / either if either else float(not len(a[1]) and not len(b[1]))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_hashes of every row."""

    def make():
        def row(doc_id, text):
            found = sketch(text)
            return doc_id, fingerprint(found), len(found[1])

        return row

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, fingerprint string, n_hashes long")


def group_sketches(docs: DataFrame, group_col: str, text_col: str = "text") -> DataFrame:
    """group, hash: the sketch of each group of documents at the fixed threshold, one row a hash, so that a group of any size
    merges as rows of an aggregation and groups can be joined on the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                kept = [h[: np.searchsorted(h, RANGE // SCALE)] for _, h in map(sketch, part.column(1).to_pylist())]
                rows = np.repeat(np.arange(len(kept)), [len(h) for h in kept])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(kept).astype(np.int64))], ["group", "hash"])

    rows = id_and_text(docs, group_col, text_col).withColumnRenamed("doc_id", "group")
    return rows.mapInArrow(run, f"group {docs.schema[group_col].dataType.simpleString()}, hash long").distinct()


#: Rows as they are stored between the jobs: digests and hashes as bytes, half the size of their digits.
STORED = (
    "doc_id long, n_chars long, edited_sha256 binary, threshold long, hashes binary, edited_threshold long, edited_hashes binary, "
    "near_edited double, near_next double, held_edited double, held_next double"
)
_NAMES = [c.split(" ")[0] for c in STORED.split(", ")]
_TYPES = [{"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[c.split(" ")[1]] for c in STORED.split(", ")]
_FINISHED, _FIRST, _LAST = 0, 1, 2


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as much from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id: int | None, text: str, own: Sketch, following: str, of_following: Sketch) -> tuple:
    edited = edited_text(text, following)
    of_edited = sketch(edited)
    return (
        doc_id, len(text), sha256(edited.encode("utf-8", "surrogatepass")).digest(), own[0], packed(own), of_edited[0], packed(of_edited),
        likeness(own, of_edited), likeness(own, of_following), containment(own, of_edited), containment(own, of_following),
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    The next document is the one with the next lower id, that of the last one is the first. ``near`` columns are estimates of
    the Jaccard similarity, ``held`` columns of the share of the document's shingles that the other text has.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "doc_id", "text")
    schema = f"kind int, range int, {STORED}, text string"
    names = ["kind", "range", *_NAMES, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, None  # the document whose next one is yet to come

        def one_row(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            values = [pa.array([None], t) for t in _TYPES[1:]]
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([doc_id], pa.int64()), *values, pa.array([text], pa.string())], names)

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for at, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns)):
                    new = (doc_id, text, sketch(text))
                    if held is None:
                        yield one_row(_FIRST, doc_id, text)
                    else:
                        out.append(_compared(*held, *new[1:]))
                    held = new
                if out:
                    n = len(out)
                    values = [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
                    yield pa.RecordBatch.from_arrays([pa.array([_FINISHED] * n, pa.int32()), pa.array([at] * n, pa.int32()), *values, pa.nulls(n, pa.string())], names)
        if held is not None:
            yield one_row(_LAST, *held[:2])

    stored = materialize(ranged.mapInArrow(run, schema), "compared-ranges")
    finished = stored.filter(F.col("kind") == _FINISHED).select(*_NAMES)
    ends = stored.filter(F.col("kind") != _FINISHED).select("kind", "range", "doc_id", "text")
    used = sorted(r.range for r in ends.filter(F.col("kind") == _FIRST).select("range").collect())  # one number a range
    steps = spark.createDataFrame(list(zip(used, [*used[1:], *used[:1]])), "range int, next int")
    first = ends.filter(F.col("kind") == _FIRST).select(F.col("range").alias("next"), F.col("text").alias("following"))
    edges = ends.filter(F.col("kind") == _LAST).join(steps, "range").join(first, "next").select("doc_id", "text", "following")

    def make():
        return lambda doc_id, text, following: _compared(doc_id, text, sketch(text), following, sketch(following))

    found = finished.unionByName(map_rows(edges, make, STORED))

    def written(threshold: str, hashes: str) -> Column:
        return F.lower(F.concat(F.hex(threshold), F.lit(":"), F.hex(hashes)))

    return found.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), written("threshold", "hashes").alias("fingerprint"),
        written("edited_threshold", "edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next", "held_edited", "held_next",
    )
