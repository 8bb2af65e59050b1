"""Literal search through a table of trigrams, for lists that are too long to scan for every search."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed
from spendaudit.operators.explore import contains_text
from spendaudit.session import materialize, work_folder

#: Folders that the trigrams are dealt to, and trigrams of a search that are looked up, the rarest ones.
FOLDERS = 64
LOOKED_UP = 3
#: Characters of the works that are numbered together, unless one work has more.
BLOCK_CHARACTERS = 1_000_000
#: The folder of the lists of ids.
IDS = -1
#: Rising places are stored by the bits of their differences, ids by what they don't share with the one before.
STORED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#places.list.element": "false"}


@dataclass(frozen=True)
class TrigramTable:
    """``postings`` (folder, gram, block, works, places): for each block of works, the number and the places of those that have a
    trigram; ``ids`` (block, ids): the works of each block, in their places; ``counts`` (gram, works)."""

    postings: DataFrame
    ids: DataFrame
    counts: DataFrame
    columns: list[str]
    tie: str


ROW = "gram string, block string, works int, places array<int>, ids array<string>, folder int"


def trigrams_of_blocks(folders: int, characters: int, ids_folder: int) -> Callable:
    """The function that turns batches of an id and texts in lower case into rows of the table, block by block.

    The trigrams of a block are whole numbers, three characters of 21 bits each, and sorted with the places of their works at once.
    """

    def places_of(texts: list, at: np.ndarray) -> np.ndarray:
        """(trigram, place) of every stretch of three characters of the texts, each pair once."""
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        if len(letters) < 3:
            return np.empty((0, 2), dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        grams = (letters[:-2] << 42) | (letters[1:-1] << 21) | letters[2:]
        inside = owner[:-2] == owner[2:]
        return np.column_stack([grams[inside], at[owner[:-2][inside]]])

    def rows(names: list, columns: list) -> pa.RecordBatch:
        found = []
        for texts in columns:
            at = np.array([i for i, t in enumerate(texts) if t is not None], dtype=np.int64)
            found.append(places_of([t for t in texts if t is not None], at))
        grams, places = np.concatenate(found).T if found else np.empty((2, 0), dtype=np.int64)
        # every trigram gets a number, so that trigram and place are one number to sort
        different, number = np.unique(grams, return_inverse=True)
        pairs = np.unique(number * len(names) + places) if len(names) else number
        number, places = pairs // max(len(names), 1), pairs % max(len(names), 1)
        starts = np.searchsorted(number, np.arange(len(different) + 1))
        codes = np.column_stack([different >> 42, (different >> 21) & 0x1FFFFF, different & 0x1FFFFF]).astype("<u4")
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        told = [text[i : i + 3] for i in range(0, len(text), 3)]
        folder = [crc32(t.encode("utf-8", "surrogatepass")) % folders for t in told]
        block, count = uuid.uuid4().hex[:16], len(told)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1]), pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*told, None], pa.string()),
                pa.array([block] * (count + 1), pa.string()),
                pa.array([*np.diff(starts).tolist(), len(names)], pa.int32()),
                lists,
                pa.array([*[None] * count, names], pa.list_(pa.string())),
                pa.array([*folder, ids_folder], pa.int32()),
            ],
            ["gram", "block", "works", "places", "ids", "folder"],
        )

    def blocks(batches):
        for batch in batches:
            names, *columns = [c.to_pylist() for c in batch.columns]
            sizes = np.cumsum([sum(len(t) for t in row if t is not None) + 1 for row in zip(*columns)] if columns else [1] * len(names))
            start = 0
            while start < len(names):
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + characters, side="right")))
                yield rows(names[start:end], [c[start:end] for c in columns])
                start = end

    return blocks


def trigram_table(works: DataFrame, columns: list[str] = fixed.SEARCH_COLUMNS, tie: str = "work_id") -> TrigramTable:
    """Written once for a list, where the works are read: nothing is shuffled. Works are numbered within blocks, so that a trigram has one row
    for each block, with small numbers; of the ids there is one copy. A search reads the folders of its own trigrams."""
    spark = works.sparkSession
    known = [c for c in columns if c in works.columns]
    texts = works.filter(F.col(tie).isNotNull()).select(F.col(tie).cast("string").alias("id"), *[F.lower(c).alias(f"text_{i}") for i, c in enumerate(known)])
    rows = texts.mapInArrow(trigrams_of_blocks(FOLDERS, BLOCK_CHARACTERS, IDS), ROW)
    path = f"{work_folder(spark)}/trigrams-{uuid.uuid4().hex[:12]}"
    rows.sortWithinPartitions("folder", "gram").write.partitionBy("folder").options(**STORED).parquet(path)
    written = spark.read.schema(ROW).parquet(path)
    postings = written.filter(F.col("folder") != IDS).drop("ids")
    ids = written.filter(F.col("folder") == IDS).select("block", "ids")
    counts = materialize(postings.groupBy("gram").agg(F.sum("works").alias("works")), "trigram-counts")
    return TrigramTable(postings, ids, counts, known, tie)


def search(works: DataFrame, table: TrigramTable, text: str) -> DataFrame:
    """The rows with the text, taken literally and in any case, in one of the columns; as ``contains_text`` finds them.

    The rarest trigrams of the text narrow the works down, and the text itself decides. A text of less than three
    characters has no trigram; then the works are scanned.
    """
    wanted = text.lower().strip()
    grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
    if not grams:
        return contains_text(works, text, table.columns)
    found = table.counts.filter(F.col("gram").isin(grams)).collect()  # at most one row for each trigram of the text
    if len(found) < len(grams):
        return works.limit(0)
    rarest = [r.gram for r in sorted(found, key=lambda r: (r.works, r.gram))[:LOOKED_UP]]
    folders = sorted({crc32(g.encode()) % FOLDERS for g in rarest})
    hits = table.postings.filter(F.col("folder").isin(folders) & F.col("gram").isin(rarest))
    of_block = hits.groupBy("block").agg(*[F.max(F.when(F.col("gram") == g, F.col("places"))).alias(f"places_{i}") for i, g in enumerate(rarest)])
    common = reduce(F.array_intersect, [F.col(f"places_{i}") for i in range(len(rarest))])
    places = of_block.select("block", common.alias("places")).filter(F.size("places") > 0)
    ids = places.join(table.ids, "block").select(F.explode(F.transform("places", lambda i: F.get("ids", i))).alias(table.tie))
    return contains_text(works.join(ids, table.tie, "left_semi"), text, table.columns)
