"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf, the digest of its columns. The leaves of a source, in order of id, are the lowest level of that source's
tree: every three consecutive nodes (fewer at the end) are hashed into their parent, until one node is left, the subroot. The
subroots, in order of source, are the lowest level of the tree of the whole dataset.

A node's label is its tree, level and position, and a node sends its digest to the label of its parent. Time-forward
processing takes the nodes in order of label and keeps the digests under way in a priority queue ordered by the label of the
receiver, so that a parent finds all its children at the head of the queue. The queue is external: between bands of
``BAND_LEVELS`` levels it is Spark's shuffle, keyed by the labels of the next band's nodes, on disk and split over tasks; within a
block, the part of a band below one node (3 ** ``BAND_LEVELS`` nodes at most), it is a heap. A reversed sweep then goes through
the bands from the root down: a node receives its proof suffix (what stands left and right of it and of each of its ancestors),
adds the siblings of each child, and passes it on, until every leaf has its whole proof.

Positions come from a sort over the cluster and sums over its slices. A source of any size is split into blocks, so no task
holds more than a slice or a block, and only numbers of rows and the root itself reach the driver.

Results for odd input: null columns are digested as ``-``; a null source is a tree of its own and comes first, as does a null
id within its source; rows that repeat an id are ordered by their digests, equal rows are equal leaves; an empty text is not a
null one; very long texts are digested whole; a source with one row has that leaf as its subroot, with no level in between; an
empty table has no leaves; only the columns named are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendaudit.llm.common import on_workers
from spendaudit.session import materialize

FAN = 3
#: Levels of a band; a block has at most FAN ** BAND_LEVELS nodes on its lowest level.
BAND_LEVELS = 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: What stands left and right of a node and of each ancestor, as digests in hexadecimal, from below.
SUFFIX = "array<struct<left:string,right:string>>"
_SUFFIX = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def hashed(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode("ascii")).hexdigest()


def digest(values: list[Column]) -> Column:
    """Digest of these values as binary: ``-`` for a null, else length in bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos``, the place of a row in its tree from 0, and ``n``, the rows of the tree. Sorted over the cluster."""
    stored = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), f"{name}-unsorted")  # equal rows are dealt by row
    keys = ["tree", *order, "row"]
    ranged = stored.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").withColumn("slice", F.spark_partition_id())
    names = ranged.columns
    at = names.index("tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, place = None, 0
        for batch in batches:
            places = []
            for t in batch.column(at).to_pylist():
                tree, place = t, place + 1 if t == tree else 0
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*names, "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    sorted_rows = materialize(ranged.mapInArrow(run, f"{schema}, place long"), name)
    slices = sorted_rows.groupBy("tree", "slice").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("tree", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    placed = sorted_rows.join(materialize(slices, f"{name}-slices"), ["tree", "slice"])
    return placed.withColumn("pos", F.col("before") + F.col("place")).drop("slice", "place", "before")


def levels_of_block(digests: list[str], first: int, n: int, levels: int) -> list[dict[int, str]]:
    """The nodes of a block by position, level by level from below. ``first`` is the position of the first node and ``n`` the
    number of nodes of the whole tree on the lowest level; the last level has one node, the block's highest."""
    sizes = [n]
    while sizes[-1] > 1 and len(sizes) <= levels:
        sizes.append(-(-sizes[-1] // FAN))
    nodes: list[dict[int, str]] = [{} for _ in sizes]
    queue = [(0, first + i, 0, d) for i, d in enumerate(digests)]  # (level, position) of the receiver, sender's position, digest
    heapify(queue)
    while queue:
        level, pos = queue[0][:2]
        arrived = []
        while queue and queue[0][:2] == (level, pos):
            arrived.append(heappop(queue)[3])
        nodes[level][pos] = found = hashed(arrived) if level else arrived[0]
        if level + 1 < len(sizes):
            heappush(queue, (level + 1, pos // FAN, pos, found))
    return nodes


def suffixes_of_block(nodes: list[dict[int, str]], above: list[tuple[str, str]]) -> dict[int, list[tuple[str, str]]]:
    """What stands beside each node of the lowest level and its ancestors, from what stands beside the block's highest node: the
    same sweep in reversed order of label."""
    (top,) = nodes[-1]
    sent = {top: above}
    for level in reversed(nodes[:-1]):
        received, sent = sent, {}
        for pos in reversed(level):
            run = range(pos // FAN * FAN, pos // FAN * FAN + FAN)
            beside = ("".join(level[k] for k in run if k < pos), "".join(level[k] for k in run if k > pos and k in level))
            sent[pos] = [beside, *received[pos // FAN]]
    return sent


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(FAN**BAND_LEVELS)).cast("long"))


def _in_order(part: pa.Table) -> tuple[list[int], list[str], int]:
    """Positions, digests and size of the level of one block's nodes."""
    part = part.select(["pos", "digest", "n"]).sort_by("pos")
    return part["pos"].to_pylist(), [d.hex() for d in part["digest"].to_pylist()], part["n"][0].as_py()


def bands(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The nodes (tree, pos, digest, n) on the lowest level of every band, and last the roots: the forward sweep."""

    def run(part: pa.Table) -> pa.Table:
        positions, digests, n = _in_order(part)
        (found,) = levels_of_block(digests, positions[0], n, BAND_LEVELS)[-1].values()
        above = -(-n // FAN**BAND_LEVELS)
        return pa.table({"tree": part["tree"][:1], "pos": part["block"][:1], "digest": pa.array([bytes.fromhex(found)]), "n": pa.array([above], pa.int64())})

    found = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        lowest = _blocks(found[-1].select("tree", "pos", "digest", "n"))
        highest = lowest.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, digest binary, n long")
        found.append(materialize(highest, f"{name}-band-{len(found)}"))
        most = -(-most // FAN**BAND_LEVELS)
    return found


def passed_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, pos, subroot, suffix of a band's lowest nodes, from those of the next band's: one step of the reversed sweep."""

    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        positions, digests, n = _in_order(part)
        suffix = [(s["left"], s["right"]) for s in told["suffix"][0].as_py()]
        found = suffixes_of_block(levels_of_block(digests, positions[0], n, BAND_LEVELS), suffix)
        columns = {
            "tree": pa.array([part["tree"][0].as_py()] * len(positions), pa.string()), "pos": pa.array(positions, pa.int64()),
            "subroot": pa.array([told["subroot"][0].as_py()] * len(positions), pa.string()),
            "suffix": pa.array([[{"left": a, "right": b} for a, b in found[p]] for p in positions], _SUFFIX),
        }
        return pa.table(columns)

    below = _blocks(nodes.select("tree", "pos", "digest", "n")).groupBy("tree", "block")
    told = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return below.cogroup(told).applyInArrow(run, f"tree string, pos long, subroot string, suffix {SUFFIX}")


def folded(leaf: str, suffix: list[tuple[str, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in suffix:
        leaf = hashed([left, leaf, right])
    return leaf


def proven_leaves(leaves: DataFrame, above: DataFrame, root: str, with_proof: bool) -> DataFrame:
    """The last step of the reversed sweep, where every leaf checks its proof."""
    kept = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(part: pa.Table, told: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        positions, digests, n = _in_order(part)
        suffix = [(s["left"], s["right"]) for s in told["suffix"][0].as_py()]
        found = suffixes_of_block(levels_of_block(digests, positions[0], n, BAND_LEVELS), suffix)
        proofs = [found[p] for p in positions]
        roots = [folded(d.hex(), proof) for d, proof in zip(part["claimed"].to_pylist(), proofs)]
        rows = len(positions)
        columns = [
            part["doc_id"], pa.array(digests), pa.array([told["subroot"][0].as_py()] * rows, pa.string()), pa.array([root] * rows),
            pa.array([hashed([x for pair in proof for x in pair]) for proof in proofs]), pa.array(roots), pa.array([r == root for r in roots]),
        ]
        if with_proof:
            columns.append(pa.array([[{"left": a, "right": b} for a, b in proof] for proof in proofs], _SUFFIX))
        return pa.table(columns, [c.split(" ")[0] for c in kept.split(", ")] + ["proof"] * with_proof)

    told = above.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return _blocks(leaves).groupBy("tree", "block").cogroup(told).applyInArrow(run, kept + f", proof {SUFFIX}" * with_proof)


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
    claimed_text: Column | None = None, with_proof: bool = False,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and the proof) of every row.

    ``claimed_text`` is the text that a holder of the row presents; ``folded_root`` is the root that its leaf leads to, and
    ``verified`` tells whether that is the root. Without it, the rows themselves are verified.
    """
    leaf = digest([F.col(f"`{c}`") for c in columns])
    claimed = leaf
    if claimed_text is not None:
        text = F.col(f"`{text_col}`").cast("string")
        same = claimed_text.eqNullSafe(text)
        claimed = F.when(~same, digest([claimed_text if c == text_col else F.col(f"`{c}`") for c in columns]))
    source = F.col(f"`{source_col}`").cast("string")
    rows = on_workers(docs).select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("tree"),  # sorts like the source, null first
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("digest"), claimed.alias("claimed"),
    )
    rows = rows.withColumn("claimed", F.coalesce("claimed", "digest"))
    leaves = materialize(numbered(rows, ["doc_id", "digest"], "merkle-leaves"), "merkle-placed")
    of_sources = bands(leaves, "merkle")
    # a tree that is complete early stays a lone node in the bands above
    subroots = of_sources[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest")
    subroots = materialize(numbered(subroots, ["own"], "merkle-subroots"), "merkle-subroots-placed")
    of_dataset = bands(subroots, "merkle-top")
    top = of_dataset[-1].select("digest").first()
    root = bytes(top.digest).hex() if top else ""
    none = F.array().cast(SUFFIX)
    told = of_dataset[-1].select("tree", "pos", F.lit("").alias("subroot"), none.alias("suffix"))
    for nodes in reversed(of_dataset[:-1]):
        told = passed_down(nodes, told)
    told = subroots.join(told.select("tree", "pos", "suffix"), ["tree", "pos"])
    told = told.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lower(F.hex("digest")).alias("subroot"), "suffix")
    told = materialize(told, "merkle-told-top")
    for step, nodes in enumerate(reversed(of_sources[1:-1])):
        told = materialize(passed_down(nodes, told), f"merkle-told-{step}")
    return proven_leaves(leaves, told, root, with_proof)
