"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles (64-bit hashes). Links are pairs of documents whose sets have a Jaccard similarity of at
least 3/4. The join is exact:

1. Documents with equal sets become one, with the smallest id.
2. A shingle that no other document has can be in no intersection. Shingles are counted over all documents, packed by range of
   their hash; a document with fewer than 3/4 of its shingles shared has no link and leaves.
3. The others are partitioned into groups of similar documents: documents with an equal least hash, under several hash
   functions, are compared with the most central of them, and connected ones form a group.
4. The matrix holds, for each shingle, the groups in whose members' index prefixes it lies, with the sizes of these members.
   Shingles are ordered from rare to frequent; a document asks with the shingles of its probe prefix, and meets every group
   that could hold a link of at most its own size.
5. The document is compared with the group's most central member. If that is no link, the group's blocks are taken in waves,
   each with the union of its members' shingles: a block whose union overlaps the document by less than 3/4 holds no link and
   stays closed; the members of the others are compared, until the two are joined or no block is left.
6. Links and groups together make the components.

One document or group meets another at most once per group, not per member: thousands of near copies are one group, found
through comparisons with one document each. Frequent shingles lie outside the prefixes of all documents but those that mostly
consist of them.

Results for odd input: null and empty texts, and texts without words, have no shingles and link with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat an id get one row; rows without an id are left out; very long
texts are read whole; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import SLICE_ROWS, id_and_text
from spendaudit.llm.components import component_labels
from spendaudit.session import materialize

SHINGLE_WORDS = 5
#: Least similarity as a fraction.
UP, DOWN = 3, 4
#: Hash functions for forming groups. More of them make fewer groups; the result is the same.
ROUNDS = 5
#: Members of a block, and blocks of a group opened in the first wave.
BLOCK_MEMBERS = 16
BLOCKS_FIRST = 4
#: Bytes of text whose shingles one task counts, and bytes of packed rows that a task holds in memory.
RANGE_BYTES = 8 << 20
SPOOL_BYTES = 16 << 20
#: Words a worker remembers the hash of.
REMEMBERED = 150_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([_HASHES[w] for w in words], np.uint64)
    if len(words) < width:
        # Not the hash of any full shingle: the number of words goes in as well.
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words)) ^ len(words)], np.uint64))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mixed(total * _MIX[k % len(_MIX)] + hashes[k : k + n])
    return np.unique(total)


def least_shared(n):
    """Shingles of a document with n that a linked one must have, too: 3/4 of n, rounded up."""
    return -(-UP * n // DOWN)


def linked(common, n, m):
    """Whether the intersection is at least 3/4 of the union."""
    return DOWN * common >= UP * (n + m - common)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


PACKED = "range long, slice long, owners binary, hashes binary, n binary, docs binary, keys binary"
#: Bytes of a hash that travel and are compared. Numbers of shingles and digests of sets come from all eight.
HASH_BYTES = 6


def packed(hashes: np.ndarray) -> bytes:
    return hashes.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpacked_hashes(data: bytes) -> np.ndarray:
    n = len(data) // HASH_BYTES
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(n, HASH_BYTES)
    return wide.reshape(-1).view(np.uint64)


def packed_shingles(docs: DataFrame, ranges: int) -> DataFrame:
    """The shingles of slices of documents, packed by range of hashes: one row for each slice and range that has any.

    ``owners`` has the place in the slice of each shingle's document. One more row of each slice, with ``keys``, lists its
    documents, their numbers of shingles and 16-byte digests of their sets. A slice has up to ``SLICE_ROWS`` documents; its
    name follows from its ids and sets.
    """

    def run(batches):
        for part in _slices(batches):
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = [shingles(t) for t in part.column(1).to_pylist()]
            counts = np.array([len(s) for s in sets], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            name = xxhash.xxh3_64_intdigest(ids.tobytes() + digests) >> 1
            rows = [(name % ranges, name, None, None, counts.tobytes(), ids.tobytes(), digests)]
            hashes = np.concatenate(sets)
            if len(hashes):
                owner = np.repeat(np.arange(len(ids), dtype=np.uint8), counts)
                at = _range_of(hashes, ranges)
                order = np.argsort(at, kind="stable")
                at, hashes, owner = at[order], hashes[order], owner[order]
                edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1)).tolist()
                rows += [(int(at[a]), name, owner[a:b].tobytes(), packed(hashes[a:b]), None, None, None) for a, b in zip(edges, edges[1:])]
            types = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            names = ["range", "slice", "owners", "hashes", "n", "docs", "keys"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.mapInArrow(run, PACKED)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64) * ranges) >> 32


class _Counts:
    """Distinct hashes and their numbers, merged as packed rows arrive: memory follows the distinct hashes of a partition."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size > 500_000 + len(self.keys):
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            new, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            at = np.searchsorted(self.keys, new)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == new if len(self.keys) else np.zeros(len(new), bool)
            self.n[at[known]] += n[known]
            self.keys, self.n = np.insert(self.keys, at[~known], new[~known]), np.insert(self.n, at[~known], n[~known])
            self.waiting, self.size = [], 0


def _frequency_class(n: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, as 16 bits: it orders shingles, nothing is left out by it."""
    return (np.log2(n) * 1000).astype(np.uint16)


def shared_shingles(rows: DataFrame, partitions: int) -> DataFrame:
    """The packed rows with only those shingles that two documents or more have; ``n`` then holds their frequency classes.

    Each partition's rows are counted as they arrive and kept in a spool that moves to the task's own temporary file when it
    grows, then read once more: a shingle that a third of all documents have costs disk, not memory.
    """

    def run(batches):
        found = _Counts()
        with tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) as spool:
            writer = None
            for batch in batches:
                about = pa.array([k is not None for k in batch.column(6).to_pylist()], pa.bool_())
                if about.true_count:
                    yield batch.filter(about)
                rows = batch.filter(pa.array([not x for x in about.to_pylist()], pa.bool_()))
                if rows.num_rows:
                    writer = writer or pa.ipc.new_stream(spool, rows.schema)
                    writer.write_batch(rows)
                    for data in rows.column(3).to_pylist():
                        found.add(unpacked_hashes(data))
            if writer is None:
                return
            writer.close()
            found.merge()
            keys, classes = found.keys[found.n > 1], _frequency_class(found.n[found.n > 1])
            if not len(keys):
                return
            spool.seek(0)
            for batch in pa.ipc.open_stream(spool):
                out = []
                for k, name, owners, hashes in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    mine = unpacked_hashes(hashes)
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    hit = keys[at] == mine
                    if hit.any():
                        owner = np.frombuffer(owners, np.uint8)[hit]
                        out.append((k, name, owner.tobytes(), packed(mine[hit]), classes[at[hit]].tobytes(), None, None))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)], batch.schema.names)

    return rows.repartition(partitions, "range").mapInArrow(run, PACKED)


SETS = "doc_id long, n long, key binary, set binary, keys array<long>, central double"


def assembled(pieces: DataFrame) -> DataFrame:
    """doc_id, n, key, set, keys, central of all documents; ``set`` only where enough shingles are shared for a link.

    ``set`` holds the shared shingles ascending, followed by their frequency classes; ``keys`` the least of each hash
    function; ``central`` is the mean frequency class, highest where a document has few edits of its own. A group is a slice of documents, so it is bounded. Documents without shingles have no key.
    """

    def gather(table: pa.Table) -> pa.Table:
        owners, hashes, classes, about = [], [], [], {}
        for owner, some, n, docs, keys in zip(*(table.column(c).to_pylist() for c in ("owners", "hashes", "n", "docs", "keys"))):
            if keys is not None:  # a slice that came twice, because its rows repeat, tells the same twice
                sizes = np.frombuffer(n, np.int64).tolist()
                about = {i: (doc, m, keys[16 * i : 16 * i + 16]) for i, (doc, m) in enumerate(zip(np.frombuffer(docs, np.int64).tolist(), sizes))}
            else:
                owners.append(np.frombuffer(owner, np.uint8))
                hashes.append(unpacked_hashes(some))
                classes.append(np.frombuffer(n, np.uint16))
        empty = [np.zeros(0, np.uint8)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        owner, every, rank = (np.concatenate(x or e) for x, e in zip((owners, hashes, classes), empty))
        order = np.lexsort((every, owner))
        owner, every, rank = owner[order], every[order], rank[order]
        edges = np.searchsorted(owner, np.arange(len(about) + 1))
        rows = []
        for i, (doc, n, key) in about.items():
            data, least, central = None, None, None
            h, k = every[edges[i] : edges[i + 1]], rank[edges[i] : edges[i + 1]]
            if n and len(h) * DOWN >= n * UP:
                h, at = np.unique(h, return_index=True)
                if len(h) * DOWN >= n * UP:
                    data = packed(h) + k[at].tobytes()
                    least = [int(_mixed(h * _MIX[r] + _MIX[r]).min() >> np.uint64(1)) for r in range(ROUNDS)]
                    central = float(k[at].sum()) / n
            rows.append((doc, n, key if n else None, data, least, central))
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64()]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n", "key", "set", "keys", "central"])

    return pieces.groupBy("slice").applyInArrow(gather, SETS)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their frequency classes."""
    n = len(data) // (HASH_BYTES + 2)
    return unpacked_hashes(data[: HASH_BYTES * n]), np.frombuffer(data, np.uint16, n, HASH_BYTES * n)


def shingles_of(data: bytes) -> np.ndarray:
    return unpacked(data)[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b")

    def hit(n, m, x, y) -> bool:
        return DOWN * min(n, m) >= UP * max(n, m) and linked(len(np.intersect1d(shingles_of(x), shingles_of(y), assume_unique=True)), n, m)

    def run(batches):
        for part in _slices(batches):
            keep = pa.array([hit(*row) for row in zip(*(part.column(k).to_pylist() for k in range(2, 6)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """doc_id, n, hash, reach: shared shingles of the probe prefix; ``reach`` is the largest size of a partner with which the
    first common shingle can be this one.

    The order is by count, then by hash. A document's unshared shingles come before all others and take their places. With
    ``p`` shingles before the first common one, at most n - p are common; a partner of m needs 3/7 of n + m.
    """

    def run(batches):
        for part in _slices(batches):
            ids, sizes, hashes, reach = [], [], [], []
            for doc, n, data in zip(*(c.to_pylist() for c in part.columns)):
                h, classes = unpacked(data)
                alone = n - len(h)
                probe = n - least_shared(n) + 1 - alone
                first = h[np.lexsort((h, classes))[:probe]].view(np.int64)
                ids.append(np.full(len(first), doc, np.int64))
                sizes.append(np.full(len(first), n, np.int64))
                hashes.append(first)
                reach.append((UP + DOWN) * (n - alone - np.arange(len(first), dtype=np.int64)) // UP - n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, sizes, hashes, reach)], ["doc_id", "n", "hash", "reach"])

    return sets.select("doc_id", "n", "set").mapInArrow(run, "doc_id long, n long, hash long, reach long")


def group_candidates(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """query, group: groups, not the query's own, in which a member of at most the query's size could be linked to it."""
    rows = materialize(prefix_rows(sets).join(groups, "doc_id"), "prefixes")
    # The smaller partner (or either of equal ones) is met, the larger asks.
    indexed = F.col("reach") >= F.col("n")
    # A shingle that only one group has, in either prefix, opens nothing.
    between = rows.groupBy("hash").agg(F.min("group").alias("one"), F.max("group").alias("other"), F.max(indexed).alias("indexed"))
    open_hashes = materialize(between.filter("one != other and indexed").select("hash"), "open-shingles")
    open_rows = materialize(rows.join(open_hashes, "hash", "left_semi"), "open-prefixes")
    matrix = open_rows.filter(indexed).groupBy("hash", F.col("group").alias("met")).agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("met_reach")
    )
    fits = (
        (F.col("met") != F.col("group")) & (F.col("least") <= F.least("n", "reach")) & (F.col("met_reach") >= F.col("n"))
        & (F.col("most") * DOWN >= F.col("n") * UP)
    )
    met = open_rows.join(materialize(matrix, "matrix"), "hash").filter(fits)
    return met.select(F.col("doc_id").alias("query"), F.col("met").alias("group")).distinct()


def group_blocks(sets: DataFrame, groups: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the met groups (group, block, doc_id), and each block's sizes and union of shingles."""
    members = sets.join(groups, "doc_id").join(candidates.select("group").distinct(), "group", "left_semi")
    many = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).alias("blocks"))
    placed = members.join(many, "group").select("group", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block"), "doc_id", "n", "set")
    placed = materialize(placed, "blocks")

    def union(table: pa.Table) -> pa.Table:
        every = np.unique(np.concatenate([shingles_of(s) for s in table.column("set").to_pylist()]))
        n = table.column("n").to_pylist()
        return pa.table({
            "group": table.column("group").slice(0, 1), "block": table.column("block").slice(0, 1), "least": pa.array([min(n)], pa.int64()),
            "most": pa.array([max(n)], pa.int64()), "every": pa.array([packed(every)], pa.binary()),
        })

    unions = placed.groupBy("group", "block").applyInArrow(union, "group long, block long, least long, most long, every binary")
    return placed.select("group", "block", "doc_id"), materialize(unions, "unions")


def open_blocks(candidates: DataFrame, sets: DataFrame, members: DataFrame, unions: DataFrame) -> DataFrame:
    """a, b: query and member for every member of a block whose union overlaps the query enough."""
    asked = candidates.join(sets.select(F.col("doc_id").alias("query"), "n"), "query")
    fits = (F.col("least") <= F.col("n")) & (F.col("most") * DOWN >= F.col("n") * UP)
    narrow = asked.join(unions.drop("every"), "group").filter(fits).select("query", "group", "block", "least")
    both = narrow.join(sets.select(F.col("doc_id").alias("query"), "n", "set"), "query").join(unions.select("group", "block", "every"), ["group", "block"])

    def bound(batches):
        for part in _slices(batches):
            n, least, own, every = (part.column(k).to_pylist() for k in (3, 4, 5, 6))
            overlaps = [len(np.intersect1d(shingles_of(s), unpacked_hashes(u), assume_unique=True)) for s, u in zip(own, every)]
            # A member of m shingles has 3/7 of n + m in common with the query if it is linked, and m is at least the least.
            keep = pa.array([o >= least_shared(a) and (UP + DOWN) * o >= UP * (a + b) for o, a, b in zip(overlaps, n, least)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(k).filter(keep) for k in range(3)], ["query", "group", "block"])

    ordered = both.select("query", "group", "block", "n", "least", "set", "every")
    opened = ordered.mapInArrow(bound, "query long, group long, block long")
    return opened.join(members, ["group", "block"]).select(F.col("query").alias("a"), F.col("doc_id").alias("b"))


def with_links(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels (node, component) after these links (a, b) have joined components; only components are joined anew."""
    of = {side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in")) for side in ("a", "b")}
    named = found.join(of["a"], "a", "left").join(of["b"], "b", "left")
    named = materialize(named.select("a", "b", F.coalesce("a_in", "a").alias("a_in"), F.coalesce("b_in", "b").alias("b_in")), "joined-links")
    joined = component_labels(named.select(F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct())
    fresh = named.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.withColumn("component", F.col("node")))
    moved = every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    return materialize(moved.select("node", F.coalesce("into", "component").alias("component")), "labels")


def components_across(candidates: DataFrame, sets: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after all links between groups that join components have been found.

    A query is compared with the most central member of a met group first, then with blocks, in waves of eight times as many.
    After a wave that joined components, candidates whose query and group have met leave: a group of thousands of near copies
    is opened by few of its like, and a group without a link to the query is opened whole.
    """
    heads = groups.join(sets.select("doc_id", "central"), "doc_id").groupBy("group").agg(F.max_by("doc_id", "central").alias("b"))
    found = materialize(verified(candidates.join(heads, "group").select(F.col("query").alias("a"), "b"), sets), "links")
    members, unions = group_blocks(sets, groups, candidates)
    first, end = 0, BLOCKS_FIRST
    while True:
        if found.limit(1).count():
            labels = with_links(labels, found)
            of = {side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in")) for side in ("query", "group")}
            left = candidates.join(of["query"], "query", "left").join(of["group"], "group", "left")
            apart = F.coalesce("query_in", "query") != F.coalesce("group_in", "group")
            candidates = materialize(left.filter(apart).select("query", "group"), "candidates")
        if not candidates.join(unions.filter(F.col("block") >= first), "group", "left_semi").limit(1).count():
            return labels
        some = unions.filter((F.col("block") >= first) & (F.col("block") < end))
        opened = materialize(open_blocks(candidates, sets, members, some).distinct(), "opened")
        found = materialize(verified(opened, sets), "links")
        first, end = end, 9 * end


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links, itself included) of every document."""
    texts = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(1, -(-size // RANGE_BYTES))
    pieces = shared_shingles(packed_shingles(texts, 4 * partitions), partitions)
    every = materialize(assembled(pieces), "shingle-sets")
    # Documents with equal sets become one, with the smallest id.
    classes = materialize(every.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    sets = every.filter("set is not null").join(classes, "key").filter("doc_id = rep").select("doc_id", "n", "set", "keys", "central")
    sets = materialize(sets.dropDuplicates(["doc_id"]), "shared-sets")

    keyed = sets.select("doc_id", "central", F.posexplode("keys").alias("round", "key"))
    firsts = keyed.groupBy("round", "key").agg(F.max_by("doc_id", "central").alias("b"), F.count("*").alias("many"))
    firsts = materialize(firsts.filter("many > 1").select("round", "key", "b"), "firsts")
    near = keyed.join(firsts, ["round", "key"]).filter("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    labels = component_labels(materialize(verified(near, sets), "links-in-groups"))
    groups = sets.select("doc_id").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    groups = materialize(groups.select("doc_id", F.coalesce("component", "doc_id").alias("group")), "groups")

    candidates = materialize(group_candidates(sets, groups), "candidates")
    labels = components_across(candidates, sets, groups, labels).withColumnRenamed("node", "rep")
    of_class = every.select("doc_id", "n", "key").join(classes, "key", "left").groupBy("doc_id").agg(F.max("n").alias("n"), F.min("rep").alias("rep"))
    named = of_class.join(labels, "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have an earlier one in their component; all columns as they were.

    Rows that repeat an id are one document and stay or go together; rows without an id stay."""
    gone = f"_{uuid.uuid4().hex}"
    later = similar_classes(docs, id_col, text_col).filter("component_id != doc_id").select(F.col("doc_id").alias(gone))
    return docs.join(later, F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
