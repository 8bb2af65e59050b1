"""Phrase collocation mining by direct-address tiling.

Phrases of two and three words are counted per language and scored by how far their words hold together.

1. Words are counted. The most frequent ones (``direct_words``) get their frequency rank as id and travel to every task; all
   others go by a 63-bit key of the word. Keys are checked for collisions over all distinct words, and drawn anew if a frequent
   word has one.
2. Each task turns its texts into arrays of ids. The matrix of word pairs is cut into square tiles of frequency ranks: the tiles
   that a slice of text fills well are counted by one dense ``bincount`` each, the pairs in all other tiles as a sorted list of
   coordinates (COO). Lists are merged within the task, and Spark sums them over the tasks.
3. Pairs that are frequent enough are ranked by frequency in their turn and become the rows of a second matrix, with words as
   columns; its tiles count phrases of three words in the same way. A phrase is counted only where both its pairs are frequent.
4. Phrases are scored at their weakest cut with exact integers; those that mostly occur within a longer one are dropped.

What travels to every task is bounded: ``direct_words`` words, as many pairs, and two bitmaps of at most ``most_bits`` bits that
tell which other words and pairs can be frequent at all. A bitmap too small for its entries lets more rows pass; the final
counts decide, so the result is the same. A task holds ``CHUNK`` ids and ``LISTED`` coordinates at most, and passes partial
sums on beyond that, so neither frequent words nor long texts gather anywhere.

Results for odd input: null and empty texts hold no words; a null language counts as ``und``; ids are not read, so repeated
rows and rows without an id count as often as they stand there; very long texts are read whole, in stretches; ties in the
ranking are broken by the phrase; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spendaudit.llm.common import SLICE_ROWS, on_workers
from spendaudit.session import materialize

LEAST_COUNT = 10
TOP = 2000
#: Words, and pairs of words, that have a place of their own in the matrix.
DIRECT = 1 << 17
#: Ranks on a side of a tile, tiles on a side of the tiled corner, and cells for each occurrence up to which a tile is dense.
SIDE = 1024
ACROSS = 16
SPARSE = 32
#: Bits of a bitmap for each entry, and at most.
BITS_EACH = 16
MOST_BITS = 1 << 28
#: Ids that a task counts at a time, coordinates it holds, distinct words it knows, and bytes of text it cuts at a time.
CHUNK = 1 << 20
LISTED = 3 << 20
KNOWN = 1 << 19
STRETCH = 1 << 20
#: Bits of an id within a task; three ids fit in one integer.
ID_BITS = 21

_PIECE_END = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes(0x0A if b in _PIECE_END else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BREAK, _NOTHING, _FIRST = 0, 1, 2
_BITMAP = 32768


def stretches(text: bytes | None) -> Iterator[bytes]:
    """The normalised text, A-Z lowered and a line break for each end of a piece, cut between words."""
    data, at = (text or b"").translate(_NORMAL), 0
    while at < len(data):
        end = data.find(b" ", at + STRETCH)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def word_key(word: bytes, seed: int) -> int:
    """Above all ranks."""
    return xxhash.xxh3_64_intdigest(word, seed) >> 2 | 1 << 62


def pair_spots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A well-mixed number for each pair of keys."""
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    return on_workers(docs).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, key, n: every distinct word."""

    def emitted(counters: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counters.items():
            words = list(counter)
            for at in range(0, len(words), 1 << 16):
                part = words[at : at + (1 << 16)]
                columns = [
                    pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()),
                    pa.array([word_key(w, seed) for w in part], pa.int64()), pa.array([counter[w] for w in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "key", "n"])

    def run(batches):
        counters: dict[str, Counter] = {}
        known = 0
        for lang, text in _rows(batches):
            for data in stretches(text):
                counter = counters.setdefault(lang, Counter())
                known -= len(counter)
                counter.update(data.split())
                known += len(counter)
                if known > KNOWN:
                    yield from emitted(counters)
                    counters, known = {}, 0
        yield from emitted(counters)

    found = texts.mapInArrow(run, "lang string, word binary, key long, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("key").alias("key"))


def bitmap(spots: DataFrame, entries: int, most_bits: int) -> np.ndarray:
    """One bit for each remainder that a ``spot`` leaves; as bytes, lowest bit first. The size is bounded."""
    bits = _BITMAP
    while bits < min(BITS_EACH * entries, most_bits):
        bits *= 2
    at = F.col("spot") % bits
    found = spots.groupBy((at / _BITMAP).cast("long").alias("block")).agg(F.bitmap_construct_agg(at % _BITMAP).alias("bits"))
    whole = np.zeros((bits // _BITMAP, _BITMAP // 8), np.uint8)
    for row in found.collect():  # 4 KB for each block
        whole[row.block] = np.frombuffer(row.bits, np.uint8)
    return whole.reshape(-1)


def _set_bits(whole: np.ndarray, spots: np.ndarray) -> np.ndarray:
    at = spots % (8 * len(whole))
    return (whole[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Ids(dict):
    """Ids of words within a task: frequent words by rank, others as they come, words that can't be frequent as a break."""

    def __init__(self, words: list[bytes], rest: np.ndarray, seed: int) -> None:
        super().__init__({w: i + _FIRST for i, w in enumerate(words)})
        self[b""], self[b"\n"] = _NOTHING, _BREAK
        self.keys_of = [-1, -1, *range(len(words))]
        self.rest, self.seed = rest, seed

    def __missing__(self, word: bytes) -> int:
        key = word_key(word, self.seed)
        at = key % (8 * len(self.rest))
        found = _BREAK
        if self.rest[at >> 3] >> (at & 7) & 1:
            found = len(self.keys_of)
            self.keys_of.append(key)
        self[word] = found
        return found


def tile_counts(left: np.ndarray, right: np.ndarray, codes: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, and how often each occurs. ``left`` is the rank of an entry's row, or -1, and ``right`` its column; the
    code of an entry is the name of its row and its column."""
    tiled = (left >= 0) & (left < SIDE * ACROSS) & (right < SIDE * ACROSS)
    tiles = np.where(tiled, left // SIDE * ACROSS + right // SIDE, ACROSS * ACROSS)
    load = np.bincount(tiles, minlength=ACROSS * ACROSS + 1)[:-1]
    found, counts = [], []
    for tile in np.flatnonzero(load >= SIDE * SIDE // SPARSE):
        inside = tiles == tile
        cells = np.bincount(left[inside] % SIDE * SIDE + right[inside] % SIDE, minlength=SIDE * SIDE)
        full = np.flatnonzero(cells)
        found.append(names[tile // ACROSS * SIDE + full // SIDE] << ID_BITS | tile % ACROSS * SIDE + full % SIDE)
        counts.append(cells[full])
        tiles[inside] = -1
    sparse = np.unique(codes[tiles >= 0], return_counts=True)
    return np.concatenate([*found, sparse[0]]), np.concatenate([*counts, sparse[1]])


def merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of coordinates as one."""
    codes, counts = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class _Pairs:
    """Counts pairs of adjacent words."""

    width = 2

    def __init__(self, keys_of: np.ndarray) -> None:
        self.keys_of = keys_of
        self.names = np.arange(SIDE * ACROSS, dtype=np.int64)

    def count(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = ids[:-1], ids[1:]
        both = (left != _BREAK) & (right != _BREAK)
        left, right = left[both], right[both]
        return tile_counts(left, right, left << ID_BITS | right, self.names)


class _Triples:
    """Counts phrases of three words of which both pairs are frequent: rows are pairs, columns words."""

    width = 3

    def __init__(self, keys_of: np.ndarray, pairs: np.ndarray, frequent: np.ndarray) -> None:
        """``pairs`` has the codes of pairs by rank, ``frequent`` the bitmap of all."""
        self.keys_of, self.frequent = keys_of, frequent
        self.order = np.argsort(pairs)
        self.sorted = pairs[self.order]
        self.names = np.concatenate([pairs, np.zeros(max(0, SIDE * ACROSS - len(pairs)), np.int64)])

    def count(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys_of[ids]
        frequent = (ids[:-1] != _BREAK) & (ids[1:] != _BREAK)
        frequent[frequent] = _set_bits(self.frequent, pair_spots(keys[:-1][frequent], keys[1:][frequent]))
        at = np.flatnonzero(frequent[:-1] & frequent[1:])
        pairs, right = ids[at] << ID_BITS | ids[at + 1], ids[at + 2]
        rank = np.full(len(at), -1, np.int64)
        if len(self.sorted):
            place = np.minimum(np.searchsorted(self.sorted, pairs), len(self.sorted) - 1)
            rank = np.where(self.sorted[place] == pairs, self.order[place], -1)
        return tile_counts(rank, right, pairs << ID_BITS | right, self.names)


def phrase_counts(texts: DataFrame, width: int, told, least_count: int) -> DataFrame:
    """lang, k1, k2 (, k3), n: phrases of so many words that occur ``least_count`` times."""
    names = ["lang", *(f"k{i + 1}" for i in range(width)), "n"]

    def run(batches):
        book = told.value

        def start():
            ids = _Ids(book["words"], book["rest"], book["seed"])
            return ids, {}, {}

        ids, waiting, lists = start()
        n_waiting = n_listed = 0

        def count_waiting() -> int:
            """Moves the ids that wait into the lists; how many coordinates these have then."""
            keys_of = np.array(ids.keys_of, np.int64)
            counter = _Pairs(keys_of) if width == 2 else _Triples(keys_of, book["pairs"], book["frequent"])
            for lang, arrays in waiting.items():
                whole = np.concatenate(arrays)
                new = [counter.count(whole[at : at + CHUNK + width - 1]) for at in range(0, len(whole), CHUNK)]
                lists[lang] = merged([*([lists[lang]] if lang in lists else []), *new])
            waiting.clear()
            return sum(len(codes) for codes, _ in lists.values())

        def emitted():
            keys_of = np.array(ids.keys_of, np.int64)
            for lang, (codes, counts) in lists.items():
                for at in range(0, len(codes), 1 << 16):
                    part = codes[at : at + (1 << 16)]
                    places = [part >> ID_BITS * (width - 1 - i) & (1 << ID_BITS) - 1 for i in range(width)]
                    columns = [pa.array([lang] * len(part), pa.string()), *(pa.array(keys_of[p]) for p in places), pa.array(counts[at : at + (1 << 16)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)

        for lang, text in _rows(batches):
            last: list[bytes] = []
            for data in stretches(text):
                tokens = data.replace(b"\n", b" \n ").split(b" ")
                found = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
                waiting.setdefault(lang, []).append(found[found != _NOTHING])
                n_waiting += len(tokens)
                last = [*last, *(t for t in tokens if t)][1 - width :]
                if n_waiting > CHUNK or len(ids) > KNOWN:
                    n_listed, n_waiting = count_waiting(), 0
                    if n_listed > LISTED or len(ids) > KNOWN:
                        yield from emitted()
                        ids, waiting, lists = start()
                    # what follows in this text may form phrases with its last words
                    waiting[lang] = [np.array([ids[t] for t in last], np.int64)]
            waiting.setdefault(lang, []).append(np.array([_BREAK], np.int64))
        count_waiting()
        yield from emitted()

    found = texts.mapInArrow(run, ", ".join(f"{n} {'string' if n == 'lang' else 'long'}" for n in names))
    # each task's counts are summed already, so a second sum before the shuffle would only hold them all in memory
    dealt = found.repartition(*names[:-1])
    return dealt.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def frequent_words(texts: DataFrame, least_count: int, keys=word_counts) -> tuple[DataFrame, DataFrame, int]:
    """The words (lang, word, n, key) of frequent phrases, the number of words of each language, and the seed of the keys."""
    for seed in count():
        every = materialize(keys(texts, seed), "word-counts")
        alike = every.groupBy("lang", "key").agg(F.count("*").alias("words"), F.sum("n").alias("n"))
        if alike.filter((F.col("words") > 1) & (F.col("n") >= least_count)).isEmpty():
            totals = materialize(every.groupBy("lang").agg(F.sum("n").alias("total")), "word-totals")
            return every.filter(F.col("n") >= least_count), totals, seed
    raise AssertionError


def integer_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)) in exact arithmetic."""
    a, left, right = (c.cast("decimal(38,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right)


def most_frequent(counted: DataFrame, most: int) -> list:
    """The rows of the largest ``n``: at most so many, and whole classes of about equal ``n``."""
    counted = counted.withColumn("class", F.floor(F.log2("n") * 8))
    threshold, rows = None, 0
    for row in sorted(counted.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # eight classes a power of two
        rows += row["count"]
        if rows > most:
            break
        threshold = row["class"]
    return [] if threshold is None else counted.filter(F.col("class") >= threshold).drop("class").collect()


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each language with their rank. Classes of scores that can't be among them go first; the others are
    ranked in parts, so that no task ranks a language whole."""
    classes = found.groupBy("lang", F.expr("score div 1000").alias("class")).count()
    higher = Window.partitionBy("lang").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("before", F.coalesce(F.sum("count").over(higher), F.lit(0))).filter(F.col("before") < top)
    found = found.join(classes.groupBy("lang").agg(F.min("class").alias("least")), "lang").filter(F.expr("score div 1000 >= least")).drop("least")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return found.filter(F.col("rank") <= top)


def collocations(
    docs: DataFrame, least_count: int = LEAST_COUNT, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
    direct: int = DIRECT, most_bits: int = MOST_BITS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    words, totals, seed = frequent_words(texts, least_count)
    short = words.filter(F.length("word") <= 256).groupBy("word").agg(F.sum("n").alias("n"))
    ranked = [bytes(r.word) for r in sorted(most_frequent(short, direct), key=lambda r: (-r.n, r.word))]
    ranks = spark.createDataFrame(pa.table({"word": pa.array(ranked, pa.binary()), "rank": pa.array(range(len(ranked)), pa.int64())}))
    words = words.join(materialize(ranks, "word-ranks"), "word", "left")
    words = materialize(words.select("lang", "word", "n", F.col("key").alias("spot"), F.coalesce("rank", "key").alias("key")), "frequent-words")
    rest = words.filter(F.col("key") == F.col("spot")).select("spot")
    book = {"words": ranked, "rest": bitmap(rest, rest.count(), most_bits), "seed": seed}
    pairs = materialize(phrase_counts(texts, 2, spark.sparkContext.broadcast(book), least_count), "frequent-pairs")

    def spots(batches):
        for batch in batches:
            left, right = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(pair_spots(left, right))], ["spot"])

    book["frequent"] = bitmap(pairs.select("k1", "k2").mapInArrow(spots, "spot long"), pairs.count(), most_bits)
    common = pairs.filter((F.col("k1") < direct) & (F.col("k2") < direct)).groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    common = sorted(most_frequent(common, direct), key=lambda r: (-r.n, r.k1, r.k2))
    book["pairs"] = np.array([(r.k1 + _FIRST) << ID_BITS | (r.k2 + _FIRST) for r in common], np.int64)
    triples = materialize(phrase_counts(texts, 3, spark.sparkContext.broadcast(book), least_count), "frequent-triples")
    found = first_of_each(materialize(candidates(words.drop("spot"), pairs, triples), "phrases"), top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def candidates(words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: the phrases that don't mostly occur within a longer one."""

    def word(i: int) -> DataFrame:
        return words.select("lang", F.col("key").alias(f"k{i}"), F.col("word").cast("string").alias(f"w{i}"), F.col("n").alias(f"n{i}"))

    longest = triples.select("lang", F.col("n").alias("longer"), F.inline(F.array(F.struct("k1", "k2"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2")))))
    longest = longest.groupBy("lang", "k1", "k2").agg(F.max("longer").alias("longer"))
    whole = pairs.join(longest, ["lang", "k1", "k2"], "left").filter(F.coalesce(2 * F.col("longer") < F.col("n"), F.lit(True)))
    two = whole.join(word(1), ["lang", "k1"]).join(word(2), ["lang", "k2"]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"),
        integer_score(F.col("n"), F.col("n1"), F.col("n2")).alias("score"),
    )
    starts = pairs.withColumnRenamed("n", "n12")
    ends = pairs.select("lang", F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("n").alias("n23"))
    three = triples.join(starts, ["lang", "k1", "k2"]).join(ends, ["lang", "k2", "k3"])
    for i in (1, 2, 3):
        three = three.join(word(i), ["lang", f"k{i}"])
    cuts = [F.struct(integer_score(F.col("n"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "n1", "n23"), (2, "n12", "n3"))]
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.least(*cuts).alias("cut"))
    return two.unionByName(three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
