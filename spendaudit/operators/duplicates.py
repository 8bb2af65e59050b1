"""Duplicate-work screening: exact pairs (A), similar pairs (B) and repeated batches (C)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from spendaudit import fixed_values as fixed
from spendaudit.config import AuditConfig
from spendaudit.functions.edits import edit_counter
from spendaudit.functions.frames import one_row
from spendaudit.functions.text import description_tokens, round_printed
from spendaudit.session import materialize

CLUSTER_KEY = ["member", "text_key", "sanctioned_amount", "sanction_date"]
# works that agree in these are one node of the search for similar works
NODE_KEY = ["member", "seat", "text_key", "sanctioned_amount", "near_date"]
# texts meet that agree in their first or in their last sorted words
SIGNATURES = ["signature", "end_signature"]
BLOCK_KEY = ["member", "seat", "kind", "words"]
BRIEF = [
    "work_id", "mp_name", "state", "constituency", "work_description", "work_category", "sanctioned_amount",
    "sanction_date", "risk_level",
]


@dataclass(frozen=True)
class Duplicates:
    """``pairs`` of works (tier A) and of nodes, groups of alike works (tier B), each shown by its first work;
    ``members`` has every work of every paired node; ``batches``, and all works of each in ``batch_works``."""

    pairs: DataFrame
    members: DataFrame
    batches: DataFrame
    batch_works: DataFrame


def prepare(works: DataFrame, config: AuditConfig = AuditConfig(), repeated: bool = False) -> DataFrame:
    """Works with a description, plus their normalized text, block signature and reference date.

    ``row_order`` (the order in which works appear) decides which work of a pair comes first; tables
    without it are ordered by work id. With ``repeated``, for short descriptions that many works have, each
    different description is cut into words once and joined to its works.
    """
    described = works.filter((F.trim("work_description") != "") & F.col("work_id").isNotNull())
    order = F.col("row_order") if "row_order" in works.columns else F.col("work_id")
    if repeated:
        words = materialize(_words_of_texts(described.select("work_description").distinct(), config), "descriptions")
        described = described.join(words, "work_description")
    else:
        described = _words_of_texts(described, config)
    return described.select(
        *[F.col(c) if c in works.columns else F.lit(None).cast("string").alias(c) for c in BRIEF],
        order.alias("place"),
        F.coalesce("mp_name", F.lit("")).alias("member"),
        F.coalesce("constituency", F.lit("")).alias("seat"),
        "normtext", "text_key", "length", *SIGNATURES,
        F.coalesce("sanction_date", "recommended_date").alias("near_date"),
    )


def _words_of_texts(described: DataFrame, config: AuditConfig) -> DataFrame:
    """Adds everything that depends on the description alone."""
    return described.withColumn("tokens", description_tokens(F.col("work_description"))).select(
        "*",
        F.array_join("tokens", " ").alias("normtext"),
        # groups are formed on the digest, so that whole texts are not shuffled
        F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("text_key"),
        # what the text measure counts: different words, or characters
        (F.size(F.array_distinct("tokens")) if config.text_measure == "words" else F.length(F.array_join("tokens", " "))).alias("length"),
        F.array_join(F.slice("tokens", 1, config.signature_tokens), " ").alias("signature"),
        F.array_join(F.slice("tokens", F.greatest(F.size("tokens") - (config.signature_tokens - 1), F.lit(1)), config.signature_tokens), " ").alias("end_signature"),
    ).drop("tokens")


def keyed(prepared: DataFrame) -> DataFrame:
    """Works that have everything an exact match needs."""
    return prepared.filter((F.col("normtext") != "") & F.col("sanctioned_amount").isNotNull() & F.col("sanction_date").isNotNull())


def clusters(prepared: DataFrame) -> DataFrame:
    """Groups of works with the same member, text, amount and date, with their size and first and last
    work. Constant state per group: a group of any size combines on the map side."""
    return keyed(prepared).groupBy(*CLUSTER_KEY).agg(
        F.count("*").alias("unit_count"),
        F.min_by("work_id", "place").alias("work_id_a"),
        F.max_by("work_id", "place").alias("work_id_b"),
        F.min("place").alias("place"),
    )


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def briefs(prepared: DataFrame, ids: DataFrame) -> DataFrame:
    """work_id, normtext and the brief fields (``work``) of the works listed in ``ids``."""
    found = prepared.join(ids.select("work_id").distinct(), "work_id", "left_semi")
    return found.select("work_id", "normtext", F.struct(*BRIEF).alias("work"))


def with_works(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Pairs of ids with both works in brief and their texts; only paired works are read in full."""
    ids = pairs.select(F.explode(F.array("work_id_a", "work_id_b")).alias("work_id"))
    found = materialize(briefs(prepared, ids), "paired_works")

    def side(name: str) -> DataFrame:
        return found.select(*[F.col(c).alias(f"{c}_{name}") for c in found.columns])

    return pairs.join(side("a"), "work_id_a").join(side("b"), "work_id_b")


def with_ids(pairs: DataFrame) -> DataFrame:
    """Pairs of ids with both works named by their ids; nothing is joined."""
    return pairs.withColumns({f"work_{name}": F.struct(F.col(f"work_id_{name}").alias("work_id")) for name in "ab"})


def exact_pairs(grouped: DataFrame, prepared: DataFrame, briefs: bool = True) -> DataFrame:
    """Tier A: groups of exactly two."""
    two = grouped.filter("unit_count = 2").select("work_id_a", "work_id_b")
    return (with_works(two, prepared) if briefs else with_ids(two)).select(
        F.lit("A").alias("tier"),
        F.lit(1.0).alias("ratio"),
        _texts(fixed.PAIR_FIELDS_EXACT).alias("matching_fields"),
        "work_a",
        "work_b",
        F.lit(1).cast("long").alias("works_a"),
        F.lit(1).cast("long").alias("works_b"),
    )


def batches(prepared: DataFrame, grouped: DataFrame) -> DataFrame:
    """Tier C: all groups of three or more, named and shown by their first work."""
    many = grouped.filter("unit_count >= 3").withColumnRenamed("work_id_a", "work_id")
    return many.join(briefs(prepared, many).select("work_id", "work"), "work_id").select(
        F.col("work_id").alias("batch_id"),
        *[F.col(f"work.{c}") for c in ("mp_name", "state", "constituency", "work_description", "sanctioned_amount", "sanction_date")],
        "unit_count",
        F.lit(fixed.BATCH_NOTE).alias("note"),
        "place",
    )


def batch_works(prepared: DataFrame, grouped: DataFrame) -> DataFrame:
    """Every work of every batch as a row; a batch of any size is a number of rows, never a list."""
    many = grouped.filter("unit_count >= 3").select(*CLUSTER_KEY, F.col("work_id_a").alias("batch_id"))
    return keyed(prepared).select(*CLUSTER_KEY, "work_id").join(many, CLUSTER_KEY).select("batch_id", "work_id")


def nodes(prepared: DataFrame, key: list[str] = NODE_KEY) -> DataFrame:
    """Works that the search for similar ones can't tell apart, as one row with their number and first work.

    Equal texts are excluded from the similar pairs, so no pair lies inside a node. Constant state per group.
    """
    usable = prepared.filter((F.col("sanctioned_amount") > 0) & F.col("near_date").isNotNull())
    return usable.groupBy(*key).agg(
        F.count("*").alias("works"),
        F.min("place").alias("place"),
        F.min_by("work_id", "place").alias("work_id"),
        F.min_by(F.col("constituency").isNotNull(), "place").alias("seated"),
        F.min("length").alias("length"),
        *[F.min(c).alias(c) for c in SIGNATURES],
    )


def _blocked(df: DataFrame) -> DataFrame:
    """One row for each of the two signatures; a text with equal ones has one."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("words")) for c in SIGNATURES])
    return df.select("*", F.inline(kinds)).drop(*SIGNATURES)


def open_blocks(blocked: DataFrame) -> DataFrame:
    """Blocks with two different texts at least; others hold no similar pair, however large they are."""
    ends = blocked.groupBy(*BLOCK_KEY).agg(F.min("text_key").alias("one"), F.max("text_key").alias("other"))
    return ends.filter("one != other").select(*BLOCK_KEY)


def _binned(df: DataFrame, config: AuditConfig) -> DataFrame:
    """Adds the logarithmic bin of the amount and the bin of the date."""
    width = -math.log(config.amount_similarity_min) * 1.001
    return df.withColumns({
        "amount_bin": F.floor(F.log("sanctioned_amount") / width), "date_bin": F.floor(F.unix_date("near_date") / (config.date_gap_max + 1)),
    })


def _close_pairs(binned: DataFrame, key: list[str], own: list[str], config: AuditConfig) -> DataFrame:
    """Pairs of rows that agree in ``key``, with close amounts and dates and different texts, earlier first.

    Amounts within 5 % lie in the same or neighbouring logarithmic bins, dates within 30 days in the
    same or neighbouring 31-day bins. Joining on key and bins meets each such pair once and never
    forms the others.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = binned.select("*", F.inline(steps)).withColumns(
        {"amount_bin": F.col("amount_bin") + F.col("i"), "date_bin": F.col("date_bin") + F.col("j")}
    )
    keys = [*key, "amount_bin", "date_bin"]

    def side(df: DataFrame, name: str) -> DataFrame:
        fields = ["work_id", "place", "works", "sanctioned_amount", "near_date", "text_key", *own]
        return df.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in fields])

    low, high = (f("sanctioned_amount_a", "sanctioned_amount_b") for f in (F.least, F.greatest))
    return (
        side(near, "a")
        .join(side(binned, "b"), keys)
        .filter(F.col("place_a") < F.col("place_b"))
        .filter(F.lit(1.0) - (high - low) / high >= config.amount_similarity_min)
        .filter(F.abs(F.datediff("near_date_a", "near_date_b")) <= config.date_gap_max)
        .filter(F.col("text_key_a") != F.col("text_key_b"))
    )


PAIR = ["work_id_a", "work_id_b", "works_a", "works_b", "text_key_a", "text_key_b"]


def candidate_pairs(prepared: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """Pairs of nodes (named by their first works, earlier first) in one block that pass every cheap test of tier B.

    Two texts whose lengths differ too much cannot reach the similarity, and equal texts are similar
    beyond the upper limit, so both are left out here. No block is too large: blocks of one text only
    are left out, others are split by amount and date.
    """
    blocked = _blocked(materialize(nodes(prepared), "nodes"))
    # written because it is read from both sides of the join; it holds no texts
    binned = materialize(_binned(blocked.join(materialize(open_blocks(blocked), "open_blocks"), BLOCK_KEY), config), "blocked_works")
    # 2 x shorter / (both) is the most that any measure can be; as a product, because both may be empty
    reachable = 2.0 * F.least("length_a", "length_b") >= config.similarity_min * (F.col("length_a") + F.col("length_b"))
    return _close_pairs(binned, BLOCK_KEY, ["length"], config).filter(reachable).select(*PAIR).distinct()  # a pair may agree in both signatures


def least_common(size: str, least: float) -> Column:
    """How many of its words a set of this size must share with any set that is as similar."""
    return F.ceil(F.col(size) * F.lit(least / (2 - least)) - 1e-9)


def rare_words(prepared: DataFrame, least: float) -> DataFrame:
    """member, seat, text_key, size, word, at: the rarest words of every distinct text that another text can have as well.

    Sets with a Dice similarity of ``least`` share so many words that, with all words in one order, each has
    one of them among its first ``size - least_common + 1``. The order is from rare to frequent within member
    and seat, so frequent words are left to texts that have no others. ``at`` is a word's place in that order.
    """
    usable = prepared.filter((F.col("sanctioned_amount") > 0) & F.col("near_date").isNotNull() & (F.col("normtext") != ""))
    texts = usable.select("member", "seat", "text_key", "normtext").dropDuplicates(["member", "seat", "text_key"])
    words = texts.select("member", "seat", "text_key", F.explode(F.array_distinct(F.split("normtext", " "))).alias("word"))
    words = materialize(words, "words_of_texts")
    counts = words.groupBy("member", "seat", "word").agg(F.count("*").alias("texts"))
    ordered = words.join(counts, ["member", "seat", "word"]).groupBy("member", "seat", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("texts", "word"))).alias("words")
    )
    ordered = ordered.withColumn("size", F.size("words"))
    first = F.slice("words", F.lit(1), (F.col("size") - least_common("size", least) + 1).cast("int"))
    placed = ordered.select("member", "seat", "text_key", "size", F.posexplode(first).alias("at", "found"))
    return placed.filter("found.texts > 1").select("member", "seat", "text_key", "size", "found.word", "at")


def overlapping_pairs(prepared: DataFrame, least: float, config: AuditConfig = AuditConfig()) -> DataFrame:
    """All pairs of nodes with close amounts and dates whose sets of words may have a Dice similarity of ``least``.

    Pairs meet in a rare word of both texts. A pair whose sizes differ too much, or that has too few words
    left behind its first common one, is left out; none that reaches ``least`` is.
    """
    found = nodes(prepared).drop(*SIGNATURES, "length").join(rare_words(prepared, least), ["member", "seat", "text_key"])
    binned = materialize(_binned(found, config), "rare_words")
    both = F.col("size_a") + F.col("size_b")
    left = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    pairs = _close_pairs(binned, ["member", "seat", "word"], ["size", "at"], config)
    return pairs.filter(2.0 * left >= least * both - 1e-9).select(*PAIR).distinct()


def meeting_pairs(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """The pairs of nodes whose texts are compared, by ``config.meet``."""
    least = config.similarity_min if config.text_measure == "words" else config.word_overlap_min
    if config.meet == "blocks":
        return candidate_pairs(prepared, config)
    if config.meet == "words":
        return overlapping_pairs(prepared, least, config)
    return candidate_pairs(prepared, config).unionByName(overlapping_pairs(prepared, least, config)).distinct()


#: Whole numbers whose bits stand for the words of a text; texts of more different words than these tell apart have as many as they need.
BITS = [f"bits_{i}" for i in range(16)]
LONG_TEXT = 500
#: Texts of one place that a task holds against each other.
PART_TEXTS = 8000
#: Common words of a pair of texts that make the point where their works meet.
MEETING_WORDS = 8
#: What a normalized text is made of.
LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"


def letter_counts(text: str) -> Column:
    """How often each character occurs in a normalized text."""
    return F.array(*[F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in LETTERS])


def common_letters(a: str, b: str) -> Column:
    """Characters that two texts share in any order, from their letter counts."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda total, n: total + n)


def edits(a: str, b: str, most: Column) -> Column:
    """Number of edits, or -1 beyond ``most``. Spark takes the limit as a column in SQL only."""
    return F.call_function("levenshtein", F.col(a), F.col(b), most.cast("int"))


def edits_of_long_texts(a: str, b: str, most: Column | None = None) -> Column:
    """Number of edits, however many, or -1 beyond ``most``; counted for the pairs of a whole batch at once (``functions/edits.py``)."""
    counts = edit_counter()

    @F.pandas_udf(LongType())
    def counted(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(counts(left, right))

    @F.pandas_udf(LongType())
    def limited(left: pd.Series, right: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series(counts(left, right, limit))

    return counted(a, b) if most is None else limited(F.col(a), F.col(b), most)


def text_ratio(a: str, b: str) -> Column:
    """Ratcliff-Obershelp similarity of whole texts, earlier work first."""

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype=float)

    return ratio(a, b)


def word_ratio(a: str, b: str) -> Column:
    """Dice similarity of the sets of words of two normalized texts, inside the JVM."""
    return set_ratio(*(F.array_distinct(F.array_remove(F.split(t, " "), "")) for t in (a, b)))


def set_ratio(left: Column, right: Column, common: Column | None = None) -> Column:
    """Dice similarity of two lists of different words."""
    both = F.size(left) + F.size(right)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(left, right) if common is None else common) / both).otherwise(0.0)


def meeting_point(common: Column) -> Column:
    """A number for a list of common words, from the few of them with the least hashes; near copies have most of them in common."""
    return F.xxhash64(F.slice(F.array_sort(F.transform(common, lambda w: F.xxhash64(w))), 1, MEETING_WORDS))


def text_pair_ratios(found: DataFrame, prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """Similarity of every distinct pair of texts (in order) among the candidates, and the point where their works meet: each
    is compared once, however many works have these texts.

    Words are cut once per text. Texts are compared by characters only if the characters that they share in any order could reach
    the similarity. The edit measure, 1 - edits / longer length, is for texts that share words as well (``word_overlap_min``), so
    that it is not spent on whole texts that have nothing but their alphabet in common; it stops counting where the similarity
    can't be reached.
    """
    distinct = materialize(found.select("text_key_a", "text_key_b").distinct(), "text_pairs")
    wanted = distinct.select(F.explode(F.array("text_key_a", "text_key_b")).alias("text_key")).distinct()
    texts = prepared.join(wanted, "text_key", "left_semi").select("text_key", "normtext").dropDuplicates(["text_key"])
    by_words = config.text_measure == "words"
    words = F.array_distinct(F.array_remove(F.split("normtext", " "), "")).alias("words")
    texts = materialize(texts.select("text_key", words) if by_words else texts.select("*", words, letter_counts("normtext").alias("letters")), "paired_texts")

    def side(name: str) -> DataFrame:
        return texts.select(*[F.col(c).alias(f"{c}_{name}") for c in texts.columns])

    both = distinct.join(side("a"), "text_key_a").join(side("b"), "text_key_b")
    least, high = config.similarity_min, F.col("ratio") < config.similarity_max
    keys = ["text_key_a", "text_key_b"]
    both = both.withColumn("common", F.array_intersect("words_a", "words_b"))
    overlap, meet = set_ratio(F.col("words_a"), F.col("words_b"), F.col("common")), meeting_point(F.col("common")).alias("meet")
    if by_words:
        rated = both.select(*keys, overlap.alias("ratio"), "common").filter((F.col("ratio") >= least) & high)
        return rated.select(*keys, "ratio", meet)
    lengths = [F.length("normtext_a"), F.length("normtext_b")]
    shared = common_letters("letters_a", "letters_b")
    # comparing texts is slow for the size of the data, so the pairs are dealt out widely, the more the more there are
    tasks = max(4 * prepared.sparkSession.sparkContext.defaultParallelism, distinct.count() // 2000)
    if config.text_measure == "edits":
        longer = F.greatest(*lengths)
        possible = both.filter(shared >= least * longer - 1e-9).filter(overlap >= config.word_overlap_min)
    else:
        possible = both.filter(2.0 * shared >= least * (lengths[0] + lengths[1]) - 1e-9)
    dealt = possible.select(*keys, "normtext_a", "normtext_b", meet).repartition(tasks, *keys)
    keys = [*keys, "meet"]
    # no filter passes the number of the task, so that pairs are compared once, and behind the exchange
    task = F.spark_partition_id().alias("task")
    if config.text_measure == "edits":
        most = F.floor((1 - least) * longer + 1e-9)
        counted = (edits_of_long_texts if config.long_texts else edits)("normtext_a", "normtext_b", most)
        rated = dealt.select(*keys, longer.alias("longer"), counted.alias("edits"), task).filter("edits >= 0 AND task >= 0")
        rated = rated.select(*keys, (F.lit(1.0) - F.col("edits") / F.col("longer")).alias("ratio"))
    else:
        rated = dealt.select(*keys, task, "normtext_a", "normtext_b").filter("task >= 0")
        rated = rated.select(*keys, text_ratio("normtext_a", "normtext_b").alias("ratio"))
    return rated.filter((F.col("ratio") >= least) & high)


def bit_of(number: str, among: Column) -> list[Column]:
    """Which of ``among`` whole numbers (a power of two) stands for a hash, and its bit there."""
    place = F.shiftright(number, 6).bitwiseAND(among - 1)
    return [place.cast("int").alias("number"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(number).bitwiseAND(63).cast("int")).alias("bit")]


def different_bits(a: str, b: str) -> Column:
    each = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int"))
    return F.aggregate(each, F.lit(0), lambda total, n: total + n)


def spans_of_texts(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """Where texts look for others, by ``config.meet``: member, seat, kind, meet and amount_bin, with the range of their works' amounts and
    dates, the bits of their words and ``least``, the overlap that a pair must reach. A text has one row for each bin of its works' amounts.

    Two sets of words differ in as many words, at least, as their bits do.
    """
    usable = prepared.filter((F.col("sanctioned_amount") > 0) & F.col("near_date").isNotNull() & (F.col("normtext") != ""))
    ends = [c for c in SIGNATURES if config.meet != "words"]
    words = _binned(usable, config).withColumn("words", F.array_distinct(F.split("normtext", " ")))
    key, span = ["member", "seat", "text_key", "amount_bin", *ends], ["sanctioned_amount", "near_date", "length"]
    words = words.select(*key, *span, F.size("words").alias("size"), F.explode("words").alias("word")).withColumn("hash", F.xxhash64("word"))
    spans = words.select(*key, *span, "size", *bit_of("hash", F.lit(len(BITS)))).groupBy(*key).agg(
        F.min("sanctioned_amount").alias("low"), F.max("sanctioned_amount").alias("high"), F.min("near_date").alias("first"), F.max("near_date").alias("last"),
        F.min("length").alias("length"), F.min("size").alias("size"), *[F.bit_or(F.when(F.col("number") == i, F.col("bit")).otherwise(0)).alias(c) for i, c in enumerate(BITS)],
    )
    overlap = {"words": config.similarity_min, "edits": config.word_overlap_min}.get(config.text_measure, 0.0)
    kinds = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("meet"), F.lit(overlap).alias("least")) for c in ends]
    if config.meet != "blocks":
        kinds.append(F.struct(F.lit("words").alias("kind"), F.lit("").alias("meet"), F.lit(overlap or config.word_overlap_min).alias("least")))
    return spans.select("*", F.inline(F.array(*kinds))).drop(*ends)


def bits_of_long_texts(prepared: DataFrame) -> DataFrame:
    """text_key, all_bits, half_bits: two to four bits for each word of a long text, and the same folded to half as many.

    Of two texts whose sizes differ by less than half, one has as many numbers as the other, or twice as many.
    """
    words = prepared.select("text_key", F.array_distinct(F.split("normtext", " ")).alias("words")).withColumn("size", F.size("words"))
    words = words.filter(F.col("size") > LONG_TEXT).withColumn("numbers", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") / 32))).cast("long"))
    bits = words.select("text_key", "numbers", F.explode("words").alias("word")).withColumn("hash", F.xxhash64("word")).select("text_key", *bit_of("hash", F.col("numbers")))
    none = words.select("text_key", F.explode(F.sequence(F.lit(0), F.col("numbers").cast("int") - 1)).alias("number"), F.lit(0).cast("long").alias("bit"))
    numbers = bits.unionByName(none).groupBy("text_key", "number").agg(F.bit_or("bit").alias("bit"))
    listed = numbers.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("number", "bit"))).alias("listed"))
    long = listed.select("text_key", F.col("listed.bit").alias("all_bits"))
    half = (F.size("all_bits") / 2).cast("int")
    return long.withColumn("half_bits", F.zip_with(F.slice("all_bits", F.lit(1), half), F.slice("all_bits", half + 1, half), lambda x, y: x.bitwiseOR(y)))


def meeting_texts(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """member, seat, text_key_a, text_key_b: each pair of texts that meet, have close amounts and dates and may be similar, once.

    Texts of neighbouring amounts are held against each other by their sizes and the bits of their words. These are bounds: no pair
    that reaches the overlap is lost, and few others remain. Only the bits travel, and a pair is written when it has passed. The
    texts of one place are dealt out in parts of some thousands, and parts are held against parts.
    """
    spans = materialize(spans_of_texts(prepared, config), "text_spans")
    place = ["member", "seat", "kind", "meet", "amount_bin"]
    parts = materialize(spans.groupBy(*place).agg(F.ceil(F.count("*") / PART_TEXTS).cast("int").alias("parts")), "text_parts")
    other = spans.join(parts, place).withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int"))
    inside = other.withColumns({"own": F.col("part"), "part": F.explode(F.sequence("part", F.col("parts") - 1))})
    # the text in the lower bin also looks into the next one
    beside = spans.join(parts.withColumn("amount_bin", F.col("amount_bin") - 1), place).withColumns(
        {"amount_bin": F.col("amount_bin") + 1, "own": F.lit(-1), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    )
    one, other, keys = inside.unionByName(beside), other.drop("least"), [*place, "part"]
    size, alike = F.col("size_a") + F.col("size_b"), F.lit(1.0) - F.col("least")

    def side(df: DataFrame, name: str, *fields: str) -> DataFrame:
        # numbers that are known not to be null are compared in half the time
        numbers = [F.coalesce(c, F.lit(0)).alias(f"{c}_{name}") for c in ("low", "high", "length", "size", *fields) if not c.endswith("_bits")]
        others = [F.col(c).alias(f"{c}_{name}") for c in ("text_key", "first", "last", *fields) if c not in BITS]
        return df.select(*[c for c in (*keys, "own", "least") if c in df.columns], *numbers, *others)

    def pairs(one: DataFrame, other: DataFrame, bounds: list[Column]) -> DataFrame:
        met = one.join(other, keys).filter(2.0 * F.least("size_a", "size_b") >= F.col("least") * size - 1e-9)
        met = met.filter(2.0 * F.least("length_a", "length_b") >= config.similarity_min * (F.col("length_a") + F.col("length_b")))
        met = met.filter(F.least("high_a", "high_b") >= (config.amount_similarity_min - 1e-9) * F.greatest("low_a", "low_b"))
        for bound in bounds:
            met = met.filter(bound)
        met = met.filter(F.datediff(F.greatest("first_a", "first_b"), F.least("last_a", "last_b")) <= config.date_gap_max)
        met = met.filter((F.col("own") < F.col("part")) | (F.col("text_key_a") < F.col("text_key_b"))).filter(F.col("text_key_a") != F.col("text_key_b"))
        return met.select("member", "seat", F.least("text_key_a", "text_key_b").alias("text_key_a"), F.greatest("text_key_a", "text_key_b").alias("text_key_b"))

    apart = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in BITS]
    few = [F.least("size_a", "size_b") <= LONG_TEXT, sum(apart[1:4], apart[0]) <= alike * size + 1e-9, sum(apart[1:], apart[0]) <= alike * size + 1e-9]
    found = pairs(side(one, "a", *BITS), side(other, "b", *BITS), few)
    bits = materialize(bits_of_long_texts(prepared), "long_texts")
    long = [side(df.join(bits, "text_key"), name, "all_bits", "half_bits") for df, name in ((one, "a"), (other, "b"))]
    numbers = [F.size("all_bits_a"), F.size("all_bits_b")]
    apart = F.when(numbers[0] == numbers[1], different_bits("all_bits_a", "all_bits_b"))
    apart = apart.when(numbers[0] == 2 * numbers[1], different_bits("half_bits_a", "all_bits_b")).when(2 * numbers[0] == numbers[1], different_bits("all_bits_a", "half_bits_b"))
    return found.unionByName(pairs(*long, [F.coalesce(apart, F.lit(0)) <= alike * size + 1e-9])).distinct()


def _both_orders(pairs: DataFrame) -> DataFrame:
    turned = {"text_key_a": "text_key_b", "text_key_b": "text_key_a"}
    return pairs.unionByName(pairs.select(*[F.col(c).alias(turned.get(c, c)) for c in pairs.columns]))


def similar_texts(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """Pairs of similar texts in both orders, with their similarity and the point where their works meet."""
    met = materialize(meeting_texts(prepared, config), "meeting_texts")
    ordered = config.text_measure == "ratio"  # the longest matching stretches depend on the order, other measures don't
    met = _both_orders(met) if ordered else met
    rated = met.join(materialize(text_pair_ratios(met, prepared, config), "rated_texts"), ["text_key_a", "text_key_b"])
    return materialize(rated if ordered else _both_orders(rated), "similar_texts")


def numbered(similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """member, seat, text_key, text: a number for each text of a similar pair; and point, text_a, text_b, ratio: the pairs, by the
    numbers of their texts and of the point where they meet."""
    texts = similar.select("member", "seat", F.explode(F.array("text_key_a", "text_key_b")).alias("text_key")).distinct()
    texts = materialize(texts.withColumn("text", F.monotonically_increasing_id()), "similar_text_numbers")
    points = similar.select("member", "seat", "meet").distinct()
    points = materialize(points.withColumn("point", F.monotonically_increasing_id()), "point_numbers")
    pairs = similar.join(points, ["member", "seat", "meet"])
    for name in "ab":
        side = texts.withColumnsRenamed({"text_key": f"text_key_{name}", "text": f"text_{name}"})
        pairs = pairs.join(side, ["member", "seat", f"text_key_{name}"])
    return texts, materialize(pairs.select("point", "text_a", "text_b", "ratio"), "similar_numbers")


def similar_nodes(prepared: DataFrame, config: AuditConfig = AuditConfig()) -> DataFrame:
    """work_id_a, work_id_b, works_a, works_b, ratio, same_seat: all pairs of nodes with similar texts, close amounts and dates.

    Texts are compared first, then only nodes that have one of a similar pair of texts are joined, at the one point where that
    pair meets. Every pair of nodes is formed once, so that none is shuffled to be made distinct; nearly all that are formed remain.
    The pairs are not written: their number may grow with the square of the works, all that is written grows with the works.
    """
    texts, similar = numbered(similar_texts(prepared, config))
    places = similar.select("point", F.explode(F.array("text_a", "text_b")).alias("text")).distinct()
    named = prepared.join(texts, ["member", "seat", "text_key"])
    found = nodes(named, ["text", "sanctioned_amount", "near_date"]).drop(*SIGNATURES, "length").join(places, "text")
    binned = materialize(_binned(found, config), "near_nodes")
    # of two neighbouring cells one looks into the other
    cell = ["point", "amount_bin", "date_bin"]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = binned.select("*", F.inline(steps)).withColumns({"amount_bin": F.col("amount_bin") + F.col("i"), "date_bin": F.col("date_bin") + F.col("j")})
    fields = ["work_id", "place", "works", "sanctioned_amount", "near_date", "text", "seated"]
    one = near.select(*cell, ((F.col("i") != 0) | (F.col("j") != 0)).alias("beside"), F.struct(*fields).alias("one"))
    other = binned.select(*cell, F.struct(*fields).alias("other"))
    earlier = F.col("one.place") < F.col("other.place")
    low, high = (f("one.sanctioned_amount", "other.sanctioned_amount") for f in (F.least, F.greatest))
    pairs = (
        one.join(other, cell)
        .filter(earlier | (F.col("beside") & (F.col("one.place") > F.col("other.place"))))
        .filter(F.lit(1.0) - (high - low) / high >= config.amount_similarity_min)
        .filter(F.abs(F.datediff("one.near_date", "other.near_date")) <= config.date_gap_max)
        .filter(F.col("one.text") != F.col("other.text"))
    )

    def of(field: str) -> list[Column]:
        one, other = F.col(f"one.{field}"), F.col(f"other.{field}")
        return [F.when(earlier, one).otherwise(other).alias(f"{field}_a"), F.when(earlier, other).otherwise(one).alias(f"{field}_b")]

    same = (F.col("one.seated") & F.col("other.seated")).alias("same_seat")
    pairs = pairs.select("point", *of("work_id"), *of("works"), *of("text"), same)
    return pairs.join(similar, ["point", "text_a", "text_b"]).select("work_id_a", "work_id_b", "works_a", "works_b", "ratio", "same_seat")


def similar_pairs(prepared: DataFrame, config: AuditConfig = AuditConfig(), briefs: bool = True) -> DataFrame:
    """Tier B: all pairs of nodes with similar texts, close amounts and dates. Without ``briefs`` the works are named by their ids only."""
    rated = similar_nodes(prepared, config)
    fields = F.array_compact(F.concat(_texts(fixed.PAIR_FIELDS_SIMILAR), F.array(F.when(F.col("same_seat"), fixed.PAIR_FIELD_CONSTITUENCY))))
    shown = with_works(materialize(rated, "rated_pairs"), prepared) if briefs else with_ids(rated)
    return shown.select(F.lit("B").alias("tier"), "ratio", fields.alias("matching_fields"), "work_a", "work_b", "works_a", "works_b")


def paired_works(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """tier, node, work_id: every work of every paired node; a tier A node is the work itself."""
    return works_of_nodes(pairs.select("tier", F.explode(F.array("work_a.work_id", "work_b.work_id")).alias("node")).distinct(), prepared)


def works_of_nodes(shown: DataFrame, prepared: DataFrame) -> DataFrame:
    """tier, node, work_id: every work of the nodes in ``shown`` (tier, node)."""
    exact = shown.filter("tier = 'A'").select("tier", "node", F.col("node").alias("work_id"))
    first = shown.filter("tier = 'B'").select(F.col("node").alias("work_id"))
    named = materialize(prepared.join(first, "work_id", "left_semi").select(*NODE_KEY, F.col("work_id").alias("node")), "paired_nodes")
    alike = prepared.select(*NODE_KEY, "work_id").join(named, NODE_KEY).select(F.lit("B").alias("tier"), "node", "work_id")
    return exact.unionByName(alike)


def _points(similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """member, seat, meet, text_key, point, number, all_alike: texts numbered within the points where they meet, and whether every two of a
    point are similar; and the pairs of numbers that are similar in the others."""
    key = ["member", "seat", "meet"]
    points = similar.groupBy(*key).agg(F.count("*").alias("pairs"), F.count_distinct("text_key_a").alias("texts"))
    points = points.select(*key, (F.col("pairs") == F.col("texts") * (F.col("texts") - 1)).alias("all_alike"), F.monotonically_increasing_id().alias("point"))
    texts = similar.select(*key, F.col("text_key_a").alias("text_key")).distinct().join(materialize(points, "points"), key)
    number = F.row_number().over(Window.partitionBy("point").orderBy("text_key"))
    texts = materialize(texts.withColumn("number", number), "numbered_texts")
    other = texts.select(*key, F.col("text_key").alias("text_key_b"), F.col("number").alias("number_b"))
    some = similar.join(texts.filter(~F.col("all_alike")).withColumnRenamed("text_key", "text_key_a"), [*key, "text_key_a"]).join(other, [*key, "text_key_b"])
    return texts, some.select("point", "number", "number_b")


def matched_nodes(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """The nodes (``NODE_KEY``) that have a pair of tier B, without forming the pairs. For measures that don't depend on the order.

    Any two works of one cell, 5 % of amount wide and 31 days long, are close. So where all texts of a point are similar, each node
    whose cell has a second text has a pair. Only the other nodes look into neighbouring cells, for one pair at most.
    """
    if config.text_measure == "ratio":
        raise ValueError("the matching-stretch ratio depends on the order of the works")
    texts, some = _points(similar_texts(prepared, config))
    usable = prepared.filter((F.col("sanctioned_amount") > 0) & F.col("near_date").isNotNull())
    found = usable.select(*NODE_KEY).distinct().join(texts.drop("meet"), ["member", "seat", "text_key"])
    width = -math.log(config.amount_similarity_min) * 0.999
    found = _binned(found.select("point", "number", "all_alike", "sanctioned_amount", "near_date"), config)
    found = materialize(found.withColumn("cell", F.floor(F.log("sanctioned_amount") / width)), "nodes_at_points")
    cell = ["point", "cell", "date_bin"]
    shared = found.filter("all_alike").groupBy(*cell).agg(F.min("number").alias("one"), F.max("number").alias("other")).filter("one < other")
    shared = materialize(shared.select(*cell), "shared_cells")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    alone = found.join(shared, cell, "left_anti").select("*", F.inline(steps))
    alone = alone.withColumns({"amount_bin": F.col("amount_bin") + F.col("i"), "date_bin": F.col("date_bin") + F.col("j")}).drop("i", "j", "cell")
    keys = ["point", "amount_bin", "date_bin"]
    other = found.select(*[F.col(c).alias(f"other_{c}") for c in (*keys, "number", "sanctioned_amount", "near_date")])
    low, high = (f("sanctioned_amount", "other_sanctioned_amount") for f in (F.least, F.greatest))
    near = (F.lit(1.0) - (high - low) / high >= config.amount_similarity_min) & (F.abs(F.datediff("near_date", "other_near_date")) <= config.date_gap_max)
    for c in keys:
        near = near & (F.col(c) == F.col(f"other_{c}"))
    of_alike = alone.filter("all_alike").join(other, near & (F.col("number") != F.col("other_number")), "left_semi")
    of_some = alone.join(some, ["point", "number"]).join(other, near & (F.col("number_b") == F.col("other_number")), "left_semi")
    fields = ["point", "number", "sanctioned_amount", "near_date"]
    matched = found.join(shared, cell, "left_semi").select(*fields).unionByName(of_alike.select(*fields)).unionByName(of_some.select(*fields))
    return matched.join(texts, ["point", "number"]).select(*NODE_KEY).distinct()


def paired_work_ids(prepared: DataFrame, config: AuditConfig) -> DataFrame:
    """Distinct works that are in any pair of either tier, as ``duplicate_ids``, without listing the pairs, whose number may grow with the
    square of the works."""
    two = keyed(prepared).groupBy(*CLUSTER_KEY).agg(F.count("*").alias("unit_count")).filter("unit_count = 2").select(*CLUSTER_KEY)
    exact = keyed(prepared).join(two, CLUSTER_KEY, "left_semi").select("work_id")
    return exact.unionByName(prepared.join(matched_nodes(prepared, config), NODE_KEY, "left_semi").select("work_id")).distinct()


def pair_record(pairs: DataFrame) -> DataFrame:
    """Pairs as reported: label, score in percent, both works in brief, action and disclaimer."""
    label = F.when(F.col("tier") == "A", fixed.PAIR_LABELS["A"]).otherwise(fixed.PAIR_LABELS["B"])
    return pairs.select(
        "tier",
        label.alias("label"),
        round_printed(F.col("ratio") * 100, 1).alias("similarity_score"),
        "matching_fields",
        "work_a",
        "work_b",
        "works_a",
        "works_b",
        "ratio",
        F.lit(fixed.PAIR_ACTION).alias("recommended_action"),
        F.lit(fixed.DISCLAIMER).alias("disclaimer"),
    )


def find_duplicates(works: DataFrame, config: AuditConfig = AuditConfig(), briefs: bool = True) -> Duplicates:
    """Both pair tiers and the batches. The prepared works are written once: several steps read them.

    Without ``briefs`` the works of a pair are named by their ids only.
    """
    prepared = materialize(prepare(works, config), "described_works")
    grouped = materialize(clusters(prepared).filter("unit_count >= 2"), "clusters")
    pairs = materialize(pair_record(exact_pairs(grouped, prepared, briefs).unionByName(similar_pairs(prepared, config, briefs))), "pairs")
    members = materialize(paired_works(pairs, prepared), "paired_works")
    return Duplicates(pairs, members, batches(prepared, grouped), batch_works(prepared, grouped))


def list_pairs(pairs: DataFrame, tier: str = "All", limit: int = 100, offset: int = 0) -> DataFrame:
    chosen = pairs.filter(F.col("tier") == tier) if tier in ("A", "B") else pairs
    order = [F.desc("similarity_score"), "tier", F.desc("ratio"), "work_a.work_id", "work_b.work_id"]
    return chosen.orderBy(*order).offset(offset).limit(limit)


def list_batches(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the batches, largest first."""
    order = [F.desc("unit_count"), F.col("mp_name").asc_nulls_first(), "work_description", "place"]
    return found.orderBy(*order).offset(offset).limit(limit)


def duplicate_summary(found: Duplicates) -> DataFrame:
    """Number of pairs per tier, of batches, and of works in batches."""
    pairs = found.pairs.agg(
        F.count_if(F.col("tier") == "A").alias("potential_duplicate_pairs"),
        F.count_if(F.col("tier") == "B").alias("possible_duplicate_pairs"),
    )
    groups = found.batches.agg(
        F.count("*").alias("batch_pattern_groups"),
        F.coalesce(F.sum("unit_count"), F.lit(0)).alias("works_in_batch_patterns"),
    )
    return one_row([pairs, groups])


def duplicate_ids(members: DataFrame) -> DataFrame:
    """Distinct works that appear in any pair."""
    return members.select("work_id").distinct()


def matches_per_work(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """For each paired work: its best match in list order and the number of matching works.

    A pair is seen from both its nodes, and by every work of a node. Constant state per node and work.
    """
    rank = F.struct(
        (-F.col("similarity_score")).alias("s"), "tier", (-F.col("ratio")).alias("r"),
        F.col("work_a.work_id").alias("a"), F.col("work_b.work_id").alias("b"),
    )

    def seen(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"work_{own}.work_id").alias("node"), F.col(f"work_{other}.work_id").alias("other"), F.col(f"works_{other}").alias("n")
        )

    both = pairs.select("tier", "similarity_score", rank.alias("rank"), F.inline(F.array(seen("a", "b"), seen("b", "a"))))
    of_node = both.groupBy("tier", "node").agg(
        F.min(F.struct("rank", F.struct("other", "tier", "similarity_score").alias("found"))).alias("best"), F.sum("n").alias("n")
    )
    best = members.join(of_node, ["tier", "node"]).groupBy("work_id").agg(F.min("best").alias("best"), F.sum("n").alias("matches"))
    return best.select("work_id", "best.found.*", "matches")


def match_counts(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """As ``matches_per_work``, without the best match's name: work_id, tier, similarity_score, matches.

    Pairs need not be written: they are read once, and summed up where they are formed, by two numbers per node.
    """
    seen = [F.struct(F.col(f"work_{own}.work_id").alias("node"), F.col(f"works_{other}").alias("n")) for own, other in ("ab", "ba")]
    both = pairs.select("tier", "ratio", F.inline(F.array(*seen)))
    of_node = materialize(both.groupBy("tier", "node").agg(F.max("ratio").alias("ratio"), F.sum("n").alias("n")), "matches_of_nodes")
    score = round_printed(F.col("ratio") * 100, 1)
    found = works_of_nodes(of_node.select("tier", "node"), prepared).join(of_node, ["tier", "node"])
    best = found.withColumn("best", F.struct((-score).alias("s"), "tier", score.alias("similarity_score")))
    return best.groupBy("work_id").agg(F.min("best").alias("best"), F.sum("n").alias("matches")).select("work_id", "best.tier", "best.similarity_score", "matches")


def summary_counts(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """As ``duplicate_summary``, from the pairs of tier B, which are counted where they are formed, and the groups of equal works."""
    groups = grouped.agg(
        F.count_if(F.col("unit_count") == 2).alias("potential_duplicate_pairs"),
        F.count_if(F.col("unit_count") >= 3).alias("batch_pattern_groups"),
        F.coalesce(F.sum(F.when(F.col("unit_count") >= 3, F.col("unit_count"))), F.lit(0)).alias("works_in_batch_patterns"),
    )
    found = one_row([groups, pairs.agg(F.count("*").alias("possible_duplicate_pairs"))])
    return found.select("potential_duplicate_pairs", "possible_duplicate_pairs", "batch_pattern_groups", "works_in_batch_patterns")


def candidate_count(prepared: DataFrame) -> DataFrame:
    """How many pairs of works the blocks hold, without those already found as exact pairs.

    Pairs that agree in the first words, plus those that agree in the last, less those that agree in both.
    """
    counts = []
    for sign, key in ((1, SIGNATURES[:1]), (1, SIGNATURES[1:]), (-1, SIGNATURES)):
        sizes = prepared.groupBy("member", "seat", *key).agg(F.count("*").cast("decimal(38,0)").alias("n"))
        counts.append(sizes.agg(F.coalesce(F.sum(F.lit(sign) * F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("twice")))
    exact = (
        keyed(prepared)
        .groupBy(*CLUSTER_KEY)
        .agg(F.count("*").alias("n"), F.min("seat").alias("seat"), F.max("seat").alias("other_seat"))
        .filter("n = 2 AND seat = other_seat")
        .agg((F.count("*") * -2).alias("twice"))
    )
    every = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(exact)
    return every.agg((F.sum("twice") / 2).cast("long").alias("candidate_pairs_scanned"))
