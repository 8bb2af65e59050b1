"""Quality rules by compression bands.

A text's zstandard ratio (bytes over compressed bytes) falls in a band that depends on how long the text is: below it the
text is incompressible (random bytes, encoded data), above it repetitive. The ratio is taken over the whole document and over
fixed chunks, so that one bad stretch in a long document is seen as well: chunks outside their band reject a document if a few
follow each other, or if there are more than the square root of the number of chunks, or than half of them. A stretch of 20 KB
always holds four whole chunks, however long the document is.

The fixed bands are the outer limits. Within them, the upper limit of each length is drawn in to the corpus's own fence: the upper
quartile of all ratios of that length plus ``fence`` times the distance of the quartiles, and at least ``margin`` above the quartile,
for whole texts and for chunks apart. Quartiles are exact to a hundredth: ratios of all documents are counted by hundredths, so a
few thousand counts tell them, whatever the size of the corpus. Lengths with fewer than ``least_ratios`` ratios keep the fixed limit.
The lower limit stays fixed: prose with a rich vocabulary compresses less than its neighbours, which is no fault. Labels are not read.

Results for odd input: a null or empty text has no words, fails the base rules, and has ratio 0 and no chunks; a very long
text is compressed once in one call and once chunk by chunk; equal rows get equal results, one row each; an empty table gives an
empty table; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendaudit.llm.common import WHITE_SPACE, id_and_text, map_rows
from spendaudit.session import materialize

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Accepted ratios of texts with at least ``least_bytes`` bytes."""

    least_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class BandRules:
    """Limits of the method. Bands are in order of length; a shorter text than the first band's is not judged by ratio."""

    level: int = 3
    chunk_bytes: int = 4096
    bands: tuple[Band, ...] = (
        Band(256, 1.1, 3.0), Band(512, 1.2, 3.2), Band(1024, 1.3, 3.6), Band(2048, 1.4, 4.0), Band(4096, 1.5, 4.5),
        Band(16384, 1.6, 5.0), Band(65536, 1.7, 6.0),
    )
    bad_chunk_share: float = 0.5
    bad_chunk_root: float = 1.0
    bad_run: int = 4
    fence: float | None = 3.0
    margin: float = 0.1
    least_ratios: int = 200


def repeated_words(words: list) -> int:
    """Words within 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # covered: end of the words counted so far
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if line in seen:
            repeats += 1
        elif line.strip(WHITE_SPACE):
            seen.add(line)
    return repeats


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "size long, ratio double, chunk_ratios array<double>"
)
#: Ratios above this many hundredths are counted as this; the widest fixed band ends far below.
MOST_HUNDREDTHS = 10_000


def measure(rules: BandRules):
    """The row function: base counts, and the ratios of the whole text and of its chunks."""
    compressor = zstandard.ZstdCompressor(level=rules.level)

    def ratio_of(data) -> float:
        return len(data) / len(compressor.compress(data)) if len(data) else 0.0

    def row(doc_id, text):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # bytes split at exactly the six ASCII white-space characters
        n_words, n_repeat = len(words), repeated_words(words)
        base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
        view = memoryview(data)
        chunks = [ratio_of(view[at : at + rules.chunk_bytes]) for at in range(0, len(data), rules.chunk_bytes)]
        return (
            doc_id, n_words, len(text) - sum(map(text.count, WHITE_SPACE)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
            n_repeat, base_failed, len(data), ratio_of(data), chunks,
        )

    return row


def _band(size: Column, rules: BandRules) -> Column:
    """Number of the band that a length falls in, null below the first."""
    found = F.lit(None).cast("int")
    for k, band in enumerate(rules.bands):
        found = F.when(size >= band.least_bytes, k).otherwise(found)
    return found


def _chunk_size(at: Column, rules: BandRules) -> Column:
    return F.least(F.lit(rules.chunk_bytes), F.col("size") - at.cast("long") * rules.chunk_bytes)


def upper_limits(measured: DataFrame, rules: BandRules) -> dict[tuple[bool, int], float]:
    """The upper limit of each (chunks or whole texts, band): at most two rows a band come to the driver."""
    limits = {(chunk, k): band.high for chunk in (False, True) for k, band in enumerate(rules.bands)}
    if rules.fence is None:
        return limits
    whole = measured.select(F.lit(False).alias("chunk"), F.col("size").alias("bytes"), "ratio")
    chunks = measured.select("size", F.posexplode("chunk_ratios").alias("at", "ratio")).select(F.lit(True), _chunk_size(F.col("at"), rules), "ratio")
    ratios = whole.unionByName(chunks.toDF("chunk", "bytes", "ratio")).withColumn("band", _band(F.col("bytes"), rules)).filter("band is not null")
    hundredths = F.least(F.floor(F.col("ratio") * 100), F.lit(MOST_HUNDREDTHS)).alias("hundredths")
    counts = ratios.groupBy("chunk", "band", hundredths).agg(F.count("*").alias("n"))
    group = Window.partitionBy("chunk", "band")  # MOST_HUNDREDTHS + 1 rows at most
    ranked = counts.select("*", F.sum("n").over(group.orderBy("hundredths")).alias("upto"), F.sum("n").over(group).alias("total"))
    quartile = [F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("hundredths"))) for k in (1, 3)]
    for r in ranked.groupBy("chunk", "band").agg(quartile[0].alias("low"), quartile[1].alias("high"), F.first("total").alias("total")).collect():
        if r.total >= rules.least_ratios:
            fence = max(r.high + rules.fence * (r.high - r.low), r.high * (1 + rules.margin)) / 100
            limits[r.chunk, r.band] = min(fence, limits[r.chunk, r.band])
    return limits


def _verdict(size: Column, ratio: Column, chunk: bool, limits: dict[tuple[bool, int], float], rules: BandRules) -> Column:
    """-1 incompressible, 1 repetitive, 0 in its band or too short to tell."""
    found = F.lit(0)
    for k, band in enumerate(rules.bands):
        found = F.when(size >= band.least_bytes, F.when(ratio < band.low, -1).when(ratio > limits[chunk, k], 1).otherwise(0)).otherwise(found)
    return found


def judged(measured: DataFrame, limits: dict[tuple[bool, int], float], rules: BandRules) -> DataFrame:
    """The verdict on measured rows, as column expressions."""
    sides = F.transform("chunk_ratios", lambda r, at: _verdict(_chunk_size(at, rules), r, True, limits, rules))
    run = F.aggregate(
        "sides", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda seen, side: F.struct(
            F.when(side == 0, 0).otherwise(seen["now"] + 1).alias("now"),
            F.greatest(seen["most"], F.when(side == 0, 0).otherwise(seen["now"] + 1)).alias("most"),
        ),
        lambda seen: seen["most"],
    )
    n_chunks = F.size("sides").cast("long")
    low, high = F.size(F.filter("sides", lambda s: s < 0)).cast("long"), F.size(F.filter("sides", lambda s: s > 0)).cast("long")
    out = measured.withColumn("sides", sides).withColumn("whole", _verdict(F.col("size"), F.col("ratio"), False, limits, rules))
    out = out.select("*", n_chunks.alias("n_chunks"), low.alias("n_incompressible_chunks"), high.alias("n_repetitive_chunks"), run.alias("longest_run"))
    low, high, n = F.col("n_incompressible_chunks"), F.col("n_repetitive_chunks"), F.col("n_chunks")
    too_many = (F.col("longest_run") >= rules.bad_run) | (low + high > F.least(rules.bad_chunk_share * n, rules.bad_chunk_root * F.sqrt(n)))
    reason = (
        F.when(F.col("base_failed"), "base").when(F.col("whole") < 0, "incompressible").when(F.col("whole") > 0, "repetitive")
        .when(too_many & (low >= high), "incompressible chunks").when(too_many, "repetitive chunks")
    )
    return out.withColumn("reason", reason).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"),
        "ratio", "n_chunks", "n_incompressible_chunks", "n_repetitive_chunks", "reason",
    )


def compression_bands(docs: DataFrame, rules: BandRules = BandRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ratios and the verdict for every document. Texts are read once; ratios, a few bytes a document, are written
    and read twice: for the limits and for the verdict."""
    texts = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(map_rows(texts, lambda: measure(rules), SCHEMA), "compression-ratios")
    return judged(measured, upper_limits(measured, rules), rules)
