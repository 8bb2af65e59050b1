"""Secret scans: fixed patterns, and zstandard novelty for strings in a sensitive context.

A candidate is an unbroken string of letters, digits and ``+/_=-`` that follows a sensitive word on its line, or on the next one if
the line ends in a mark that leaves a value open (``key:``, ``key =``, ``-----``), or anywhere in the block that a ``-----BEGIN ...-----``
line with a sensitive word opens. A string that goes on from the word itself is a name up to its first ``=``, and what is behind
that is the candidate. Its novelty is the compressed bytes that it adds, over its length, behind common words and identifiers in
a frame whose dictionary is the text around it, without the candidate's own copies. The words tell the compressor how often each
letter occurs, so that names, paths and words that it never saw add few bytes a letter, while keys add about as many as they have,
or more; what the surrounding text holds adds least. Capitals that only begin words are taken as small letters. Nothing but this
decides; digits are not counted. Names that are half numbers (``release_2024_01_15``) lie near the limit.

Results for odd input: null and empty texts have no spans; overlapping spans of different kinds are all kept, but a candidate
that a fixed pattern covers is not reported again; a string that occurs again in the surroundings is reported at each place that
follows a sensitive word; very long texts are read whole, with a bounded surrounding for each candidate; equal rows get equal
results, one row each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import id_and_text, map_rows

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need no look
_SENSITIVE = re.compile(r"passw|secret|token|api_?key|credential|private|bearer|auth", re.IGNORECASE | re.ASCII)
_STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Small letters, and capitals that begin a word.
_SMALL, _BEGINS = re.compile(rb"[a-z]"), re.compile(rb"(?<![A-Z])[A-Z](?=[a-z]{2})")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{1,40}-----")
#: Marks at the end of a line that leave a value open, to stand on the next one.
_OPEN = tuple("-:=|>\\([{,+")

# Words of code, settings and prose, and parts of longer words; the dictionary is made of them.
WORDS = (
    "password passwd secret token api key access private public client id authorization bearer credential username user name session "
    "request environment configuration connection string database url localhost example default undefined parameter value get set type "
    "expires in refresh auth encode decode base64 sha256 import return class function void integer boolean object array list table "
    "column index number count file path line text data server response message error handler manager service factory builder context "
    "option property current previous next start stop open close read write create update delete insert select filter group order "
    "search match replace format load store save cache queue stream process schedule event status result code the of and to is that for "
    "it as was with be by on not this have from they which one you were all would there been their has will each about time other new "
    "some could people work between under never world nation ation ment ness able ible ality ization ing ous ive ful less ship ance ence "
    "ical inter trans super over counter multi auto respons character"
)


_PAIRS = list(zip(WORDS.split(), WORDS.split()[1:]))
IDENTIFIERS = (WORDS + "\n" + " ".join(f"{a}_{b}" for a, b in _PAIRS[:60:2]) + "\n").encode()


@dataclass(frozen=True)
class NoveltyRules:
    """Limits of the method: how far a sensitive word reaches, the shortest string, how much text is the surrounding, and the least novelty."""

    reach: int = 64
    least_length: int = 16
    around: int = 512
    least_novelty: float = 0.7
    level: int = 9


def novelty(candidate: bytes, surrounding: bytes, level: int = 9) -> float:
    """Compressed bytes that the candidate adds to the identifiers, over its length, with the surrounding as dictionary."""
    prior = zstandard.ZstdCompressionDict(surrounding or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=prior, write_content_size=False, write_checksum=False)
    small = candidate.lower() if not _SMALL.search(candidate) else _BEGINS.sub(lambda m: m[0].lower(), candidate)
    return (len(compressor.compress(IDENTIFIERS + small)) - len(compressor.compress(IDENTIFIERS))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kinds 0 assign, 1 access, 2 hex."""
    spans = []
    if _SENSITIVE.search(text):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(spans + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def novel_spans(text: str, taken: list[tuple[int, int, int]], rules: NoveltyRules) -> list[tuple[int, int, int]]:
    """(start, 3, end) of incompressible strings that follow a sensitive word and that no fixed pattern covers."""
    found, after, covered, blocks = [], 0, _Cover(taken), _blocks(text)
    for word in _SENSITIVE.finditer(text):
        if word.end() < after:
            continue
        end = _reach(text, word.end(), rules.reach)
        at = bisect_right(blocks, (word.start(), len(text), 0)) - 1
        if at >= 0 and word.end() <= blocks[at][1]:
            end = max(end, blocks[at][2])
        for m in _STRING.finditer(text, word.end(), end):
            # A string is taken whole, even where it goes on beyond the reach or begins before the word's end.
            start, stop = m.start(), _STRING.match(text, m.start()).end()
            if start < after:
                continue
            after = stop
            if start == word.end():  # it goes on from the word: a name, and perhaps its value
                name = text.find("=", start, stop)
                start = stop if name < 0 else name
                while start < stop and text[start] == "=":
                    start += 1
            string = text[start:stop]
            if len(string) < rules.least_length or covered(start, stop):
                continue
            surrounding = _surrounding(text, start, stop, rules)
            if novelty(string.encode(), surrounding.encode("utf-8", "surrogatepass"), rules.level) >= rules.least_novelty:
                found.append((start, 3, stop))
    return found


def _blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end of its first line, end of its body) of the blocks that a BEGIN line opens and an END line closes."""
    found, end = [], -1
    for m in _BEGIN.finditer(text) if "-----BEGIN " in text else ():
        if end < m.end():
            end = text.find("-----END ", m.end())
        if end < 0:
            break
        found.append((m.start(), m.end(), end))
    return found


def _reach(text: str, start: int, most: int) -> int:
    """Where the reach of a sensitive word that ends at ``start`` ends: at a line break, unless a value is left open there."""
    line = text.find("\n", start, start + most)
    while line >= 0:
        if not text[start:line].rstrip(" \t\r").endswith(_OPEN):
            return line
        line = text.find("\n", line + 1, start + most)
    return start + most


def _surrounding(text: str, start: int, stop: int, rules: NoveltyRules) -> str:
    """The text on both sides without copies of the candidate, or of its part behind a ``=``, those that only reach into it included."""
    string, wide = text[start:stop], rules.around + stop - start
    value = string.partition("=")[2]
    copy = value if len(value) >= rules.least_length else string
    before, behind = (part.replace(copy, " " * len(copy)) for part in (text[max(0, start - wide) : start], text[stop : stop + wide]))
    return before[max(0, len(before) - rules.around) :] + behind[: rules.around]


class _Cover:
    """Whether a span touches one of the given ones."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, _, b in spans:  # by start
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def __call__(self, start: int, stop: int) -> bool:
        at = bisect_left(self.starts, stop)
        return at > 0 and self.ends[at - 1] > start


KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, spans array<struct<start:int,end:int,kind:string>>"


def find_secrets(rules: NoveltyRules):
    def row(doc_id, text):
        text = text or ""
        base = base_spans(text)
        spans = sorted(base + novel_spans(text, base, rules))
        counts = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
        return doc_id, *counts, [{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in spans]

    return row


def secret_scan(docs: DataFrame, rules: NoveltyRules = NoveltyRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind and spans (start, kind, end) in code points, of every document; one map, no shuffle."""
    texts = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(texts, lambda: find_secrets(rules), SCHEMA)
