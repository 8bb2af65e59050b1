"""SentencePiece encoding and decoding of merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would form, then by place; the best
pair is merged, its new neighbours enter the agenda, until no pair forms a piece. Symbols that are no piece fall back to byte
pieces. No piece of such a vocabulary holds the space mark after another character (checked when the vocabulary is loaded), so
no merge crosses from a word into the next space: texts are cut there, and a word that a Python worker has met before is not
encoded again. A new word is cut where signs and other characters meet that share no piece of the vocabulary,
and only parts that the worker has not met go through the agenda. In every Arrow batch the words new to the worker, and every text with runs of spaces or marks as a whole, are
compared with the sentencepiece library, ids and decoded text (a word's is the library's own); a difference raises an error.

Results for odd input: a null text counts as empty; an empty text has no ids, the digest of the empty string, and decodes to
the empty string; very long texts are cut at spaces like all others, and a stretch without spaces takes n log n steps; equal
rows give equal results, one row each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendaudit.llm.common import SLICE_ROWS, id_and_text, sha256_hex

MARK = "▁"

#: Words are cut between these, with the characters that share a piece with one of them, and all other characters.
SIGNS = frozenset(chr(c) for c in range(128) if not chr(c).isalnum())

#: Words and parts whose ids a worker remembers in each of two generations. Memory only: no result depends on it.
REMEMBERED = 250_000
#: Longer words are encoded each time, and with a heap; the agenda of shorter ones is a plain list.
SHORT = 40


class Vocabulary:
    """Pieces, scores and byte pieces of a merge-type model file, and the agenda over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.names = [sp.id_to_piece(i) for i in range(size)]
        self.costs = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(map(sp.is_unused, range(size))) or not all(map(sp.is_byte, self.byte_ids)):
            raise ValueError("only merge-type vocabularies with byte pieces and without unused pieces")
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("only vocabularies whose pieces hold the space mark in front")
        if sp.decode(sp.encode(" a  ﬁ")) != " a  ﬁ":
            raise ValueError("only vocabularies that leave the text as it is")
        self.byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.cut = parts_pattern(self.ids).findall
        self.new: dict[str, list[int]] = {}
        self.parts, self.words = Memory(self.encode_stretch), Memory(self.encode_word)

    def pieces(self, stretch: str) -> list[str]:
        """Merge the best-scored adjacent pair, leftmost first, until none forms a piece."""
        return self._by_list(list(stretch)) if len(stretch) <= SHORT else self._by_heap(list(stretch))

    def _by_list(self, symbols: list[str]) -> list[str]:
        cost, never = self.costs.get, float("inf")
        agenda = list(map(cost, map(add, symbols, symbols[1:]), repeat(never)))
        while agenda:
            best = min(agenda)
            if best == never:
                break
            at = agenda.index(best)
            pair = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = [pair]
            del agenda[at]
            if at:
                agenda[at - 1] = cost(symbols[at - 1] + pair, never)
            if at < len(agenda):
                agenda[at] = cost(pair + symbols[at + 1], never)
        return symbols

    def _by_heap(self, symbols: list[str]) -> list[str]:
        costs, end = self.costs, len(symbols)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        agenda = [(costs[pair], i, pair) for i in range(end - 1) if (pair := symbols[i] + symbols[i + 1]) in costs]
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            # An entry is stale when either of its symbols has grown or gone since it was made.
            if not symbols[left] or right >= end or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = following = after[right]
            if following < end:
                before[following] = left
                if (joined := pair + symbols[following]) in costs:
                    heappush(agenda, (costs[joined], left, joined))
            if (previous := before[left]) >= 0 and (joined := symbols[previous] + pair) in costs:
                heappush(agenda, (costs[joined], previous, joined))
        return [s for s in symbols if s]

    def encode_stretch(self, stretch: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(stretch):
            found = self.ids.get(piece)
            if found is None:
                ids += [self.byte_ids[b] for b in piece.encode("utf-8")]
            else:
                ids.append(found)
        return ids

    def encode_word(self, word: str) -> str:
        """Ids of a word without marks, joined by commas."""
        ids: list[int] = []
        for part in self.cut(MARK + word):
            ids += self.parts[part]
        self.new[word] = ids
        return ",".join(map(str, ids))

    def decode(self, ids: list[int]) -> str:
        """Pieces put together, byte pieces read as UTF-8, marks as spaces, without the mark before the text."""
        data = b"".join(self.byte_of.get(i) or self.names[i].encode("utf-8") for i in ids)
        return data.decode("utf-8", "replace").replace(MARK, " ")[1:]

    def encode(self, text: str) -> tuple[str, str]:
        """Ids joined by commas, and the text decoded from them."""
        if not text:
            return "", ""
        words = text.split(" ")
        if "" in words or MARK in text:  # runs of spaces merge with each other: cut only where a run begins
            ids: list[int] = []
            for stretch in _stretches(MARK + text.replace(" ", MARK)):
                ids += self.encode_stretch(stretch)
            decoded = self.decode(ids)
            self.compare(text, ids, decoded)
            return ",".join(map(str, ids)), decoded
        remembered = self.words
        return ",".join([remembered[w] for w in words]), text  # each word's decoded form was found to be the word

    def compare(self, text: str, ids: list[int], decoded: str) -> None:
        known = self.library.encode(text)
        if known != ids or self.library.decode(known) != decoded:
            raise AssertionError(f"the agenda and the library disagree on {text[:80]!r}")

    def compare_new(self) -> None:
        """Hold the words met since the last call against the library."""
        new, self.new = self.new, {}
        if new:
            known = self.library.encode(list(new), num_threads=1)
            decoded = self.library.decode(known)
            for (word, ids), theirs, back in zip(new.items(), known, decoded):
                if ids != theirs or back != word:
                    raise AssertionError(f"the agenda and the library disagree on {word[:80]!r}")


class Memory(dict):
    """Results of ``make`` by text; when full, those of the generation before last are forgotten."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str):
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def parts_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Runs of signs, and of other characters with the mark before them, such that no piece reaches from one into the next."""
    pairs = {pair for piece in pieces for pair in zip(piece, piece[1:]) if MARK not in pair}
    signs = set(SIGNS)
    while joined := {c for pair in pairs if len(signs.intersection(pair)) == 1 for c in pair} - signs:
        signs |= joined
    kind = "".join(map(re.escape, sorted(signs - {MARK})))
    return re.compile(f"{MARK}?[^{kind}{MARK}]+|{MARK}?[{kind}]+|{MARK}")


def _stretches(marked: str) -> list[str]:
    """Cut before every run of marks: no piece reaches from another character into a mark."""
    cut, start = [], 0
    for at in range(1, len(marked)):
        if marked[at] == MARK and marked[at - 1] != MARK:
            cut.append(marked[start:at])
            start = at
    return [*cut, marked[start:]]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids and decoded text of every document, as digests and, if asked for, as lists; one map, no shuffle.

    ``model_file`` must be readable at the same path on every executor. Raises if the library disagrees with the agenda.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches):
        pieces = vocabulary(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [pieces.encode(t) for t in texts]
                pieces.compare_new()
                columns = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in found], pa.int64()),
                    "ids_sha256": pa.array([sha256_hex(ids.encode()) for ids, _ in found], pa.string()),
                    "decoded_sha256": pa.array([sha256_hex(decoded.encode("utf-8")) for _, decoded in found], pa.string()),
                    "round_trip": pa.array([decoded == text for (_, decoded), text in zip(found, texts)], pa.bool_()),
                }
                if with_ids:
                    lists = [list(map(int, ids.split(","))) if ids else [] for ids, _ in found]
                    columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
