import hashlib

import pytest
import sentencepiece

from spendaudit.llm import sentencepiece_codec
from spendaudit.llm.queries import model_file
from spendaudit.llm.sentencepiece_codec import Vocabulary, encode_documents
from tests.llm.conftest import prose

TEXTS = [
    None, "", " ", "  ", "a", " a b ", "a  b   c", "a\nb\tc\r\n", "x▁y ▁ z", "\x00a", "<s>a</s><unk>", "\U0001f600 zz  \n\n\t", "日本語テキスト",
    "ñ" * 300, "abab" * 2000, " " * 40 + "a", "﻿a​b", "é", "<0x41>", "ﬁ 　x\xa0y", prose(1, 4000), prose(2, 50), prose(2, 50),
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_decoded_texts_equal_the_library(make_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    rows = {r.doc_id: r for r in encode_documents(make_docs(*TEXTS), model_file(), with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids), text
        assert rows[i].ids_sha256 == digest(",".join(map(str, ids)))
        assert rows[i].decoded_sha256 == digest(library.decode(ids))


def test_list_and_heap_agendas_agree():
    pieces = Vocabulary(model_file())
    for text in TEXTS:
        if text:
            symbols = list(text.replace(" ", "▁"))[:400]
            assert pieces._by_list(list(symbols)) == pieces._by_heap(list(symbols))


def test_a_difference_from_the_library_raises():
    pieces = Vocabulary(model_file())
    pieces.costs = {}  # no merges
    pieces.encode("word")
    with pytest.raises(AssertionError):
        pieces.compare_new()


def test_forgetting_changes_nothing(monkeypatch):
    from spendaudit.llm import sentencepiece_codec

    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED", 3)
    pieces = Vocabulary(model_file())
    for _ in range(2):
        assert [int(i) for i in pieces.encode(prose(3, 200))[0].split(",")] == pieces.library.encode(prose(3, 200))


def test_empty_table(make_docs):
    assert encode_documents(make_docs(), model_file()).collect() == []


def test_words_that_differ_in_their_marks_share_parts(monkeypatch):
    pieces = Vocabulary(model_file())
    seen = []
    monkeypatch.setattr(pieces.parts, "make", lambda part: seen.append(part) or pieces.encode_stretch(part))
    for text in ("word word, word. word,word\nword_x1 #word", "(word) ...word\tword!? _word_ 3word"):
        assert [int(i) for i in pieces.encode(text)[0].split(",")] == pieces.library.encode(text)
        pieces.compare_new()
    assert seen.count("▁word") == 1 and seen.count("word") == 1


def test_no_piece_reaches_across_a_cut():
    assert sentencepiece_codec.parts_pattern(["▁a", "ab", "..", "."]).findall("▁ab..a") == ["▁ab", "..", "a"]
    assert sentencepiece_codec.parts_pattern(["▁a", "².", "."]).findall("▁ab².a") == ["▁ab", "².", "a"]
    assert sentencepiece_codec.parts_pattern(["▁a", "a.", "ab"]).findall("▁ab.a") == ["▁ab.a"]
