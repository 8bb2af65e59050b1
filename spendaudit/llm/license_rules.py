"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised (ASCII letters and digits in lower case, single spaces) and looked up among
known licence sentences, on its line alone and joined with the lines that follow up to a blank line or an end mark, so that
hard-wrapped notices and comments are met too; the longest known sentence counts. The identifiers met, in order, are matched against ordered rules: at each place the first rule whose
sequence stands there wins and takes its sentences; a sentence that opens no rule is passed over.

Results for odd input: null and empty texts have no sentences and no licences; a sentence that repeats is met each time, its
licence is listed once; very long texts are read whole; equal rows get equal results, one row each; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from spendaudit.llm.common import id_and_text, map_rows

# One letter for each known sentence, in its normalised form.
SENTENCES = {
    "A": "licensed under the apache license version 2 0",
    "B": "you may not use this file except in compliance with the license",
    "C": "you may obtain a copy of the license at",
    "D": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "E": "see the license for the specific language governing permissions and limitations under the license",
    "F": "released under the mit license",
    "G": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "H": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "I": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "J": "this work is licensed under the gnu general public license version 3",
    "K": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "L": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "M": "licensed under cc by nc 4 0",
    "N": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "O": "licensed under cc by 4 0",
    "P": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "Q": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "R": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "S": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "T": "licensed under the gnu affero general public license version 3",
    "U": "all rights reserved",
    "V": "licensed under the apache license version 2 0 the license",
    # The original GPL notices have an end mark behind "free software", and some before "either".
    "W": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "X": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "Y": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "Z": "either version 3 of the license or at your option any later version",
    "a": "either version 2 of the license or at your option any later version",
    "b": "version 2 of the license",
    "c": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "d": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "e": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "f": "either version 2 1 of the license or at your option any later version",
    "g": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "h": "this source code form is subject to the terms of the mozilla public license v",
    "i": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "j": "this is free and unencumbered software released into the public domain",
    "k": "this work is licensed under a creative commons attribution 4 0 international license",
    "l": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "m": "licensed under cc by sa 4 0",
    "n": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
}

# Sequences of sentences, the licence they state and its kind; earlier rules win.
RULES = [
    ("ABCDE", "Apache-2.0", "permissive"),
    ("GHI", "MIT", "permissive"),
    ("GH", "MIT", "permissive"),
    ("PQnR", "BSD-3-Clause", "permissive"),
    ("PQR", "BSD-3-Clause", "permissive"),
    ("PQn", "BSD-2-Clause", "permissive"),
    ("PQ", "BSD-2-Clause", "permissive"),
    ("KL", "GPL-3.0-or-later", "copyleft"),
    ("SL", "GPL-2.0-only", "copyleft"),
    ("AB", "Apache-2.0", "permissive"),
    ("A", "Apache-2.0", "permissive"),
    ("F", "MIT", "permissive"),
    ("G", "MIT", "permissive"),
    ("J", "GPL-3.0-only", "copyleft"),
    ("K", "GPL-3.0-or-later", "copyleft"),
    ("S", "GPL-2.0-only", "copyleft"),
    ("M", "CC-BY-NC-4.0", "noncommercial"),
    ("N", "CC-BY-NC-4.0", "noncommercial"),
    ("O", "CC-BY-4.0", "permissive"),
    ("P", "BSD-2-Clause", "permissive"),
    ("T", "AGPL-3.0-only", "copyleft"),
    ("VBCDE", "Apache-2.0", "permissive"),
    ("VB", "Apache-2.0", "permissive"),
    ("V", "Apache-2.0", "permissive"),
    ("W", "GPL-3.0-or-later", "copyleft"),
    ("X", "GPL-2.0-or-later", "copyleft"),
    ("YZ", "GPL-3.0-or-later", "copyleft"),
    ("Ya", "GPL-2.0-or-later", "copyleft"),
    ("Yb", "GPL-2.0-only", "copyleft"),
    ("c", "LGPL-3.0-or-later", "copyleft"),
    ("d", "LGPL-2.1-or-later", "copyleft"),
    ("eZ", "LGPL-3.0-or-later", "copyleft"),
    ("ef", "LGPL-2.1-or-later", "copyleft"),
    ("g", "AGPL-3.0-or-later", "copyleft"),
    ("h", "MPL-2.0", "copyleft"),
    ("i", "ISC", "permissive"),
    ("j", "Unlicense", "permissive"),
    ("k", "CC-BY-4.0", "permissive"),
    ("l", "CC-BY-SA-4.0", "copyleft"),
    ("m", "CC-BY-SA-4.0", "copyleft"),
]
# "All rights reserved" at the head of a whole notice belongs to its copyright line; alone it states that there is no licence.
RULES = [(f"U{s}", licence, kind) for s, licence, kind in RULES if s[0] in "GPVWXYcdeghi" or s.startswith("AB")] + RULES + [("U", "All-Rights-Reserved", "proprietary")]

#: A sentence ends at a line break, or at these marks before white space or the end.
SENTENCE_END = r"\n|[.!?:;]+(?:[\x20\x09-\x0D]|$)"

_END = re.compile(r"\n|[.!?:;]+(?:[\x20\x09-\x0D]|\Z)")
_WORD = re.compile(r"[a-z0-9]+")
_RULE = re.compile("|".join(sequence for sequence, _, _ in RULES))
_LETTER = {sentence: letter for letter, sentence in SENTENCES.items()}
_LICENCE = {sequence: (licence, kind) for sequence, licence, kind in RULES}
#: Every known sentence holds one of these words; a text without them holds no known sentence.
_ANCHORS = ("license", "permission", "redistribut", "copyright", "warrant", "licensed", "rights reserved", "public domain")
#: What known sentences begin with, word by word, themselves included.
_BEGINNINGS = {" ".join(words[: i + 1]) for words in map(str.split, SENTENCES.values()) for i in range(len(words))}

if not all(any(a in s for a in _ANCHORS) for s in SENTENCES.values()):
    raise AssertionError("a known sentence without an anchor word")

SCHEMA = "doc_id long, n_sentences long, sentences string, licences string, kinds string, spans array<struct<start:int,end:int,sentence:string>>"


def known_sentences(text: str) -> list[tuple[int, int, str]]:
    """Place and letter of every known sentence, in order."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z, so places stay
    pieces, start = [], 0  # start, end, normalised, whether only a line break ends it
    for m in _END.finditer(lower):
        pieces.append((start, m.start(), " ".join(_WORD.findall(lower, start, m.start())), m[0] == "\n"))
        start = m.end()
    pieces.append((start, len(lower), " ".join(_WORD.findall(lower, start)), False))
    found, at = [], 0
    while at < len(pieces):
        start, end, joined, wrapped = pieces[at]
        after, best = at + 1, None
        while joined in _BEGINNINGS:
            if (letter := _LETTER.get(joined)) is not None:
                best = after, end, letter
            if not wrapped or not pieces[after][2]:
                break
            _, end, words, wrapped = pieces[after]
            joined += " " + words
            after += 1
        if best:
            at, end, letter = best
            found.append((start, end, letter))
        else:
            at += 1
    return found


def rules_met(letters: str) -> list[str]:
    """Sequences of the rules that win, from left to right."""
    return _RULE.findall(letters)


def recognise():
    def row(doc_id, text):
        lower = (text or "").lower()
        if not any(a in lower for a in _ANCHORS):
            return doc_id, 0, "", "", "", []
        found = known_sentences(text)
        letters = "".join(letter for _, _, letter in found)
        met = [_LICENCE[s] for s in rules_met(letters)]
        return (
            doc_id, len(found), letters, ",".join(sorted({licence for licence, _ in met})), ",".join(sorted({kind for _, kind in met})),
            [{"start": a, "end": b, "sentence": c} for a, b, c in found],
        )

    return row


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known sentences with their places, licences and their kinds, of every document; one map, no shuffle."""
    return map_rows(id_and_text(docs, id_col, text_col), recognise, SCHEMA)
