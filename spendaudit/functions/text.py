"""Column expressions that clean exported text. All run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendaudit import fixed_values as fixed


def lookup(values: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed dictionary, null when absent."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def message(template: str, **values: Column) -> Column:
    """Fill the ``{name}`` places of a fixed text with columns; null if any value is null."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def money(amount: Column) -> Column:
    return F.format_number(amount, 2)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, half-even on the binary value (as printf does in C and Python)."""
    return F.call_function("format_number", value, F.lit("0.0"))


def plain_number(value: Column) -> Column:
    """Shortest text of a number rounded to two decimals, at least one shown: 0.5, 1.0, 0.25."""
    return F.call_function("format_number", value, F.lit("0.0#"))


def round_printed(value: Column, places: int) -> Column:
    """Rounded as a number prints: exact binary value, ties to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places)).cast("double")


def round_scaled(value: Column, places: int) -> Column:
    """Rounded after scaling, ties to even; this is how array libraries round whole columns."""
    scale = F.lit(10.0**places)
    return F.rint(value * scale) / scale


def strip(text: Column) -> Column:
    """Without white space of any kind around it (line breaks, tabs and no-break spaces included)."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    """Trim; the usual spellings of a missing value become null."""
    trimmed = strip(text)
    return F.when(~trimmed.isin(fixed.MISSING_TEXT), trimmed)


def is_total_row(columns: list[str]) -> Column:
    """True when any cell of the row starts like a total line."""
    hits = [F.coalesce(F.col(f"`{c}`").rlike(fixed.TOTAL_ROW_PATTERN), F.lit(False)) for c in columns]
    return reduce(or_, hits)


def parse_amount(text: Column) -> Column:
    """Amount written with or without currency and separators; null for anything but a plain decimal number."""
    stripped = strip(F.regexp_replace(text, fixed.CURRENCY_PATTERN, ""))
    return F.when(stripped.rlike(fixed.NUMBER_PATTERN), stripped.try_cast("double"))


def parse_date(text: Column) -> Column:
    """Date in one of the fixed formats, month names in any case; null when none fits.

    The shape of the text selects the formats, so that no row fails its way through all of them.
    """
    day = F.regexp_replace(strip(text), fixed.TIME_OF_DAY_PATTERN, "")
    found = F.lit(None).cast("date")
    for shape, formats in reversed(fixed.DATE_SHAPES):
        found = F.when(day.rlike(shape), F.coalesce(*[_date(day, f) for f in formats])).otherwise(found)
    return found


def numeric_date(text: Column, day_first: bool) -> Column:
    """Date of a text of three numbers with the year last, in the one order or the other; null for all other texts."""
    day = F.regexp_replace(strip(text), fixed.TIME_OF_DAY_PATTERN, "")
    found = F.lit(None).cast("date")
    for shape, formats in fixed.DATE_SHAPES:
        if len(formats) == 2 and formats[1].startswith("d"):
            found = F.when(day.rlike(shape), _date(day, formats[day_first])).otherwise(found)
    return found


def _date(day: Column, form: str) -> Column:
    """Date in one format; years of two digits from 69 on are of the last century."""
    found = F.try_to_date(day, form)
    short = "yy" in form and "yyyy" not in form
    return F.when(F.year(found) >= 2069, F.add_months(found, -1200)).otherwise(found) if short else found


def extract_work_id(text: Column) -> Column:
    """Work id found in free text by the fixed patterns, most specific first; null when none fits."""
    hits = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in fixed.WORK_ID_PATTERNS]
    return F.upper(F.regexp_replace(F.coalesce(*hits), r"\s+", ""))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters (``initcap`` only looks at spaces)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    words = F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(words, "")


def normalize_member(name: Column) -> Column:
    bare = strip(F.regexp_replace(strip(name), fixed.HONORIFIC_PATTERN, ""))
    bare = strip(F.regexp_replace(bare, fixed.TERM_PATTERN, ""))
    return F.coalesce(title_case(bare), F.lit(fixed.UNKNOWN_MEMBER))


def normalize_state(state: Column) -> Column:
    titled = title_case(strip(state))
    return F.coalesce(lookup(fixed.STATE_SPELLINGS, titled), titled, F.lit(fixed.UNKNOWN_STATE))


def display_state(state: Column) -> Column:
    return F.coalesce(lookup(fixed.STATE_DISPLAY, state), state)


def state_from_display(name: str) -> str:
    """Stored spelling of a state given in its display spelling (any case)."""
    for stored, shown in fixed.STATE_DISPLAY.items():
        if shown.lower() == name.lower():
            return stored
    return name


def member_id(house: Column, name: Column) -> Column:
    """Stable member id from chamber and name."""
    joined = F.concat_ws("|", F.coalesce(house, F.lit("")), F.coalesce(name, F.lit("")))
    return F.concat(F.lit("MP-"), F.upper(F.substring(F.sha1(joined), 1, 10)))


def either(words: list[str]) -> str:
    """A pattern for any of some words, grouped by their beginnings."""
    rest: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            rest.setdefault(word[0], []).append(word[1:])
    branches = [letter + either(more) for letter, more in rest.items()]
    if "" in words and branches:
        return f"(?:{'|'.join(branches)})?"
    return f"(?:{'|'.join(branches)})" if len(branches) > 1 else "".join(branches)


def description_tokens(text: Column) -> Column:
    """Sorted meaningful words of a description: numbers of any length, other words from 3 letters.

    Unwanted words are cut out by one pattern before splitting, which is several times faster on long
    texts than testing every element of the split array. Words are held apart by single spaces first, so
    that the pattern is tried at spaces only.
    """
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    unwanted = f" (?:[a-z][a-z0-9]?|[0-9][a-z]|{either(fixed.DESCRIPTION_STOP_WORDS)})(?= )"
    return F.sort_array(F.array_remove(F.split(F.regexp_replace(plain, unwanted, ""), " "), ""))


def encode_reasons(reasons: Column) -> Column:
    return F.to_json(reasons)


def decode_reasons(text: Column, keep_bad_text: bool) -> Column:
    """Reasons from their JSON text. Text that is not a JSON list is kept as the only reason
    (``keep_bad_text``) or dropped; missing text is an empty list."""
    parsed = F.from_json(text, "array<string>")
    empty = F.array().cast("array<string>")
    bad = F.array(text) if keep_bad_text else empty
    return F.when(text.isNull(), empty).otherwise(F.coalesce(parsed, bad))
