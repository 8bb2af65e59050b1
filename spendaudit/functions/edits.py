"""Numbers of edits between texts, for many pairs at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of 64 bits of the first window; pairs that need more get one four times as wide. Numbers that one step works on.
WORDS = 8
AT_ONCE = 4096
#: Bytes of the texts of a group, and pairs below which a group is too small for arrays.
GROUP_BYTES = 4_000_000
SMALL_GROUP = 40
#: Columns whose bits are cut out at once, where a pair is counted alone.
COLUMNS = 256


def edit_counter() -> Callable:
    """A function of two lists of texts, and of limits if there are any, that counts the edits of each pair; -1 is beyond the limit.

    A column of the table of edits is held as bits (Myers 1999, Hyyrö 2003). Of a pair only the window around the diagonal is held that
    as many edits can reach as are allowed, as words of 64 bits, for many pairs of one width side by side; what it finds is exact as long
    as it is no more than the window is wide. A few long texts are counted one by one, with a whole number as their window.

    All that runs is inside, so that executors need not have this package.
    """
    first_words, at_once, group_bytes, small_group, columns_cut = WORDS, AT_ONCE, GROUP_BYTES, SMALL_GROUP, COLUMNS

    def whole(short, long, letters: Callable) -> int:
        mask, top = (1 << len(short)) - 1, 1 << (len(short) - 1)
        at = {c: letters(short, c) for c in set(short)}
        more, less, found = mask, 0, len(short)
        for c in long:
            same = at.get(c, 0)
            down = same | less
            across = (((same & more) + more) ^ more) | same
            up, lower = less | (mask & ~(across | more)), more & across
            found += bool(up & top) - bool(lower & top)
            up, lower = ((up << 1) | 1) & mask, (lower << 1) & mask
            more, less = lower | (mask & ~(down | up)), up & down
        return found

    def in_text(short: str, letter: str) -> int:
        return int("".join("1" if x == letter else "0" for x in reversed(short)), 2)

    def in_bytes(short: bytes, letter: int) -> int:
        return int(short[::-1].translate(bytes(48 + (x == letter) for x in range(256))), 2)

    def alone(short: bytes, long: bytes, limit: int) -> int:
        """The edits of one pair, by windows that grow until they are wide enough; beyond the limit any larger number."""
        gap, at, reach = len(long) - len(short), {c: in_bytes(short, c) for c in set(short)}, 128
        while True:
            side = max(1, (min(reach, limit) - gap) // 2 + 1)
            width = gap + 2 * side + 1
            if 2 * width >= len(short):
                return whole(short, long, lambda _, c: at[c])
            full, bit, kept, before = (1 << width) - 1, 1 << side, 0, gap + side
            up, down, cut = full ^ ((1 << before) - 1), 0, (1 << (width + columns_cut)) - 1
            for start in range(0, len(long), columns_cut):
                by = start - before
                part = {c: ((n >> by) if by > 0 else (n << -by)) & cut for c, n in at.items()}
                for j, c in enumerate(long[start : start + columns_cut]):
                    same = (part.get(c, 0) >> j) & full
                    equal = ((((same & up) + up) ^ up) | same | down) & full
                    kept += not equal & bit
                    right, left, after = down | (full & ~(equal | up)), equal & up, equal >> 1
                    up, down = left | (full & ~(after | right)), after & right
            if kept <= width or width > limit:
                return kept
            reach *= 4

    def by_window(pairs: list, side: int, words: int) -> np.ndarray:
        """For pairs (shorter, longer), the longest first: their edits, or more where they are more than difference of lengths + 2 side + 1.

        Bit b of column j stands for row j - difference - side + b; ``side`` is the bit of the diagonal that ends where both texts do.
        """
        lengths = np.array([len(t) for _, t in pairs])
        before = lengths - np.array([len(s) for s, _ in pairs]) + side
        many, longest = len(pairs), int(lengths[0])
        numbers = (longest >> 6) + words + 2
        rows, columns = np.zeros((many, numbers * 64), dtype=np.uint8), np.zeros((longest, many), dtype=np.intp)
        for i, (s, t) in enumerate(pairs):
            rows[i, before[i] : before[i] + len(s)] = s
            columns[: len(t), i] = t
        letters = np.unique(rows)
        letters = letters[letters > 0]
        place = np.zeros(256, dtype=np.intp)
        place[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        bits = np.zeros((numbers, many, width), dtype=np.uint64)
        for k, c in enumerate(letters):
            bits[:, :, k + 1] = np.packbits(rows == c, axis=1, bitorder="little").view("<u8").T
        bits = bits.reshape(numbers, many * width)
        columns = place[columns] + np.arange(many) * width
        below = np.arange(words * 64) >= before[:, None]
        up = np.ascontiguousarray(np.packbits(below, axis=1, bitorder="little").view("<u8").T)
        down, kept = np.zeros_like(up), np.zeros(many, dtype=np.int64)
        word, bit, one, last = side >> 6, np.uint64(side & 63), np.uint64(1), np.uint64(63)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for j in range(longest):
            k = active[j]
            if k < up.shape[1]:
                up, down = up[:, :k].copy(), down[:, :k].copy()
            at, by = j >> 6, np.uint64(j & 63)
            found = bits[at : at + words + 1].take(columns[j, :k], axis=1)
            same = found[:words]
            if by:
                same = (same >> by) | (found[1:] << (np.uint64(64) - by))
            both = same & up
            total = both + up
            if words > 1:
                # what a word carries goes to the next one, and on where that is full
                carry = ((both & up) | ((both | up) & ~total))[:-1] >> last
                total[1:] += carry
                full = total[1:] < carry
                while full.any():
                    carry = np.zeros_like(carry)
                    carry[1:] = full[:-1]
                    total[1:] += carry
                    full = total[1:] < carry
            equal = (total ^ up) | same | down
            kept[:k] += ((equal[word] >> bit) & one).view(np.int64)
            right, left = down | ~(equal | up), equal & up
            after = equal >> one
            if words > 1:
                after[:-1] |= equal[1:] << last
            up, down = left | ~(after | right), after & right
        return lengths - kept

    def counts(left, right, most=None) -> np.ndarray:
        out, todo = np.full(len(left), -1, dtype=np.int64), []

        def found(i: int, edits: int, limit: int) -> None:
            out[i] = edits if edits <= limit else -1

        for i, (a, b) in enumerate(zip(left, right)):
            short, long = sorted((a, b), key=len)
            limit = len(long) if most is None else min(int(most[i]), len(long))
            if not (a.isascii() and b.isascii()) or "\0" in a or "\0" in b:
                found(i, whole(short, long, in_text) if short else len(long), limit)
                continue
            s, t = np.frombuffer(short.encode(), np.uint8), np.frombuffer(long.encode(), np.uint8)
            for _ in range(2):  # without what both begin with, then what both end in
                other = np.flatnonzero(s != t[: len(s)])
                same = other[0] if len(other) else len(s)
                s, t = s[same:][::-1], t[same:][::-1]
            if not len(s):
                found(i, len(t), limit)
            elif len(t) - len(s) <= limit:
                todo.append((i, s, t, limit))
        words = first_words
        while todo:
            # pairs of one group have windows of one width, and texts that are not much shorter than the first one's
            gaps = [len(t) - len(s) for _, s, t, _ in todo]
            widths = [min(words, max((x[3] + 64) >> 6, (gap >> 6) + 1)) for x, gap in zip(todo, gaps)]
            order, at, rest = sorted(range(len(todo)), key=lambda i: (widths[i], -len(todo[i][2]))), 0, []
            while at < len(order):
                width, longest = widths[order[at]], len(todo[order[at]][2])
                room = max(16, min(at_once // width, group_bytes // (longest + 64 * width)))
                places = [i for i in order[at : at + room] if widths[i] == width and 4 * len(todo[i][2]) >= 3 * longest]
                at += len(places)
                group = [todo[i] for i in places]
                if len(group) < small_group:
                    for i, s, t, limit in group:
                        found(i, alone(s.tobytes(), t.tobytes(), limit), limit)
                    continue
                gap = max(gaps[i] for i in places)
                width = max(width, (gap >> 6) + 1)
                side = (64 * width - 1 - gap) // 2
                for x, edits in zip(group, by_window([x[1:3] for x in group], side, width).tolist()):
                    sure = len(x[2]) - len(x[1]) + 2 * side + 1
                    if edits <= sure or sure >= x[3]:
                        found(x[0], edits, x[3])
                    else:
                        rest.append(x)
            todo, words = rest, words * 4
        return out

    return counts
