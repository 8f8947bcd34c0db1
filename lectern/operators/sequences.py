"""Alignment of word sequences: inherently sequential, so row by row in Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIFF = "struct<ok:int,missed:int,extra:int,ops:string>"


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; among these one with most neighbouring pairs (i, j), (i + 1, j + 1).

    Remaining ties leave out words of a first, then of b.  Rows of the table are numpy vectors, of which two are held,
    and three bits a cell for the way back: 150 MB for two texts of 20,000 words.
    """
    import numpy as np

    n, m = len(a), len(b)
    if not n or not m:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(b))}
    x, y = np.array([number.get(w, -1) for w in a]), np.array([number[w] for w in b])
    one = min(n, m) + 1  # a pair counts for more than all neighbours
    below = np.zeros(m + 1, np.int64)  # best from (i + 1, j) on
    paired = np.full(m + 1, -1, np.int64)  # best from (i + 1, j) on if that is a pair
    down, right, chain = ([None] * n for _ in range(3))
    for i in range(n - 1, -1, -1):
        chain[i] = np.packbits(paired[1:] + 1 > below[1:])
        now = np.where(y == x[i], one + np.maximum(below[1:], np.where(paired[1:] >= 0, paired[1:] + 1, 0)), -1)
        best = np.zeros(m + 1, np.int64)
        best[:m] = np.maximum.accumulate(np.maximum(now, below[:m])[::-1])[::-1]
        down[i], right[i] = np.packbits(best[:m] == below[:m]), np.packbits(best[:m] == best[1:])
        below, paired = best, np.append(now, -1)

    def bit(rows, i, j):
        return rows[i][j >> 3] >> (7 - (j & 7)) & 1

    out, i, j, bound = [], 0, 0, False
    while i < n and j < m:
        if not bound and bit(down, i, j):
            i += 1
        elif not bound and bit(right, i, j):
            j += 1
        else:
            out.append((i, j))
            bound = bool(bit(chain, i, j))
            i, j = i + 1, j + 1
    return out


def diff(expected: list | None, given: list | None) -> dict:
    """Words right, missed and extra, and the operations in order (= - +)."""
    expected, given = expected or [], given or []
    ops, i, j = [], 0, 0
    for x, y in [*common(expected, given), (len(expected), len(given))]:
        ops += ["-"] * (x - i) + ["+"] * (y - j) + ["="]
        i, j = x + 1, y + 1
    ops.pop()
    return {"ok": ops.count("="), "missed": ops.count("-"), "extra": ops.count("+"), "ops": "".join(ops)}


def word_diff(expected: Column, given: Column) -> Column:
    """struct<ok,missed,extra,ops> of two arrays of words."""
    return F.udf(diff, DIFF, useArrow=True)(expected, given)


def accuracy(result: Column) -> Column:
    """Right words over expected and extra ones; null without either."""
    total = result["ok"] + result["missed"] + result["extra"]
    return F.when(total > 0, result["ok"] / total)


def moved(a: list, b: list, pairs: list[tuple[int, int]], least: int = 3) -> list[tuple[int, int, int]]:
    """(i, j, n): runs of n words, least or more, that the alignment leaves out on both sides but that occur in both.

    Longest first; words are used once.
    """
    free_a, free_b = set(range(len(a))) - {i for i, _ in pairs}, set(range(len(b))) - {j for _, j in pairs}
    found, places = [], {}
    for j in sorted(free_b):
        places.setdefault(b[j], []).append(j)
    for i in sorted(free_a):
        for j in places.get(a[i], ()):
            n = 0
            while i + n in free_a and j + n in free_b and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                found.append((-n, abs(i - j), i, j))
    out = []
    for n, _, i, j in sorted(found):
        mine_a, mine_b = set(range(i, i - n)), set(range(j, j - n))
        if mine_a <= free_a and mine_b <= free_b:
            out.append((i, j, -n))
            free_a -= mine_a
            free_b -= mine_b
    return out


def similar(a: str, b: str, swaps: dict[str, set[str]] | None = None, least: int = 5) -> bool:
    """Equal, one the other with a common ending, one that stands for the other in swaps, or from ``least`` letters on one edit apart."""
    if a == b or b in (swaps or {}).get(a, ()):
        return True
    short, long = sorted((a, b), key=len)
    if long.startswith(short) and long[len(short) :] in ("s", "es", "d", "ed", "ing", "eth", "est"):
        return True
    if len(short) < least or len(long) - len(short) > 1:
        return False
    same = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    return short[same + (len(short) == len(long)) :] == long[same + 1 :]


def in_order(a: list, b: list, like) -> list[tuple[int, int]]:
    """As many pairs (i, j), both rising, as can be of items that are alike; the first ones of several ways."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], 1 + best[i + 1][j + 1] if like(a[i], b[j]) else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if like(a[i], b[j]) and best[i][j] == 1 + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(words: list, other: list, swaps: dict | None = None, small: frozenset = frozenset()) -> list[tuple[int, str] | None]:
    """For each word of the other version the place it answers to and how, or null.

    same: aligned as it is, or part of a moved phrase; similar: alike in the stretch between two aligned words, in
    order; position: what is left there is one word on each side, both among the small words or neither.
    """
    pairs = {j: (i, "same") for i, j in common(words, other)}
    for i, j, n in moved(words, other, [(i, j) for j, (i, _) in pairs.items()]):
        pairs |= {j + k: (i + k, "same") for k in range(n)}
    used = {i for i, _ in pairs.values()}

    def gaps():
        """Stretches of both versions, with no word matched, that begin behind matched neighbours or at the start."""
        j = 0
        while j < len(other):
            if j in pairs:
                j += 1
                continue
            end = j
            while end < len(other) and end not in pairs:
                end += 1
            first = pairs[j - 1][0] + 1 if j else 0
            last = first
            while last < len(words) and last not in used:
                last += 1
            if end == len(other) or pairs[end][0] == last:  # what follows on both sides answers to each other
                yield first, last, j, end
            j = end

    for a0, a1, b0, b1 in list(gaps()):
        for i, j in in_order(words[a0:a1], other[b0:b1], lambda x, y: similar(x, y, swaps)):
            pairs[b0 + j] = (a0 + i, "similar")
            used.add(a0 + i)
    for a0, a1, b0, b1 in list(gaps()):
        if a1 - a0 == b1 - b0 == 1 and (words[a0] in small) == (other[b0] in small):
            pairs[b0] = (a0, "position")
            used.add(a0)
    return [pairs.get(j) for j in range(len(other))]


def carried(words: list | None, tags: list | None, other: list | None, swaps: dict | None = None, small: frozenset = frozenset()) -> list:
    """Tags of words on the words of another version, by aligned(); null where nothing matches."""
    words, tags, other = words or [], tags or [], other or []
    found = aligned(words, other, swaps, small)
    return [tags[m[0]] if m and m[0] < len(tags) else None for m in found]


def tag_transfer(words: Column, tags: Column, other: Column, swaps: dict[str, set[str]] | None = None, small: frozenset = frozenset()) -> Column:
    """array<string>: a tag or null for each word of the other version.  swaps and small are tables that the caller bounds."""
    return F.udf(lambda a, t, b: carried(a, t, b, swaps, small), "array<string>", useArrow=True)(words, tags, other)


def match_rules(words: Column, other: Column, swaps: dict[str, set[str]] | None = None, small: frozenset = frozenset()) -> Column:
    """array<string>: how each word of the other version was matched (same, similar, position), or null."""
    return F.udf(lambda a, b: [m and m[1] for m in aligned(a or [], b or [], swaps, small)], "array<string>", useArrow=True)(words, other)
