"""Learning by heart: seeded orders, words to hide, typed answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# A step of the generator's state, and the shares of words hidden in each round.
STEP = 0x6D2B79F5
SHARES = (0.2, 0.4, 0.6, 0.8, 1.0)


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two unsigned 32-bit numbers, by halves of a, so that nothing exceeds a long."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = F.shiftleft((F.shiftright(a, 16) * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF))


def draws(seed: Column, count: Column) -> Column:
    """array<bigint>: that many unsigned 32-bit random numbers of a seed.

    The generator's state rises by a fixed step, so each number comes from its place alone: multiply, exclusive-or, shift.
    """
    mask = F.lit(0xFFFFFFFF)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def one(k: Column) -> Column:
        state = (seed.cast("long").bitwiseAND(mask) + _times(k.cast("long"), F.lit(STEP).cast("long"))).bitwiseAND(mask)
        first = lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
        second = lambda t: t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
        return once(once(once(state, first), second), lambda t: t.bitwiseXOR(F.shiftright(t, 14)))

    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(F.array().cast("array<bigint>"))


def _swapped(numbers: pd.Series) -> pd.Series:
    """Places after the swaps that random numbers ask for, from the last place down; one number fewer than places."""

    def one(draw):
        if draw is None:
            return None
        order = list(range(len(draw) + 1))
        for i, number in zip(range(len(draw), 0, -1), draw.tolist()):
            j = number * (i + 1) >> 32
            order[i], order[j] = order[j], order[i]
        return order

    return numbers.map(one)


def shuffled(items: Column, seed: Column) -> Column:
    """The items in the order of a Fisher-Yates shuffle by the numbers of draws(); null items stay null."""
    order = F.pandas_udf(_swapped, "array<int>")(draws(seed, F.size(items) - 1))
    return F.when(F.size(items) > 1, F.transform(order, lambda i: F.get(items, i))).otherwise(items)


def scrambled(items: Column, seed: Column) -> Column:
    """The items shuffled; where that is the order given, the first goes to the end, so two or more items never stay as they are."""
    places = F.transform(items, lambda _, i: i)
    order = shuffled(places, seed)
    turned = lambda o: F.when((F.size(o) > 1) & (o == places), F.concat(F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 1, 1))).otherwise(o)
    return F.transform(F.get(F.transform(F.array(order), turned), F.lit(0)), lambda i: F.get(items, i))


def hide_counts(words: Column, shares: tuple[float, ...] = SHARES) -> Column:
    """How many words are hidden in each round: none, then each share rounded up, at least one more than before, up to all and no further."""
    parts = F.array(*[F.lit(float(s)) for s in shares])
    more = lambda acc, n: F.when(F.element_at(acc, -1) < words, F.array_append(acc, F.least(words, n).cast("int"))).otherwise(acc)
    rounds = F.aggregate(parts, F.array(F.lit(0)), lambda acc, s: more(acc, F.greatest(F.element_at(acc, -1) + 1, F.ceil(words * s).cast("int"))))
    return F.get(F.transform(F.array(rounds), lambda acc: more(acc, words)), F.lit(0))


def blanks(words: Column, stop: list[str], seed: Column, share: float = 0.25) -> Column:
    """Places of about a share of the key words, in order; key words have three letters and are no stop words."""
    low = F.transform(words, lambda w: F.lower(w))
    keys = F.filter(F.transform(low, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: (F.length(p["w"]) >= 3) & ~p["w"].isin(stop))
    wanted = F.greatest(F.lit(1), F.round(F.size(keys) * share).cast("int"))
    drawn = F.array_sort(F.transform(keys, lambda p: F.struct(F.xxhash64(seed, p["i"]).alias("h"), p["i"].alias("i"))))
    return F.array_sort(F.transform(F.slice(drawn, F.lit(1), wanted), lambda p: p["i"]))


def typed(expected: Column, keys: Column) -> Column:
    """struct<index,missed>: how far first letters typed in turn got through the words, and the places typed wrong.

    A wrong letter marks the word as missed and leaves it open; a right one goes on.
    """
    start = F.struct(F.lit(0).alias("index"), F.array().cast("array<int>").alias("missed"))

    def step(acc, key):
        word = F.get(expected, acc["index"])
        right = F.lower(F.substring(word, 1, 1)) == F.lower(key)
        missed = F.when(word.isNull() | right | F.array_contains(acc["missed"], acc["index"]), acc["missed"]).otherwise(F.concat(acc["missed"], F.array(acc["index"])))
        return F.struct(F.when(F.coalesce(right, F.lit(False)), acc["index"] + 1).otherwise(acc["index"]).alias("index"), missed.alias("missed"))

    return F.aggregate(keys, start, step)
