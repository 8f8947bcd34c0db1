"""Words: tokens with places, normal forms, likeness, titles and brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+(?:['’-][\p{L}\p{M}\p{N}]+)*"


def _starts(lengths: Column, block: int = 256) -> Column:
    """Where each part begins: sums of the lengths before it, inside blocks and over the blocks, since an array grows by copying."""

    def scan(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0))), lambda k: scan(F.slice(lengths, k * block + 1, block)))
    joined = lambda parts: F.flatten(F.zip_with(parts, F.slice(scan(F.transform(parts, lambda p: F.element_at(p, -1))), F.lit(1), F.size(parts)), lambda p, base: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda n: n + base)))
    return F.get(F.transform(F.array(blocks), joined), F.lit(0))


def placed(text: Column) -> Column:
    """array<struct<word,pre,start>>: words with what stands before each and where they start, from 0.

    Words may hold inner apostrophes and hyphens; gaps and words in turn give the text up to its last word.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.split(text, WORD, -1)
    pairs = F.zip_with(words, F.slice(gaps, 1, F.size(words)), lambda w, g: F.struct(w.alias("word"), g.alias("pre")))
    begun = lambda p: _starts(F.transform(p, lambda x: F.length(x["pre"]) + F.length(x["word"])))
    put = lambda p: F.zip_with(p, begun(p), lambda x, at: F.struct(x["word"].alias("word"), x["pre"].alias("pre"), (at + F.length(x["pre"])).alias("start")))
    return F.get(F.transform(F.array(pairs), put), F.lit(0))


def plain(word: Column) -> Column:
    """Lower case, ligatures apart, letters and digits only; marks that stand alone go."""
    low = F.replace(F.replace(F.lower(word), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]", "")


def latin_only(word: Column) -> Column:
    """a to z of the lower-cased word, accented letters by their base."""
    return F.regexp_replace(F.translate(F.lower(word), "áàâäãāăéèêëēĕíìîïīĭóòôöõōŏúùûüūŭñçšṣḥṭ", "aaaaaaaeeeeeeiiiiiiooooooouuuuuuncssht"), "[^a-z]", "")


def consonants(word: Column) -> Column:
    """Hebrew consonants without points, final letters as usual ones."""
    return F.regexp_replace(F.translate(word, "ךםןףץ", "כמנפצ"), "[^א-ת]", "")


def loose_consonants(word: Column) -> Column:
    """Consonants without the vowel letters after the first."""
    return F.regexp_replace(consonants(word), "(?<=.)[אהוי]", "")


def alike(a: Column, b: Column, least: int = 5) -> Column:
    """Equal, one the other with a common ending, or from ``least`` letters on one edit apart."""
    ends = r"^(?:s|es|d|ed|ing|eth|est)$"
    stem = lambda x, y: x.startswith(y) & F.substring(x, F.length(y) + 1, F.length(x)).rlike(ends)
    long_enough = (F.length(a) >= least) & (F.length(b) >= least)
    return (a == b) | stem(a, b) | stem(b, a) | (long_enough & (F.levenshtein(a, b, 1) >= 0))


def key_word(word: Column, stop: list[str], least: int = 3) -> Column:
    return (F.length(word) >= least) & ~word.isin(stop)


def titled(text: Column, small: tuple[str, ...] = ("a", "an", "and", "at", "by", "for", "in", "of", "on", "or", "the", "to")) -> Column:
    """Capitals for all words but small ones within; roman numerals stay upper."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    little = F.array(*[F.lit(w) for w in small])

    def one(w, i):
        roman = w.rlike("^(?=[ivxlc])(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
        return F.when(roman & (w != "i"), F.upper(w)).when((i > 0) & F.array_contains(little, w), w).otherwise(F.array_join(F.transform(F.split(w, "-"), F.initcap), "-"))

    return F.array_join(F.transform(words, one), " ")


def split_outside(text: Column, separator: str) -> Column:
    """struct<head,tail>: the text before and after the first separator outside brackets; null without one.

    One pass over the characters with a depth (never below 0) and a place, so it takes time in proportion to the text.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("at"))

    def step(acc, c):
        depth = F.when(c.isin("(", "["), acc["depth"] + 1).when(c.isin(")", "]"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        found = (acc["at"] == 0) & (c == separator) & (acc["depth"] == 0)
        return F.struct(depth.alias("depth"), (acc["seen"] + 1).alias("seen"), F.when(found, acc["seen"] + 1).otherwise(acc["at"]).alias("at"))

    at = F.aggregate(F.split(text, ""), start, step, lambda acc: acc["at"])
    cut = lambda k: F.struct(F.trim(F.substring(text, F.lit(1), k - 1)).alias("head"), F.trim(F.substring(text, k + 1, F.length(text))).alias("tail"))
    return F.get(F.transform(F.filter(F.array(at), lambda k: k > 0), cut), F.lit(0))


def balanced(text: Column) -> Column:
    """The text without closing parentheses that nothing opened."""
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

    def step(acc, c):
        stray = (c == ")") & (acc["d"] == 0)
        d = acc["d"] + F.when(c == "(", 1).when((c == ")") & ~stray, -1).otherwise(0)
        return F.struct(d.alias("d"), F.when(stray, acc["out"]).otherwise(F.concat(acc["out"], c)).alias("out"))

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def editions(text: Column) -> Column:
    """Distinct labels of a list joined by +, order marks in parentheses away, in first order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"\+"), lambda x: F.trim(F.regexp_replace(x, r"\(.*?\)", ""))), lambda x: x != ""))


def in_all(text: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), editions(text))) == 0


def code_parts(code: Column, shared: bool) -> Column:
    """Parts of a grammar code.  shared: the first letter names the language of all parts, split at /;
    else parts are joined by ``+`` and what stands after = counts."""
    if shared:
        return F.transform(F.split(F.substring(code, F.lit(2), F.length(code)), "/"), lambda p: F.concat(F.substring(code, F.lit(1), F.lit(1)), p))
    return F.transform(F.split(code, r"\s*\+\s*"), lambda p: F.trim(F.regexp_replace(p, "^.*=", "")))
