"""Lists of numbers, verse spans and typographic marks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = "array<bigint>"
_TEXTS = "array<string>"


def _numbers(texts: Column) -> Column:
    return F.transform(texts, lambda t: t.cast("long"))


def numbers_listed(text: Column, most: int = 8674, widest: int = 12) -> Column:
    """struct<nums,irregular> of a list such as ``1254-57, 130l + 12 etc.``

    Items stand between commas and plus signs; a final ``l`` is a one; the end of a range may leave out
    its first digits.  A range wider than ``widest`` keeps its two ends and is irregular, as are ranges
    that run backwards, numbers beyond ``most``, and items with other text (their numbers count).
    """
    items = F.filter(F.transform(F.split(text, "[,+]"), lambda t: F.regexp_replace(F.trim(t), "^(\\d{1,17})l$", "$11")), lambda t: (t != "") & ~t.rlike("^etc\\.?$"))

    def read(item: Column) -> Column:
        a, b = (F.regexp_extract(item, "^(\\d{1,17})\\s*[–-]\\s*(\\d{1,17})$", k) for k in (1, 2))
        b = F.when(F.length(b) < F.length(a), F.concat(F.substring(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(b)
        low, high = F.nullif(a, F.lit("")).cast("long"), F.nullif(b, F.lit("")).cast("long")
        plain = item.rlike("^\\d{1,17}$")
        all_between = F.sequence(low, F.greatest(low, F.least(high, low + widest)))
        found = (
            F.when(low.isNull(), _numbers(F.regexp_extract_all(item, F.lit("\\d{1,17}"), F.lit(0))))
            .when(high < low, F.array().cast(_NUMBERS))
            .when(high - low > widest, F.array(low, high))
            .otherwise(all_between)
        )
        odd = ~plain & (low.isNull() | (high < low) | (high - low > widest))
        beyond = F.transform(F.filter(found, lambda n: (n < 1) | (n > most)), lambda n: n.cast("string"))
        return F.struct(F.filter(found, lambda n: (n >= 1) & (n <= most)).alias("nums"), F.concat(F.when(odd, F.array(item)).otherwise(F.array().cast(_TEXTS)), beyond).alias("irregular"))

    each = F.transform(items, read)
    return F.struct(F.array_distinct(F.flatten(F.transform(each, lambda e: e["nums"]))).alias("nums"), F.flatten(F.transform(each, lambda e: e["irregular"])).alias("irregular"))


def verses_named(span: Column) -> Column:
    """array<struct<chapter,verse>> of ``18:1``, ``10:4-5`` (each verse) or ``25:19-26:1`` (both ends); null for other text."""
    point = lambda c, v: F.struct(c.alias("chapter"), v.alias("verse"))
    shape = "^\\d{1,9}:\\d{1,9}(-\\d{1,9}(:\\d{1,9})?)?$"
    numbers = F.when(span.rlike(shape), F.split(span, "[:-]").cast("array<int>"))

    def named(n: Column) -> Column:
        at = lambda k: F.get(n, F.lit(k))
        return (
            F.when(F.size(n) == 2, F.array(point(at(0), at(1))))
            .when((F.size(n) == 3) & (at(2) >= at(1)), F.transform(F.sequence(at(1), F.greatest(at(1), at(2))), lambda v: point(at(0), v)))
            .when(F.size(n) == 4, F.array(point(at(0), at(1)), point(at(2), at(3))))
        )

    # an array of one binds the numbers, which are then read once a text and not once a verse
    return F.get(F.transform(F.array(numbers), named), F.lit(0))


def verse_span(verses: Column) -> Column:
    """The text of array<struct<chapter,verse>>: first and last, the chapter once where they share it; null without verses."""
    a, b = F.get(verses, F.lit(0)), F.get(verses, F.size(verses) - 1)
    head = F.concat_ws(":", a["chapter"], a["verse"])
    return F.when(F.size(verses) > 0, F.when(a == b, head).when(a["chapter"] == b["chapter"], F.concat_ws("-", head, b["verse"])).otherwise(F.concat_ws("-", head, F.concat_ws(":", b["chapter"], b["verse"]))))


def typographic(markup: Column) -> Column:
    """Long dashes for ``--`` and directional quotes for ``"``, in text but not in tags.

    A quote opens after white space, an opening bracket or a dash, also across a tag, else it closes.
    """
    opens = "[\\s(\\[{—–-]"
    pieces = F.regexp_extract_all(markup, F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
    start = F.struct(F.lit(" ").alias("last"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        dashed = F.replace(piece, F.lit("--"), F.lit("—"))
        led = F.when(acc["last"].rlike(opens), F.regexp_replace(dashed, '^"', "“")).otherwise(dashed)
        quoted = F.replace(F.regexp_replace(led, f'(?<={opens})"', "“"), F.lit('"'), F.lit("”"))
        tag = piece.startswith("<")
        return F.struct(F.when(tag, acc["last"]).otherwise(F.substring(dashed, -1, 1)).alias("last"), F.concat(acc["out"], F.when(tag, piece).otherwise(quoted)).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def bar(start: Column, end: Column) -> Column:
    """struct<start,end> of a bar at least one year long."""
    return F.struct(start.alias("start"), F.greatest(F.coalesce(end, start + 1), start + 1).alias("end"))
