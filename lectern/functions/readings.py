"""Readings of texts in print: lists of references, variant readings, tagged cells, names and notes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import refs, words

_POINT = "struct<book:string,chapter:int,out:array<string>>"

def refs_listed(text: Column) -> Column:
    """Compact references of a list with semicolons; what is none is left out."""
    found = F.transform(F.split(text, ";"), lambda t: refs.from_compact(F.trim(t)))
    return F.coalesce(F.filter(found, lambda r: r.isNotNull()), F.array().cast(f"array<{refs.REF}>"))


def refs_inherited(text: Column, codes: dict[str, str], single: list[str]) -> Column:
    """array<string>: a compact reference, or null, for each part of a list such as ``Job.26.6; 28.22, 24``.

    A part without a book has the one before it, and with one number its chapter too; after a book one number is a
    chapter (a verse in the books of one chapter, ``single``).  codes: from names in lower case.
    """
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    parts = F.filter(F.transform(F.split(text, "[;,]"), lambda p: F.regexp_replace(F.trim(p), "[.\\s]+$", "")), lambda p: p != "")
    start = F.struct(F.lit(None).cast("string").alias("book"), F.lit(None).cast("int").alias("chapter"), F.array().cast("array<string>").alias("out")).cast(_POINT)

    def step(acc: Column, part: Column) -> Column:
        name = F.regexp_extract(part, "^[1-3]?[A-Za-z]+", 0)
        rest = F.regexp_replace(F.substring(part, F.length(name) + F.lit(1), F.length(part)), "^\\.?\\s*", "")
        sides = F.split(rest, "-")
        numbers = F.transform(F.split(F.get(sides, F.lit(0)), "[.:]"), lambda n: n.try_cast("int"))
        last = F.get(sides, F.lit(1))
        fine = rest.rlike("^[0-9]+([.:][0-9]+){0,2}(-[0-9]+)?$")
        named = name != ""
        book = F.when(fine & named, known[F.lower(name)]).otherwise(acc["book"])
        before = F.when(named, F.lit(None).cast("int")).otherwise(acc["chapter"])
        alone = F.size(numbers) == 1
        chapter = F.when(~alone, numbers[0]).when(named & book.isin(single), 1).when(named, numbers[0]).otherwise(before)
        verse = F.when(~alone, F.get(numbers, F.lit(1))).when(named & ~book.isin(single), F.lit(None).cast("int")).otherwise(numbers[0])
        text = F.concat_ws(".", book, chapter.cast("string"), F.concat_ws("-", verse.cast("string"), last))
        found = F.when(fine & book.isNotNull() & chapter.isNotNull(), F.when(verse.isNull(), F.concat_ws(".", book, chapter.cast("string"))).otherwise(text))
        return F.struct(book.alias("book"), F.when(fine & book.isNotNull(), chapter).otherwise(acc["chapter"]).alias("chapter"), F.concat(acc["out"], F.array(found)).alias("out")).cast(_POINT)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def clamped(first: Column, last: Column, count: Column) -> Column:
    """struct<first,last> of a wanted range within 1 to count; both null where first is none of them or all are wanted."""
    a = F.when(first.between(1, count), first)
    b = F.when(a.isNotNull(), F.least(F.greatest(F.coalesce(last, count), a), count))
    whole = (a == 1) & (b == count)
    return F.struct(F.when(~whole, a).alias("first"), F.when(~whole, b).alias("last"))


def long_passage(whole: Column, verses: Column, least: int = 6) -> Column:
    """Whether a passage is learned as a chapter: a whole one, or from ``least`` verses on."""
    return whole | (verses >= least)


def respelled(word: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The word after each rule in turn: (``start``, ``end`` or ``any``, letters, letters in their place)."""
    for where, old, new in rules:
        n = F.length(word)
        if where == "start":
            word = F.when(word.startswith(old), F.concat(F.lit(new), F.substring(word, F.lit(len(old) + 1), n))).otherwise(word)
        elif where == "end":
            word = F.when(word.endswith(old), F.concat(F.substring(word, F.lit(1), n - len(old)), F.lit(new))).otherwise(word)
        elif where == "any":
            word = F.replace(word, F.lit(old), F.lit(new))
        else:
            raise ValueError(f"no place in a word: {where}")
    return word


def bare(word: Column) -> Column:
    """The word without punctuation behind it."""
    return F.regexp_replace(word, r"""[\s,.;:·"“”()\[\]]+$""", "")


def unnumbered(name: Column) -> Column:
    """A place's name without the number that tells namesakes apart."""
    return F.regexp_replace(name, r"\s+[0-9]+$", "")


def is_affix(tag: Column) -> Column:
    """Whether a lexicon tag is one of the affixes, H9000 to H9999, with or without a sense letter."""
    return F.coalesce(F.upper(tag).rlike("^H9[0-9]{3}[A-Z]?$"), F.lit(False))


def spoken(cell: Column, marks: str = "¶") -> Column:
    """struct<text,sound> of ``λόγος (logos)``: what stands before the last opening bracket, and inside it; marks go from both.

    Without a bracket all is text and the sound is empty.
    """
    clean = F.translate(cell, marks, "")
    inside = F.element_at(F.split(clean, r"\("), -1)
    text = F.left(clean, F.length(clean) - F.length(inside) - 1)
    has = F.contains(clean, F.lit("("))
    return F.struct(F.trim(F.when(has, text).otherwise(clean)).alias("text"), F.trim(F.when(has, F.substring_index(inside, ")", 1)).otherwise("")).alias("sound"))


def tag_pairs(tags: Column, between: str = " + ", alternative: str = "|", note: str = "«") -> Column:
    """struct<ids,codes> of pairs ``id=code`` in a list: of alternative ids the last, without a note behind it; a pair may lack its code."""
    pairs = F.filter(F.transform(F.split(tags, _literal(between)), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("id"), F.trim(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("code"))), lambda p: (p["id"] != "") | (p["code"] != ""))
    ids = F.transform(pairs, lambda p: F.trim(F.substring_index(F.substring_index(p["id"], note, 1), alternative, -1)))
    codes = F.filter(F.transform(pairs, lambda p: p["code"]), lambda c: c != "")
    return F.struct(ids.alias("ids"), F.array_join(codes, between).alias("codes"))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in text)


def _parted(text: Column, mark: str, last: bool = False) -> tuple[Column, Column]:
    """Text before and after the first (or last) mark, trimmed; both null without it."""
    head = F.substring_index(text, mark, 1)
    tail = F.substring_index(text, mark, -1)
    there = F.contains(text, F.lit(mark))
    if last:
        return F.when(there, F.trim(F.left(text, F.length(text) - F.length(tail) - len(mark)))), F.when(there, F.trim(tail))
    return F.when(there, F.trim(head)), F.when(there, F.trim(F.substring(text, F.length(head) + len(mark) + 1, F.length(text))))


def variants(cell: Column) -> Column:
    """array<struct<text,gloss,ids,codes,editions>> of readings ``text (sound) gloss - tags in: editions`` between ¦.

    A reading that lacks one of these parts is null.
    """

    def read(reading: Column) -> Column:
        front, editions = _parted(reading, " in: ", last=True)
        said, tags = _parted(front, " - ", last=True)
        text, rest = _parted(said, " (")
        _, gloss = _parted(rest, ") ")
        whole = (text != "") & (tags != "") & (editions != "") & gloss.isNotNull()
        return F.when(whole, F.struct(text.alias("text"), gloss.alias("gloss"), tag_pairs(tags)["ids"].alias("ids"), tag_pairs(tags)["codes"].alias("codes"), words.editions(editions).alias("editions")))

    return F.transform(F.filter(F.transform(F.split(cell, "¦"), lambda r: F.trim(r)), lambda r: r != ""), read)


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fitting(candidates: Column, most: int) -> Column:
    """The first of an array of texts that is shorter than most; where none is, the last one cut behind a word, with an ellipsis."""

    def cut(text: Column) -> Column:
        kept = F.split(F.left(text, F.lit(most - 2)), r"\s+")
        return F.concat(F.when(F.size(kept) > 1, F.array_join(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))), " ")).otherwise(kept[0]), F.lit("…"))

    return _once(candidates, lambda some: F.coalesce(F.get(F.filter(some, lambda c: F.length(c) < most), F.lit(0)), cut(F.element_at(some, -1))))


def first_sense(definition: Column, instead: Column, openings: list[str], most: int = 60) -> Column:
    """A definition's first sense: what stands before its first semicolon outside brackets, without one of the openings before it.

    Where nothing stands there, the first of the renderings in ``instead`` (between commas, a leading + or X is a mark) serves.
    A sense that is too long is given without what is in brackets, or only up to its first comma, or cut.
    """

    def opened(text: Column) -> Column:
        begins = lambda o: F.lower(text).startswith(o + " ") | F.lower(text).startswith(o + ", ")
        return F.coalesce(*[F.when(begins(o), F.ltrim(F.substring(text, F.lit(len(o) + 1), F.length(text)), F.lit(", "))) for o in openings], text)

    before = lambda text, mark: F.coalesce(words.split_outside(text, mark)["head"], text)
    squeezed = F.trim(F.regexp_replace(F.coalesce(definition, F.lit("")), r"\s+", " "))
    sense = _once(_once(squeezed, opened), lambda t: F.rtrim(before(t, ";"), F.lit(" ,:;.")))
    other = _once(F.trim(before(F.coalesce(instead, F.lit("")), ",")), lambda o: F.when(F.substring_index(o, " ", 1).isin("+", "X"), F.trim(F.substring(o, 2, 1 << 30))).otherwise(o))
    said = _once(sense, lambda s: F.when(s == "", other).otherwise(s))
    bare_said = lambda s: F.trim(F.regexp_replace(s, r"\s*\([^()]*\)", ""))
    return _once(said, lambda s: _once(bare_said(s), lambda b: fitting(F.array(s, b, before(b, ",")), most)))


def note_usable(text: Column, roles: list[str], openings: list[str], meanings: list[str]) -> Column:
    """Whether a note tells a person apart: it names a role or a people, or opens as a description does; no numbers, no meaning of the name, no bare name."""
    given = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")
    low = F.transform(given, lambda w: F.lower(w))
    names = lambda some: F.arrays_overlap(low, F.array(*[F.lit(x) for x in some]))
    capital = lambda w: F.left(w, F.lit(1)) != F.lower(F.left(w, F.lit(1)))
    people = F.exists(given, lambda w: capital(w) & (w.endswith("ite") | w.endswith("ites")))
    opens = F.exists(F.array(*[F.lit(o) for o in openings]), lambda o: F.array_join(F.slice(low, F.lit(1), F.size(F.split(o, " "))), " ") == o)
    bare_name = (F.size(given) == 1) & capital(F.coalesce(F.get(given, F.lit(0)), F.lit(""))) & ~people
    digits = F.translate(text, "0123456789", "") != text
    return ~digits & ~names(meanings) & ~bare_name & (people | names(roles) | opens)


def person_title(own: Column, shared: Column, relations: list[tuple[Column, Column]], note: Column) -> Column:
    """What tells a person from namesakes: what the own title has in brackets at its end, else, for a shared name, the first relative known, else a note.

    relations: (label, name) in the order of preference.
    """
    tail = F.substring_index(F.rtrim(own), "(", -1)
    bracketed = F.when(F.rtrim(own).endswith(")") & F.contains(own, F.lit("(")), F.nullif(F.trim(F.left(tail, F.length(tail) - 1)), F.lit("")))
    known = F.filter(F.array(*[F.when(name.isNotNull(), F.concat(label, F.lit(" of "), name)) for label, name in relations], note), lambda t: t.isNotNull())
    return F.coalesce(bracketed, F.when(shared, F.get(known, F.lit(0))))


def significance(place: Column, description: Column, summary: Column) -> Column:
    """What is said of a name: a person's description, or a place's summary up to its first mark and without where it is mentioned; null for nothing."""
    clause = summary
    for mark in (";", ",", "(", " first mentioned", " only mentioned"):
        clause = F.substring_index(clause, mark, 1)
    said = F.trim(F.when(place, clause).otherwise(description))
    return F.when(~said.isin("", ">", "A location"), said)


def family_ids(*members: Column) -> Column:
    """All ids of a family tree, in order, not made distinct: single ids and arrays of them."""
    return F.flatten(F.array(*members))


def runs_joined(a: Column, b: Column) -> Column:
    """Two lists of text runs with a space between: the last of a and the first of b stay runs of their own."""
    spaced = F.transform(b, lambda r, i: F.when((i == 0) & (F.size(a) > 0), F.concat(F.lit(" "), r)).otherwise(r))
    return F.concat(a, spaced)


def marker_range(text: Column, pattern: str) -> Column:
    """struct<first,last>: the number of the first marker in a text and the highest of all; null without markers.  pattern: its only group is the number."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int"))
    return F.when(F.size(numbers) > 0, F.struct(F.get(numbers, F.lit(0)).alias("first"), F.array_max(numbers).alias("last")))


def headed(text: Column, pattern: str) -> Column:
    """array<struct<head,body>>: a text cut before each header; what stands before the first one has no head."""
    heads = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    bodies = F.transform(F.split(text, pattern, -1), lambda b: F.trim(b))
    pieces = F.zip_with(heads, bodies, lambda h, b: F.struct(F.trim(h).alias("head"), b.alias("body")))
    return F.filter(pieces, lambda p: p["head"].isNotNull() | (p["body"] != ""))


def paired_refs(refs: Column, labels: Column) -> Column:
    """array<struct<ref,label>>: each reference with its own label where there are as many, else all labels for the first one."""
    each = F.arrays_zip(refs.alias("ref"), labels.alias("label"))
    whole = F.array(F.struct(F.get(refs, F.lit(0)).alias("ref"), F.array_join(labels, ", ").alias("label")))
    return F.when(F.size(refs) == F.size(labels), F.transform(each, lambda e: F.struct(e["ref"].alias("ref"), e["label"].alias("label")))).when(F.size(refs) > 0, whole)
