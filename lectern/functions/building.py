"""Words built from parallel columns: parts between separators, marks that hold to a part, sounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_marks(part: Column, marks: str, hold: str = "\\") -> Column:
    """A part without what is held to its end: from the first hold on if only holds, blanks and marks follow, else without the holds alone."""
    head = F.substring_index(part, hold, 1)
    tail = F.substring(part, F.length(head) + 1, F.length(part))
    only_marks = F.trim(F.translate(tail, hold + marks, "")) == ""
    return F.when(only_marks, head).otherwise(F.replace(part, F.lit(hold), F.lit("")))


def surface(text: Column, apart: str, between: str = "/", hold: str = "\\") -> Column:
    """The text as it is printed: parts joined, two separators a blank, held marks joined but for those of ``apart``, which stand by themselves."""
    out = F.replace(text, F.lit(between * 2), F.lit(" "))
    for mark in apart:
        out = F.replace(out, F.lit(hold + mark), F.lit(" " + mark))
    out = F.translate(out, between + hold, "")
    return F.array_join(F.filter(F.split(out, r"\s+"), lambda w: w != ""), " ")


def plain_sound(text: Column, accented: str = "áàâéèêíìîóòôúùû", plain: str = "aaaeeeiiiooouuu") -> Column:
    """A transliteration without accents; letters that are in neither table, such as long vowels, stay."""
    return F.translate(text, accented, plain)


def parts(text: Column, tags: Column, codes: Column, glosses: Column, joiners: list[str], between: str = "/", root: str = "{") -> Column:
    """struct<parts,root,problem>: parts (text, tag, code, gloss) of a word whose columns list them between separators.

    Tags lose a brace around them; a part with an empty tag or one of joiners only joins others and goes.  The
    language in front of the codes is put before each code.  root: the tag of the first part whose tag begins with that mark.
    problem: ``uneven`` where texts, tags and codes differ in number, ``no root``, or null.  Null for an empty text.
    """
    language, listed = F.left(codes, F.lit(1)), F.split(F.substring(codes, 2, 1 << 30), between)
    texts, marks, said = F.split(text, between), F.split(tags, between), F.split(F.coalesce(glosses, F.lit("")), between)
    even = (F.size(texts) == F.size(marks)) & (F.size(marks) == F.size(listed))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    bare = lambda t: F.trim(F.translate(t, "{}", ""))

    def one(t: Column, i: Column) -> Column:
        code = blank(F.get(listed, i))
        return F.struct(t.alias("text"), bare(F.get(marks, i)).alias("tag"), F.concat(language, code).alias("code"), blank(F.get(said, i)).alias("gloss"))

    kept = F.filter(F.transform(texts, one), lambda p: (p["tag"] != "") & ~p["tag"].isin(joiners))
    roots = F.filter(marks, lambda t: F.trim(t).startswith(root))
    problem = F.when(~even, "uneven").when(F.size(roots) == 0, "no root")
    whole = F.struct(F.when(even, kept).alias("parts"), bare(F.get(roots, F.lit(0))).alias("root"), problem.alias("problem"))
    return F.when(F.trim(text) != "", whole)
