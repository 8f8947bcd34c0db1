"""Typed references resolved against tables of books and chapters."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import refs
from lectern.operators.ordered import running_total

#: What the numbers behind a book's name mean, by the marks between them (``n`` stands for a number).
SHAPES = {
    "n": ["chapter"],
    "n-n": ["chapter", "last_chapter"],
    "n-n:n": ["chapter", "last_chapter", "last_verse"],
    "n:n": ["chapter", "verse"],
    "n:n-n": ["chapter", "verse", "end_verse"],
    "n:n-n:n": ["chapter", "verse", "end_chapter", "end_verse"],
}
#: The same in a book of one chapter.
ONE_CHAPTER = SHAPES | {"n": ["verse"], "n-n": ["verse", "end_verse"], "n-n:n": []}


def books(spark: SparkSession, rows: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(book, book_index, chapters, names) from (code, chapters, names) in canonical order.

    names are written in any way, the full name first; the result holds their keys.  The code is a name too.
    """
    given = spark.createDataFrame([(code, i, chapters, list(names)) for i, (code, chapters, names) in enumerate(rows, 1)], "book string, book_index int, chapters int, names array<string>")
    return given.withColumn("names", F.transform("names", refs.book_key))


def chapter_table(counts: DataFrame, ranges: int = 256) -> DataFrame:
    """(book, book_index, chapter, n_verses, start_ord, end_ord) from (book, book_index, chapter, n_verses).

    Ordinals run over the totals of ranges of books first and within a range then, so no task needs all chapters, nor all
    books: the ranges are at most ``ranges``, by quantiles of the books.
    """
    at = counts.where("book_index IS NOT NULL").withColumn("_at", F.col("book_index").cast("double"))
    cuts = sorted(set(at.approxQuantile("_at", [k / ranges for k in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    at = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_range").transform(at) if cuts else at.withColumn("_range", F.lit(0.0))
    placed = running_total(at.drop("_at").withColumn("_order", F.struct("book_index", "chapter")), "_order", "n_verses", F.col("_range"), "start_ord").drop("_range")
    return placed.withColumn("end_ord", F.col("start_ord") + F.col("n_verses") - 1).drop("_order")


def resolve_books(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """df with book, book_index, chapters: an exact name, else the only full name that begins with the key.

    Keys shorter than three characters and prefixes of several books resolve to null.
    """
    found = F.struct("book", "book_index", "chapters").alias("_found")
    names = known.select(F.explode("names").alias("_name"), found)
    codes = known.select(F.lower("book").alias("_name"), found).join(names.select("_name"), "_name", "left_anti")
    exact = names.unionByName(codes).dropDuplicates(["_name"])
    full = known.select(F.col("names")[0].alias("_full"), found)
    prefixes = full.select(F.explode(F.transform(F.sequence(F.lit(3), F.length("_full")), lambda n: F.substring("_full", F.lit(1), n))).alias("_prefix"), "_found")
    only = prefixes.groupBy("_prefix").agg(F.count("*").alias("_n"), F.first("_found").alias("_longer")).where("_n = 1").drop("_n")
    met = df.join(exact, df[key] == exact["_name"], "left").join(only, df[key] == only["_prefix"], "left")
    return met.select(*df.columns, *[F.coalesce(F.col(f"_found.{c}"), F.col(f"_longer.{c}")).alias(c) for c in ("book", "book_index", "chapters")])


def _read(df: DataFrame, column: str) -> DataFrame:
    """df with the key of the book's name, the shape of what follows it, and its numbers.

    A text is read up to its first comma or semicolon.  The name is everything before the first digit
    that is not its ordinal.
    """
    text = F.get(F.split(F.col(column), "[,;]"), F.lit(0))
    name = F.regexp_extract(text, r"^\s*[0-9]?[^0-9]*", 0)
    tight = F.regexp_replace(F.substring(text, F.length(name) + F.lit(1), F.length(text)), r"\s*([:.v–—-])\s*", "$1")
    marks = F.translate(F.trim(tight), ".v–—", "::--")
    plain = F.translate(F.lower(name), "abcdefghijklmnopqrstuvwxyz0123456789. \t", "") == ""
    return df.withColumns(
        {
            "_key": F.when(plain & name.rlike("[A-Za-z]"), refs.book_key(name)),
            "_shape": F.regexp_replace(marks, "[0-9]+", "n"),
            "_numbers": F.transform(F.regexp_extract_all(marks, F.lit("[0-9]+"), F.lit(0)), lambda n: n.try_cast("int")),
        }
    )


def _member(shapes: dict[str, list[str]], name: str) -> Column:
    """The number that stands for name in the shape, null if the shape has none."""
    at = {shape: members.index(name) for shape, members in shapes.items() if name in members}
    places = F.create_map(*[F.lit(x) for pair in at.items() for x in pair]) if at else F.create_map().cast("map<string,int>")
    return F.get(F.col("_numbers"), places[F.col("_shape")])


def _exists(met: DataFrame, verses: DataFrame, chapter: Column, verse: Column, out: str) -> DataFrame:
    """met with out: whether verse is null or among the verses of the chapter of the reference's book."""
    known = verses.select(F.col("book").alias("_kb"), F.col("chapter").alias("_kc"), F.col("n_verses").alias("_kn"))
    found = met.join(known, (F.col("ref.book") == F.col("_kb")) & (chapter == F.col("_kc")), "left")
    return found.withColumn(out, verse.isNull() | F.coalesce(verse <= F.col("_kn"), F.lit(False))).drop("_kb", "_kc", "_kn")


def parse(df: DataFrame, column: str, known: DataFrame, verses: DataFrame | None = None) -> DataFrame:
    """df with ref: the reference that a typed text names, null if there is none.

    A name alone is the first chapter.  Of a range of chapters the first stays; in a book of one chapter
    numbers are verses, but for a lone 1.  verses (book, chapter, n_verses) bounds verse numbers where given.
    """
    met = resolve_books(_read(df, column), "_key", known)
    small = (F.col("chapters") == 1) & ~((F.col("_shape") == "n") & (F.get("_numbers", F.lit(0)) == 1))
    m = {n: F.when(small, _member(ONE_CHAPTER, n)).otherwise(_member(SHAPES, n)) for n in ("chapter", "last_chapter", "verse", "end_chapter", "end_verse")}
    bare = F.col("_shape") == ""
    readable = bare | F.col("_shape").isin(list(SHAPES)) & ~(small & (F.col("_shape") == "n-n:n"))
    counted = F.forall("_numbers", lambda n: n.isNotNull())
    chapter = F.coalesce(m["chapter"], F.lit(1))
    forward = F.coalesce((m["last_chapter"] >= chapter) & (m["last_chapter"] <= F.col("chapters")), F.lit(True))
    ref = refs.ref(F.col("book"), chapter, m["verse"], m["end_chapter"], m["end_verse"])
    within = (chapter >= 1) & (chapter <= F.col("chapters")) & (F.coalesce(m["end_chapter"], F.lit(1)) <= F.col("chapters"))
    fine = F.coalesce(F.col("book").isNotNull() & readable & counted & forward & within, F.lit(False))
    met = met.withColumn("ref", F.when(fine, ref)).withColumn("ref", F.when(refs.well_formed(F.col("ref")), refs.collapsed(F.col("ref"))))
    if verses is not None:
        r = F.col("ref")
        met = _exists(met, verses, r["chapter"], r["verse"], "_starts")
        met = _exists(met, verses, F.coalesce(r["end_chapter"], r["chapter"]), r["end_verse"], "_ends")
        met = met.withColumn("ref", F.when(F.col("_starts") & F.col("_ends"), F.col("ref")))
    return met.select(*df.columns, "ref")


def valid(df: DataFrame, ref: str, verses: DataFrame) -> DataFrame:
    """Rows of df whose reference exists and runs forward: start and end each meet the chapter table."""
    a = verses.select(F.col("book").alias("_b1"), F.col("chapter").alias("_c1"), F.col("n_verses").alias("_n1"))
    b = verses.select(F.col("book").alias("_b2"), F.col("chapter").alias("_c2"), F.col("n_verses").alias("_n2"))
    r = F.col(ref)
    started = df.join(a, (r["book"] == F.col("_b1")) & (r["chapter"] == F.col("_c1")) & (F.coalesce(r["verse"], F.lit(1)).between(F.lit(1), F.col("_n1"))), "left_semi")
    return started.where(refs.well_formed(r)).join(b, (r["book"] == F.col("_b2")) & (F.coalesce(r["end_chapter"], r["chapter"]) == F.col("_c2")) & (F.coalesce(r["end_verse"], F.lit(1)) <= F.col("_n2")), "left_semi")


def validity(df: DataFrame, ref: str, verses: DataFrame) -> DataFrame:
    """df with forward, loose and strict: whether the reference's chapters and verses exist, by three rules for its end.

    forward: the end has a start verse and does not come before it.  loose: the end is within its chapter, in any order, and
    what stands behind a whole chapter is not looked at.  strict: the end comes after the start, and a named end chapter
    is a later one.  A null reference is none of them.
    """
    size = lambda n: verses.select(F.col("book").alias(f"_b{n}"), F.col("chapter").alias(f"_c{n}"), F.col("n_verses").alias(f"_n{n}"))
    r = F.col(ref)
    last = F.coalesce(r["end_chapter"], r["chapter"])
    met = df.join(size(1), (r["book"] == F.col("_b1")) & (r["chapter"] == F.col("_c1")), "left").join(size(2), (r["book"] == F.col("_b2")) & (last == F.col("_c2")), "left")
    here, there = F.col("_n1").isNotNull(), F.col("_n2").isNotNull()
    whole, open_end = r["verse"].isNull(), r["end_verse"].isNull()
    begins = here & r["verse"].between(1, F.col("_n1"))
    ends = there & (last >= r["chapter"])
    inside = r["end_verse"].between(1, F.col("_n2"))
    same = last == r["chapter"]
    sure = lambda c: F.coalesce(c, F.lit(False))
    return met.withColumns({
        "forward": sure(here & (whole | begins) & ends & (open_end | (~whole & inside & (~same | (r["end_verse"] >= r["verse"]))))),
        "loose": sure(here & (whole | (begins & there & (open_end | (r["end_verse"] <= F.col("_n2")))))),
        "strict": sure(here & F.when(whole, open_end).otherwise(begins & ends & (open_end | (inside & (~same | (r["end_verse"] > r["verse"])))) & (r["end_chapter"].isNull() | (r["end_chapter"] > r["chapter"])))),
    }).drop("_b1", "_c1", "_n1", "_b2", "_c2", "_n2")


def verses_of(df: DataFrame, ref: str, verses: DataFrame) -> DataFrame:
    """df with chapter and verse, a row for each verse that the reference covers."""
    r, t = F.col(ref), verses.select(F.col("book").alias("_b"), F.col("chapter").alias("_chapter"), F.col("n_verses").alias("_n"))
    met = df.join(t, (r["book"] == F.col("_b")) & F.col("_chapter").between(r["chapter"], F.coalesce(r["end_chapter"], r["chapter"])))
    last = F.col("_chapter") == F.coalesce(r["end_chapter"], r["chapter"])
    low = F.when(r["verse"].isNotNull() & (F.col("_chapter") == r["chapter"]), r["verse"]).otherwise(1)
    high = F.when(r["verse"].isNotNull() & last, F.coalesce(r["end_verse"], F.when(r["end_chapter"].isNull(), r["verse"]), F.col("_n"))).otherwise(F.col("_n"))
    return met.withColumn("_v", F.when(low <= F.least(high, F.col("_n")), F.sequence(low, F.least(high, F.col("_n"))))).select(*df.columns, F.col("_chapter").alias("chapter"), F.explode("_v").alias("verse"))


def remapped(df: DataFrame, key: str, rules: DataFrame, known: DataFrame, fallback: DataFrame) -> DataFrame:
    """df with target: the key's rule, else the key itself if it is known, else the fallback's only target."""
    one = fallback.groupBy(F.col("from_key").alias("_f")).agg(F.countDistinct("to_key").alias("_n"), F.min("to_key").alias("_t")).where("_n = 1").drop("_n")
    met = df.join(rules.select(F.col("from_key").alias("_r"), F.col("to_key").alias("_to")), F.col(key) == F.col("_r"), "left")
    met = met.join(known.select(F.col("key").alias("_k")).distinct(), F.col(key) == F.col("_k"), "left").join(one, F.col(key) == F.col("_f"), "left")
    return met.select(*df.columns, F.coalesce("_to", "_k", "_t").alias("target"))


def kin(people: DataFrame) -> DataFrame:
    """(person, relative, kind): parents, children, partners, siblings and grandparents from a table of
    id, father, mother, partners; nobody is kin of themselves, and nearer kinds win."""
    parents = people.select(F.col("id").alias("person"), F.explode(F.array("father", "mother")).alias("relative")).where("relative is not null")
    parents = parents.hint("merge")  # a row has several relatives, of which an estimate by file size knows nothing
    children = parents.select(F.col("relative").alias("person"), F.col("person").alias("relative"))
    partners = people.select(F.col("id").alias("person"), F.explode("partners").alias("relative"))
    siblings = parents.select("person", F.col("relative").alias("_p")).join(children.select(F.col("person").alias("_p"), "relative"), "_p").select("person", "relative")
    grand = parents.select("person", F.col("relative").alias("_p")).join(parents.select(F.col("person").alias("_p"), "relative"), "_p").select("person", "relative")
    kinds = [("parent", parents), ("child", children), ("partner", partners), ("sibling", siblings), ("grandparent", grand)]
    rows = None
    for rank, (kind, df) in enumerate(kinds):
        one = df.select("person", "relative", F.lit(rank).alias("rank"))
        rows = one if rows is None else rows.unionByName(one)
    # dealt before they are grouped: few pairs are repeated, so grouping them where they were read would only fill that task's memory
    nearest = rows.where("person <> relative").repartition("person", "relative").groupBy("person", "relative").agg(F.min("rank").alias("rank"))
    return nearest.select("person", "relative", F.get(F.array(*[F.lit(kind) for kind, _ in kinds]), F.col("rank")).alias("kind"))


def from_dotted(df: DataFrame, column: str, codes: dict[str, str], verses: DataFrame) -> DataFrame:
    """df with ref, note and error for a text such as ``Bible:Gen.1.1!a-Gen.2``.

    A work before the colon and grains behind ``!`` go, other works are errors.  A range of chapters becomes its first
    one, with a note; a range of verses that ends in a chapter runs to that chapter's last verse.  codes: from names in
    lower case; verses: (book, chapter, n_verses).
    """
    text = F.trim(F.col(column))
    work = F.regexp_extract(text, r"^([\w.]+):", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[\w.]+:", ""), r"![\w.]*", "")
    sides = F.transform(F.split(body, "-"), lambda s: F.split(s, r"\."))
    known = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    a, b = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    named = F.get(b, F.lit(0)).rlike("[A-Za-z]")
    # an end without a book has the start's, and one number is a verse where the start has one
    full = F.when(named, b).when((F.size(b) == 1) & (F.size(a) == 3), F.concat(F.slice(a, 1, 2), b)).otherwise(F.concat(F.slice(a, 1, 1), b))
    number = lambda p, k: F.get(p, F.lit(k)).try_cast("int")
    digits = lambda p: F.forall(F.slice(p, 2, 9), lambda n: n.rlike("^[0-9]{1,9}$")) & F.size(p).between(2, 3)
    met = df.withColumns({"_a": a, "_b": F.when(b.isNotNull(), full), "_work": work, "_body": body, "_sides": F.size(sides)})
    met = met.withColumns({"_book": known[F.lower(F.get("_a", F.lit(0)))], "_to": known[F.lower(F.get("_b", F.lit(0)))], "_c": number(F.col("_a"), 1), "_v": number(F.col("_a"), 2), "_ec": number(F.col("_b"), 1), "_ev": number(F.col("_b"), 2)})
    table = verses.select(F.col("book").alias("_kb"), F.col("chapter").alias("_kc"), F.col("n_verses").alias("_kn"))
    met = met.join(table, (F.col("_book") == F.col("_kb")) & (F.col("_c") == F.col("_kc")), "left").withColumnRenamed("_kn", "_first").drop("_kb", "_kc")
    met = met.join(table, (F.col("_book") == F.col("_kb")) & (F.col("_ec") == F.col("_kc")), "left").withColumnRenamed("_kn", "_last").drop("_kb", "_kc")
    ranged, chapters = F.col("_b").isNotNull(), F.col("_v").isNull()
    end = F.coalesce("_ev", "_last")
    exists = lambda v, n: n.isNotNull() & (v.isNull() | v.between(1, n))
    backwards = F.when(chapters, F.col("_ec") < F.col("_c")).otherwise((F.col("_ec") < F.col("_c")) | ((F.col("_ec") == F.col("_c")) & (end < F.col("_v"))))
    error = (
        F.when((F.col("_work") != "") & ~F.col("_work").rlike(r"(?i)^bible\b"), "other work")
        .when((F.col("_sides") > 2) | ~digits(F.col("_a")) | (ranged & ~digits(F.col("_b"))) | F.col("_body").rlike(r"\s"), "unreadable")
        .when(F.col("_book").isNull() | (ranged & F.col("_to").isNull()), "unknown book")
        .when(ranged & (F.col("_to") != F.col("_book")), "several books")
        .when(~exists(F.col("_v"), F.col("_first")) | (ranged & ~exists(F.col("_ev"), F.col("_last"))), "no such verse")
        .when(ranged & chapters & F.col("_ev").isNotNull(), "from a chapter to a verse")
        .when(ranged & backwards, "backwards")
    )
    found = refs.collapsed(refs.ref(F.col("_book"), F.col("_c"), F.col("_v"), F.when(ranged & ~chapters, F.col("_ec")), F.when(ranged & ~chapters, end)))
    error = F.when(F.col(column).isNull(), "unreadable").otherwise(error)
    note = F.when(error.isNull() & ranged & chapters & (F.col("_ec") != F.col("_c")), "first of several chapters")
    return met.select(*df.columns, F.when(error.isNull(), found).alias("ref"), note.alias("note"), error.alias("error"))


def best_source(verses: DataFrame) -> DataFrame:
    """(book, chapter, verse, to_chapter, to_verse) of each verse of another numbering, from rows of book, to_chapter, to_verse and
    source (array<struct<chapter,verse>>, null where the numbers agree).

    Of several verses a real one (not 0) is better than a title, one that names its source better than one that agrees,
    then the lower.
    """
    own = F.array(F.struct(F.col("to_chapter").alias("chapter"), F.col("to_verse").alias("verse")))
    listed = verses.select("book", "to_chapter", "to_verse", F.col("source").isNull().alias("_agrees"), F.explode(F.coalesce("source", own)).alias("_s"))
    order = F.struct((F.col("to_verse") == 0).alias("title"), "_agrees", "to_chapter", "to_verse")
    best = listed.groupBy("book", F.col("_s.chapter").alias("chapter"), F.col("_s.verse").alias("verse")).agg(F.min(order).alias("_best"))
    return best.select("book", "chapter", "verse", "_best.to_chapter", "_best.to_verse")


def whole_chapters(mapped: DataFrame) -> DataFrame:
    """(book, chapter, to_chapter) of chapters whose verses all go to one chapter that has no others, from best_source's or like rows."""
    distinct = mapped.select("book", "chapter", "to_chapter").distinct()
    there = distinct.groupBy("book", "chapter").agg(F.count("*").alias("_n"), F.min("to_chapter").alias("to_chapter")).where("_n = 1").drop("_n")
    back = distinct.groupBy(F.col("book").alias("_b"), F.col("to_chapter").alias("_t")).agg(F.count("*").alias("_m")).where("_m = 1").drop("_m")
    return there.join(back, (F.col("book") == F.col("_b")) & (F.col("to_chapter") == F.col("_t")), "left_semi")
