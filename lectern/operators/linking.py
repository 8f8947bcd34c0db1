"""References in running text: context carried through an entry, and a decision between a tag and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import ordered

PLACE = "struct<book:string,chapter:int,verse:int>"


def reading(text: Column, books: dict[str, str]) -> Column:
    """struct<name,book,chapter,verse> of ``Name 3:5``, ``3:5``, ``5`` or a name alone; missing parts are null.

    books: codes from names in lower case; a name that is none of them has no book.  One number is a chapter behind a name,
    else a verse.
    """
    known = F.create_map(*[F.lit(x) for pair in books.items() for x in pair])
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    # each pattern is met once a text: what a lambda is given is never computed again by those who use it
    def numbered(text: Column, head: Column) -> Column:
        rest = F.substring(text, F.coalesce(F.length(head), F.lit(0)) + 1, F.length(text))
        numbers = F.transform(F.regexp_extract_all(rest, F.lit("[0-9]{1,9}"), F.lit(0)), lambda n: n.cast("int"))
        return F.struct(head.alias("head"), known[F.lower(head)].alias("book"), numbers.alias("numbers"))

    def parts(s: Column) -> Column:
        head = F.when(s["book"].isNotNull() | (F.size(s["numbers"]) > 0), s["head"])  # a word alone is a name only if it is known
        first, second = F.get(s["numbers"], F.lit(0)), F.get(s["numbers"], F.lit(1))
        chapter = F.when(head.isNotNull() | second.isNotNull(), first)
        verse = F.when(second.isNotNull(), second).when(head.isNull(), first)
        return F.struct(head.alias("name"), s["book"].alias("book"), chapter.alias("chapter"), verse.alias("verse"))

    def headed(text: Column) -> Column:
        head = F.regexp_extract(text, r"^([1-3]?\s?\p{L}+)[.]?\s*(?:[0-9]|$)", 1)
        return once(once(head, lambda h: numbered(text, F.nullif(h, F.lit("")))), parts)

    return once(F.trim(text), headed)


def carried(rows: DataFrame, entry: str, place: str, read: str, bucket: Column | None = None, out: str = "context") -> DataFrame:
    """rows with struct<book,chapter>: what the rows before in the entry have set, by their readings in column ``read``.

    A known name sets its book and chapter (1 if it has none), an unknown one clears both, a chapter alone
    sets the chapter.  Values run through the entry in buckets, so that one entry may hold most rows.  bucket: as in ordered.running.
    """
    r = F.col(read)
    named = r["name"].isNotNull()
    book = F.when(named, F.struct(r["book"].alias("v")))
    chapter = F.when(named, F.struct(F.when(r["book"].isNotNull(), F.coalesce(r["chapter"], F.lit(1))).alias("v"))).when(r["chapter"].isNotNull(), F.struct(r["chapter"].alias("v")))
    met = ordered.running(rows, [entry], [place], bucket, before=True, _book=("last", book), _chapter=("last", chapter))
    return met.withColumn(out, F.struct(F.col("_book.v").alias("book"), F.when(F.col("_book.v").isNotNull(), F.col("_chapter.v")).alias("chapter"))).drop("_book", "_chapter")


def _known(rows: DataFrame, place: str, chapters: DataFrame, out: str) -> DataFrame:
    """rows with out: whether the struct place names a verse that its chapter has (chapters: book, chapter, verses), or a whole chapter."""
    size = chapters.select(F.col("book").alias("_cb"), F.col("chapter").alias("_cc"), F.col("verses").alias("_cv"))
    at = F.col(place)
    met = rows.join(size, (at["book"] == F.col("_cb")) & (at["chapter"] == F.col("_cc")), "left")
    return met.withColumn(out, F.coalesce(F.col("_cv").isNotNull() & (at["verse"].isNull() | at["verse"].between(1, F.col("_cv"))), F.lit(False))).drop("_cb", "_cc", "_cv")


def arbitrated(rows: DataFrame, tag: str, read: str, context: str, chapters: DataFrame, trust: bool = False) -> DataFrame:
    """rows with ref (a place) and status: what a tagged reference means, by its tag (a place, or null), its text and its context.

    ok: tag and text agree; kept: they differ, and tags are trusted; fixed: they differ, or the tag is no place, and the text is taken; unchecked:
    the text gives no place of its own, and does not speak against the tag; book: a name alone; dropped: nothing fits.
    """
    r, c = F.col(read), F.col(context)
    own = F.struct(
        F.when(r["name"].isNotNull(), r["book"]).otherwise(c["book"]).alias("book"),
        F.coalesce(r["chapter"], F.when(r["name"].isNull(), c["chapter"])).alias("chapter"),
        r["verse"].alias("verse"),
    ).cast(PLACE)
    numbered = r["chapter"].isNotNull() | r["verse"].isNotNull()
    both = _known(_known(rows.withColumn("_own", F.when(numbered, own)), tag, chapters, "_tag_fine"), "_own", chapters, "_own_fine")
    t, o, fine, read_fine = F.col(tag), F.col("_own"), F.col("_tag_fine"), F.col("_own_fine")
    agree = (t["book"] == o["book"]) & (t["chapter"] == o["chapter"]) & t["verse"].eqNullSafe(o["verse"])
    near = F.when(r["name"].isNotNull(), r["book"]).otherwise(F.coalesce(c["book"], t["book"]))
    status = (
        F.when(~numbered, F.when(r["book"].isNotNull(), "book").otherwise("dropped"))
        .when(fine & read_fine, F.when(agree, "ok").when(F.lit(trust), "kept").otherwise("fixed"))
        .when(read_fine, "fixed")
        .when(fine & (near == t["book"]), "unchecked")
        .otherwise("dropped")
    )
    taken = F.when(F.col("status").isin("ok", "kept", "unchecked"), t.cast(PLACE)).when(F.col("status") == "fixed", o)
    return both.withColumn("status", status).withColumn("ref", taken).drop("_own", "_tag_fine", "_own_fine")


def linked(rows: DataFrame, entry: str, place: str, text: str, tag: str, books: dict[str, str], chapters: DataFrame, bucket: Column | None = None, trust: bool = False) -> DataFrame:
    """rows with status and ref: references of entries in order, each by its tag, its text and the context before it."""
    read = rows.withColumn("_read", reading(F.col(text), books))
    return arbitrated(carried(read, entry, place, "_read", bucket, "_context"), tag, "_read", "_context", chapters, trust).drop("_read", "_context")
