"""Aliases, agreed targets, covered verses, coded descriptions, locations and aligned segments."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: So many rows of a batch are Python objects at a time.
ROWS = 50


def alias_targets(records: DataFrame, key: str, link: str, most: int = 5) -> DataFrame:
    """(key, target, steps, status): where each record's chain of links ends.

    link is null for a record that is no alias.  At most ``most`` links are followed, one equi-join of
    the aliases each; status is ok, broken (the end is no record) or loop (there are more links).
    """
    aliases = records.where(F.col(link).isNotNull()).select(F.col(key).alias("_at"), F.col(link).alias("_to"))
    now = records.select(F.col(key), F.coalesce(link, key).alias("target"), F.col(link).isNotNull().cast("int").alias("steps"))
    for _ in range(most - 1):
        met = now.join(aliases, (F.col("target") == F.col("_at")) & (F.col("steps") > 0), "left")
        now = met.select(key, F.coalesce("_to", "target").alias("target"), (F.col("steps") + F.col("_to").isNotNull().cast("int")).alias("steps"))
    ends = records.select(F.col(key).alias("_at"), F.col(link).isNotNull().alias("_more"))
    status = F.when(F.col("_more").isNull(), "broken").when(F.col("_more") & (F.col("steps") > 0), "loop").otherwise("ok")
    return now.join(ends, F.col("target") == F.col("_at"), "left").select(key, "target", "steps", status.alias("status"))


def agreed_targets(rows: DataFrame, key: str, target: str, known: DataFrame) -> DataFrame:
    """(key, target) for the keys missing from known whose rows all name one target."""
    loose = rows.where(F.col(target).isNotNull()).join(known.select(key).distinct(), key, "left_anti")
    return loose.groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("_last")).where(F.col(target) == F.col("_last")).drop("_last")


def covered_verses(refs: DataFrame, chapters: DataFrame) -> DataFrame:
    """refs with ``covered``, how many verses each spans.

    refs: book, chapter, verse, end_chapter, end_verse (the last three may be null: a whole chapter, one
    chapter, one verse or up to the end of end_chapter).  chapters: book, chapter, verses.  Running
    totals inside a book make it two equi-joins, whatever the length of a span.
    """
    before = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    sums = chapters.select("book", "chapter", "verses", F.coalesce(F.sum("verses").over(before), F.lit(0)).alias("before"))
    whole = refs.withColumn("_last", F.coalesce("end_chapter", "chapter"))
    met = whole.join(sums.drop("verses").withColumnRenamed("before", "_low"), ["book", "chapter"])
    met = met.join(sums.select("book", F.col("chapter").alias("_last"), F.col("before").alias("_high"), F.col("verses").alias("_size")), ["book", "_last"])
    final = F.when(F.col("verse").isNull(), F.col("_size")).when(F.col("end_verse").isNotNull(), F.col("end_verse")).when(F.col("end_chapter").isNotNull(), F.col("_size")).otherwise(F.col("verse"))
    return met.select(*refs.columns, (F.col("_high") + final - F.col("_low") - F.coalesce("verse", F.lit(1)) + 1).cast("long").alias("covered"))


def briefs_described(codes: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """(code, text) of each distinct code; text is null if some part of it is unknown.

    table: code, text.  A code stands for itself, or for alternatives (``A / B``), each of which stands
    for itself or for a combination (``X + Y``).  ``A:`` codes without a row of their own take the text of the
    ``H:`` code, with Aramaic for Hebrew.
    """
    even = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), "\\s+", " "), "\\s*/\\s*", " / ")
    plain = table.select(even(F.col("code")).alias("_code"), "text").dropDuplicates(["_code"])
    lent = plain.where("_code like 'H:%' and not contains(_code, '/') and not contains(_code, '+')").select(F.concat(F.lit("A:"), F.expr("substring(_code, 3)")).alias("_code"), F.regexp_replace("text", "\\bHebrew\\b", "Aramaic").alias("text"))
    known = plain.unionByName(lent.join(plain.select("_code"), "_code", "left_anti"))

    def told(df: DataFrame, name: str) -> DataFrame:
        return df.join(known.select(F.col("_code").alias("_k"), F.col("text").alias(f"{name}_text")), even(F.col(name)) == F.col("_k"), "left").drop("_k")

    asked = told(codes.select(F.trim(code).alias("_whole"), F.col(code)).where(F.col(code).isNotNull()).distinct(), "_whole")
    either = asked.select(code, "_whole_text", F.posexplode(F.split("_whole", "\\s+/\\s*|/\\s+")).alias("_i", "_alt"))
    both = told(either, "_alt").select(code, "_whole_text", "_i", "_alt_text", F.posexplode(F.split("_alt", "\\s*\\+\\s*")).alias("_j", "_part"))
    parts = told(both, "_part").groupBy(code, "_whole_text", "_i", "_alt_text").agg(F.array_sort(F.collect_list(F.struct("_j", "_part_text"))).alias("_parts"))

    def joined(listed: Column, field: str, between: str) -> Column:
        return F.when(F.forall(listed, lambda x: x[field].isNotNull()), F.array_join(F.transform(listed, lambda x: x[field]), between))

    alts = parts.select(code, "_whole_text", F.struct("_i", F.coalesce("_alt_text", joined(F.col("_parts"), "_part_text", " + ")).alias("t")).alias("_a"))
    return alts.groupBy(code, "_whole_text").agg(F.array_sort(F.collect_list("_a")).alias("_alts")).select(code, F.coalesce("_whole_text", joined(F.col("_alts"), "t", " OR ")).alias("text"))


def located(places: DataFrame, modern: DataFrame) -> DataFrame:
    """(id, lon, lat, score, custom, reason) of each place.

    places: id, identifications array<struct<score,special,resolutions array<struct<lonlat,basis,special>>>>,
    best first.  Only the first identification counts, by its first resolution with coordinates; modern
    (basis, custom_lonlat) may replace them.  The score is held to 0 to 1000.  Without coordinates, reason says why.
    """
    top = F.get("identifications", F.lit(0))
    resolutions = F.coalesce(top["resolutions"], F.array().cast("array<struct<lonlat:string,basis:string,special:string>>"))
    first = F.get(F.filter(resolutions, lambda r: r["lonlat"].isNotNull()), F.lit(0))
    special = F.coalesce(top["special"], F.get(F.filter(resolutions, lambda r: r["special"].isNotNull()), F.lit(0))["special"], F.lit("no coordinates"))
    asked = places.select("id", first["lonlat"].alias("_own"), first["basis"].alias("basis"), top["score"].alias("_score"), F.when(top.isNull(), "no identification").when(first.isNull(), special).alias("_reason"))
    met = asked.join(modern.select("basis", "custom_lonlat").dropDuplicates(["basis"]), "basis", "left")
    at = F.split(F.coalesce("custom_lonlat", "_own"), ",")
    lon, lat = F.get(at, F.lit(0)).try_cast("double"), F.get(at, F.lit(1)).try_cast("double")
    bad = lon.isNull() | lat.isNull()
    fine = F.col("_reason").isNull() & ~bad
    return met.select(
        "id",
        F.when(fine, lon).alias("lon"),
        F.when(fine, lat).alias("lat"),
        F.when(fine, F.greatest(F.lit(0), F.least(F.lit(1000), F.round(F.coalesce("_score", F.lit(0.0))).cast("int")))).alias("score"),
        (fine & F.col("custom_lonlat").isNotNull()).alias("custom"),
        F.coalesce("_reason", F.when(bad, F.lit("bad coordinates"))).alias("reason"),
    )


def paired(segments: list | None, words: list | None, kin: dict | None = None) -> list[list[int]]:
    """Places of the words that each segment translates.

    segments: dicts of numbers (list) and again (a run that repeats the one before); words: lists of
    numbers.  A number takes the next free word that carries it, from the last one taken on and then from
    the start; failing that one of a kindred number (kin); failing that the word that an earlier segment
    of the same numbers took.
    """
    carrying: dict[str, list[int]] = {}
    for i, own in enumerate(words or []):
        for n in set(own):
            carrying.setdefault(n, []).append(i)
    taken: set[int] = set()
    before, alike, at, out = {}, {}, 0, []

    def free(numbers):
        places = carrying.get(numbers[0], []) if len(numbers) == 1 else sorted({i for n in numbers for i in carrying.get(n, ())})
        return places[bisect_left(places, at) % len(places)] if places else None

    for segment in segments or []:
        numbers, mine = segment["numbers"] or [], {}
        for n in numbers:
            tries = (lambda: before.get(n) if segment["again"] else None, lambda: free([n]), lambda: free((kin or {}).get(n, ())), lambda: alike.get(tuple(numbers), {}).get(n))
            place = next((p for p in (t() for t in tries) if p is not None), None)
            if place is None:
                continue
            mine[n] = place
            if place not in taken:
                taken.add(place)
                at = place + 1
                for other in set(words[place]):
                    del carrying[other][bisect_left(carrying[other], place)]
        if numbers:
            before = mine
        if mine:
            alike[tuple(numbers)] = mine
        out.append(sorted(set(mine.values())))
    return out


def segment_words(segments: Column, words: Column, kin: dict | None = None) -> Column:
    """array<array<int>>: ``paired`` for each row; kin is a small fixed table of kindred numbers."""
    kind = pa.list_(pa.list_(pa.int32()))

    @F.arrow_udf("array<array<int>>")
    def places(s: pa.Array, w: pa.Array) -> pa.Array:
        few = lambda k: zip(s.slice(k, ROWS).to_pylist(), w.slice(k, ROWS).to_pylist())
        return pa.concat_arrays([pa.array([paired(*row, kin) for row in few(k)], kind) for k in range(0, len(s), ROWS)] or [pa.array([], kind)])

    return places(segments, words)
