"""Queries on references: typed, compact and dotted ones, their verses, numberings and kin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import readings, refs
from lectern.operators import lexicon, references
from lectern.plans.catalog import query
from lectern.tables import table

# A small canon for the queries: code, chapters, names.  Chapter c of book i has 9 + i * c verses.
CANON = [("ALF", 3, ["Alfa", "Alf"]), ("BRV", 1, ["The Book of Bravo"]), ("1CH", 4, ["1 Charlie", "First Charles"]), ("2CH", 4, ["2 Charlie", "II Charles"]), ("DLT", 5, ["Delta"])]
NAMES = ["Alfa", "Bravo", "I Charlie", "2nd Charles", "Delt"]
CODES = {"alf": "ALF", "brv": "BRV", "1ch": "1CH", "2ch": "2CH", "dlt": "DLT"}

_BOOKS = "b(i, code, name, n) AS (VALUES " + ", ".join(f"({i}, '{c}', '{name}', {n})" for i, ((c, n, _), name) in enumerate(zip(CANON, NAMES), 1)) + ")"
_DRAWN = f"{_BOOKS}, k AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderkey // 6 % 7 AS c, o_orderkey // 7 % 13 AS v, o_orderkey // 11 % 17 AS w, b.* FROM orders JOIN b ON i = o_orderkey // 3 % 5 + 1)"


def _verses(spark):
    rows = [(code, i, c, 9 + i * c) for i, (code, n, _) in enumerate(CANON, 1) for c in range(1, n + 1)]
    return spark.createDataFrame(rows, "book string, book_index int, chapter int, n_verses int")


def _drawn(spark, d):
    """A book, chapter and verses for each order."""
    k = F.col("o_orderkey")
    book = F.floor(k / 3) % 5
    pick = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), (book + 1).cast("int"))
    return table(spark, d, "orders").select(
        "o_orderkey", (k % 6).alias("kind"), (F.floor(k / 6) % 7).alias("c"), (F.floor(k / 7) % 13).alias("v"), (F.floor(k / 11) % 17).alias("w"),
        (book + 1).alias("i"), pick([x[0] for x in CANON]).alias("code"), pick(NAMES).alias("name"), pick([x[1] for x in CANON]).alias("n"),
    )


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


@query(f"""WITH {_DRAWN}
           SELECT o_orderkey, CASE
             WHEN kind = 4 THEN code || '.1'
             WHEN c < 1 THEN NULL
             WHEN kind = 0 THEN CASE WHEN c <= n THEN code || '.' || c WHEN n = 1 AND c <= 9 + i THEN code || '.1.' || c END
             WHEN kind = 5 THEN CASE WHEN n = 1 THEN CASE WHEN c + 2 <= 9 + i THEN code || '.1.' || c || '-' || (c + 2) END WHEN c + 2 <= n THEN code || '.' || c END
             WHEN c > n OR v < 1 OR v > 9 + i * c THEN NULL
             WHEN kind = 1 THEN code || '.' || c || '.' || v
             WHEN kind = 2 THEN CASE WHEN w = v THEN code || '.' || c || '.' || v WHEN w > v AND w <= 9 + i * c THEN code || '.' || c || '.' || v || '-' || w END
             WHEN kind = 3 AND c + 1 <= n AND w BETWEEN 1 AND 9 + i * (c + 1) THEN code || '.' || c || '.' || v || '-' || (c + 1) || '.' || w END AS ref FROM k""")
def refs_parsed(spark, d):
    """References typed in six ways."""
    name, c, v, w = (F.col(x) for x in ("name", "c", "v", "w"))
    typed = (
        F.when(F.col("kind") == 0, _text(name, " ", c))
        .when(F.col("kind") == 1, _text(name, " ", c, ":", v))
        .when(F.col("kind") == 2, _text(" ", name, ". ", c, " : ", v, "-", w, "; 3"))
        .when(F.col("kind") == 3, _text(name, " ", c, ".", v, " – ", c + 1, ":", w))
        .when(F.col("kind") == 4, F.upper(name))
        .otherwise(_text(name, " ", c, "-", c + 2, ", 5"))
    )
    found = references.parse(_drawn(spark, d).withColumn("typed", typed), "typed", references.books(spark, CANON), _verses(spark))
    return found.select("o_orderkey", refs.compact(F.col("ref")).alias("ref"))


@query(f"""WITH {_DRAWN} SELECT o_orderkey, CASE kind WHEN 0 THEN code || '.' || c WHEN 1 THEN code || '.' || c || '.' || v WHEN 2 THEN code || '.' || c || '.' || v || '-' || w
           WHEN 3 THEN code || '.' || c || '.' || v || '-' || w || '.' || v END AS ref FROM k""")
def refs_round_trip(spark, d):
    """Compact references read and written again; two kinds are malformed."""
    code, c, v, w = (F.col(x) for x in ("code", "c", "v", "w"))
    text = (
        F.when(F.col("kind") == 0, _text(code, ".", c))
        .when(F.col("kind") == 1, _text(code, ".", c, ".", v))
        .when(F.col("kind") == 2, _text(code, ".", c, ".", v, "-", w))
        .when(F.col("kind") == 3, _text(code, ".", c, ".", v, "-", w, ".", v))
        .when(F.col("kind") == 4, _text(code, ".", c, "-", w))
        .otherwise(_text(F.lower(code), ".", c, ".", v, "."))
    )
    return _drawn(spark, d).select("o_orderkey", refs.compact(refs.from_compact(text)).alias("ref"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey % 66 + 1) * 1000000 + l_suppkey % 150 * 1000 + l_partkey % 176 AS id, l_orderkey % 66 + 1 AS book_index, l_suppkey % 150 AS chapter, l_partkey % 176 AS verse FROM lineitem")
def verse_numbers(spark, d):
    """Numbers of verses, and what they are read as."""
    number = refs.verse_id(F.col("l_orderkey") % 66 + 1, F.col("l_suppkey") % 150, F.col("l_partkey") % 176)
    found = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", number.alias("id")).withColumn("at", refs.from_verse_id(F.col("id")))
    return found.select("l_orderkey", "l_linenumber", "id", *[F.col(f"at.{x}").cast("long").alias(x) for x in ("book_index", "chapter", "verse")])


@query(f"""WITH {_DRAWN} SELECT o_orderkey FROM k WHERE c BETWEEN 1 AND n AND v BETWEEN 1 AND 9 + i * c AND CASE WHEN kind < 3 THEN w >= v AND w BETWEEN 1 AND 9 + i * c ELSE c + 1 <= n AND w BETWEEN 1 AND 9 + i * (c + 1) END""")
def refs_valid(spark, d):
    """Orders whose range of verses exists."""
    end = F.when(F.col("kind") >= 3, F.col("c") + 1)
    given = _drawn(spark, d).withColumn("ref", refs.ref(F.col("code"), F.col("c"), F.col("v"), end, F.col("w")))
    return references.valid(given, "ref", _verses(spark)).select("o_orderkey")


@query(f"""WITH {_DRAWN}, r AS (SELECT o_orderkey, i, n, c, CASE WHEN o_orderkey % 7 > 0 THEN v END AS v, CASE o_orderkey % 5 WHEN 0 THEN c + 1 WHEN 1 THEN c WHEN 2 THEN c - 1 END AS ec, CASE WHEN o_orderkey % 3 > 0 THEN w END AS ev FROM k),
                e AS (SELECT *, coalesce(ec, c) AS l, c BETWEEN 1 AND n AS here, coalesce(ec, c) BETWEEN 1 AND n AS there FROM r),
                f AS (SELECT *, here AND v BETWEEN 1 AND 9 + i * c AS begins, there AND l >= c AS ends, ev BETWEEN 1 AND 9 + i * l AS inside FROM e)
           SELECT o_orderkey, coalesce(here AND (v IS NULL OR begins) AND ends AND (ev IS NULL OR (v IS NOT NULL AND inside AND (l <> c OR ev >= v))), false) AS forward,
                  coalesce(here AND (v IS NULL OR (begins AND there AND (ev IS NULL OR ev <= 9 + i * l))), false) AS loose,
                  coalesce(here AND CASE WHEN v IS NULL THEN ev IS NULL ELSE begins AND ends AND (ev IS NULL OR (inside AND (l <> c OR ev > v))) AND (ec IS NULL OR ec > c) END, false) AS strict FROM f""")
def refs_valid_by_rule(spark, d):
    """Which references exist by each of three rules for their end."""
    k, c = F.col("o_orderkey"), F.col("c")
    end = F.when(k % 5 == 0, c + 1).when(k % 5 == 1, c).when(k % 5 == 2, c - 1)
    ref = refs.ref(F.col("code"), c, F.when(k % 7 > 0, F.col("v")), end, F.when(k % 3 > 0, F.col("w")))
    return references.validity(_drawn(spark, d).withColumn("ref", ref), "ref", _verses(spark)).select("o_orderkey", "forward", "loose", "strict")


@query(f"""WITH {_DRAWN}, r AS (SELECT *, unnest(range(c, c + CASE WHEN kind < 3 THEN 1 ELSE 2 END)) AS chapter FROM k), s AS (SELECT *, CASE WHEN chapter = c AND kind > 0 THEN v ELSE 1 END AS lo,
                  CASE WHEN kind = 0 THEN 9 + i * chapter WHEN kind < 3 OR chapter = c + 1 THEN least(w, 9 + i * chapter) ELSE 9 + i * chapter END AS hi FROM r WHERE chapter BETWEEN 1 AND n)
           SELECT o_orderkey, chapter, unnest(range(lo, hi + 1)) AS verse FROM s WHERE lo <= hi""")
def verses_of_refs(spark, d):
    """The verses of whole chapters, ranges within one and across two."""
    whole, across = F.col("kind") == 0, F.col("kind") >= 3
    ref = refs.ref(F.col("code"), F.col("c"), F.when(~whole, F.col("v")), F.when(across, F.col("c") + 1), F.when(~whole, F.col("w")))
    found = references.verses_of(_drawn(spark, d).withColumn("ref", ref), "ref", _verses(spark))
    return found.select("o_orderkey", F.col("chapter").cast("long").alias("chapter"), F.col("verse").cast("long").alias("verse"))


@query("""WITH c AS (SELECT l_orderkey AS book_index, l_linenumber AS chapter, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2)
          SELECT book_index, chapter, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS start_ord, CAST(coalesce(sum(n) OVER w, 0) + n - 1 AS BIGINT) AS end_ord FROM c
          WINDOW w AS (ORDER BY book_index, chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def chapter_ordinals(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book_index"), F.col("l_linenumber").alias("chapter")).agg(F.max(F.col("l_quantity").cast("long")).alias("n_verses"))
    return references.chapter_table(counts.withColumn("book", F.col("book_index"))).select("book_index", "chapter", "start_ord", "end_ord")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey + 1000000 WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey
                 WHEN o_custkey % 2 = 0 THEN o_custkey // 10 END AS target FROM orders""")
def keys_remapped(spark, d):
    """A rule for each third customer, else the customer itself, else the only fallback."""
    customers = table(spark, d, "customer")
    rules = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("from_key"), (F.col("c_custkey") + 1_000_000).alias("to_key"))
    tens = F.floor(F.col("c_custkey") / 10)
    fallback = customers.select(F.col("c_custkey").alias("from_key"), F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(tens, tens)).otherwise(F.array(tens, tens + 1))).alias("to_key"))
    known = customers.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return references.remapped(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", rules, known, fallback).select("o_orderkey", "target")


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 4 THEN c_custkey // 4 END AS f, CASE WHEN c_custkey >= 8 THEN c_custkey // 4 - 1 END AS m FROM customer),
               e AS (SELECT id AS a, unnest([f, m]) AS b FROM p), pa AS (SELECT * FROM e WHERE b IS NOT NULL),
               r AS (SELECT a, b, 0 AS k FROM pa UNION ALL SELECT b, a, 1 FROM pa UNION ALL SELECT id, id + 1 - id % 2 * 2, 2 FROM p WHERE id % 8 < 4
                     UNION ALL SELECT x.a, y.a, 3 FROM pa x JOIN pa y ON x.b = y.b UNION ALL SELECT x.a, y.b, 4 FROM pa x JOIN pa y ON x.b = y.a)
          SELECT a AS person, b AS relative, ['parent', 'child', 'partner', 'sibling', 'grandparent'][min(k) + 1] AS kind FROM r WHERE a <> b GROUP BY 1, 2""")
def kin(spark, d):
    """Parents, children, partners, siblings and grandparents among customers."""
    k = F.col("c_custkey")
    parent = lambda least, shift: F.when(k >= least, F.floor(k / 4) - shift)
    partners = F.when(k % 8 < 4, F.array(k + 1 - k % 2 * 2)).otherwise(F.array().cast("array<bigint>"))
    return references.kin(table(spark, d, "customer").select(k.alias("id"), parent(4, 0).alias("father"), parent(8, 1).alias("mother"), partners.alias("partners")))


@query("""WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 4 THEN [c_custkey // 4] ELSE [] END AS parents, range(c_custkey % 3) AS more FROM customer)
          SELECT id, array_to_string(list_concat([id], parents, more, more), ',') AS ids FROM p""")
def family_ids(spark, d):
    k = F.col("c_custkey").cast("long")
    none = F.array().cast("array<bigint>")
    parents = F.when(k >= 4, F.array(F.floor(k / 4))).otherwise(none)
    more = F.when(k % 3 > 0, F.sequence(F.lit(0).cast("long"), k % 3 - 1)).otherwise(none)
    return table(spark, d, "customer").select(k.alias("id"), F.array_join(readings.family_ids(F.array(k), parents, more, more).cast("array<string>"), ",").alias("ids"))


@query(f"""WITH {_DRAWN} SELECT o_orderkey, CASE WHEN kind < 2 THEN code || '.' || c || ' ' ELSE '' END || CASE WHEN kind < 4 THEN code || '.' || (c + 1) || '.' || v ELSE '' END AS refs FROM k""")
def refs_listed(spark, d):
    """The references of lists with semicolons, some malformed."""
    code, c, v, kind = (F.col(x) for x in ("code", "c", "v", "kind"))
    text = _text(F.when(kind < 2, _text(code, ".", c)).when(kind < 4, _text(code, " ", c)).otherwise(""), "; ", F.when(kind < 4, _text(" ", code, ".", c + 1, ".", v)).otherwise("none"), ";")
    return _drawn(spark, d).select("o_orderkey", F.array_join(F.transform(readings.refs_listed(text), refs.compact), " ").alias("refs"))


@query(f"""WITH {_DRAWN} SELECT o_orderkey, array_to_string([code || '.' || c || '.' || v, code || '.' || c || '.' || w, CASE WHEN kind = 3 THEN '-' ELSE code || '.' || (c + 1) || '.' || v || '-' || w END,
                  CASE WHEN kind = 3 THEN code || '.' || c || '.' || 7 ELSE code || '.' || (c + 1) || '.' || 7 END, 'DLT.' || c, 'DLT.' || c || '.' || v, 'BRV.1.' || v, 'ALF.2.3'], ' ') AS refs FROM k""")
def refs_inherited(spark, d):
    """Lists whose parts take book and chapter from the part before."""
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)]), F.col("code"))
    c, v, w = (F.col(x) for x in ("c", "v", "w"))
    third = F.when(F.col("kind") == 3, F.lit("see above")).otherwise(_text(c + 1, ":", v, "-", w))
    text = _text(" ", F.initcap(name), ".", c, ".", v, ", ", w, "; ", third, ", 7; Dlt ", c, ", ", v, ";Brv.", v, "; alf 2:3. ")
    return _drawn(spark, d).select("o_orderkey", F.array_join(readings.refs_inherited(text, CODES, ["BRV"]), " ", "-").alias("refs"))


@query(f"""WITH {_DRAWN}, e AS (SELECT *, CASE WHEN kind = 5 AND o_orderkey % 4 = 0 THEN 'other work' WHEN c NOT BETWEEN 1 AND n OR kind > 1 AND v NOT BETWEEN 1 AND 9 + i * c OR kind IN (1, 3, 4) AND c + 1 > n OR kind = 2 AND w NOT BETWEEN 1 AND 9 + i * c
                    OR kind = 3 AND w NOT BETWEEN 1 AND 9 + i * (c + 1) THEN 'no such verse' WHEN kind = 2 AND w < v THEN 'backwards' END AS error FROM k)
           SELECT o_orderkey, error, CASE WHEN error IS NULL AND kind = 1 THEN 'first of several chapters' END AS note, CASE WHEN error IS NULL THEN CASE kind WHEN 0 THEN code || '.' || c WHEN 1 THEN code || '.' || c
                  WHEN 2 THEN code || '.' || c || '.' || v || CASE WHEN w = v THEN '' ELSE '-' || w END WHEN 3 THEN code || '.' || c || '.' || v || '-' || (c + 1) || '.' || w
                  WHEN 4 THEN code || '.' || c || '.' || v || '-' || (c + 1) || '.' || (9 + i * (c + 1)) ELSE code || '.' || c || '.' || v END END AS ref FROM e""")
def refs_dotted(spark, d):
    """Dotted references with works, grains and ranges."""
    name = F.initcap(F.element_at(F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (v, k)]), F.col("code")))
    c, v, w, kind = (F.col(x) for x in ("c", "v", "w", "kind"))
    text = (
        F.when(kind == 0, _text("Bible:", name, ".", c))
        .when(kind == 1, _text(name, ".", c, "-", name, ".", c + 1))
        .when(kind == 2, _text(" ", name, ".", c, ".", v, "!a-", name, ".", c, ".", w, "!b.2"))
        .when(kind == 3, _text("Bible.X:", name, ".", c, ".", v, "-", c + 1, ".", w))
        .when(kind == 4, _text(name, ".", c, ".", v, "-", name, ".", c + 1))
        .otherwise(_text(F.when(F.col("o_orderkey") % 4 == 0, "Other:").otherwise("bible:"), name, ".", c, ".", v))
    )
    found = references.from_dotted(_drawn(spark, d).withColumn("text", text), "text", CODES, _verses(spark))
    return found.select("o_orderkey", "error", "note", refs.compact(F.col("ref")).alias("ref"))


@query("""WITH v AS (SELECT o_custkey AS book, o_orderkey % 9 + 1 AS tc, o_orderkey % 5 AS tv, o_orderkey % 3 AS kind FROM orders),
               s AS (SELECT *, kind = 0 AS agrees, unnest(CASE kind WHEN 0 THEN [tv] WHEN 1 THEN [tv + 1] ELSE [tv, tv + 2] END) AS sv FROM v)
          SELECT book, tc AS chapter, sv AS verse, arg_min(tc, (tv = 0, agrees, tc, tv)) AS to_chapter, arg_min(tv, (tv = 0, agrees, tc, tv)) AS to_verse FROM s GROUP BY 1, 2, 3""")
def best_source(spark, d):
    """The best verse for each verse of another numbering."""
    k = F.col("o_orderkey")
    point = lambda verse: F.struct((k % 9 + 1).alias("chapter"), verse.alias("verse"))
    source = F.when(k % 3 == 1, F.array(point(k % 5 + 1))).when(k % 3 == 2, F.array(point(k % 5), point(k % 5 + 2)))
    return references.best_source(table(spark, d, "orders").select(F.col("o_custkey").alias("book"), (k % 9 + 1).alias("to_chapter"), (k % 5).alias("to_verse"), source.alias("source")))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS book, o_orderkey % 50 AS c, o_orderkey % 45 AS t FROM orders), a AS (SELECT book, c, min(t) AS t FROM m GROUP BY 1, 2 HAVING count(*) = 1),
               b AS (SELECT book, t FROM m GROUP BY 1, 2 HAVING count(*) = 1) SELECT book, c AS chapter, t AS to_chapter FROM a JOIN b USING (book, t)""")
def whole_chapters(spark, d):
    k = F.col("o_orderkey")
    return references.whole_chapters(table(spark, d, "orders").select(F.col("o_custkey").alias("book"), (k % 50).alias("chapter"), (k % 45).alias("to_chapter")))


@query("""SELECT o_orderkey, CASE WHEN f BETWEEN 1 AND n AND NOT (f = 1 AND e = n) THEN f END AS first, CASE WHEN f BETWEEN 1 AND n AND NOT (f = 1 AND e = n) THEN e END AS last, n >= 6 OR f = 1 AS long
          FROM (SELECT *, least(greatest(CASE WHEN o_orderkey % 4 > 0 THEN l ELSE n END, f), n) AS e FROM (SELECT o_orderkey, o_orderkey % 11 AS f, o_orderkey % 7 AS l, o_orderkey % 9 + 1 AS n FROM orders))""")
def ranges_clamped(spark, d):
    k = F.col("o_orderkey")
    wanted = readings.clamped(k % 11, F.when(k % 4 > 0, k % 7), k % 9 + 1)
    return table(spark, d, "orders").select("o_orderkey", wanted.alias("r"), readings.long_passage(k % 11 == 1, k % 9 + 1).alias("long")).select("o_orderkey", "r.first", "r.last", "long")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 + 1 AS n, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem),
               u AS (SELECT l_orderkey, l_linenumber, max(n) AS n FROM v GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
          SELECT l_orderkey, CAST(before + p AS BIGINT) AS i, l_linenumber, 'w' || p AS word, p = 0 AS verse_start FROM (SELECT *, unnest(range(n)) AS p FROM b)""")
def passage_words(spark, d):
    """Words of an order's lines numbered across lines."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_suppkey") % 3 + 1).alias("n"))
    words = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.concat(F.lit("w"), i.cast("string")))
    return lexicon.passage_words(lines.withColumn("words", words), "l_orderkey", "l_linenumber", "words")


@query("""SELECT l_orderkey AS v, l_suppkey % 4 AS w, p_name AS word, max(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END) AS presence,
                 coalesce(string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_returnflag || l_linenumber) FILTER (l_linenumber % 3 > 0), '') AS alts FROM lineitem LEFT JOIN part ON p_partkey = (l_orderkey * 4 + l_suppkey % 4) GROUP BY 1, 2, 3""")
def variant_units(spark, d):
    """Units of an order's words, with the printed word where there is one."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "presence").otherwise("alt")
    text = F.when(kind == "presence", F.col("l_returnflag")).otherwise(F.concat("l_returnflag", F.col("l_linenumber").cast("string")))
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("v"), (F.col("l_suppkey") % 4).alias("w"), kind.alias("kind"), text.alias("text"))
    words = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 4).alias("v"), (F.col("p_partkey") % 4).alias("w"), F.col("p_name").alias("word"))
    return lexicon.units_by_word(units, words, "v").withColumn("alts", F.array_join("alts", " "))


@query("""WITH o AS (SELECT o_orderkey AS n, o_orderkey // 40 % 3 AS part, o_orderkey // 6 % 7 + 1 AS c, o_orderkey % 9 + 1 AS v, o_orderkey % 3 AS kind FROM orders),
               f AS (SELECT *, CASE WHEN part = lag(part) OVER (ORDER BY n) THEN 0 ELSE 1 END AS new FROM o), r AS (SELECT *, sum(new) OVER (ORDER BY n) AS run FROM f)
          SELECT CAST(run AS BIGINT) AS run, 'Part ' || any_value(part) AS title, count(*) AS sections, string_agg(n || ' ' || 'ALF.' || c || '.' || v || CASE kind WHEN 0 THEN '' WHEN 1 THEN '-' || (v + 2) ELSE '-' || (c + 1) || '.2' END, '; ' ORDER BY n) AS refs FROM r GROUP BY run""")
def harmony_nested(spark, d):
    """Sections in their order, nested in the parts that they follow each other in, with their references."""
    n = F.col("o_orderkey")
    c, v, kind = F.floor(n / 6) % 7 + 1, n % 9 + 1, n % 3
    ref = refs.collapsed(refs.ref(F.lit("ALF"), c, v, F.when(kind == 2, c + 1).otherwise(c), F.when(kind == 0, v).when(kind == 1, v + 2).otherwise(2)))
    sections = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Part "), (F.floor(n / 40) % 3).cast("string")).alias("title"), F.concat(n.cast("string"), F.lit(" "), refs.compact(ref)).alias("section"))
    found = lexicon.consecutive(sections, [], ["o_orderkey"], "title", "section", F.floor(n / 4096))
    return found.select("run", "title", F.size("items").cast("long").alias("sections"), F.array_join("items", "; ").alias("refs"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 END AS first, CASE WHEN o_orderkey % 4 > 0 THEN greatest(o_orderkey % 9, o_custkey % 12, 3) END AS last FROM orders""")
def marker_ranges(spark, d):
    """The first and the highest marker of texts."""
    mark = lambda k: F.concat(F.lit('<verse osisID="ALF.1.'), k.cast("string"), F.lit('"/> text '))
    text = F.when(F.col("o_orderkey") % 4 > 0, F.concat(mark(F.col("o_orderkey") % 9), mark(F.col("o_custkey") % 12), mark(F.lit(3)))).otherwise("no marker")
    found = table(spark, d, "orders").select("o_orderkey", readings.marker_range(text, 'osisID="[^"]*\\.([0-9]+)"').alias("m"))
    return found.select("o_orderkey", F.col("m.first").cast("long").alias("first"), F.col("m.last").cast("long").alias("last"))


@query("""WITH p AS (SELECT o_orderkey, o_orderkey % 3 AS a, o_custkey AS c FROM orders)
          SELECT o_orderkey, NULL AS head, 'before ' || c AS body FROM p WHERE a > 0 UNION ALL SELECT o_orderkey, 'Verse ' || c || '.', 'one' FROM p UNION ALL SELECT o_orderkey, 'Verse ' || (c + 1) || '.', CASE a WHEN 2 THEN '' ELSE 'two' END FROM p""")
def headers_split(spark, d):
    """Comments cut at their verse headers."""
    a, c = F.col("o_orderkey") % 3, F.col("o_custkey")
    text = F.concat(F.when(a > 0, F.concat(F.lit("before "), c.cast("string"))).otherwise(""), F.lit(" Verse "), c.cast("string"), F.lit(". one Verse "), (c + 1).cast("string"), F.when(a == 2, ".").otherwise(". two "))
    return table(spark, d, "orders").select("o_orderkey", F.explode(readings.headed(text, "Verse [0-9]+\\.")).alias("p")).select("o_orderkey", "p.head", "p.body")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = o_custkey % 3 THEN array_to_string(list_transform(range(o_orderkey % 3 + 1), lambda i: 'R' || i || '=L' || i), ' ') ELSE 'R0=' || array_to_string(list_transform(range(o_custkey % 3 + 1), lambda i: 'L' || i), ', ') END AS pairs FROM orders""")
def refs_paired(spark, d):
    """Displayed labels with the references behind them."""
    listed = lambda mark, k: F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) % 3), lambda i: F.concat(F.lit(mark), i.cast("string")))
    found = table(spark, d, "orders").select("o_orderkey", readings.paired_refs(listed("R", "o_orderkey"), listed("L", "o_custkey")).alias("p"))
    return found.select("o_orderkey", F.array_join(F.transform("p", lambda e: F.concat(e["ref"], F.lit("="), e["label"])), " ").alias("pairs"))
