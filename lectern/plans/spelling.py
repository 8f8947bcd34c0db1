"""Queries on words: forms, likeness, titles, brackets, editions, tagged cells, names and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import markup, practice, readings, words
from lectern.functions import text as tx
from lectern.operators import resolving, sequences
from lectern.plans.catalog import query
from lectern.tables import table

_SOME = "(SELECT p_partkey, p_partkey % 3 AS a, p_partkey % 5 AS b, p_partkey % 7 AS c, string_split(p_name, ' ')[1] AS w, p_name FROM part)"


def _some(spark, d):
    """Parts dealt to all cores, however few splits their file has: what is done with a row here takes much longer than to move it."""
    k = F.col("p_partkey")
    return table(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey").select("p_partkey", (k % 3).alias("a"), (k % 5).alias("b"), (k % 7).alias("c"), F.split("p_name", " ")[0].alias("w"), "p_name")


def _pick(number: str, *of: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in of]), (F.col(number) + 1).cast("int"))


def _sql(number: str, *of: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + f"][{number} + 1]"


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS rendering FROM conversations""")
def renderings_normal(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.rendering(F.col("text")).alias("rendering"))


@query("""SELECT doc_id, regexp_replace(translate(lower(text), 'áàâäãāăéèêëēĕíìîïīĭóòôöõōŏúùûüūŭñçšṣḥṭ', 'aaaaaaaeeeeeeiiiiiiooooooouuuuuuncssht'), '[^a-z]', '', 'g') AS latin FROM documents""")
def latin_letters(spark, d):
    return table(spark, d, "documents").select("doc_id", words.latin_only(F.col("text")).alias("latin"))


@query(r"""SELECT doc_id, trim(strip_accents(lower(coalesce(text, '')))) AS folded FROM documents""")
def texts_folded(spark, d):
    """Texts in lower case without marks."""
    return table(spark, d, "documents").select("doc_id", tx.folded(F.coalesce("text", F.lit(""))).alias("folded"))


@query(r"""WITH t AS (SELECT o_orderkey, translate(CAST(o_orderkey * 7919 AS VARCHAR), '0123456789', 'אבהךיםףומץ') AS w FROM orders), c AS (SELECT *, translate(w, 'ךםןףץ', 'כמנפצ') AS k FROM t)
           SELECT o_orderkey, k AS consonants, left(k, 1) || regexp_replace(substr(k, 2), '[אהוי]', '', 'g') AS loose FROM c""")
def consonant_skeletons(spark, d):
    """Numbers of orders in Hebrew letters, with a point and a mark between them."""
    letters = F.translate((F.col("o_orderkey") * 7919).cast("string"), "0123456789", "אבהךיםףומץ")
    pointed = F.concat(F.lit("("), F.regexp_replace(letters, "(.)", "$1ָ"), F.lit(")־"))
    return table(spark, d, "orders").select("o_orderkey", words.consonants(pointed).alias("consonants"), words.loose_consonants(pointed).alias("loose"))


_ENDINGS, _ODD = ("", "s", "ing", "th", "eth"), ("", "x", "", "", "es", "ed", "dd")


@query(rf"""WITH t AS (SELECT p_partkey, w || {_sql("b", *_ENDINGS)} AS x, w || {_sql("c", *_ODD)} AS y FROM {_SOME}),
                 s AS (SELECT *, starts_with(x, y) AND regexp_matches(substr(x, len(y) + 1), '^(s|es|d|ed|ing|eth|est)$') OR starts_with(y, x) AND regexp_matches(substr(y, len(x) + 1), '^(s|es|d|ed|ing|eth|est)$') AS stem FROM t)
            SELECT p_partkey, x = y OR stem OR len(x) >= 5 AND len(y) >= 5 AND levenshtein(x, y) <= 1 AS alike FROM s""")
def words_alike(spark, d):
    x, y = F.concat("w", _pick("b", *_ENDINGS)), F.concat("w", _pick("c", *_ODD))
    return _some(spark, d).select("p_partkey", words.alike(x, y).alias("alike"))


@query(r"""SELECT conv_id, turn, len(list_filter(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: len(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with'))) AS n FROM conversations""")
def key_words(spark, d):
    """How many words of a turn are none of a few stop words and have three letters."""
    kept = F.filter(tx.tokens(F.col("text")), lambda w: words.key_word(w, ["the", "and", "for", "with"]))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(kept).cast("long").alias("n"))


_TITLES = ("THE {} OF", "{} AND THE xiv", "a iv-{} IN THE")
_TITLED = ("The {} of", "{} and the XIV", "A Iv-{} in the")


@query(f"""SELECT p_partkey, replace({_sql("a", *_TITLED)}, '{{}}', upper(w[1]) || substr(w, 2)) || ' ' || upper(w[1]) || substr(w, 2) AS title FROM {_SOME}""")
def titles_cased(spark, d):
    text = F.concat(F.lit("  "), F.replace(_pick("a", *_TITLES), F.lit("{}"), F.col("w")), F.lit("   "), F.upper("w"))
    return _some(spark, d).select("p_partkey", words.titled(text).alias("title"))


@query(f"""SELECT p_partkey, CASE WHEN a < 2 THEN w || ' (x; ' || b || ') y' END AS head, CASE a WHEN 0 THEN 'z [' || c || ';' || c || '] ; q' WHEN 1 THEN '' END AS tail FROM {_SOME}""")
def split_outside(spark, d):
    """What stands before and after the first semicolon outside brackets."""
    w, b, c = F.col("w"), F.col("b").cast("string"), F.col("c").cast("string")
    head = F.concat(w, F.lit(" (x; "), b, F.lit(") y"))
    text = F.when(F.col("a") == 0, F.concat(head, F.lit(" ;z ["), c, F.lit(";"), c, F.lit("] ; q"))).when(F.col("a") == 1, F.concat(head, F.lit(";"))).otherwise(head)
    return _some(spark, d).select("p_partkey", words.split_outside(text, ";").alias("s")).select("p_partkey", "s.head", "s.tail")


@query(f"SELECT p_partkey, CASE a WHEN 0 THEN w || ' (' || b || ') c' WHEN 1 THEN '((' || w || ') ' || b ELSE w END AS text FROM {_SOME}")
def balanced(spark, d):
    """Texts without closing brackets that nothing opened."""
    w, b = F.col("w"), F.col("b").cast("string")
    text = F.when(F.col("a") == 0, F.concat(F.lit(")"), w, F.lit(" ("), b, F.lit(")) c)"))).when(F.col("a") == 1, F.concat(F.lit("(("), w, F.lit(") "), b)).otherwise(F.concat(w, F.lit("))")))
    return _some(spark, d).select("p_partkey", words.balanced(text).alias("text"))


@query(f"""SELECT p_partkey, 'N' || a || CASE WHEN a = b THEN '' ELSE ' N' || b END || ' WH ' || w AS editions, a = 1 OR b = 1 AS has FROM {_SOME}""")
def editions_listed(spark, d):
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    text = F.concat(F.lit("N"), a, F.lit("(2) + N"), b, F.lit("+WH+"), F.col("w"), F.lit("(o)+WH++N"), a)
    return _some(spark, d).select("p_partkey", F.array_join(words.editions(text), " ").alias("editions"), words.in_all(text, ["WH", "N1"]).alias("has"))


_RULES = [("any", "ou", "u"), ("start", "th", "z"), ("end", "ed", "t"), ("end", "tion", "shn")]


@query(r"""SELECT w AS word, count(*) AS n, regexp_replace(regexp_replace(regexp_replace(replace(w, 'ou', 'u'), '^th', 'z'), 'ed$', 't'), 'tion$', 'shn') AS respelled
           FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) GROUP BY 1""")
def words_respelled(spark, d):
    """Every word of the documents in its new spelling, and how often it occurs."""
    found = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", readings.respelled(F.col("word"), _RULES).alias("respelled"))


@query(f"""SELECT p_partkey, w || '.' || b AS bare, w || ' ' || b || CASE WHEN a = 0 THEN ' east' ELSE '' END AS place, a = 1 AS affix FROM {_SOME}""")
def names_bare(spark, d):
    """Words without punctuation behind them, places without numbers, and which tags are affixes."""
    w, b = F.col("w"), F.col("b").cast("string")
    place = F.concat(w, F.lit(" "), b, F.when(F.col("a") == 0, " east").otherwise(F.concat(F.lit("  "), b)))
    tag = F.when(F.col("a") == 1, F.concat(F.lit("h900"), b, F.when(F.col("b") > 2, "a").otherwise(""))).when(F.col("a") == 2, F.concat(F.lit("H90"), b)).otherwise(F.concat(F.lit("G900"), b))
    return _some(spark, d).select("p_partkey", readings.bare(F.concat(w, F.lit("."), b, F.lit(" .;”)"))).alias("bare"), readings.unnumbered(place).alias("place"), readings.is_affix(tag).alias("affix"))


@query("SELECT page_id, trim(regexp_replace(replace(url, '¶', ''), '[(][^(]*$', '')) AS text, trim(regexp_extract(replace(url, '¶', ''), '[(]([^()]*)[^(]*$', 1)) AS sound FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN ' (' || substr(url, 1, 9) || ') ' WHEN 1 THEN '¶ (x) (y' ELSE '' END AS url FROM pages)")
def cells_spoken(spark, d):
    """Addresses with something in brackets behind them."""
    more = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" ("), F.substring("url", 1, 9), F.lit(") "))).when(F.col("page_id") % 3 == 1, "¶ (x) (y").otherwise("")
    return table(spark, d, "pages").select("page_id", readings.spoken(F.concat("url", more)).alias("s")).select("page_id", "s.text", "s.sound")


@query(f"""SELECT p_partkey, 'G' || b || CASE WHEN a = 0 THEN '' ELSE ' G' || c END AS ids, CASE a WHEN 0 THEN 'N-' || w WHEN 1 THEN 'N-' || w || ' + V' ELSE 'V' END AS codes FROM {_SOME}""")
def tags_paired(spark, d):
    w, b, c = F.col("w"), F.col("b").cast("string"), F.col("c").cast("string")
    first = F.concat(F.lit("G1|G"), b, F.when(F.col("a") == 2, "").otherwise(F.concat(F.lit("=N-"), w)))
    tags = F.concat(first, F.when(F.col("a") == 0, " + ").otherwise(F.concat(F.lit(" + G"), c, F.lit("«G9=V "))))
    return _some(spark, d).select("p_partkey", readings.tag_pairs(tags).alias("t")).select("p_partkey", F.array_join("t.ids", " ").alias("ids"), "t.codes")


@query(f"""SELECT p_partkey, 1 AS place, w AS text, 'to ' || p_name AS gloss, 'N' AS codes, 'A B' AS editions FROM {_SOME} UNION ALL SELECT p_partkey, 2, w || ' ' || b, 'it', 'V-' || c || ' + N', 'C' FROM {_SOME} WHERE a > 0
           UNION ALL SELECT p_partkey, 3, NULL, NULL, NULL, NULL FROM {_SOME} WHERE a = 2""")
def variants_read(spark, d):
    """Readings between broken bars; one that can't be read is null."""
    w, b, c = F.col("w"), F.col("b").cast("string"), F.col("c").cast("string")
    first = F.concat(w, F.lit(" (t=so) to "), F.col("p_name"), F.lit(" - G1=N in: A(1)+B"))
    second = F.when(F.col("a") > 0, F.concat(F.lit(" ¦ "), w, F.lit(" "), b, F.lit(" (B=x) it - G2=V-"), c, F.lit(" + G3=N in: C ¦"))).otherwise(" ¦ ")
    cell = F.concat(first, second, F.when(F.col("a") == 2, "nothing known").otherwise(""))
    found = _some(spark, d).select("p_partkey", F.posexplode(readings.variants(cell)).alias("i", "v"))
    return found.select("p_partkey", (F.col("i") + 1).alias("place"), "v.text", "v.gloss", "v.codes", F.array_join("v.editions", " ").alias("editions"))


@query(f"""SELECT p_partkey, CASE c WHEN 0 THEN w WHEN 1 THEN p_name || ' (a; b)' WHEN 2 THEN 'first ' || w WHEN 3 THEN repeat(w, 8) WHEN 4 THEN 'a ' || w WHEN 5 THEN 'one two three four five six seven eight nine ten eleven…' ELSE '' END AS gloss FROM {_SOME}""")
def first_senses(spark, d):
    w, name, c = F.col("w"), F.col("p_name"), F.col("c")
    given = (
        F.when(c == 0, F.concat(F.lit("Properly, "), w, F.lit(", ; more")))
        .when(c == 1, F.concat(name, F.lit("  (a; b);c")))
        .when(c == 2, F.lit(" ; x"))
        .when(c == 3, F.concat(F.repeat(w, F.lit(8)), F.lit(" (in brackets that make it longer than sixty letters)")))
        .when(c == 4, F.concat(F.lit("i.e. a "), w, F.lit(", and much more than sixty letters can hold, as it goes on and on")))
        .when(c == 5, F.lit("one two three four five six seven eight nine ten eleven twelve thirteen"))
    )
    return _some(spark, d).select("p_partkey", readings.first_sense(F.coalesce(given, F.lit("")), F.when(c == 2, F.concat(F.lit("+ first "), w, F.lit(", second"))), ["properly", "literally", "i.e."]).alias("gloss"))


_NOTES = ("a king", "Xerxes", "Hittite 2", "Hittites", "god of war", "of the house", "blue")


@query(f"""SELECT p_partkey, c IN (0, 3, 5) AS usable, CASE WHEN b = 0 THEN 'of ' || w WHEN a = 0 THEN NULL WHEN b = 1 THEN 'daughter of ' || w WHEN b = 2 THEN 'father of ' || w WHEN b = 3 THEN 'sister of ' || w ELSE {_sql("c", *_NOTES)} END AS title,
                  CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN NULL ELSE w END WHEN c > 0 THEN 'city of ' || w END AS significance FROM {_SOME}""")
def people_titled(spark, d):
    """Titles that tell namesakes apart, usable notes, and what is said of persons and places."""
    w, b, note = F.col("w"), F.col("b"), _pick("c", *_NOTES)
    usable = readings.note_usable(note, ["king", "son"], ["a", "the", "of the"], ["god", "lord"])
    label = lambda woman, man: F.when(b % 2 == 1, woman).otherwise(man)
    kin = [(label("daughter", "son"), F.when(b == 1, w)), (label("mother", "father"), F.when(b == 2, w)), (label("wife", "husband"), F.lit(None).cast("string")), (label("sister", "brother"), F.when(b == 3, w))]
    title = readings.person_title(F.when(b == 0, F.concat(F.lit("X (of "), w, F.lit(" ) "))).otherwise("X ()"), F.col("a") > 0, kin, note)
    about = F.when(F.col("c") > 0, F.concat(F.lit("city of "), w, F.lit(" first mentioned at X, and more"))).otherwise("A location; unknown")
    said = readings.significance(F.col("a") > 0, F.when(b == 0, " > ").otherwise(F.concat(F.lit(" "), w)), about)
    return _some(spark, d).select("p_partkey", usable.alias("usable"), title.alias("title"), said.alias("significance"))


@query("""SELECT conv_id, turn, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296) AS BIGINT) AS seed FROM conversations""")
def seed_hashes(spark, d):
    """Seeds from the whole text of each turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", tx.fnv1a(F.col("text")).alias("seed"))


@query(f"""SELECT p_partkey, '<' || w || '> & "' || b || '" ''' || a || ''' é' AS text FROM {_SOME}""")
def entities_decoded(spark, d):
    text = F.concat(F.lit("&lt;"), F.col("w"), F.lit("&gt; &amp; &quot;"), F.col("b").cast("string"), F.lit("&#34; &#x27;"), F.col("a").cast("string"), F.lit("&#39; &eacute;"))
    return _some(spark, d).select("p_partkey", tx.unescaped(text).alias("text"))


@query(r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'אבגדהαβγδε') || 'x' || translate(CAST(p_size AS VARCHAR), '0123456789', 'αβγδεאבגדה'), '\p{Hebrew}+|\p{Greek}+|[^\p{Hebrew}\p{Greek}]+'), '|') AS runs FROM part")
def script_runs(spark, d):
    shown = lambda c, to: F.translate(F.col(c).cast("string"), "0123456789", to)
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.script_runs(F.concat("p_name", shown("p_partkey", "אבגדהαβγδε"), F.lit("x"), shown("p_size", "αβγδεאבגדה"))), "|").alias("runs"))


@query(f"""SELECT p_partkey, least(b + 1, 3) AS done, CASE WHEN c < 3 AND c <= b THEN CAST(c AS VARCHAR) ELSE '' END AS missed FROM {_SOME}""")
def first_letters_typed(spark, d):
    """How far first letters typed in turn get through three words, with one wrong letter at a place."""
    expected = F.array("w", F.lit("Middle"), F.lit("end"))
    right = F.transform(expected, lambda w: F.lower(F.substring(w, 1, 1)))
    wrong = F.transform(right, lambda k, i: F.when(i == F.col("c"), F.array(F.lit("#"), k)).otherwise(F.array(k)))
    keys = F.flatten(F.slice(wrong, F.lit(1), F.least(F.col("b") + 1, F.lit(3)).cast("int")))
    return _some(spark, d).select("p_partkey", practice.typed(expected, keys).alias("t")).select("p_partkey", F.col("t.index").alias("done"), F.array_join(F.col("t.missed").cast("array<string>"), ",").alias("missed"))


@query(f"""SELECT p_partkey, array_to_string(list_concat(list_transform(range(c), lambda i: 'x' || i), [CASE WHEN c > 0 THEN ' y' ELSE 'y' END || b]), '|') AS runs FROM {_SOME}""")
def runs_joined(spark, d):
    """Lists of text runs joined with a space."""
    first = F.when(F.col("c") == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("c") - 1, F.lit(0))), lambda i: F.concat(F.lit("x"), i.cast("string"))))
    return _some(spark, d).select("p_partkey", F.array_join(readings.runs_joined(first, F.array(F.concat(F.lit("y"), F.col("b").cast("string")))), "|").alias("runs"))


@query(r"""SELECT p_partkey, CASE a WHEN 0 THEN 'Gen. ' || (b + 1) || ':' || (c + 1) || '-' || (c + 3) || '|1 Sam ' || (b + 1) WHEN 1 THEN 'Gen ' || c ELSE '' END AS refs FROM """ + _SOME)
def prose_references(spark, d):
    """References in prose, by the names of books."""
    b, c = (F.col("b") + 1).cast("string"), F.col("c")
    text = (
        F.when(F.col("a") == 0, F.concat(F.lit("as in Gen. "), b, F.lit(":"), (c + 1).cast("string"), F.lit("-"), (c + 3).cast("string"), F.lit(", and (1 Sam "), b, F.lit(")")))
        .when(F.col("a") == 1, F.concat(F.col("w"), F.lit(" Gen "), c.cast("string"), F.lit("; Genx 3")))
        .otherwise(F.concat(F.lit("no Gen here "), c.cast("string")))
    )
    return _some(spark, d).select("p_partkey", F.array_join(markup.prose_references(text, ["Gen", "1 Sam"]), "|").alias("refs"))


@query("SELECT conv_id, count(*) AS turns, true AS same, count(*) > 1 AS moved FROM conversations GROUP BY 1")
def shuffles_hold(spark, d):
    """A seeded order holds all turns and is never the given one, unless there is one alone."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")).withColumn("mixed", practice.scrambled(F.col("turns"), F.col("conv_id")))
    return turns.select("conv_id", F.size("turns").cast("long").alias("turns"), (F.array_sort("mixed") == F.col("turns")).alias("same"), (F.col("mixed") != F.col("turns")).alias("moved"))


@query(r"""WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: len(x) >= 3 AND x NOT IN ('the', 'and'))) AS n FROM conversations)
           SELECT conv_id, turn, least(n, greatest(1, CAST(floor(n * 0.25 + 0.5) AS BIGINT))) AS blanks, true AS held FROM t""")
def blanks_picked(spark, d):
    """About a quarter of a turn's key words are hidden, at places in order."""
    found = table(spark, d, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w")).withColumn("at", practice.blanks(F.col("w"), ["the", "and"], F.col("conv_id")))
    held = F.forall("at", lambda i: F.length(F.get("w", i)) >= 3) & (F.array_sort(F.array_distinct("at")) == F.col("at"))
    return found.select("conv_id", "turn", F.size("at").cast("long").alias("blanks"), held.alias("held"))


@query(f"""SELECT p_partkey, place, kind, depth, text FROM (SELECT p_partkey, w, a, b, c FROM {_SOME}), LATERAL (SELECT * FROM (VALUES (0, 'h', a + 1, w || ' one'), (1, 'p', 0, 'first ' || w || ' second'), (2, 'li', 1, 'item ' || b || ' goes on'), (3, 'li', 2, 'inner ' || c),
                  (4, 'q', 0, 'said ' || w || ' again')) AS v(place, kind, depth, text))""")
def markdown_blocks(spark, d):
    """Blocks of a small markdown text of each part."""
    w, b, c = F.col("w"), F.col("b").cast("string"), F.col("c").cast("string")
    text = F.concat(F.repeat(F.lit("#"), (F.col("a") + 1).cast("int")), F.lit(" "), w, F.lit("  one\n\nfirst "), w, F.lit("\n  second\n- item "), b, F.lit("\n  goes on\n  * inner "), c, F.lit("\n \n> said "), w, F.lit("\n> again\n\n"))
    return _some(spark, d).select("p_partkey", F.posexplode(markup.markdown_blocks(text)).alias("place", "m")).select("p_partkey", F.col("place").cast("long").alias("place"), "m.kind", F.col("m.depth").cast("long").alias("depth"), "m.text")


@query(f"""SELECT p_partkey, CASE WHEN a = b THEN '#' || a ELSE '#' || a || ' #' || b END AS links, CASE WHEN b = 0 THEN '#0' ELSE '' END AS kept FROM {_SOME} WHERE a > 0""")
def links_kept(spark, d):
    """Links of two paragraphs, and those to a known target."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    found = _some(spark, d).where("a > 0").withColumn("blocks", markup.blocks(F.concat(F.lit('<p>x <a href="#'), a, F.lit('">y</a></p><div><a href="#'), b, F.lit('">z</a></div>'))))
    kept = markup.links_kept(F.col("blocks"), F.array(F.lit("#0"), F.lit("#9")))
    return found.select("p_partkey", F.array_join(markup.links(F.col("blocks")), " ").alias("links"), F.array_join(markup.links(kept), " ").alias("kept"))


@query(f"""SELECT p_partkey, CASE a WHEN 0 THEN '1|2,3|4' WHEN 1 THEN '0|1|2|' ELSE '0|0|2' END AS places FROM {_SOME}""")
def segments_placed(spark, d):
    """The words that the segments of a small text take: in order, further on, and again."""
    numbers = lambda *of: F.array(*[F.concat(F.lit("H"), (F.col("b") + n).cast("string")) for n in of])
    segment = lambda *of: F.struct(numbers(*of).alias("numbers"), F.lit(False).alias("again"))
    segments = F.when(F.col("a") == 0, F.array(segment(1), segment(2, 3), segment(4))).when(F.col("a") == 1, F.array(segment(1), segment(2), segment(1), segment(9))).otherwise(F.array(segment(1), segment(1), segment(3)))
    found = F.when(F.col("a") == 0, F.array(numbers(8), numbers(1), numbers(2, 7), numbers(3), numbers(4, 2))).when(F.col("a") == 1, F.array(numbers(1), numbers(2), numbers(1))).otherwise(F.array(numbers(1), numbers(2), numbers(3)))
    placed = _some(spark, d).select("p_partkey", resolving.segment_words(segments, found).alias("s"))
    return placed.select("p_partkey", F.array_join(F.transform("s", lambda x: F.array_join(x.cast("array<string>"), ",")), "|").alias("places"))


@query(f"""SELECT p_partkey, CASE a WHEN 0 THEN '4 5 6 1 2 3' WHEN 1 THEN '1 - 3 4 - -' ELSE '1 2 3 4 5' END AS tags FROM {_SOME}""")
def tags_moved(spark, d):
    """Tags on a version with a moved phrase, with words put in and left out, and with one word for another."""
    w = [F.concat("w", F.lit(str(n))) for n in range(1, 7)]
    tags = F.array(*[F.lit(str(n)) for n in range(1, 7)])
    new = F.lit("new")
    other = F.when(F.col("a") == 0, F.array(*w[3:], *w[:3])).when(F.col("a") == 1, F.array(w[0], new, w[2], w[3], new, new)).otherwise(F.array(w[0], w[1], new, w[3], w[4]))
    found = _some(spark, d).select("p_partkey", sequences.tag_transfer(F.when(F.col("a") == 1, F.array(*w[:1], *w[2:4])).otherwise(F.slice(F.array(*w), F.lit(1), F.when(F.col("a") == 2, 5).otherwise(6))), F.when(F.col("a") == 1, F.array(F.lit("1"), F.lit("3"), F.lit("4"))).otherwise(tags), other).alias("t"))
    return found.select("p_partkey", F.array_join("t", " ", "-").alias("tags"))


@query(f"""SELECT p_partkey, place, kind, depth, text FROM (SELECT p_partkey, w, a, b, c FROM {_SOME}), LATERAL (SELECT * FROM (VALUES (0, 'h', 0, w || ' & more'), (1, 'p', 0, 'one ' || w || ' two'), (2, 'li', 1, 'item ' || b), (3, 'li', 2, 'inner ' || c), (4, 'q', 0, 'said')) AS v(place, kind, depth, text))""")
def html_blocks_read(spark, d):
    """Blocks of a small page of each part."""
    w, b, c = F.col("w"), F.col("b").cast("string"), F.col("c").cast("string")
    page = F.concat(F.lit("<script>x</script><h2>"), w, F.lit(" &amp; more</h2>\n<p>one <b>"), w, F.lit("</b>\n two</p><ul><li>item "), b, F.lit("<ol><li>inner "), c, F.lit("</li></ol></li></ul><blockquote>said</blockquote>"))
    found = _some(spark, d).select("p_partkey", F.posexplode(markup.blocks(page)).alias("place", "m"))
    text = F.trim(F.array_join(F.transform("m.runs", lambda r: r["t"]), ""))
    return found.select("p_partkey", F.col("place").cast("long").alias("place"), "m.kind", F.col("m.depth").cast("long").alias("depth"), text.alias("text"))
