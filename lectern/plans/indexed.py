"""Queries on a written word index, on bucketed tables, and on fuzzy evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import fuzzy, lookup, postings
from lectern.plans.catalog import query
from lectern.tables import scratch, table

_WRITTEN: dict[tuple[str, str], str] = {}
_WORD = r"(^|[^\p{L}\p{N}])%s($|[^\p{L}\p{N}])"


def _index(spark, d):
    """The index of the documents, written once a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _WRITTEN:
        path = scratch(spark)
        postings.write_index(table(spark, d, "documents"), path, "doc_id", "text")
        _WRITTEN[at] = path
    return postings.WordIndex(spark, _WRITTEN[at])


_TERMS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents"


@query(f"SELECT left(term, 1) AS initial, count(DISTINCT (doc_id, term)) AS postings, count(*) AS occurrences, count(DISTINCT term) AS terms FROM ({_TERMS}) GROUP BY 1")
def index_written(spark, d):
    """What the index holds for each first character."""
    rows = _index(spark, d).rows
    return rows.groupBy(F.substring("term", 1, 1).alias("initial")).agg(F.count("*").alias("postings"), F.sum(F.size("positions")).alias("occurrences"), F.countDistinct("term").alias("terms"))


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"regexp_matches(text, '(?i){_WORD % w}')" for w in ("the", "idiot")))
def index_words(spark, d):
    return _index(spark, d).words("the idiot").select(F.col("key").alias("doc_id"))


@query(rf"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){_WORD % r'of[\s\p{P}]+the'}')")
def index_phrase(spark, d):
    return _index(spark, d).phrase('"of the"').select(F.col("key").alias("doc_id"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])for[\s\p{P}]+the[\s\p{P}]+th')")
def index_phrase_prefix(spark, d):
    """A phrase that ends with the beginning of a word."""
    return _index(spark, d).phrase('"for the th*"').select(F.col("key").alias("doc_id"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\p{L}\p{N}])path')")
def index_prefix(spark, d):
    return _index(spark, d).words("path*").select(F.col("key").alias("doc_id"))


@query(f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM ({_TERMS}) WHERE term IN ('of', 'le') OR starts_with(term, 'ont') GROUP BY 1")
def index_counts(spark, d):
    return _index(spark, d).counts("le of ont*")


def _bucketed(spark, d, name, key, buckets=16):
    return lookup.BucketedTable.write(table(spark, d, name), f"{name}_{uuid.uuid4().hex}", scratch(spark), key, buckets)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 77, 1000, 1000000000)")
def bucket_lookup(spark, d):
    """Some keys of a bucketed table: their buckets alone are read."""
    return _bucketed(spark, d, "orders", "o_orderkey").get([1, 2, 77, 1000, 10**9, None, 1]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def bucket_join(spark, d):
    """Orders with their lines and the sum for each order, all in the buckets that hold them."""
    met = _bucketed(spark, d, "orders", "o_orderkey").with_columns_of(_bucketed(spark, d, "lineitem", "l_orderkey"))
    return met.groupBy("o_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


_LETTERS = "regexp_extract_all(lower(text), '[a-z]+')"  # the other engine measures distances in bytes
_LOOSE = "[aeiouy]"


def _spelled(df, word: str):
    return df.withColumns({"bare": F.col(word), "loose": F.regexp_replace(word, _LOOSE, "")})


@query(rf"""
    WITH w AS (SELECT doc_id AS id, unnest(l) AS word, unnest(range(len(l))) AS place FROM (SELECT doc_id, {_LETTERS} AS l FROM documents)),
         f AS (SELECT DISTINCT item_id AS key, l[i] AS form, regexp_replace(l[i], '{_LOOSE}', '', 'g') AS bl FROM (SELECT item_id, {_LETTERS} AS l, unnest([1, 5, 6]) AS i FROM benchmark) WHERE length(l[i]) > 4),
         s AS (SELECT DISTINCT word, regexp_replace(word, '{_LOOSE}', '', 'g') AS al FROM w),
         p AS (SELECT word, key, max(strong) AS strong, max(weak) AS weak FROM (
                 SELECT word, key, (word = form OR (length(al) >= 2 AND al = bl) OR (length(form) >= 3 AND contains(word, form)) OR (length(word) >= 3 AND contains(form, word))
                             OR (least(length(al), length(bl)) >= 3 AND levenshtein(al, bl) <= 1))::INT AS strong,
                        ((least(length(word), length(form)) >= 2 AND levenshtein(word, form) <= 1) OR (least(length(al), length(bl)) >= 2 AND levenshtein(al, bl) <= 1))::INT AS weak
                 FROM s, f) WHERE strong + weak > 0 GROUP BY word, key),
         e AS (SELECT id, key, max(strong = 1 AND place < 3) AS strong FROM w JOIN p USING (word) WHERE place < 8 GROUP BY id, key),
         c AS (SELECT DISTINCT key FROM e WHERE strong),
         m AS (SELECT key, min(id) AS id FROM w JOIN p USING (word) WHERE strong = 1 GROUP BY key)
    SELECT key, id, CASE WHEN strong THEN 'strong' WHEN key IN (FROM c) THEN 'dropped' ELSE 'weak' END AS status FROM e
    UNION ALL SELECT DISTINCT f.key, m.id, CASE WHEN m.id IS NULL THEN 'missing' ELSE 'restored' END FROM f LEFT JOIN m USING (key) WHERE f.key NOT IN (SELECT key FROM e)""")
def fuzzy_resolved(spark, d):
    """Documents whose first words speak for a benchmark item by some of its longer words: strong evidence first, then weak, then any mention."""
    listed = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    words = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(listed).alias("place", "word"))
    some = F.transform(F.array(F.lit(0), F.lit(4), F.lit(5)), lambda i: F.get(listed, i))
    forms = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.explode(some).alias("form")).where("length(form) > 4").distinct()
    return fuzzy.resolve_words(_spelled(words, "word"), _spelled(forms, "form"))
