"""Queries on readers, writers and streams: what is written to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import aggregates
from lectern.plans.catalog import query
from lectern.sources import files, sinks
from lectern.streaming import groups, state
from lectern.tables import scratch, table

_PART = "SELECT p_partkey, p_name, p_size FROM part"


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


def _schema(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@query(_PART)
def json_scanned(spark, d):
    """A table written as JSON lines and read again."""
    path, part = scratch(spark), _part(spark, d)
    sinks.json_export(part, path)
    return files.json_lines(spark, path, _schema(part))


@query(_PART)
def tabs_scanned(spark, d):
    """A table written with tabs and read again."""
    path, part = scratch(spark), _part(spark, d)
    part.write.csv(path, sep="\t")
    return files.tab_separated(spark, path, _schema(part))


@query("SELECT p_name AS line, count(*) AS n FROM part GROUP BY 1")
def lines_scanned(spark, d):
    """Lines with carriage returns."""
    path = scratch(spark)
    _part(spark, d).select(F.concat("p_name", F.lit("\r"))).write.option("lineSep", "\n").text(path)
    return aggregates.counted(files.lines(spark, path), "line")


@query(_PART)
def xml_scanned(spark, d):
    """Entries of XML files."""
    path, part = scratch(spark), _part(spark, d)
    entry = F.format_string("<entry><p_partkey>%s</p_partkey><p_name>%s</p_name><p_size>%s</p_size></entry>", "p_partkey", "p_name", "p_size")
    lists = part.groupBy(F.floor(F.col("p_partkey") / 1000).alias("file")).agg(F.concat(F.lit("<list>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</list>")).alias("value"))
    lists.repartition("file").write.partitionBy("file").text(path)  # one root element a file
    return files.xml_entries(spark, f"{path}/*", "entry", _schema(part))


@query("SELECT n_nationkey, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def files_digested(spark, d):
    """A file for each nation, and its digest."""
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    found = files.digests(spark, path).where("path like '%.txt'")
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)/", 1).cast("long").alias("n_nationkey"), "bytes", "sha256")


@query("SELECT p_partkey // 100 AS bucket, count(*) AS n, sum(p_size) AS size FROM part GROUP BY 1")
def buckets_written(spark, d):
    """Parts in folders of a hundred numbers each."""
    path = scratch(spark)
    sinks.numbered_buckets(_part(spark, d), path, "p_partkey", 100)
    return spark.read.parquet(path).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("SELECT p_partkey, CAST(sum(CASE WHEN starts_with(p_name, 'cold') THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS record FROM part")
def records_marked(spark, d):
    """Which marker line of its file a line follows."""
    return files.records(table(spark, d, "part"), "p_name", "p_partkey", "p_brand", "cold").select("p_partkey", "record")


def _streamed(spark, d):
    """The events as a stream of files."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").withColumn("at", F.col("ts").cast("timestamp"))


def _drained(stream, path):
    """All that the stream emits until its input and watermark are used up."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark, d):
    """Counts by day and type of all days that the watermark has closed."""
    found = _drained(state.windowed_counts(_streamed(spark, d).select("at", "event_type"), "at", "event_type", "1 day", "1 hour"), scratch(spark))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m)
          SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    """Users' sessions that the watermark has closed."""
    found = _drained(state.sessions(_streamed(spark, d).select("at", "user_id"), "at", "user_id", "1 day", "1 hour"), scratch(spark))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_upserts(spark, d):
    """The latest event of each user, from the updates of a stateful stream."""
    path = scratch(spark)
    rows = _streamed(spark, d).select(F.col("user_id").cast("string").alias("user_id"), "event_id", "event_type")
    latest = state.upserted(rows, "user_id", "event_id", "event_type")
    writer = latest.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, number: batch.write.mode("append").parquet(path)).start().awaitTermination()
    return aggregates.latest(spark.read.schema(latest.schema).parquet(path), "user_id", ["event_id"], "event_type").select("user_id", "event_id", "event_type")


_LINES = "SELECT user_id % 7 AS source, event_id AS line, CASE WHEN event_type IN ('view', 'click') THEN event_type || event_id // 500 ELSE 'other' || event_id // 900 END AS value FROM events"
_STRETCHES = f"""WITH l AS ({_LINES}), c AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS c FROM l WINDOW w AS (PARTITION BY source ORDER BY line)),
                 g AS (SELECT source, line, value, sum(c) OVER (PARTITION BY source ORDER BY line) AS g FROM c),
                 s AS (SELECT source, value, min(line) AS first, max(line) AS last, count(*) AS n FROM g GROUP BY source, g, value)"""


def _lines_streamed(spark, d):
    """Lines of sources in four files, one a batch, and an end for each source; what they have left when all are read."""
    path, rows = scratch(spark), table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("source"), F.col("event_id").alias("line"),
        F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", F.expr("cast(event_id div 500 as string)"))).otherwise(F.concat(F.lit("other"), F.expr("cast(event_id div 900 as string)"))).alias("value"),
    )
    last = rows.agg(F.max("line")).first()[0] or 0
    ends = rows.select("source").distinct().select("source", F.lit(last + 1).alias("line"), F.lit(None).cast("string").alias("value"))
    for k in range(4):  # files one after another, so that batches follow the order of lines
        rows.unionByName(ends).where((F.col("line") > (last * k // 4 if k else -1)) & (F.col("line") <= last * (k + 1) // 4 + k // 3)).coalesce(1).write.mode("append").parquet(f"{path}-in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
    groups.written(groups.stretches(stream, "source", "line", "value"), path, f"{path}-state")
    return path


@query(f"{_STRETCHES} SELECT CAST(source AS VARCHAR) AS source, value, first, last, n FROM s")
def stream_stretches(spark, d):
    """Stretches of equal values in each source, closed as the stream goes on."""
    return groups.read_written(spark, _lines_streamed(spark, d)).select("source", "value", "first", "last", "n")


@query(f"{_STRETCHES} SELECT CAST(source AS VARCHAR) AS source, 'back' AS kind, value, first FROM (SELECT *, row_number() OVER (PARTITION BY source, value ORDER BY first) AS k FROM s) WHERE k > 1")
def stream_returned(spark, d):
    """The side output: values that come back after their stretch has ended."""
    return groups.read_written(spark, _lines_streamed(spark, d), problems=True).select("source", "kind", "value", "first")


@query("SELECT n_regionkey, count(*) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def folders_counted(spark, d):
    """Files and bytes of each folder: a folder a region, a file a nation."""
    path = scratch(spark)
    table(spark, d, "nation").select("n_regionkey", "n_name").repartition("n_name").write.option("maxRecordsPerFile", 1).partitionBy("n_regionkey").text(path)
    return files.folder_stats(spark, path, ".txt").select(F.regexp_extract("folder", "n_regionkey=([0-9]+)$", 1).cast("int").alias("n_regionkey"), "files", "bytes")
