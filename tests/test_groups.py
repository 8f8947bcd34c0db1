"""Stretches of a stream: batches, restarts, values that come back and late lines."""

from lectern.streaming import groups
from lectern.tables import scratch

SCHEMA = "source string, line long, value string"


def test_a_restart_goes_on_with_the_open_stretch(spark):
    path = scratch(spark)

    def given(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}-in")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
        groups.written(groups.stretches(stream, "source", "line", "value"), path, f"{path}-state")
        read = lambda bad: sorted((tuple(r) for r in groups.read_written(spark, path, bad).collect()), key=str)
        return read(False), read(True)

    given([("a", 3, "x"), ("a", 1, "x"), ("a", 2, "x"), ("b", 1, "y")])
    assert run() == ([], [])
    given([("a", 4, "x"), ("a", 5, "z"), ("b", 2, "z"), ("b", 3, "y")])
    first = run()
    assert first == ([("a", "group", "x", 1, 4, 4), ("b", "group", "y", 1, 1, 1), ("b", "group", "z", 2, 2, 1)], [("b", "back", "y", 3, 3, 1)])
    assert run() == first  # nothing new, nothing twice
    given([("a", 2, "late"), ("a", 6, None), ("b", 4, "y"), ("a", 7, "z")])
    given([("a", 8, None), ("b", 9, None), ("b", 10, None), (None, 1, "q"), (None, 2, None)])
    found, problems = run()
    closed = [("a", "group", "z", 5, 5, 1), ("a", "group", "z", 7, 7, 1), ("b", "group", "y", 3, 4, 2), (None, "group", "q", 1, 1, 1)]
    assert found == sorted([*first[0], *closed], key=str)
    assert problems == [("a", "back", "z", 7, 7, 1), ("a", "late", "late", 2, 2, 1), ("b", "back", "y", 3, 3, 1)]
