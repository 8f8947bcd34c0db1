import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies, blanks, nulls, ties and one very long text."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        rows.append([i, text, "en" if i % 3 else "fr", f"src{i % 5 if i % 2 else 0}", len(text)])
    for i in range(30):  # copies that differ in blanks
        text = rows[i % 4][1]
        rows.append([200 + i, text.replace(" ", "\n " if i % 2 else "\t"), "en", "src0", len(text)])
    for i in range(20):  # near copies
        parts = rows[60][1].split(" ") * 5
        parts[i] = "changed"
        rows.append([300 + i, " ".join(parts), "en", "src1", 1])
    rows += [[400, None, None, None, None], [401, "", "en", "src1", 0], [402, " \t\n", "en", "src1", 3], [None, "one two three four", "en", "src2", 9], [403, "¡Señor! %%% 漢字 ünïcode İ", "es", "src2", 9]]
    rows += [[5, rows[5][1], "en", "src0", 1], [404, "long " * 60_000 + "end", "en", "src3", 1]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
