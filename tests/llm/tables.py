"""Small tables for the edge cases, and the plain definitions that operators are held against."""

import random
import re

WORD = re.compile(r"(?:[a-z0-9_]|[^\x00-\x7f])+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns an operator may use itself.
CLASHING = ("key", "id", "ids", "sig", "part", "score", "keep", "keep_id", "tokens", "block", "shard", "quota", "group", "home", "found", "count", "u", "v", "__drop")


def words(t):
    return WORD.findall((t or "").lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=5, n=60):
    """Prose with copies, near copies, a passage that many share, and nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    shared = prose(rng, 70)
    for i in range(n):
        t = prose(rng, rng.choice([1, 3, 8, 60, 150, 300]))
        if i % 5 == 0:
            t = t + " " + shared
        rows.append([i, t, rng.choice(["en", "de", None]), f"s{i % 3}", len(t)])
    for i in range(n, n + 20):
        base = rows[rng.randrange(n)][1]
        w = base.split()
        for _ in range(len(w) // 25):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        t = base if i % 2 else " ".join(w)
        rows.append([i, t, "en", "s0", len(t)])
    rows += [
        [n + 20, None, None, None, None],
        [n + 21, None, "en", "s1", None],
        [n + 22, "", "en", "s1", 0],
        [n + 23, "", None, "s1", 0],
        [n + 24, "  \n\t ", "en", "s1", 5],
        [n + 25, "!!! ... ???", "en", "s1", 11],
        [None, "no identifier here at all", "en", "s2", 25],
        [n + 26, "und " * 400, "de", "s2", 1600],
        [n + 27, prose(rng, 30000), "en", "s2", 0],
        [n + 28, "x" * 200_000, "en", "s2", 200_000],
        [n + 29, "\U0001f600 éàü 漢字 " * 40, "fr", "s2", 0],
    ]
    rows += [list(rows[3]), list(rows[3]), list(rows[n + 1])]
    return [tuple(r) for r in rows]


def frame(spark, rows, clash=False, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "n_chars")
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(7) for c in CLASHING})
    return df


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
