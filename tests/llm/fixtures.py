"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that other code might use inside; they must not disturb.
CLASHING = "fp bigint, key string, word string, row int, doc string, kept string, stratum string, marks string, copy string, rank string, piece string, component_id string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeflmnorstu") for _ in range(rng.randint(1, 8))) for _ in range(n))


def documents():
    """Nulls, empty and blank texts, copies, near copies, shared passages, repeated rows, a very long text."""
    rng = random.Random(5)
    base = words(rng, 300)
    passage = words(rng, 90)
    long = words(rng, 30_000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(base.split()[150], "changed", 1), "en", "b"), (4, None, "fr", None), (5, "", None, "a"), (6, " \t\n ", "de", "c"),
        (7, "Straße ünïcode 日本語 \U0001f600 " * 30, "de", "a"), (8, passage + " " + words(rng, 40), "en", "a"), (9, words(rng, 60) + " " + passage, "fr", "a"), (10, long, "en", "a"),
        (11, "word", "en", "b"), (12, "two words", "en", "b"), (13, "x" * 1000, "en", "b"), (14, "ab" * 700, None, "b"), (15, base[:399], "en", "a"), (16, base[:400], "en", "a"),
        (17, "same line here now\n" * 40, "fr", "c"), (17, "same line here now\n" * 40, "fr", "c"), (18, "THE END is Near!! stupid trash", "en", "a"), (None, base + " tail", None, None),
        (20, "퟿ a\x0bb\x0cc\rd e", "en", "a"), (21, passage, "en", "d"),
    ]
    rows += [(100 + i, words(rng, rng.randint(5, 120)), ["en", "fr", "de", "es"][i % 4], "abc"[i % 3]) for i in range(40)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows=None, extra=True):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHING.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit(7).cast(kind) if kind != "string" else F.lit("odd"))
    return df


def tables(spark, path, rows=None):
    """A folder of tables as queries read them."""
    rows = documents() if rows is None else rows
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], i % 5 and 1, int(i % 7 == 0)) for i, r in enumerate(rows) if r[0] is not None]
    labels += [(10**6, 1, 0), (1, None, None), (None, 1, 1)]
    spark.createDataFrame(labels if rows else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    talk = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "hi \\ there"), (2, 0, "user", "hello"), (2, 1, "assistant", "other ### x: </turn>\n"), (3, 0, "system", None), (3, 1, "user", ""),
        (3, 2, "assistant", ""), (4, 0, "user", "hello"), (5, 0, "user", "hello"), (5, 1, "assistant", "hi \\ there"), (5, 2, "user", "more"), (6, 0, None, "a: b"), (6, 0, None, "a: b"),
        (7, 0, "assistant", "long " * 5000), (None, None, "user", "no id"),
    ]
    spark.createDataFrame(talk if rows else [], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)
