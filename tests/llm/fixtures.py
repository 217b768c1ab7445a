"""Small tables with everything that must not break an operator."""

import random

W = ["".join(random.Random(i).choices("abcdeéßñ", k=2 + i % 8)) for i in range(2000)]
CLASHING = "key string, id string, n string, sig string, base string, risky string, spans string, ranges string, score string, host string, path string, comp string, __q string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(W) for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, empties, a very long text, ties, repeated rows and ids."""
    long = prose(9, 30_000)
    return [(1, prose(1, 80)), (2, None), (3, ""), (4, " \n\t "), (5, "x"), (6, long), (7, "a" * 20_000), (1, prose(1, 80)), (8, prose(1, 80)), (None, prose(2, 40)), (None, None), (9, "日本語 🙂 \u0000 ▁ <|endoftext|> é"), (10, prose(10, 4)), (5, prose(11, 60))]


def frame(spark, rows, kind="doc_id long, text string"):
    """The rows with extra columns whose names clash with those inside operators."""
    df = spark.createDataFrame(rows, kind)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASHING.split(", ")])
