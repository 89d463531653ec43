"""Small tables with the awkward cases every operator must give a defined result for."""

import random

from pyspark.sql import functions as F

WORDS = "the of and to in that was for on are with as his they at be this have from or one had by word".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


#: (doc_id, text): nulls, empty and white-space texts, ties, repeated rows, a very long text
AWKWARD = [
    (None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "Same text here now"), (5, "same TEXT here now"),
    (6, "same text here now"), (7, prose(1, 60)), (7, prose(1, 60)), (8, prose(1, 60).replace("word", "worm", 1)),
    (9, prose(2, 30_000)), (10, prose(2, 30_000)), (11, "É é İ ß 日本語 😀 <|endoftext|> \x00\x1f"), (12, "one"),
    (13, "ÄB"), (14, "äB"), (15, "x" * 50_000), (-3, "negative"), (16, prose(3, 200)), (17, prose(4, 200)),
]


def documents(spark, rows=AWKWARD):
    """The documents table with further columns whose names the operators use themselves."""
    df = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    df = df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("h", "norm", "fp", "key", "share", "rank", "slot", "kind", "start", "a", "b", "weight", "kept_id", "tie"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()),
                  key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


def sample_texts(spark, n=60):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()
    return [(r["doc_id"], r["text"]) for r in rows]
