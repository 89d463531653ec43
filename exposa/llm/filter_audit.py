"""How text filters interact: what each removes, in every order (op 12).

A document fails each of five filters or not; which ones is a mask of five bits. Four bits follow from its own
text (``own_failures``), the fifth, a text identical to that of a smaller doc_id anywhere in the table, from radix
tries over whole texts (``text_tries``). Orders need no further look at documents: whatever the order, a
document goes at the first filter it fails, so the counts of the 32 masks of a part give all 120 orders.

Only (doc_id, digest, part, mask) rows meet the tries' answers and the labels; rows alike in all four are added up
before that, so null ids or a repeated row make few rows. A hot part is 32 counts for each task.

Defined results: a null text is the empty text; a null source belongs to the part ''; a null doc_id is smaller
than none and has none smaller, so it never fails E, and it has no labels; rows that repeat a doc_id count each,
and one is no smaller than the other; a document with several labels counts as good, or toxic, if one says so; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize, text_of
from exposa.llm.text_tries import HELD, OWNED, digest, first_rows

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
CAPITALS, CONTINUATION = bytes(range(65, 91)), bytes(range(128, 192))
DUPLICATE = 1 << FILTERS.index("E")
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

ROWS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("part", pa.string()), ("mask", pa.int32())])
RESULT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                    *((m, pa.int64()) for m in MEASURES)])


def own_failures(text: bytes) -> int:
    """Bits of A to D that a text fails. Words are runs between ASCII white space, as ``bytes.split`` has it."""
    words = text.split()
    points = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3)


def masked(documents: DataFrame) -> DataFrame:
    """doc_id, digest (null with the id), part, mask (A to D)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, ids = rows.column("text").to_pylist(), rows.column("doc_id")
            yield batch(ROWS, {"doc_id": ids, "part": rows.column("part"), "mask": list(map(own_failures, texts)),
                               "digest": [None if d is None else digest(t) for d, t in zip(ids.to_pylist(), texts)]})

    return in_batches(documents, run, "doc_id long, digest binary, part string, mask int")


def mask_counts(documents: DataFrame, labels: DataFrame, held: int = HELD, owned: int = OWNED) -> DataFrame:
    """part, mask, n, good, toxic."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"),
                                 F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = masked(documents).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = first_rows(documents.where("doc_id IS NOT NULL").select("doc_id", "text"), held, owned)
    first = first.withColumn("first", F.lit(True))
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    fails = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
            .groupBy("part", F.when(fails, F.col("mask") + DUPLICATE).otherwise(F.col("mask")).alias("mask"))
            .agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))))


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before, bit of the step's filter)."""
    out = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append((order, step, before, bit))
            before |= bit
    return out


def by_order(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from at most 32 counts of a part."""
    steps, masks = order_steps(), 1 << len(FILTERS)
    m = np.arange(masks)[:, None]
    before, bit = (np.array([s[k] for s in steps])[None, :] for k in (2, 3))
    kept, reached, fails = m & (before | bit) == 0, m & before == 0, m & bit != 0
    removed = (reached & fails).astype(np.int64)
    orders = [sum(removed[k, j] for j, s in enumerate(steps) if s[3] == b) for b in (1, 2, 4, 8, 16) for k in range(masks)]
    first = np.array(orders, np.int64).reshape(len(FILTERS), masks).T  # mask, filter -> orders in which it removes
    filters = [b.bit_length() - 1 for _, _, _, b in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, entries in zip(rows.column("part").to_pylist(), rows.column("entries").to_pylist()):
                n, good, toxic = np.zeros((3, masks), np.int64)
                for e in entries:
                    n[e["mask"]], good[e["mask"]], toxic[e["mask"]] = e["n"], e["good"], e["toxic"]
                values = {"kept": n @ kept, "removed": n @ removed, "redundant": n @ (~reached & fails),
                          "unique_fails": n @ (m == bit), "good_lost": good @ removed, "toxic_lost": toxic @ removed,
                          "shapley": (n @ first)[filters]}
                yield batch(RESULT, {"part": [part] * len(steps), "filter_order": [s[0] for s in steps],
                                     "step": [s[1] for s in steps]} | {k: v.astype(np.int64) for k, v in values.items()})

    grouped = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    return in_batches(grouped, run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


def audit(documents: DataFrame, labels: DataFrame, held: int = HELD, owned: int = OWNED) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return by_order(materialize(mask_counts(documents, labels, held, owned)))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask,
             coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
             coalesce(list_sum([1 << (ascii(filter_order[k]) - 65) FOR k IN range(1, step)]), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept,
             sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
             sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost,
             sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
      FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM r"""
