import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from llm_cases import AWKWARD, documents, prose, rows_of, sample_texts
from pyspark.sql import functions as F

from exposa.llm import filter_audit as A
from exposa.llm import text_tries as T

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ("A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
            + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text)))


def brute(rows, labels):
    """Every order applied to every document, filter by filter."""
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    least = {}
    for d, _, t in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    docs = [(d, s or "", fails(t or "") + "E" * (d is not None and d > least[t or ""])) for d, s, t in rows]
    out, shapley = [], Counter()
    for part in {s for _, s, _ in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in docs if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[2]]
                redundant = sum(f in x[2] for x in gone)
                left = [x for x in left if f not in x[2]]
                gone += here
                shapley[part, f] += len(here)
                out.append([part, order, step, len(left), len(here), redundant, sum(x[1] == part and x[2] == f for x in docs),
                            sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def tables(spark, rows, labels):
    df = documents(spark, [(i, t) for i, (_, _, t) in enumerate(rows)]).drop("source")
    meta = spark.createDataFrame([(i, d, s) for i, (d, s, _) in enumerate(rows)], "doc_id long, real long, source string")
    df = df.join(meta, "doc_id").withColumn("doc_id", F.col("real"))
    for name in ("digest", "mask", "part", "n", "good", "toxic", "first", "least", "owner", "border", "quality"):
        df = df.withColumn(name, F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(0)).withColumn("n", F.lit(0))
    return df, marks


def cases(spark):
    r = random.Random(2)
    rows = [(d, r.choice(["a", "b", None, ""]), t) for d, t in AWKWARD]
    rows += [(100 + d, f"s{d % 3}", t) for d, t in sample_texts(spark)]
    rows += [(1000 + i, "hot", "the same hot copy $ of THIS TEXT " * 3) for i in range(200)]
    rows += [(None, "hot", "nobody " * 60)] * 4 + [(5000, "a", prose(9, 200)), (5000, "b", prose(9, 200)), (5000, "b", "other text"),
             (4000, "c", "other text"), (6000, "a", "shared beginning " * 200 + "x"), (6001, "a", "shared beginning " * 200 + "y"),
             (6002, "b", "shared beginning " * 200 + "x")]
    r.shuffle(rows)
    labels = [(d, r.randrange(2), r.randrange(2)) for d, _, _ in rows if d is not None and r.random() < .6]
    return rows, labels + labels[:30] + [(None, 1, 1), (99_999, 1, 1), (7, None, None), (8, 0, 1)]


@pytest.mark.parametrize("held, owned", [(T.HELD, T.OWNED), (2000, 3000)])
def test_against_brute_force(spark, held, owned):
    rows, labels = cases(spark)
    assert rows_of(A.audit(*tables(spark, rows, labels), held, owned), *COLUMNS) == brute(rows, labels)


def test_oracle_agrees(spark):
    rows, labels = cases(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    cur = con.execute(A.ORACLE)
    at = [[c[0] for c in cur.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[k] for k in at) for r in cur.fetchall()) == brute(rows, labels)


def test_empty_tables(spark):
    rows, labels = cases(spark)
    assert A.audit(*tables(spark, [], labels)).collect() == []
    assert rows_of(A.audit(*tables(spark, rows, [])), *COLUMNS) == brute(rows, [])


def test_trie_holds_texts_in_order():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab\xc3") for _ in range(r.randrange(9))) for _ in range(500)]
    trie = T.Trie()
    for i, t in enumerate(texts):
        trie.insert(t, 1000 - i)
    want = {}
    for i, t in enumerate(texts):
        want[t] = min(1000 - i, want.get(t, 1000))
    assert list(trie.walk()) == sorted(want.items())

    def nodes(n):
        return 1 + sum(map(nodes, n.children.values()))
    assert nodes(trie.root) <= 2 * len(want)  # compressed: no chains of single children
    parts = [s for s, _ in T.separators(trie, 200)]
    assert parts[:-1] == sorted(parts[:-1]) and parts[-1] is None and len(parts) > 10


def test_borders_follow_the_texts(spark):
    """Texts that share a long beginning are parted after it; what still is too heavy has several owners."""
    rows = [(i, (b"p" * 300 + b"%05d" % (i * 7919 % 100_000)) * 3) for i in range(2000)]
    texts = spark.createDataFrame(rows, "doc_id long, text binary")
    borders = T.weighed_borders(texts.repartition(4), 100_000)
    chosen = T.thinned(borders, 100_000)
    assert len(chosen) > 5 and all(300 < len(b) <= 305 for b, _ in chosen)
    owners = T.Owners(chosen, 0, 100_000)
    load = Counter()
    for _, t in rows:
        load[owners.of(t)] += len(t)
    assert max(load.values()) < 500_000 and sum(load.values()) == 2000 * 915
    owners = T.Owners([(b"p", 10), (b"q", 10**6)], 0, 10**5)
    assert len(owners) == 12 and len({owners.of(t) for _, t in rows}) == 10


def test_very_long_texts_and_one_owner_range(spark):
    rows = [(i, b"z" * 200_000 + bytes([i % 3])) for i in range(30)]
    first = T.first_rows(spark.createDataFrame(rows, "doc_id long, text binary").repartition(5), 500_000, 300_000)
    assert sorted(r["doc_id"] for r in first.collect()) == [0, 1, 2]
