import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from llm_cases import documents, rows_of
from pyspark.sql import functions as F

from exposa.llm import source_divergence as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def brute(rows, top=200):
    """rows: (lang, source, text)."""
    counts, docs, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(words)
        total[lang].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {k[0] for k in counts}:
        kept = [w for w, n in docs[lang].items() if n >= 3]

        def shares(c):
            n = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // n for w in kept}
        q = shares(total[lang])
        own = {s: shares(counts[lang, s]) for l, s in counts if l == lang}
        for s, p in own.items():
            pairs = [(sum((p[w] - o[w])**2 // o[w] for w in kept), other) for other, o in own.items() if other != s]
            terms = [((p[w] - q[w])**2 // q[w], w) for w in kept if counts[lang, s][w] and p[w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)
                        if part == "pair" or k <= top]
    return sorted(out)


def table(spark, rows):
    """``documents`` with the columns the operator makes itself as clashing further ones."""
    df = documents(spark, [(i, t) for i, (_, _, t) in enumerate(rows)]).drop("lang", "source")
    meta = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "doc_id long, lang string, source string")
    df = df.join(meta, "doc_id")
    for name in ("term", "n", "docs", "entries", "V", "N", "sources", "cells", "p", "q", "value", "part", "item", "g"):
        df = df.withColumn(name, F.lit(7))
    return df


AWKWARD = [
    (None, None, None), (None, None, "alpha beta"), ("", "", "Alpha, BETA! beta"), (None, "s", "alpha_beta"), ("en", None, "only"),
    ("xx", "quiet", ""), ("xx", "quiet", " 12 \n"), ("xx", "loud", "word"), ("yy", "one", "a a a"), ("yy", "one", "a"), ("yy", "one", "A b"),
    *[("zz", "s1", "äÄ tie Tie one\x00two\x7fthree 日本語 😀x")] * 3, ("zz", "s2", "tie eit ä Ä " * 2000), ("zz", "s2", "x" * 100_000),
    ("zz", "s3", "9 8 7"),
]


def test_awkward_rows_against_brute_force(spark):
    assert rows_of(D.audit(table(spark, AWKWARD)), *COLUMNS) == brute(AWKWARD)


def test_random_rows_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}" for i in range(600)]
    rows = [(r.choice(["en", "de"]), "hot" if r.random() < .4 else f"s{r.randrange(7)}",
             " ".join(words[min(int(r.expovariate(.02)), 599)] for _ in range(r.randrange(1, 120)))) for _ in range(400)]
    want = brute(rows)
    assert rows_of(D.audit(table(spark, rows)), *COLUMNS) == want
    assert rows_of(D.audit(table(spark, rows), top=5), *COLUMNS) == brute(rows, 5)
    # sums sent on whenever a few entries are held
    monkeypatch.setattr(D, "ENTRIES", 50)
    monkeypatch.setattr(D, "CELLS", 10)
    assert rows_of(D.audit(table(spark, rows).repartition(3)), *COLUMNS) == want


def test_more_terms_than_the_report_holds(spark):
    alphabet = "abcdefghijklmnopqrst"
    words = [a + b + c for a in alphabet for b in alphabet for c in "xyz"]
    rows = [("en", "a", " ".join(words))] * 3 + [("en", "b", "other words here")] * 3
    out = rows_of(D.audit(table(spark, rows)), *COLUMNS)
    assert out == brute(rows) and sum(x[1] == "a" and x[2] == "term" for x in out) == 200


def test_share_is_exact_for_huge_counts():
    r = random.Random(1)
    cases = [(n, n + r.randrange(1, 10**14)) for n in (0, 1, 9 * 10**9, 10**13, 2 * 10**14 - 1) for _ in range(20)]
    for (n, total), p in zip(cases, D.share(*(np.array(c, np.int64) for c in zip(*cases)))):
        assert p == 1 + 10**9 * (n + 1) // total


def test_empty_table(spark):
    assert D.audit(table(spark, [])).collect() == []


def test_oracle_agrees_on_awkward_rows():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", AWKWARD)
    cur = con.execute(D.ORACLE)
    at = [[c[0] for c in cur.description].index(c) for c in COLUMNS]
    assert sorted(tuple(r[k] for k in at) for r in cur.fetchall()) == brute(AWKWARD)
