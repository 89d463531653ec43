import math
import random
from collections import Counter

import pytest
import xxhash
from llm_cases import AWKWARD, documents, prose

from exposa.llm import quality as Q


def buckets(text):
    words = [xxhash.xxh64(w.encode()).intdigest() for w in text.lower().split()]
    out = [w >> 48 for w in words]
    for a, b in zip(words, words[1:]):
        mix = (a * 0x9E3779B97F4A7C15 % 2**64 ^ b >> 7) * 0xC2B2AE3D27D4EB4F % 2**64
        out.append(0x3039 if a == b else mix >> 48)
    return out


def brute_weights(rows, labels):
    raw, target = Counter(), Counter()
    for d, t in rows:
        raw.update(buckets(t or ""))
        if labels.get(d, 0) > 0 and Q.fits_model(d):
            target.update(buckets(t or ""))
    n, size = (sum(target.values()), sum(raw.values())), 1 << 16
    out = []
    for d, t in rows:
        b = buckets(t or "")
        s = sum(math.log((target[x] + 1) / (n[0] + size)) - math.log((raw[x] + 1) / (n[1] + size)) for x in b)
        out.append((d, s / math.sqrt(len(b)) if b else 0.0))
    return out


def junk(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["BUY!!", "NOW$$", "CLICK%%", "FREE##"]) for _ in range(n))


LABELS = {**{i: 1 for i in range(100, 140)}, **{i: 0 for i in range(300, 320)}}
ROWS = ([(i, prose(i, 80)) for i in range(100, 180)] + [(i, junk(i, 60)) for i in range(300, 340)]
        + [(400, "echo " * 200), (310, "word " * 90)])


def labels_table(spark, labels=LABELS):
    return spark.createDataFrame([*labels.items(), (None, 1), (5000, None)], "doc_id long, quality int")


def test_weights_against_brute_force(spark):
    rows = AWKWARD + ROWS
    got = Q.score(documents(spark, rows), labels_table(spark)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], r["weight"]) for r in got), key=key)
    want = sorted(brute_weights(rows, LABELS), key=key)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [w for _, w in got] == pytest.approx([w for _, w in want], abs=1e-3)


def test_junk_goes_and_prose_stays(spark):
    df = documents(spark, ROWS)
    kept = Q.keep_good(df, labels_table(spark))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns
    assert set(range(100, 180)) <= ids
    assert not ids & set(range(311, 340))


def test_top_k_of_the_keys(spark):
    rows = Q.score(documents(spark, ROWS), labels_table(spark)).collect()
    kept = sorted(r["key"] for r in rows if r["kept"])
    assert kept[0] > max((r["key"] for r in rows if not r["kept"]), default=-math.inf)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known, held = labels.where("doc_id % 2 = 0"), {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    kept = {r["doc_id"]: r["kept"] for r in Q.score(docs, known).collect()}
    good = [kept[d] for d, q in held.items() if q == 1]
    bad = [not kept[d] for d, q in held.items() if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) > 0.9


@pytest.mark.parametrize("k", [1, 2, 7, 500, 1999, 2000])
def test_kth_largest(spark, k):
    r = random.Random(3)
    values = [r.choice([r.gauss(0, 1), 1.0, 1e9 * r.random(), -5.0]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert Q.kth_largest(df, "x", k, bins=16, few=3) == sorted(values)[-k]


def test_threshold():
    assert Q.threshold([(1.0, 1), (2.0, 1)]) == -math.inf == Q.threshold([])
    assert 0 < Q.threshold([(-1.0, 0), (0.0, 0), (1.0, 1), (2.0, 1)]) < 1


def test_without_labels_all_stay(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] for r in Q.score(documents(spark), none).collect())
    assert Q.keep_good(documents(spark), none).count() == len(AWKWARD)


def test_empty_table(spark):
    assert Q.score(documents(spark, []), labels_table(spark)).collect() == []


def test_sample_by_hash(spark):
    from exposa.llm.common import sample_by_hash
    df = spark.range(5000).toDF("x")
    assert 90 <= sample_by_hash(df, 100, "x").count() <= 100
    assert sample_by_hash(df, 4000, "x").count() == 4000
    assert {r.x for r in sample_by_hash(df, 50, "x").collect()} <= {r.x for r in sample_by_hash(df, 300, "x").collect()}
    assert sample_by_hash(df, 5001, "x").count() == 5000
