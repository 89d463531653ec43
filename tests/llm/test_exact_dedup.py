import hashlib
from collections import defaultdict

from llm_cases import AWKWARD, documents, rows_of, sample_texts

from exposa.llm import exact_dedup as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_against_brute_force(spark):
    rows = AWKWARD + [(100 + d, t) for d, t in sample_texts(spark)] + [(900 + i, "HOT copy") for i in range(300)]
    assert rows_of(X.exact_dedup(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_overfull_buckets_split(spark):
    rows = [(i, f"text {i % 150}") for i in range(300)]
    index = X.build_index(documents(spark, rows), capacity=10, max_depth=8).collect()
    assert len(index) == 150
    held = defaultdict(list)
    for r in index:
        held[r["bucket"]].append(r)
    assert max(r["depth"] for r in index) > 2
    for bucket, entries in held.items():
        assert len(entries) <= 10 and len({r["depth"] for r in entries}) == 1
        depth = entries[0]["depth"]
        for r in entries:  # a bucket is the slots that share its leading bits
            slot = (r["h"] % (1 << 64)) >> 56
            assert slot >> (8 - depth) << (8 - depth) == bucket
    assert rows_of(X.exact_dedup(documents(spark, rows), 10, 8), *COLUMNS) == brute(rows)


def test_depth_ends_at_the_limit(spark):
    rows = [(i, f"text {i}") for i in range(40)]
    assert rows_of(X.exact_dedup(documents(spark, rows), 1, 2), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    assert X.exact_dedup(documents(spark, [])).collect() == []


def test_keep_last(spark):
    kept = X.keep_last(documents(spark))
    want = sorted({(r[0] is None, r[0] or 0, r[4]) for r in brute(AWKWARD) if r[3]})
    assert sorted({(r["doc_id"] is None, r["doc_id"] or 0,
                    hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest())
                   for r in kept.collect()}) == want
    assert kept.columns == documents(spark).columns


def test_no_python_on_the_main_path(spark):
    plan = X.exact_dedup(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_look_up_goes_through_small_buckets(spark):
    rows = AWKWARD + [(1000 + i, f"text {i % 300}") for i in range(600)]
    got = rows_of(X.exact_dedup(documents(spark, rows), capacity=10, max_depth=8),
                  "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == rows_of(X.exact_dedup(documents(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    kept = X.keep_last(documents(spark, rows), capacity=10, max_depth=8)
    assert kept.columns == documents(spark, rows).columns
    assert rows_of(kept, "doc_id", "text") == rows_of(X.keep_last(documents(spark, rows)), "doc_id", "text")
