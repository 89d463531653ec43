import random

import numpy as np
import pytest
import xxhash
from llm_cases import AWKWARD, documents, rows_of, sample_texts

from exposa.llm import simhash as S
from exposa.llm.components import components

SPACES = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACES:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """points: (name, fingerprint); root name: the smallest reachable, None last."""
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    out = []
    for i, (name, _) in enumerate(points):
        names = [points[j][0] for j in range(len(points)) if find(j) == find(i) and points[j][0] is not None]
        out.append(min(names, default=None))
    return out


def test_fingerprints(spark):
    for _, text in AWKWARD + sample_texts(spark):
        assert S.fingerprint(text or "") == brute_fingerprint(text)
    assert S.fingerprint("a b c\x1dd e f") == brute_fingerprint("a b c\x1dd e f")


def test_against_brute_force(spark):
    rows = AWKWARD + [(100 + d, t) for d, t in sample_texts(spark, 120)]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_components(fps))),
                  key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))
    assert rows_of(S.near_duplicates(documents(spark, rows)), "doc_id", "fingerprint", "component_id") == want


def clustered(seed, n=220):
    """Fingerprints in chains and clusters, some with common halves."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        fp = r.choice([r.getrandbits(64), r.getrandbits(32), 0, out[-1] if out else 0])
        for b in r.sample(range(64), r.choice([0, 1, 2, 4, 5, 6])):
            fp ^= 1 << b
        out.append(fp)
    return sorted(set(out))


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_no_link_is_lost(spark, parts):
    fps = clustered(parts)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(S.links(points, S.make_plan(points, parts=parts))).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(list(zip(signed, fps)))
    assert got == want


def test_thresholds_add_up(spark):
    points = spark.createDataFrame([(int(x),) for x in range(500)], "fp long")
    plan = S.make_plan(points, parts=3)
    us = plan.allocate(plan.values(np.arange(500, dtype=np.uint64)))
    assert (us.sum(axis=0) == 5).all() and us.min() >= 0
    assert sorted(b for g in plan.groups for b in g) == list(range(64))


def test_common_values_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 5)
    fps = clustered(9)
    points = np.array(fps, np.uint64)
    plan = S.Plan(S.group_bits(np.eye(64), 3), np.full((3, 1 << 16), 40.0), 10, 4)
    assert plan.blocks(0, plan.values(points)[0]).min() > 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(5, 3), (100, 101), (7, 7)], "x long, y long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_empty_table(spark):
    assert S.near_duplicates(documents(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    kept = S.keep_one(documents(spark, rows))
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted({d for (d, _), c in zip(fps, brute_components(fps)) if d == c})
    assert kept.columns == documents(spark).columns
