import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from llm_cases import AWKWARD, documents, sample_texts
from tokenizers import Tokenizer

from exposa.llm import bpe
from exposa.llm import packing as P


def used(patterns):
    return sum(times for _, times in patterns)


def check_solution(histogram, capacity, patterns):
    total = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= capacity
        for x in pattern:
            total[x] += times
    assert total == Counter({k: v for k, v in histogram.items() if v})


def optimum(pieces, capacity):
    best = len(pieces)
    for order in set(permutations(pieces)):
        bins = [capacity]
        for x in order:
            if bins[-1] < x:
                bins.append(capacity)
            bins[-1] -= x
        best = min(best, len(bins))
    return best


def test_small_packings_are_optimal():
    r = random.Random(5)
    for _ in range(60):
        pieces = [r.randint(1, 20) for _ in range(r.randint(1, 7))]
        patterns = P.solve(Counter(pieces), 20)
        check_solution(Counter(pieces), 20, patterns)
        assert used(patterns) == optimum(pieces, 20)


def test_search_betters_best_fit():
    # best-fit decreasing needs 4 sequences: 6+3, 5+5, 4+4+2, 2
    histogram = Counter([6, 5, 5, 4, 4, 3, 2, 1])
    assert used(P.solve(histogram, 10)) == 3 == P.lower_bound(histogram, 10)


def test_bounds_hold_on_many_pieces():
    r = random.Random(6)
    for _ in range(40):
        histogram = Counter(r.randint(1, 100) for _ in range(r.randint(1, 3000)))
        patterns = P.solve(histogram, 100, nodes=500)
        check_solution(histogram, 100, patterns)
        assert P.lower_bound(histogram, 100) <= used(patterns) <= sum(P.best_fit({k: v for k, v in histogram.items() if k < 100}, 100).values()) + histogram[100]


def test_cut():
    assert P.cut(5, 8) == [(0, 5)] and P.cut(8, 8) == [(0, 8)]
    assert P.cut(17, 8) == [(0, 1), (1, 8), (9, 8)] and P.cut(16, 8) == [(0, 8), (8, 8)]


def check_packed(rows, capacity, docs):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (start, n) in enumerate(P.cut(len(ids), capacity)):
            want[d, k, start, n, zlib.crc32(ids[start:start + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_documents_are_packed_whole(spark):
    docs = AWKWARD + [(100 + d, t) for d, t in sample_texts(spark, 100)]
    for capacity in (2048, 50):
        rows = P.pack(documents(spark, docs), capacity).collect()
        n = check_packed(rows, capacity, docs)
        assert n <= P.lower_bound(Counter(r["length"] for r in rows), capacity) * 1.05 + 1


def test_empty_table(spark):
    assert P.pack(documents(spark, [])).collect() == []


def test_search_tries_fillings_of_equal_sums():
    # 50+25+25, 36+34+30, 43+37+20: {25, 25} beside 50 has the sum of {30, 20}
    histogram = Counter([50, 43, 37, 36, 34, 30, 25, 25, 20])
    patterns = P.solve(histogram, 100)
    check_solution(histogram, 100, patterns)
    assert used(patterns) == 3
