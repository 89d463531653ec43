import hashlib
import random

import sentencepiece
from llm_cases import AWKWARD, documents, rows_of, sample_texts

from exposa.llm import sentencepieces as S


def test_ids_equal_the_library(spark):
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=S.default_path()), S.Backtracking(S.default_path(), 100)
    r = random.Random(3)
    texts = [t or "" for _, t in AWKWARD + sample_texts(spark)]
    for alphabet in ("aabbeeinnrst  ▁\n\t,.AE日本é😀0123<0x0A> \x00", "ab", "the in ", "))(';,.  "):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert encoder.encode(t) == model.encode(t), repr(t)


def test_steps_back():
    """Somewhere the longest piece leads to a dead end, and a position is tried in vain."""
    e = S.Backtracking(S.default_path())
    tried = []
    e.compatible = lambda a, b, f=e.compatible: tried.append(f(a, b)) or tried[-1]
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("abceinorst") for _ in range(12))
        assert e.tokens(text) == e.model.encode(text)[0:0] + [e.id[p] for p in e.merged(text)]
    assert not all(tried)


def test_digests(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=S.default_path())
    want = []
    for d, t in AWKWARD:
        ids = model.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    want.sort(key=lambda r: tuple((x is None, 0 if x is None else x) for x in r))
    assert rows_of(S.digests(documents(spark)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_encode_gives_ids_and_text(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=S.default_path())
    for r in S.encode(documents(spark, [(1, "one text"), (2, None)])).collect():
        assert r["ids"] == model.encode("one text" if r["doc_id"] == 1 else "") and r["decoded"] == model.decode(r["ids"])


def test_empty_table(spark):
    assert S.digests(documents(spark, [])).collect() == []


def test_long_runs_without_joined_neighbours():
    e = S.Backtracking(S.default_path())
    single = "".join(sorted(c for c in e.characters if c + c not in e.joined)[:40])
    texts = ["0" * 50_000, "1234567890" * 300, "x" + "7" * 3000 + "xx", "日" * 2000, "0日é" * 1500, single * 50]
    texts += [f"no {n} 0{'1' * n}a{'2' * n} end" for n in (1, 2, 70, 1100)]
    for t in texts:
        assert e.encode(t) == e.model.encode(t), t[:20]
    assert max(map(len, e.words)) <= S.SHORT
