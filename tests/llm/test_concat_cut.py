import array
import random
import zlib
from collections import defaultdict

import pytest
from llm_cases import AWKWARD, documents, prose, sample_texts
from tokenizers import Tokenizer

from exposa.llm import concat_cut as P
from exposa.llm import word_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe.default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    r = random.Random(5)
    parts = ["don't", "We'LL", "x's", "éa", "ÀÉ", "ß", "Ǆ", "ª", "²3", "½", "12a", "--", "...", "\x00", "\x1f", "\x85", "\xa0", " ",
             "  ", "\n\t", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "😀", "İ", "Σς", "é", "the", "Hello", "'", "''s", "_a_",
             "\xad", "qzx" * 40, "</w>", "a</w>"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ""]) for _ in range(r.randrange(12))) for _ in range(6000)]
    texts += [t for _, t in AWKWARD if t] + ["".join(chr(c) for c in range(0x250)), "9" * 5000]
    encoder = word_bpe.encoder(word_bpe.default_path())
    for t in texts:
        assert array.array("I", encoder.packed(t)).tolist() == ids_of(library, t), t


def test_sample_texts_equal_the_library(spark, library):
    encoder = word_bpe.Encoder(word_bpe.default_path(), memory=100)
    for _, t in sample_texts(spark, 200):
        assert array.array("I", encoder.packed(t)).tolist() == ids_of(library, t)


def check_packed(rows, capacity, texts, library):
    """Pieces of each row's ids lie once and gapless in documents and sequences; little is padded."""
    want = sorted(((d is None, d or 0), tuple(ids_of(library, t) + [P.END_ID])) for d, t in texts)
    by_place, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= capacity
        by_place[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for places in by_place.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in rows) == total
    assert len(by_place) == total // capacity + bin(total % capacity).count("1")
    pieces = defaultdict(int)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"])] += 1
    ids_by_doc = defaultdict(list)
    for (none, d), ids in want:
        ids_by_doc[None if none else d].append(ids)
    for d, own in by_doc.items():
        assert sum(r["length"] for r in own) == sum(map(len, ids_by_doc[d]))
        for r in own:
            crcs = {zlib.crc32(array.array("I", ids[r["start"]:r["start"] + r["length"]]).tobytes())
                    for ids in ids_by_doc[d] if len(ids) == r["doc_tokens"]}
            assert r["ids_crc32"] in crcs


@pytest.mark.parametrize("capacity", [4096, 64, 100])
def test_packs_whole_documents(spark, library, capacity):
    rows = AWKWARD + [(100 + d, t) for d, t in sample_texts(spark)]
    df = documents(spark, rows).repartition(5)
    check_packed(P.pack(df, capacity).collect(), capacity, rows, library)


def test_sequences_join_boundary_records(spark, library):
    rows = [(i, prose(i, 1 + i % 7 * 9)) for i in range(300)] + [(999, prose(9, 5000))]
    tokens = P.encoded(documents(spark, rows).repartition(17))
    row = P.long_row(tokens, 256)
    held = {r["sequence_id"]: array.array("I", r["ids"]).tolist() for r in P.sequences(tokens, row).collect()}
    pieces = P.pieces(tokens, row).collect()
    ids = {d: ids_of(library, t) + [P.END_ID] for d, t in rows}
    assert sum(map(len, held.values())) == sum(map(len, ids.values())) == sum(r["length"] for r in pieces)
    for r in pieces:
        at = r["offset"]
        assert held[r["sequence_id"]][at:at + r["length"]] == ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
    assert {len(v) for k, v in held.items() if k < row.full} == {256}


def test_many_tasks_share_a_window(spark, library):
    """More tasks than windows, some of them empty."""
    rows = [(i, "one") for i in range(40)]
    tokens = P.encoded(documents(spark, rows).repartition(60))
    row = P.long_row(tokens, 64)
    held = {r["sequence_id"]: len(r["ids"]) // 4 for r in P.sequences(tokens, row).collect()}
    assert held == {0: 64, 1: 16}


def test_empty_table(spark):
    tokens = P.encoded(documents(spark, []))
    row = P.long_row(tokens)
    assert P.pieces(tokens, row).collect() == [] and P.sequences(tokens, row).collect() == []


def test_given_columns_only(spark):
    assert P.pack(documents(spark)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
