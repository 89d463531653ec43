import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from llm_cases import AWKWARD, documents, sample_texts
from tokenizers import Tokenizer

from exposa.llm import bpe
from exposa.llm import token_files as T


class Kept(io.BytesIO):
    def close(self):
        pass


def test_ids_equal_the_library(spark):
    tokenizer, encoder = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path(), memory=50)
    r = random.Random(2)
    texts = [t or "" for _, t in AWKWARD + sample_texts(spark)]
    texts += ["".join(r.choice("aAbé's't9 ..,!\n\t ñ \x1c½日") for _ in range(r.randint(0, 25))) for _ in range(4000)]
    for t in texts:
        want = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.packed(t) == want, repr(t)


def written(docs):
    out = Kept()
    w = T.FrameWriter(out)
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    return out.getvalue()


def test_one_document_is_read_alone():
    docs = [(7, b"\1\0\0\0" * 1000), (None, b""), (9, b"\2\0\0\0")]
    data = written(docs)
    reader = T.FrameReader(io.BytesIO(data))
    assert reader.docs == [7, None, 9]
    assert [reader.ids(i) for i in (2, 0, 1)] == [docs[2][1], docs[0][1], docs[1][1]]
    # any zstandard reader sees plain frames: the two trailing ones are skippable
    assert zstandard.ZstdDecompressor().decompressobj().decompress(data) == docs[0][1]


def test_damage_is_found():
    data = bytearray(written([(1, bytes(range(256)) * 40), (2, b"abcd")]))
    entry = len(data) - T.FOOTER.size - 3 * T.ENTRY.size
    data[entry + 8] ^= 1  # the first frame's sum in the seek table
    reader = T.FrameReader(io.BytesIO(bytes(data)))
    assert reader.ids(1) == b"abcd"
    with pytest.raises(ValueError):
        reader.ids(0)
    with pytest.raises(ValueError):
        T.FrameReader(io.BytesIO(b"no table here"))


def test_round_trip(spark):
    docs = AWKWARD + [(100 + d, t) for d, t in sample_texts(spark)]
    tokenizer = Tokenizer.from_file(bpe.default_path())
    rows = sorted(T.write_and_read(documents(spark, docs)).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))  # ascending, null first
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = sorted((d is not None, d or 0, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
                 for d, t in docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_crc32"]) for r in rows) == crc


def test_empty_table(spark):
    assert T.write_and_read(documents(spark, [])).collect() == []
