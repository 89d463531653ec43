"""Token-ID files: independent zstandard frames with a trailing seek table (op 6).

One file per range of doc_id. A document is one frame of its ids as little-endian unsigned 32-bit
integers, so a reader decompresses only the documents it asks for. After the frames come two
skippable frames: the documents' ids (int64 each, with a null flag byte each), and the seek table of
the public zstandard seekable format, whose entries carry the compressed size, the decompressed size
and the low 32 bits of the XXH64 (seed 0) of each frame's content. Readers check that sum.

``write`` returns the manifest, one row per file, written as a table in the shared folder. A task
writes its file under a name of its own, and only files of successful attempts get into the
manifest, so a lost executor leaves at worst a file that nobody reads.

Defined results: a null text is the empty text (only the end id); rows with a null doc_id come first
(nulls sort first) and are kept; rows that share a doc_id are all written, ordered by their text's
hash; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposa.llm import bpe
from exposa.llm.common import batch, checkpoint_dir, in_batches, materialize, text_of

# Fixed values of the public seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")

END_ID = 0
LEVEL = 3
MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()),
                      ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                  ("ids_crc32", pa.int64())])


class FrameWriter:
    """Writes frames one at a time and the two trailing tables on ``close``."""

    def __init__(self, out):
        self.out, self.entries, self.docs, self.n_bytes = out, [], [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self._write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append(doc_id)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        n = len(self.docs)
        ids = struct.pack(f"<{n}q", *(d or 0 for d in self.docs)) + bytes(d is None for d in self.docs)
        block = struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids
        self._write(block)
        entries = b"".join(ENTRY.pack(*e) for e in (*self.entries, (len(block), 0, 0)))
        self._write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + FOOTER.size) + entries
                    + FOOTER.pack(n + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()


class FrameReader:
    """Random access to the documents of one file (any seekable binary file object)."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(end - FOOTER.size)
        frames, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable token file")
        file.seek(end - FOOTER.size - frames * ENTRY.size)
        self.entries = list(ENTRY.iter_unpack(file.read(frames * ENTRY.size)))
        self.offsets = [0]
        for size, _, _ in self.entries:
            self.offsets.append(self.offsets[-1] + size)
        file.seek(self.offsets[-2] + 8)
        n = frames - 1
        data = file.read(n * 9)
        self.docs = [None if null else d for d, null in zip(struct.unpack(f"<{n}q", data[:8 * n]), data[8 * n:])]
        self.decompressor = zstandard.ZstdDecompressor()

    def ids(self, i: int) -> bytes:
        """The ids of the file's i-th document; raises if the frame or its checksum is wrong."""
        size, length, checksum = self.entries[i]
        self.file.seek(self.offsets[i])
        data = self.decompressor.decompress(self.file.read(size), max_output_size=max(length, 1))
        if len(data) != length or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return data


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A Hadoop path may be written ``/x``, ``file:/x`` or ``scheme://host/x``."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(documents: DataFrame, folder: str, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenise ``documents`` (doc_id, text) and write them in ascending doc_id order as files under
    ``folder`` (a URI all executors reach). Returns the manifest, with each file's first position."""
    path = tokenizer_path or bpe.default_path()
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n_ids, name = None, 0, ""
        part = TaskContext.get().partitionId()
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                if writer is None:
                    fs, root = _filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                ids = bpe.encoder(path).packed(text) + end
                writer.add(doc_id, ids)
                n_ids += len(ids) // 4
        if writer is not None:
            writer.close()
            yield batch(MANIFEST, {"part": [part], "path": [f"{folder.rstrip('/')}/{name}"],
                                   "n_docs": [len(writer.docs)], "n_ids": [n_ids], "n_bytes": [writer.n_bytes]})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = (docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    files = materialize(in_batches(ordered, run, "part long, path string, n_docs long, n_ids long, n_bytes long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document back from the files: doc_id, start, n_tokens, ids_crc32. A task reads a file
    or a few, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for uri, start in zip(rows.column("path").to_pylist(), rows.column("start").to_pylist()):
                fs, at = _filesystem(uri)
                with fs.open_input_file(at) as file:
                    reader, out = FrameReader(file), {f.name: [] for f in READ}
                    for i, doc_id in enumerate(reader.docs):
                        ids = reader.ids(i)
                        for k, v in (("doc_id", doc_id), ("start", start), ("n_tokens", len(ids) // 4),
                                     ("ids_crc32", zlib.crc32(ids))):
                            out[k].append(v)
                        start += len(ids) // 4
                        if len(out["doc_id"]) == 10_000:
                            yield batch(READ, out)
                            out = {f.name: [] for f in READ}
                    yield batch(READ, out)

    # a given number of partitions: the manifest is small, and would else be read by one task
    files = manifest.select("path", "start").repartitionByRange(max(1, manifest.count()), "start")
    return in_batches(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    folder = f"{checkpoint_dir(documents.sparkSession).rstrip('/')}/exposa-tokens/{uuid.uuid4().hex}"
    return read(materialize(write(documents, folder, tokenizer_path)))
