"""Token-id files of independent zstandard frames.

Layout of one file (the public seekable zstandard format, so ordinary tools
can decompress it too):

    data frame*   ids of one or more whole documents, little-endian, 2 or 4 bytes each
    index frame   per document: id, frame, first id in the frame, number of ids
    seek table    a skippable frame: per frame its compressed size, raw size and
                  the low 32 bits of the xxh64 of its raw bytes; then a footer

A reader takes the footer, the seek table and the index, and then only the
frames of the documents that it wants, each checked against its checksum.

Documents are written in ascending id (null first; equal ids by a hash of their
text), range-partitioned, one file a task.  A file gets its name from the task
attempt, and only files that a finished task has reported are read, so a lost
or repeated task leaves no trace in the result.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, prepare, stored
from .tokenizing import coder

SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Raw bytes of a data frame, reached or passed by whole documents.
FRAME_BYTES = 1 << 16
#: Text bytes of a file.
FILE_BYTES = 24 << 20

MANIFEST = "part int, path string, n_docs bigint, n_ids bigint, id_bytes int"


def filesystem(uri: str):
    """The Arrow filesystem and path of a folder or file in the shared store."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    def __init__(self, sink, id_bytes: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard
        self.sink, self.frame_bytes = sink, frame_bytes
        self.dtype = np.dtype({2: "<u2", 4: "<u4"}[id_bytes])
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.seek, self.docs, self.pending, self.pending_ids, self.n_ids = [], [], [], 0, 0

    def _frame(self, raw: bytes) -> None:
        import xxhash
        packed = self.compress(raw)
        self.sink.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.pending_ids = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(self.seek), self.pending_ids, len(ids)))
        self.pending.append(ids.astype(self.dtype).tobytes())
        self.pending_ids += len(ids)
        self.n_ids += len(ids)
        if self.pending_ids * self.dtype.itemsize >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.docs, "<i8").reshape(-1, 5).T.tobytes())
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        footer = struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, uri: str, id_bytes: int):
        fs, path = filesystem(uri)
        self.dtype = np.dtype({2: "<u2", 4: "<u4"}[id_bytes])
        self.f = fs.open_input_file(path)
        size = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self.f.read_at(9, size - 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{uri}: no seek table")
        table = np.frombuffer(self.f.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = table.T
        self.at = np.concatenate([[0], np.cumsum(self.packed)])
        index = np.frombuffer(self.frame(n - 1), "<i8").reshape(5, -1)
        self.known, self.doc_id, self.frame_no, self.first, self.count = index
        self.n_frames = n - 1

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard
        raw = zstandard.ZstdDecompressor().decompress(self.f.read_at(int(self.packed[k]), int(self.at[k])),
                                                      max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: checksum differs")
        return raw

    def rows(self, wanted=None):
        """``(row, doc_id, ids)`` in file order; ``wanted``: only these ids, and
        only their frames are decompressed."""
        rows = np.arange(len(self.doc_id))
        if wanted is not None:
            rows = rows[(self.known == 1) & np.isin(self.doc_id, np.asarray(list(wanted), np.int64))]
        at, ids = -1, None
        for r in rows:
            if self.frame_no[r] != at:
                at = self.frame_no[r]
                ids = np.frombuffer(self.frame(int(at)), self.dtype)
            yield int(r), int(self.doc_id[r]) if self.known[r] else None, ids[self.first[r]:self.first[r] + self.count[r]]

    def close(self) -> None:
        self.f.close()


def _write(folder: str, path: str, end_id: int | None, id_bytes: int):
    def run(batches):
        import pyarrow as pa
        out, writer, uri, n = None, None, "", 0
        c = coder(path)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for b in batches:
            if writer is None:
                task = TaskContext.get()
                uri = f"{folder}/part-{task.partitionId():07d}-{uuid.uuid4().hex}.zst"
                fs, p = filesystem(uri)
                fs.create_dir(p.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(p, compression=None)
                writer = TokenFileWriter(out, id_bytes)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), c.encode(b.column("text").to_pylist())):
                writer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [uri],
                                              "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64()),
                                              "id_bytes": pa.array([id_bytes], pa.int32())})
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text and write the files; returns their manifest."""
    prepare(docs.sparkSession)
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), (end_id or 0) + 1)
    texts = id_text(docs)
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-total // file_bytes))
    ordered = (texts.withColumn("tie", F.xxhash64("text"))
                    .repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie"))
    parts = ordered.select("doc_id", "text").mapInArrow(
        _write(folder, tokenizer_path, end_id, 2 if size <= 1 << 16 else 4), MANIFEST)
    return stored(parts, "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds each file's first id position.  One row per file meets in one task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(with_ids: bool):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for uri, base, id_bytes in zip(*(b.column(c).to_pylist() for c in ("path", "base", "id_bytes"))):
                file = TokenFile(uri, id_bytes)
                starts = base + np.concatenate([[0], np.cumsum(file.count)[:-1]]) if len(file.count) else file.count
                ids, crc, rows, size = [], [], [], 0

                def batch():
                    known = file.known[rows] == 1
                    cols = {"doc_id": pa.array(file.doc_id[rows], pa.int64(), mask=~known), "start": pa.array(starts[rows], pa.int64()),
                            "n_tokens": pa.array(file.count[rows], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
                    return pa.RecordBatch.from_pydict(cols)
                for r, _, x in file.rows():
                    rows.append(r)
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(x.astype(np.int32))
                    size += len(x)
                    if size >= 1 << 20:
                        yield batch()
                        ids, crc, rows, size = [], [], [], 0
                if rows:
                    yield batch()
                file.close()
    return run


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, on demand, ``ids`` of every
    document, read back from the files; a file is read frame by frame."""
    files = with_starts(manifest).repartition(max(1, manifest.count()), "path")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return files.mapInArrow(_read(with_ids), schema + (", ids array<int>" if with_ids else ""))
