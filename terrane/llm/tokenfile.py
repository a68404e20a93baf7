"""Token ids in binary files of independent zstandard frames.

A file holds the documents of one range of doc_id, in ascending order: a frame for
each document (its ids and the closing id 0 as little-endian unsigned 32-bit integers,
with zstandard's own content checksum), a skippable frame with the doc_ids, and the
trailing seek table of the public seekable format: for each frame its compressed size,
its size and the low half of the XXH64 of its content. A reader takes the last bytes of
the file, finds the frames it wants and decompresses only those.

Encoding is the tokenizers library's, piece by piece: texts whose characters all lie in
the Latin blocks are cut by ``pretoken``, and each new piece goes to the library once;
other texts go to the library whole.

Files are written under a name of the attempt and then renamed, so a task that runs
again, or twice, leaves one whole file. Ranges come from Spark's range partitioning.

Edge cases: null and empty texts are frames of the one closing id; null doc_ids come
first; equal doc_ids are ordered by a hash of their text; an empty table writes one
empty file or none and gives an empty result.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm.bpe import PieceCache, encode_texts, slabs
from terrane.llm.runtime import new_path, small_batches, written
from terrane.llm.textops import text_buffer

#: Numbers of the public seekable format (fixed values).
SKIPPABLE_SEEK, SKIPPABLE_IDS, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
END_ID, LEVEL = 0, 3
#: Characters from here on go to the library in whole texts.
LATIN_END = 0x250


class LibraryCache(PieceCache):
    """Pieces encoded by the tokenizers library."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_new(self, data, starts, ends):
        b = data.tobytes()
        ids = self.whole([b[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.int32, int(size.sum()))
        return flat, np.cumsum(size) - size, size


@functools.lru_cache(maxsize=2)
def library(path: str) -> LibraryCache:
    return LibraryCache(path)


def encode_documents(cache: LibraryCache, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Ids of each text as the library gives them."""
    n = len(offs) - 1
    # bytes from 0xC9 0x90 on begin the characters that aren't Latin
    far = (data > 0xC9) | ((data == 0xC9) & (np.r_[data[1:], 0][: len(data)] >= 0x90))
    total = np.r_[0, np.cumsum(far)]
    apart = (total[offs[1:]] - total[offs[:-1]]) > 0
    size = np.where(apart, 0, np.diff(offs))
    near = data[np.repeat(~apart, np.diff(offs))] if apart.any() else data
    ids, count = encode_texts(cache, near, np.r_[0, np.cumsum(size)])
    out = np.split(ids, np.cumsum(count)[:-1]) if n else []
    for i in np.flatnonzero(apart).tolist():
        out[i] = np.array(cache.whole([data[offs[i] : offs[i + 1]].tobytes().decode()])[0], np.int32)
    return out


class FrameWriter:
    """Frames one by one; close() adds the doc_ids and the seek table."""

    def __init__(self, sink: BinaryIO) -> None:
        self.sink, self.entries, self.ids = sink, [], []
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.press.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        ids = b"".join(struct.pack("<?q", i is not None, i or 0) for i in self.ids)
        self.sink.write(struct.pack("<II", SKIPPABLE_IDS, len(ids)) + ids)
        entries = [*self.entries, (len(ids) + 8, 0, 0)]
        table = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 1 << 7, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Random access by the seek table; only requested frames are read and decompressed."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags >> 7:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        self.size, self.length, self.check = table[:-1, 0].astype(np.int64), table[:-1, 1].astype(np.int64), table[:-1, 2]
        self.start = np.cumsum(self.size) - self.size
        raw = self._at(int(self.size.sum()) + 8, int(table[-1, 0]) - 8)
        self.ids = [i if has else None for has, i in struct.iter_unpack("<?q", raw)]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> bytes:
        """The content of frame k, both checksums verified."""
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.start[k]), int(self.size[k])), max_output_size=int(self.length[k]))
        if len(content) != self.length[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != int(self.check[k]):
            raise ValueError(f"frame {k} doesn't agree with its checksum")
        return content


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> tuple[str, DataFrame]:
    """Writes the token files; returns their folder and the manifest (part, file, n_docs, n_ids)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{part:06d}.tok", f"{root}/.{part:06d}-{task.taskAttemptId()}"
        cache, n_docs, n_ids = library(path), 0, 0
        with store.open_output_stream(own) as sink:
            out = FrameWriter(sink)
            for batch in batches:
                data, offs = text_buffer(batch.column(1))
                doc_ids = batch.column(0).to_pylist()
                for k, j in slabs(offs):
                    for i, ids in zip(doc_ids[k:j], encode_documents(cache, data[offs[k] : offs[j]], offs[k : j + 1] - offs[k])):
                        out.add(i, np.r_[ids, END_ID].astype("<u4").tobytes())
                        n_docs, n_ids = n_docs + 1, n_ids + len(ids) + 1
            out.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": f"part-{part:06d}.tok", "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return folder, written(rows.mapInArrow(kernel, "part long, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(folder: str, manifest: DataFrame, doc_ids: tuple[int, ...] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, or of the requested ones, from the files."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    frames = FrameReader(source)
                    size = frames.length // 4
                    start = row["base"] + np.cumsum(size) - size
                    take = [k for k, i in enumerate(frames.ids) if wanted is None or i in wanted]
                    crc = [zlib.crc32(frames.read(k)) for k in take]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([frames.ids[k] for k in take], pa.int64()), pa.array(start[take].astype(np.int64)), pa.array(size[take].astype(np.int64)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return files.repartition(n, "file").select("file", "base").mapInArrow(kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5(docs: DataFrame, path: str) -> DataFrame:
    return read_tokens(*write_tokens(docs, path))
