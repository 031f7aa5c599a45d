"""Token ids in fixed-width bit-packed files.

A file holds documents in ascending id order.  Ids take ``width`` bits each,
the fewest that hold the vocabulary, least significant bit first, in blocks of
``BLOCK`` ids that start on a byte.  Layout, little-endian:

    header   8 bytes magic, u32 version, u32 width, u32 ids in a block,
             u32 flags (0), u64 documents, u64 ids, u64 position of the index
    blocks   packed ids
    index    u64 position of each block and of the end of the last;
             i64 document ids; u8 whether the id is known (not null);
             u64 start of each document in the file's id stream, and its end

A block is found by its offset and unpacked by numpy, so any document, or any
id range, is read without the rest of the file.

Each partition writes one file under a name of its own attempt; only files
named in the manifest, which Spark commits, count, so a lost executor leaves
unused files and never a wrong result.

Defined results: a null text is empty and gives the end id alone; rows with a
null id come first; rows of equal id keep an order by the hash of their text; an empty table
gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import column_texts, new_path, ship, stored, table, taken, text_key, wanted
from basalt.llm.tokens import tokenizer, vocabulary_path

MAGIC = b"BSLTIDS1"
VERSION = 1
BLOCK = 4096
#: Ids that are unpacked at once when a file is read from end to end.
RUN = 1 << 18
_HEADER = struct.Struct("<8sIIIIQQQ")


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Least significant bit first, padded to a byte."""
    if width == 16:
        return ids.astype("<u2").tobytes()
    if width == 32:
        return ids.astype("<u4").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (16, 32):
        return np.frombuffer(data, "<u2" if width == 16 else "<u4", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)


class Writer:
    """Appends documents; holds one block of ids and the document index."""

    def __init__(self, out, width: int):
        self.out, self.width, self.held, self.held_n = out, width, [], 0
        self.at, self.blocks, self.docs, self.known, self.starts, self.n = _HEADER.size, [], [], [], [0], 0
        out.write(_HEADER.pack(MAGIC, VERSION, width, BLOCK, 0, 0, 0, 0))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.n += len(ids)
        self.starts.append(self.n)
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ids[i : i + BLOCK])
            self.held, self.held_n = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        """The index and a trailer with its position; the header's counts stay 0, as object stores can't seek back."""
        if self.held_n:
            self._block(np.concatenate(self.held))
        index = np.array([*self.blocks, self.at], "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
        index += np.array(self.known, np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(index)
        self.out.write(_HEADER.pack(MAGIC, VERSION, self.width, BLOCK, 0, len(self.docs), self.n, self.at))
        self.out.close()


class Reader:
    """Random access to documents and id ranges of one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        magic, version, self.width, self.block, _, self.n_docs, self.n_ids, at = _HEADER.unpack(self._read(size - _HEADER.size, _HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a packed id file, or not a whole one")
        index, blocks = self._read(at, size - _HEADER.size - at), -(-self.n_ids // self.block)
        cut = np.cumsum([0, 8 * (blocks + 1), 8 * self.n_docs, self.n_docs, 8 * (self.n_docs + 1)])
        part = [index[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.blocks, self.docs = np.frombuffer(part[0], "<u8").astype(np.int64), np.frombuffer(part[1], "<i8")
        self.known, self.starts = np.frombuffer(part[2], np.uint8).astype(bool), np.frombuffer(part[3], "<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(n))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file's stream."""
        if start >= end:
            return np.empty(0, np.uint32)
        lo, hi = start // self.block, -(-end // self.block)
        data, base = self._read(self.blocks[lo], self.blocks[hi] - self.blocks[lo]), self.blocks[lo]
        out = []
        for b in range(lo, hi):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(data[self.blocks[b] - base : self.blocks[b + 1] - base], self.width, n))
        return np.concatenate(out)[start - lo * self.block : end - lo * self.block]

    def runs(self, most: int = RUN) -> Iterator[tuple[int, int]]:
        """Consecutive documents [lo, hi) that cover the file, of about ``most`` ids each or one document."""
        lo = 0
        while lo < self.n_docs:
            hi = max(lo + 1, int(np.searchsorted(self.starts, self.starts[lo] + most, side="right")) - 1)
            yield lo, hi
            lo = hi

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_ids(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Writes the files under ``folder``; the manifest (part, file, n_docs, n_ids), one row a file."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = _at(folder)
        writer, own = None, f"{base}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        encode = tokenizer(vocabulary)
        for batch in batches:
            for doc_id, ids in zip(taken(batch, "doc_id").to_pylist(), encode.encode_all(column_texts(batch, "text")), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = Writer(fs.open_output_stream(own), width_of(encode.size))
                writer.add(doc_id, np.frombuffer(ids, "<u4"))
        if writer is not None:
            writer.close()
            row = [[task.partitionId()], [folder.rstrip("/") + own.removeprefix(base)], [len(writer.docs)], [writer.n]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "file", "n_docs", "n_ids"])

    # rows of one id are dealt by the hash of their text and then their number, so a frequent id is split;
    # rows of equal id and text are interchangeable
    rows = wanted(docs, doc_id="bigint", text="string").withColumns({"text_key": text_key(), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "text_key", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_key", "text").select("doc_id", "text")
    return ordered.mapInArrow(write, "part bigint, file string, n_docs bigint, n_ids bigint")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; needs the column ``base``, ids in the files before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(taken(batch, "file").to_pylist(), taken(batch, "base").to_pylist(), strict=True):
                fs, path = _at(uri)
                with fs.open_input_file(path) as f:
                    reader = Reader(f)
                    for lo, hi in reader.runs():
                        at = reader.starts[lo : hi + 1] - reader.starts[lo]
                        ids = memoryview(reader.ids(reader.starts[lo], reader.starts[hi]).astype("<u4").tobytes())
                        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.docs[lo:hi], mask=~reader.known[lo:hi]),
                                pa.array(reader.starts[lo:hi] + base),
                                pa.array(np.diff(reader.starts[lo : hi + 1])),
                                pa.array(crc, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return manifest.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The round trip: files are written, then each document comes from them.

    The running sum over the manifest has one row a file; its window is global,
    over as many rows as there are files.
    """
    spark = docs.sparkSession
    manifest, _ = stored(write_ids(docs, new_path(spark, "ids"), vocabulary), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = max(1, manifest.count())
    return read_ids(placed.repartition(files, "part"))


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"), vocabulary_path())
