"""Removal of word passages that repeat, with a count-min prefilter.

The documents are written once as chunks of about ``CHUNK_BYTES`` bytes in the
shared folder; a chunk is what every pass reads whole, so a pass may run on
other executors, or again, and still meets the same chunks.

Pass 1: every chunk sketches its windows (``WINDOW`` consecutive words) into a
count-min sketch of two rows.  A chunk's sketch travels as sorted cell numbers,
a byte or two each, dealt by cell range; each range is merged on its own, and
tells each chunk one bit for each cell that it sent: whether two windows or more
of the corpus fell there.  The estimate never undercounts, so a window without
both bits occurs once.  The sketch has at least four cells a word in each row
at every size, and a range holds 2^``RANGE_BITS`` cells, so ranges grow in
number with the corpus, and no task holds more than one range, or the answers
to one chunk.

Pass 2: only windows with both bits are grouped exactly, by a 128-bit key of
their word sequence.  A chunk first groups its own: a key that occurs in it
twice is known to repeat, and is sent once, so a hot window costs a row for
each chunk and not for each copy.  Keys are dealt by range, and what turns out
repeated goes back as word positions to its chunk.

Pass 3: every chunk drops the words that its repeated windows cover.

Answers and positions go back to their chunks through files by chunk number, so
no text is shuffled in any pass.

Defined results: a null text has no words; texts under ``WINDOW`` words keep
all; repeated rows and null ids are judged like other rows, each copy by its
own windows; a text longer than a chunk is a chunk of its own; an empty table
gives no rows.  Windows are compared by their keys: the two are polynomials of
64-bit hashes of the words, so two windows count as equal by chance only where
the hashes of two different words are equal (about w^2 / 2^65 for w different
words) or both polynomials are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import column_bytes, delete_path, new_path, parts, ship, stored, table, taken, wanted

WINDOW = 35
ROWS = 2
CELLS_PER_WORD = 4
LEAST_BITS, RANGE_BITS = 16, 23
CHUNK_BYTES = 6 << 20
#: Candidate windows that one key range is meant to hold.
KEYS_PER_RANGE = 500_000
#: Words of the corpus for each task of a shuffle.
TASK_WORDS = 16_000_000
_SLICE = 256
# Odd multipliers of the two polynomial hashes, and of the finishing mix.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    """word -> 64-bit hash; a bounded table."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 0)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = h
        return h


_hash_of = _WordHash()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _powers[base] = (pair[0], pair[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def window_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each window of a sequence of word hashes."""
    n, out = len(words), []
    for base, w in zip(_BASES, (words, _mixed(words)), strict=True):
        up, down = _power(base, n)
        total = np.cumsum(w * up, dtype=np.uint64)
        at = np.concatenate([total[WINDOW - 1 : WINDOW], total[WINDOW:] - total[:-WINDOW]])
        out.append(_mixed(at * down[: n - WINDOW + 1]))
    return out[0], out[1]


def rising(values: np.ndarray) -> bytes:
    """Sorted non-negative numbers as differences, seven bits a byte."""
    d = np.diff(values, prepend=0).astype(np.uint64)
    size = np.maximum(1, -(-np.frexp(d.astype(np.float64))[1] // 7))
    wide = int(size.max(initial=1))
    out = np.empty((len(d), wide), np.uint8)
    for k in range(wide):
        out[:, k] = ((d >> np.uint64(7 * k)) & np.uint64(0x7F)) | (np.uint64(0x80) * (k + 1 < size))
    return out[np.arange(wide) < size[:, None]].tobytes()


def risen(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 0x80
    which = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(raw) else np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.empty(0, np.int64)
    place = np.arange(len(raw)) - first[which]
    d = np.zeros(len(first), np.uint64)
    np.add.at(d, which, (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64))
    return np.cumsum(d).astype(np.int64)


def _rows(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


_CHUNK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.large_binary())])
_LISTED = "chunk bigint, file string, at int, n_words bigint"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _write_chunks(folder: str):
    """Documents into chunks, one file a task; rows (chunk, file, at, n_words), where n_words is at least the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, held, size = TaskContext.get(), [], [], 0
        fs, base = _open(folder)
        name = f"chunks-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = sink = None

        def close() -> None:
            nonlocal writer, sink, held, size
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = pa.ipc.new_file(sink, _CHUNK_SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            ids, texts = zip(*held, strict=True)
            n_words = len(texts) + sum(int(np.count_nonzero(_SPACE[np.frombuffer(t, np.uint8)])) for t in texts)
            out.append(((task.partitionId() << 32) + len(out), name, len(out), n_words))
            writer.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], schema=_CHUNK_SCHEMA))
            held, size = [], 0

        for batch in batches:
            for row in zip(taken(batch, "doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= CHUNK_BYTES:
                    close()
        if held:
            close()
        if writer is not None:
            writer.close()
            sink.close()
        yield _rows(out, ["chunk", "file", "at", "n_words"], [pa.int64(), pa.string(), pa.int32(), pa.int64()])

    return run


def _read_chunks(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(chunk, ids, texts) of the listed chunks."""
    fs, base = _open(folder)
    for batch in batches:
        for chunk, name, at in zip(*(taken(batch, c).to_pylist() for c in ("chunk", "file", "at")), strict=True):
            with fs.open_input_file(f"{base}/{name}") as f:
                rows = pa.ipc.open_file(f).get_batch(at)
                yield chunk, rows.column(0).to_pylist(), rows.column(1).to_pylist()


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position among the chunk's words, first key, second key) of each window within one document."""
    words = [np.fromiter(map(_hash_of.__getitem__, w), np.uint64, len(w)) for w in map(bytes.split, texts)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = int(size.sum())
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = window_keys(np.concatenate(words))
    ends = np.repeat(np.cumsum(size), size)[: n - WINDOW + 1]
    at = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= ends)
    return at, a[at], b[at]


def _ranges(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted cells fall in, and where each begins."""
    of = cells >> width
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    return of[first], np.append(first, len(cells))


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


_SKETCH = ["shard", "chunk", "cells", "twice"]
_SKETCH_SCHEMA = "shard bigint, chunk bigint, cells binary, twice binary"


def _sketch(folder: str, bits: int):
    """A chunk's sketch: for each row and cell range the cells hit, and which of them more than once."""
    width = min(bits, RANGE_BITS)
    ranges = 1 << (bits - width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _read_chunks(folder, batches):
            out = []
            for row, key in enumerate(_windows(texts)[1:]):
                cells = np.sort(_cells(key, bits))
                first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
                twice = np.diff(np.append(first, len(cells))) > 1
                cells = cells[first]
                of, cut = _ranges(cells, width)
                for s, lo, hi in zip(of.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    out.append((row * ranges + s, chunk, rising(cells[lo:hi] - (s << width)), np.packbits(twice[lo:hi]).tobytes()))
            for i in range(0, len(out), _SLICE):
                yield _rows(out[i : i + _SLICE], _SKETCH, [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    return run


_BACK = ["home", "chunk", "shard", "data"]
_BACK_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_BACK_SCHEMA = "home bigint, chunk bigint, shard bigint, data binary"


def home_of(chunk: int, homes: int) -> int:
    """The file that holds what goes back to a chunk."""
    return xxhash.xxh64_intdigest(chunk.to_bytes(8, "little"), 0) % homes


def _answers(bits: int, homes: int):
    """Rows sorted by range: the range's cells are counted, then each chunk gets one bit for each cell that it sent."""
    range_cells = 1 << min(bits, RANGE_BITS)

    def close(shard: int, held: list[tuple[int, np.ndarray]], count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held), _SLICE):
            some = held[i : i + _SLICE]
            yield _rows([(home_of(c, homes), c, shard, np.packbits(count[at] >= 2).tobytes()) for c, at in some], _BACK, _BACK_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        now, held, count = None, [], None
        for batch in batches:
            for shard, chunk, cells, twice in zip(*(taken(batch, c).to_pylist() for c in _SKETCH), strict=True):
                if shard != now:
                    if now is not None:
                        yield from close(now, held, count)
                    now, held, count = shard, [], np.zeros(range_cells, np.uint8)
                at = risen(cells).astype(np.int32)
                more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(at))
                count[at] = np.minimum(count[at] + 1 + more, 2)
                held.append((chunk, at))
        if now is not None:
            yield from close(now, held, count)

    return run


def _write_back(folder: str, joined: Callable[[list[bytes]], bytes]):
    """Rows sorted by (home, chunk, shard): one file for each home, of one entry a chunk and an index; rows (home, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        attempt, files, out, index, held, at, now = TaskContext.get().taskAttemptId(), [], None, [], [], 0, (None, None)

        def entry() -> None:
            nonlocal at, held
            data = joined(held)
            out.write(data)
            index.append((now[1], at, len(data)))
            at, held = at + len(data), []

        def close() -> None:
            entry()
            out.write(np.array(index, "<i8").tobytes() + len(index).to_bytes(8, "little"))
            out.close()

        for batch in batches:
            for home, chunk, data in zip(*(taken(batch, c).to_pylist() for c in ("home", "chunk", "data")), strict=True):
                if home != now[0]:
                    if out is not None:
                        close()
                    fs.create_dir(base, recursive=True)
                    files.append((home, f"{home:06d}-{attempt}"))
                    out, index, at = fs.open_output_stream(f"{base}/{files[-1][1]}"), [], 0
                elif chunk != now[1]:
                    entry()
                now = (home, chunk)
                held.append(data)
        if out is not None:
            close()
        yield _rows(files, ["home", "file"], [pa.int64(), pa.string()])

    return run


def _back(folder: str, files: dict[int, str], chunk: int, homes: int) -> bytes | None:
    """What went back to a chunk."""
    name = files.get(home_of(chunk, homes))
    if name is None:
        return None
    fs, base = _open(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        n = int.from_bytes(f.read_at(8, size - 8), "little")
        index = np.frombuffer(f.read_at(24 * n, size - 8 - 24 * n), "<i8").reshape(n, 3)
        hit = np.searchsorted(index[:, 0], chunk)
        return f.read_at(int(index[hit, 2]), int(index[hit, 1])) if hit < n and index[hit, 0] == chunk else None


def _estimated(answer: np.ndarray, at: int, key: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, int]:
    """For each window its cell's bit in one row of the answers from byte ``at``, and where the next row begins."""
    cells, which = np.unique(_cells(key, bits), return_inverse=True)
    _, cut = _ranges(cells, width)
    told = []
    for n in np.diff(cut).tolist():
        size = -(-n // 8)
        told.append(np.unpackbits(answer[at : at + size], count=n))
        at += size
    return np.concatenate(told)[which] > 0, at


_SENT = ["shard", "chunk", "kind", "data", "more"]
_SENT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_SENT_SCHEMA = "shard bigint, chunk bigint, kind bigint, data binary, more binary"


def _candidates(folder: str, answers: str, files: dict[int, str], homes: int, bits: int, shards: int):
    """Rows of kind 0: keys and positions for a key range.  Kind 1: what repeats within the chunk."""
    shift, width = np.uint64(64 - (shards.bit_length() - 1)), min(bits, RANGE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, texts in _read_chunks(folder, batches):
            at, a, b = _windows(texts)
            if not len(at):
                continue
            data = _back(answers, files, chunk, homes)
            if data is None:
                raise ValueError(f"no answers to chunk {chunk}")
            answer = np.frombuffer(data, np.uint8)
            keep, next_row = _estimated(answer, 0, a, bits, width)
            second, end = _estimated(answer, next_row, b, bits, width)
            if end != len(answer):
                raise ValueError(f"answers to another chunk than {chunk}")
            keep &= second
            at, a, b = at[keep], a[keep], b[keep]
            order = np.lexsort((at, b, a))
            at, a, b = at[order], a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(a)))
            known = np.sort(at[np.repeat(size > 1, size)])
            rows = [(home_of(chunk, shards), chunk, 1, rising(known), None)] if len(known) else []
            at, a, b, many = at[first], a[first], b[first], size > 1
            shard = (a >> shift).astype(np.int64) if shards > 1 else np.zeros(len(a), np.int64)
            order = np.lexsort((at, shard))
            at, a, b, many, shard = at[order], a[order], b[order], many[order], shard[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi > lo:
                    keys = np.stack([a[lo:hi], b[lo:hi]]).astype("<u8").tobytes() + np.packbits(many[lo:hi]).tobytes()
                    rows.append((int(shard[lo]), chunk, 0, keys, rising(at[lo:hi])))
            for i in range(0, len(rows), _SLICE):
                yield _rows(rows[i : i + _SLICE], _SENT, _SENT_KINDS)

    return run


def _release() -> None:
    """A worker that goes on to later stages lets go of what only the scans need."""
    _powers.clear()
    _hash_of.clear()


def _repeated(homes: int):
    """Rows sorted by key range: the positions whose key occurs elsewhere, back to their chunks; kind 1 passes through."""

    def close(held: list[tuple[int, bytes, bytes]]) -> list[tuple]:
        keys, many, at = [], [], []
        for _, data, more in held:
            p = risen(more)
            at.append(p)
            keys.append(np.frombuffer(data, "<u8", 2 * len(p)).reshape(2, -1))
            many.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=16 * len(p)), count=len(p)))
        if not held:
            return []
        size = [len(p) for p in at]
        k, w = np.concatenate(keys, axis=1), np.concatenate(many).astype(np.int64) + 1
        order = np.lexsort((k[1], k[0]))
        a, b = k[0][order], k[1][order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        group = np.cumsum(new) - 1
        twice = np.bincount(group, w[order]) >= 2
        flag = np.empty(len(a), bool)
        flag[order] = twice[group]
        out = []
        for (chunk, _, _), p, f, m in zip(held, at, np.split(flag, np.cumsum(size)[:-1]), many, strict=True):
            told = p[f & (m == 0)]
            if len(told):
                out.append((home_of(chunk, homes), chunk, 0, rising(told)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        now, held = None, []
        for batch in batches:
            for shard, chunk, kind, data, more in zip(*(taken(batch, c).to_pylist() for c in _SENT), strict=True):
                if shard != now:
                    yield _rows(close(held), _BACK, _BACK_KINDS)
                    now, held = shard, []
                if kind:
                    yield _rows([(home_of(chunk, homes), chunk, 1, data)], _BACK, _BACK_KINDS)
                else:
                    held.append((chunk, data, more))
        yield _rows(close(held), _BACK, _BACK_KINDS)

    return run


def _positions(held: list[bytes]) -> bytes:
    return rising(np.unique(np.concatenate([risen(x) for x in held])))


def _keep(folder: str, removed: str, files: dict[int, str], homes: int):
    """Documents without the words that their repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for chunk, ids, texts in _read_chunks(folder, batches):
            hit = risen(_back(removed, files, chunk, homes) or b"")
            out, base = [], 0
            for doc_id, text in zip(ids, texts, strict=True):
                words, gone = text.split(), 0
                n = len(words)
                lo, hi = np.searchsorted(hit, (base, base + n))
                if hi > lo:
                    starts = hit[lo:hi] - base
                    apart = np.flatnonzero(starts[1:] > starts[:-1] + WINDOW) + 1
                    kept, last = [], 0
                    for a, b in zip(starts[np.append(0, apart)].tolist(), (starts[np.append(apart - 1, len(starts) - 1)] + WINDOW).tolist(), strict=True):
                        kept += words[last:a]
                        gone, last = gone + b - a, b
                    words = kept + words[last:]
                base += n
                kept_text = b" ".join(words)
                out.append((doc_id, n, gone, hashlib.sha256(kept_text).hexdigest(), kept_text.decode()))
                if len(out) >= _SLICE:
                    yield _rows(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"], kinds)
                    out = []
            yield _rows(out, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"], kinds)

    return run


def _files(written: DataFrame) -> dict[int, str]:
    """One name for each home; there are as many homes as shuffle partitions."""
    return {r["home"]: r["file"] for r in written.collect()}


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words, joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    chunks, answers, removed = (new_path(spark, x) for x in ("chunks", "answers", "removed"))
    homes = parts(spark)
    listed, _ = stored(wanted(docs, doc_id="bigint", text="string").mapInArrow(_write_chunks(chunks), _LISTED), "listed")
    total = listed.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    bits = max(LEAST_BITS, (CELLS_PER_WORD * total["words"]).bit_length())
    shards = 1 << max(6, (total["words"] // KEYS_PER_RANGE).bit_length())
    # at the least as many tasks as the session asks for, and more for a larger corpus; chunks are dealt evenly, a few to a task
    n = max(homes, total["words"] // TASK_WORDS)
    dealt = listed.repartition(max(1, min(total["chunks"], 4 * n)))

    sketches = dealt.mapInArrow(_sketch(chunks, bits), _SKETCH_SCHEMA)
    bitsets = sketches.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_answers(bits, homes), _BACK_SCHEMA)
    back = bitsets.repartition(n, "home").sortWithinPartitions("home", "chunk", "shard").mapInArrow(_write_back(answers, b"".join), "home bigint, file string")
    files = _files(back)

    sent = dealt.mapInArrow(_candidates(chunks, answers, files, homes, bits, shards), _SENT_SCHEMA)
    told = sent.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_repeated(homes), _BACK_SCHEMA)
    back = told.repartition(n, "home").sortWithinPartitions("home", "chunk").mapInArrow(_write_back(removed, _positions), "home bigint, file string")
    files = _files(back)
    delete_path(spark, answers)
    return dealt.mapInArrow(_keep(chunks, removed, files, homes), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op8_count_min_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
