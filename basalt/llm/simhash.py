"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of eight one-byte segments.  If two
fingerprints differ in at most 3 bits, the pigeonring principle (strong form)
gives a start from which every chain of l consecutive segments differs in at
most floor(3 l / 8) bits: 0 for one and two segments, 1 up to five, 2 up to
seven.  The first five steps become equality keys: a start (8) and the one
segment among the third to fifth that may differ (3), that is 24 keys of 32
compared bits.  Fingerprints that share a key are candidates; the budgets of
five and seven segments prune them before the full Hamming distance.

Defined results: a null text is empty; an empty text has fingerprint 0 and is
linked like any other; null ids are kept and never name a component unless all
its ids are null; repeated rows are all returned; an empty table gives no rows.
Exact copies meet before the search (one row per fingerprint).  A key shared by
more than ``BLOCK`` fingerprints is dealt out as pairs of blocks, so a task
holds two blocks at most and no comparison is lost; each run of a key gives a
spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import column_bytes, lean, parts, ship, stored, table, taken, text_key, wanted
from basalt.llm.components import components
from basalt.names import free

SHINGLE = 3
SEED = 42
MAX_DIFF = 3
SEGMENTS = 8
BLOCK = 2048
_CHUNK = 1 << 15


def _hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, a bounded number at a time."""
    if len(words) < SHINGLE:
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(words) - SHINGLE + 1, _CHUNK):
        some = words[i : i + _CHUNK + SHINGLE - 1]
        joined = b" ".join(some)
        size = np.fromiter(map(len, some), np.int64, len(some))
        end = np.cumsum(size + 1) - 1
        start = end - size
        spans = zip(start[: len(some) - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def fingerprint(text: bytes) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    total, counts = 0, np.zeros(64, np.int64)
    for h in _hashes(text.lower().split()):
        total += len(h)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x) for x in column_bytes(batch, "text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([taken(batch, "doc_id"), taken(batch, "text_key"), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = wanted(docs, doc_id="bigint", text="string").withColumn("text_key", text_key())
    return rows.mapInArrow(lean(_print_batches), "doc_id bigint, text_key bigint, fp bigint")


def ring_keys(fp: str) -> list:
    """The 24 chain keys of a fingerprint column: tag in the high bits, five segments with one blanked below."""
    keys = []
    for i in range(SEGMENTS):
        turn = 8 * i
        ring = F.col(fp) if not turn else F.shiftleft(F.col(fp), turn).bitwiseOR(F.shiftrightunsigned(F.col(fp), 64 - turn))
        chain = F.shiftrightunsigned(ring, 24)
        for j in (2, 3, 4):
            keep = ((1 << 40) - 1) & ~(0xFF << (8 * (4 - j)))
            keys.append(chain.bitwiseAND(F.lit(keep)).bitwiseOR(F.lit((3 * i + j - 2) << 40)))
    return keys


def _mask(start: int, length: int) -> np.uint64:
    """The bits of ``length`` segments of the ring from ``start``; segment 0 is the top byte."""
    return np.uint64(sum(0xFF << (56 - 8 * ((start + k) % SEGMENTS)) for k in range(length)))


_FIVE = [_mask(i, 5) for i in range(SEGMENTS)]
_SEVEN = [_mask(i, 7) for i in range(SEGMENTS)]


def _forest(prints: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links between those that are within the distance, as stars around each least member."""
    prints = np.sort(prints.view(np.int64)).view(np.uint64)
    n = len(prints)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for lo in range(0, n, 256):
        x = prints[lo : lo + 256, None] ^ prints[None, :]
        a, b = np.nonzero(np.bitwise_count(x & _FIVE[start]) <= 1)
        above = a + lo < b
        a, b = a[above], b[above]
        d = x[a, b]
        chain = np.bitwise_count(d & _SEVEN[start]) <= 2
        a, b, d = a[chain], b[chain], d[chain]
        near = np.bitwise_count(d) <= MAX_DIFF
        for i, j in zip((a[near] + lo).tolist(), b[near].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
    signed = prints.view(np.int64)
    return [(int(signed[r]), int(signed[i])) for i in range(n) if (r := find(i)) != i]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (k, p, q); a run of those three is one comparison task."""

    def runs(k: np.ndarray, fp: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        if len(two):
            lo, hi = np.minimum(fp[two], fp[two + 1]), np.maximum(fp[two], fp[two + 1])
            x = (lo ^ hi).view(np.uint64)
            start = (k[two] >> 40) // 3
            ok = (np.bitwise_count(x & np.array(_FIVE)[start]) <= 1) & (np.bitwise_count(x & np.array(_SEVEN)[start]) <= 2)
            ok &= (np.bitwise_count(x) <= MAX_DIFF) & (lo != hi)
            out += zip(lo[ok].tolist(), hi[ok].tolist(), strict=True)
        for i in np.flatnonzero(size > 2).tolist():
            out += _forest(fp[cut[i] : cut[i + 1]].view(np.uint64), int(k[cut[i]] >> 40) // 3)
        return out

    held: list[np.ndarray] = [np.empty((4, 0), np.int64)]
    for batch in batches:
        rows = np.stack([np.asarray(taken(batch, c)).astype(np.int64) for c in ("k", "p", "q", "fp")])
        rows = np.concatenate([*held, rows], axis=1)
        if not rows.shape[1]:
            continue
        cut = np.flatnonzero(np.any(rows[:3, 1:] != rows[:3, :-1], axis=0)) + 1
        done = int(cut[-1]) if len(cut) else 0
        held = [rows[:, done:]]
        if done:
            yield _pairs(runs(rows[0, :done], rows[3, :done], np.concatenate([[0], cut])))
    last = held[0]
    if last.shape[1]:
        yield _pairs(runs(last[0], last[3], np.array([0, last.shape[1]])))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): a forest that joins all distinct fingerprints (column fp) within MAX_DIFF bits."""
    keyed = prints.select("fp", F.explode(F.array(*ring_keys("fp"))).alias("k"))
    shared = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = keyed.join(shared, "k").select("k", "fp", blocks.alias("b"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    # a block meets itself and each other block once: rows (min, max) of the two
    dealt = met.select("k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")
    dealt = dealt.repartition(parts(prints.sparkSession), "k", "p", "q").sortWithinPartitions("k", "p", "q")
    return dealt.mapInArrow(lean(_link_batches), "a bigint, b bigint")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored rows (doc_id, fp and what else ``fingerprints`` passes), and fp's component: (known, root, component_id)."""
    marked, _ = stored(fingerprints(docs), "prints")
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots, _ = components(links(reps.select("fp")))
    named = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, named.select(F.col("fp").alias("known"), "root").join(whole, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the least doc_id that links reach."""
    marked, known = _grouped(docs)
    out = marked.join(known, F.col("fp") == F.col("known"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component: the least id, known ids first, then the least text key.

    Rows repeated with one id and one text are one.
    """
    marked, known = _grouped(docs)
    id_, key, kept_id, kept_key = free("id", "key", "kept_id", "kept_key", of=(docs,))
    no_id = F.lit(-(1 << 63))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce("doc_id", no_id).alias(kept_id), F.col("text_key").alias(kept_key)))
    kept = marked.join(known, F.col("fp") == F.col("known")).groupBy("root").agg(best.alias("best")).select(f"best.{kept_id}", f"best.{kept_key}")
    rows = docs.withColumns({id_: F.coalesce(F.col("`doc_id`").cast("bigint"), no_id), key: text_key()})
    met = rows.join(kept, (F.col(id_) == F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return met.dropDuplicates([id_, key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
