"""Nearest neighbours by an inverted file with an adaptive dimension scan.

Vectors are turned by a fixed random rotation and dealt to the lists of a
k-means fitted on ``SAMPLE`` rows (those of least hash of their ids).  Every
row is indexed.  A query probes its nearest lists: as many as hold ``COVERED``
of the true neighbours of rows of the sample within the sample, which is sparser
than the table and so asks for more rather than fewer (``Index.probed`` tells
the number).

Within a list the rotated vectors are read in blocks of ``COLUMNS`` columns, for
a batch of queries at a time: after d of D columns the partial squared distance
times D/d estimates the whole, and a candidate whose estimate exceeds
(1 + EPSILON/sqrt(d)) times the query's tenth best distance so far is abandoned.
While many candidates are left a block of columns is one matrix product; once few are,
only they are read on.  The first such distance comes from ``SEEDS`` rows of the
fitted sample, and the seeds nearest a query are among its found candidates, so
it has as many as it should whatever is abandoned.  Scores are computed on the
original vectors in double precision.

Lists are put together to blocks of rows, and a list longer than a block is
split by the hash of the id, so that one vector held by a third of all rows is
dealt to many tasks.  A task holds one block; a query's vector is sent once to
each block that has a list it probes.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, vectors of another length than the most common one, and rows without
an id take no part.  Rows of one id count once, with the nearest of their
vectors; a query's own id is no candidate.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import parts, ship, stored, table, taken

K = 10
QUERY_EVERY = 100
SAMPLE = 8192
MAX_LISTS = 1024
#: The share of neighbours that probing is chosen to find in the sample, the rows that tell, and the least number of lists.
COVERED, TELLING, LEAST_PROBED = 0.98, 512, 16
COLUMNS = 16
EPSILON = 2.1
#: Candidates are read on one by one once their share falls below this.
FEW = 0.2
BLOCK_ROWS = 32_768
BATCH = 64
SLICE = 4096
SEEDS = 2048
SEED = 42


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that take part."""
    v = F.col("v")
    named = rows.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.col("`embedding`").cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return named.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct rows."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    c = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        near = _squares(sample, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    col = taken(batch, "v")
    return np.frombuffer(b"".join(col.to_pylist()), "<f8").reshape(-1, dims) if pa.types.is_binary(col.type) else np.asarray(col.flatten()).reshape(-1, dims)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest, each id once, ties to the smaller id."""
    order = np.lexsort((ids, scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return order[first[:k]]


class Block:
    """Rows of one or more lists: ids, original and rotated vectors, sorted by list."""

    def __init__(self, ids: np.ndarray, lists: np.ndarray, vectors: np.ndarray, turn: np.ndarray):
        order = np.argsort(lists, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.turned = self.vectors @ turn
        found, first = np.unique(lists[order], return_index=True)
        ends = np.append(first[1:], len(lists))
        self.span = {li: (a, b) for li, a, b in zip(found.tolist(), first.tolist(), ends.tolist(), strict=True)}

    def _near(self, lo: int, hi: int, turned: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of rows lo..hi whose distance isn't told to be beyond the query's limit."""
        x, dims = self.turned[lo:hi], self.turned.shape[1]
        whole: np.ndarray | None = np.zeros((len(turned), hi - lo))
        q = r = partial = np.empty(0, np.int64)
        for c in range(0, dims, COLUMNS):
            d = min(c + COLUMNS, dims)
            # rotation and the sample's bound are rounded: a hair's breadth of slack keeps ties
            factor = 1 + EPSILON / np.sqrt(d) if d < dims else 1 + 1e-9
            most = (factor * limit) ** 2 * (d / dims) + 1e-18
            if whole is not None:
                whole += _squares(turned[:, c:d], x[:, c:d])
                # a product of matrices rounds more than a difference does
                live = whole <= most[:, None] + 1e-9 * (1 + whole)
                if live.mean() < FEW or d == dims:
                    q, r = np.nonzero(live)
                    partial, whole = whole[q, r], None
                else:
                    whole[~live] = np.inf
            else:
                diff = x[r, c:d] - turned[q, c:d]
                partial = partial + np.einsum("ij,ij->i", diff, diff)
                live = partial <= most[q] + 1e-9 * (1 + partial)
                q, r, partial = q[live], r[live], partial[live]
            if whole is None and not len(q):
                break
        return q, r + lo

    def search(self, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, bounds: np.ndarray, probes: list[list[int]], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of the nearest rows found in the lists that it probes."""
        turned, limit = queries @ turn, bounds * (1 + 1e-9)
        found = [(np.empty(0, np.int64), np.empty(0)) for _ in query_ids]
        asked: dict[int, list[int]] = {}
        for i, lists in enumerate(probes):
            for li in lists:
                asked.setdefault(li, []).append(i)
        for li, who in asked.items():
            if li not in self.span:
                continue
            start, end = self.span[li]
            own = np.array(who)
            for lo in range(start, end, SLICE):
                q, r = self._near(lo, min(lo + SLICE, end), turned[own], limit[own])
                q = own[q]
                other = self.ids[r] != query_ids[q]
                q, r = q[other], r[other]
                if not len(q):
                    continue
                diff = self.vectors[r] - queries[q]
                score = np.sqrt((diff * diff).sum(1))
                cut = np.searchsorted(q, np.unique(q))
                for i, a, b in zip(q[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(q)], strict=True):
                    ids, scores = np.concatenate([found[i][0], self.ids[r[a:b]]]), np.concatenate([found[i][1], score[a:b]])
                    top = _best(ids, scores, k)
                    found[i] = ids[top], scores[top]
                    if len(top) == k:
                        limit[i] = min(limit[i], float(scores[top[-1]]) * (1 + 1e-9))
        return found


def lists_to_probe(sample: np.ndarray, centers: np.ndarray) -> int:
    """The nearest lists that a query must probe to meet ``COVERED`` of the neighbours that rows of the sample have in it."""
    some = sample[:TELLING]
    apart = _squares(some, sample)
    apart[np.arange(len(some)), np.arange(len(some))] = np.inf
    k = min(K, len(sample) - 1)
    if k < 1:
        return len(centers)
    near = np.argpartition(apart, k - 1, axis=1)[:, :k]
    home = _squares(sample, centers).argmin(1)
    rank = np.empty((len(some), len(centers)), np.int64)
    np.put_along_axis(rank, _squares(some, centers).argsort(axis=1, kind="stable"), np.arange(len(centers))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1).reshape(-1))
    return int(needed[int(np.ceil(COVERED * len(needed))) - 1]) + 1


class Index:
    """What every task needs: rotation, centroids, list sizes, blocks, and seeds for first bounds."""

    def __init__(self, sample_ids: np.ndarray, sample: np.ndarray, rows: int):
        self.dims = sample.shape[1]
        lists = int(min(MAX_LISTS, max(1, round(rows**0.5)), len(sample)))
        self.turn, self.centers = rotation(self.dims), centroids(sample, lists)
        self.probed = min(len(self.centers), max(LEAST_PROBED, lists_to_probe(sample, self.centers)))
        self.ids, self.seeds = sample_ids[:SEEDS], sample[:SEEDS]
        self.sizes = np.zeros(len(self.centers), np.int64)
        self.first_block = np.zeros(len(self.centers), np.int64)
        self.splits = np.ones(len(self.centers), np.int64)

    def deal(self, most: int) -> int:
        """Puts lists together to blocks of about ``most`` rows, and splits longer ones; the number of blocks."""
        at = held = 0
        for li, size in enumerate(self.sizes.tolist()):
            if size > most:
                at += held > 0
                self.first_block[li], self.splits[li] = at, -(-size // most)
                at, held = at + int(self.splits[li]), 0
            else:
                if held + size > most:
                    at, held = at + 1, 0
                self.first_block[li], held = at, held + size
        return at + (held > 0)

    def nearest_list(self, v: np.ndarray) -> np.ndarray:
        return _squares(v, self.centers).argmin(1)

    def probes(self, v: np.ndarray) -> list[dict[int, list[int]]]:
        """For each vector its lists by block: the nearest ``probed``, and on until they hold more than k rows."""
        out = []
        for order in _squares(v, self.centers).argsort(axis=1, kind="stable"):
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), 2 * K + 1)) + 1
            by_block: dict[int, list[int]] = {}
            for li in order[: max(self.probed, enough)].tolist():
                if self.sizes[li]:
                    for s in range(int(self.splits[li])):
                        by_block.setdefault(int(self.first_block[li]) + s, []).append(li)
            out.append(by_block)
        return out

    def first(self, query_ids: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of each vector's nearest seeds."""
        near = _squares(v, self.seeds)
        near[query_ids[:, None] == self.ids[None, :]] = np.inf
        out = []
        for row, x in zip(near, v, strict=True):
            some = np.flatnonzero(row <= np.partition(row, min(2 * K, len(row) - 1))[min(2 * K, len(row) - 1)])
            some = some[np.isfinite(row[some])]
            diff = self.seeds[some] - x
            d = np.sqrt((diff * diff).sum(1))
            top = _best(self.ids[some], d, K)
            out.append((self.ids[some][top], d[top]))
        return out


def build_index(rows: DataFrame) -> tuple[DataFrame, Index | None]:
    """The usable rows with their lists, stored, and the index; None if there are no rows."""
    spark = rows.sparkSession
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if common is None:
        return rows, None
    rows = rows.where(F.size("v") == common["n"])
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    index = Index(np.array([r["vec_id"] for r in fit]), np.array([r["v"] for r in fit], np.float64), common["c"])
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, shared.value.dims)
            near = shared.value.nearest_list(v) if len(v) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([taken(batch, "vec_id"), pa.array(near, pa.int32()), pa.array([x.tobytes() for x in v.astype("<f8")], pa.binary())], ["vec_id", "list", "v"])

    dealt, _ = stored(rows.mapInArrow(assign, "vec_id bigint, list int, v binary"), "lists")
    for r in dealt.groupBy("list").agg(F.count("*").alias("n")).collect():
        index.sizes[r["list"]] = r["n"]
    return dealt, index


def nearest(embeddings: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by QUERY_EVERY."""
    spark = embeddings.sparkSession
    ship(spark)
    dealt, index = build_index(usable(embeddings))
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = parts(spark)
    blocks = index.deal(int(min(BLOCK_ROWS, max(256, 2 * int(index.sizes.sum()) // n))))
    shared = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and SEEDS rows
    result = "query_id bigint, vec_id bigint, score double"

    def rows_of(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        size = [len(ids) for _, ids, _ in found]
        q = np.repeat(np.array([i for i, _, _ in found], np.int64), size)
        ids, scores = (np.concatenate([f[j] for f in found]) if found else np.empty(0, t) for j, t in ((1, np.int64), (2, np.float64)))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """Queries a few at a time: ids, vectors, and the vectors' bytes."""
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                yield np.asarray(taken(part, "vec_id")), _matrix(part, shared.value.dims), taken(part, "v").to_pylist()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.list_(pa.int32()))
        for ids, v, raw in some(batches):
            rows = []
            for query_id, data, (near, scores), lists in zip(ids.tolist(), raw, index.first(ids, v), index.probes(v), strict=True):
                bound = float(scores[-1]) if len(near) == K else float("inf")
                rows += [(block, 1, query_id, data, bound, own) for block, own in lists.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["block", "kind", "vec_id", "v", "bound", "lists"])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, _ in some(batches):
            yield rows_of([(i, *f) for i, f in zip(ids.tolist(), shared.value.first(ids, v), strict=True)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, kind): a block's vectors, then the queries that probe it."""
        index = shared.value
        at, held, asked, built = None, [], [], None

        def answer() -> pa.RecordBatch:
            nonlocal held, asked, built
            if built is None and held:
                ids, vectors, lists = zip(*held, strict=True)
                built, held = Block(np.array(ids, np.int64), np.array(lists), np.frombuffer(b"".join(vectors), "<f8").reshape(-1, index.dims), index.turn), []
            ids, vectors, bounds, lists = zip(*asked, strict=True)
            asked = []
            if built is None:
                return rows_of([])
            own = np.array(ids, np.int64)
            found = built.search(own, np.frombuffer(b"".join(vectors), "<f8").reshape(-1, index.dims), index.turn, np.array(bounds), list(lists), k)
            return rows_of([(i, *f) for i, f in zip(ids, found, strict=True)])

        for batch in batches:
            for block, kind, vec_id, data, bound, lists in zip(*(taken(batch, c).to_pylist() for c in ("block", "kind", "vec_id", "v", "bound", "lists")), strict=True):
                if block != at:
                    if asked:
                        yield answer()
                    at, held, built = block, [], None
                if not kind:
                    held.append((vec_id, data, lists[0]))
                    continue
                asked.append((vec_id, data, bound, lists))
                if len(asked) >= BATCH:
                    yield answer()
        if asked:
            yield answer()

    # a list's first block and its number of blocks, by the list's number
    of = lambda numbers: F.element_at(F.array(*(F.lit(int(x)) for x in numbers)), F.col("list") + 1)
    block = (of(index.first_block) + F.pmod(F.xxhash64("vec_id"), of(index.splits))).cast("int")
    kept = dealt.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("bound"), F.array("list").alias("lists"))
    queries = dealt.where(F.col("vec_id") % QUERY_EVERY == 0).select("vec_id", "v")
    asked_of = queries.mapInArrow(probe, "block int, kind int, vec_id bigint, v binary, bound double, lists array<int>")
    met = kept.unionByName(asked_of).repartition(max(n, blocks), "block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(search, result).unionByName(queries.mapInArrow(seeded, result))
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
