"""WARC files in replicas, audited by Merkle trees.

Each task writes its pages as one file of gzip members, a WARC 1.1 resource
record each, to every replica.  The manifest, a table that Spark commits, has
for each file the ordered offset ranges of its records, their digests, and the
root of the tree over them; a file that it doesn't name was left by a lost attempt
and doesn't count.

An audit hashes each range of each replica, builds a tree over the ordered
ranges (``FAN`` children a node; offset and length are part of a leaf), and
compares the replicas' roots.  A root that equals the stored one tells an intact
replica, and the others are compared with it, branch by branch: only mismatching
branches are descended, down to the records that are damaged.  Where no replica
is intact, the tree over the manifest's digests takes its place.  A record is read from the
first replica that holds it intact.

Defined results: null html is an empty payload; null ids and urls are kept;
repeated rows are records of their own; an empty table gives no file and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.common import column_bytes, new_path, ship, stored, table, taken, wanted

FAN = 16
REPLICAS = 2
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
RECORDS = 50_000


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """One resource record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    lines = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []),
        f"WARC-Block-Digest: sha256:{digest}",
        "Content-Type: text/html",
        f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def payload_of(data: bytes) -> bytes:
    """The payload of an uncompressed record; an error if its length or digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    if rest != payload + b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("damaged record")
    return payload


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def leaf(offset: int, length: int, stored: bytes) -> bytes:
    return hashlib.sha256(b"\0" + offset.to_bytes(8, "big") + length.to_bytes(8, "big") + hashlib.sha256(stored).digest()).digest()


def tree(leaves: list[bytes]) -> list[list[bytes]]:
    """Levels from the root, a single node, down to the leaves."""
    levels = [leaves]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [hashlib.sha256(b"\1" + b"".join(below[i : i + FAN])).digest() for i in range(0, len(below), FAN)])
    return levels


def differing(a: list[list[bytes]], b: list[list[bytes]]) -> list[int]:
    """Leaves at which two trees of one shape differ; only mismatching branches are looked at."""
    at = [i for i in range(len(a[0])) if a[0][i] != b[0][i]]
    for x, y in zip(a[1:], b[1:], strict=True):
        at = [j for i in at for j in range(i * FAN, min((i + 1) * FAN, len(x))) if x[j] != y[j]]
    return at


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


_MANIFEST = "name string, offsets binary, digests binary, root binary, ids array<bigint>, urls array<string>"


def write_warc(pages: DataFrame, folder: str, replicas: int = REPLICAS) -> DataFrame:
    """Writes ``folder``/replica-i/name for each replica; the manifest, one row a file of RECORDS records at most."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _at(folder)
        task, number = TaskContext.get(), 0
        outs, offsets, digests, ids, urls, name = [], [0], [], [], [], ""

        def close() -> pa.RecordBatch:
            for out in outs:
                out.close()
            cols = [[name], [np.array(offsets, "<i8").tobytes()], [b"".join(digests)], [tree(digests)[0][0]], [ids], [urls]]
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["name", "offsets", "digests", "root", "ids", "urls"])

        for batch in batches:
            for page_id, url, payload in zip(taken(batch, "page_id").to_pylist(), taken(batch, "url").to_pylist(), column_bytes(batch, "html"), strict=True):
                if not outs:
                    name = f"pages-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
                    offsets, digests, ids, urls, number = [0], [], [], [], number + 1
                    for k in range(replicas):
                        fs.create_dir(f"{base}/replica-{k}", recursive=True)
                        outs.append(fs.open_output_stream(f"{base}/replica-{k}/{name}", compression=None))
                data = _member(record(page_id, url, payload))
                for out in outs:
                    out.write(data)
                digests.append(leaf(offsets[-1], len(data), data))
                offsets.append(offsets[-1] + len(data))
                ids.append(page_id)
                urls.append(url)
                if len(ids) >= RECORDS:
                    yield close()
                    outs = []
        if outs:
            yield close()

    return wanted(pages, page_id="bigint", url="string", html="string").mapInArrow(write, _MANIFEST)


def replica_tree(uri: str, offsets: np.ndarray) -> list[list[bytes]] | None:
    """The tree over one replica's file as it is; None if the file is missing.  What a short file lacks hashes as nothing."""
    fs, path = _at(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as f:
        return tree([leaf(lo, hi - lo, f.read(hi - lo)) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])


def damaged(trees: list[list[list[bytes]] | None], root: bytes, leaves: list[bytes]) -> dict[int, list[int]]:
    """record -> the replicas that hold it damaged; ``leaves`` are looked at only where no replica has the root."""
    intact = next((t for t in trees if t is not None and t[0][0] == root), None)
    out: dict[int, list[int]] = {}
    for k, own in enumerate(trees):
        if own is not None and own[0][0] == root:
            continue
        for i in range(len(leaves)) if own is None else differing(intact or tree(leaves), own):
            out.setdefault(i, []).append(k)
    return out


def audit(manifest: DataFrame, folder: str, replicas: int = REPLICAS) -> DataFrame:
    """page_id, url, name, offset, length, n_bytes, payload_sha256, n_replicas, n_damaged, damaged (replica numbers).

    n_bytes and payload_sha256 come from the first intact replica; null if none is.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "name", "offset", "length", "n_bytes", "payload_sha256", "n_replicas", "n_damaged", "damaged"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            for name, raw, digests, root, ids, urls in zip(*(taken(batch, c).to_pylist() for c in ("name", "offsets", "digests", "root", "ids", "urls")), strict=True):
                offsets = np.frombuffer(raw, "<i8")
                leaves = [digests[i : i + 32] for i in range(0, len(digests), 32)]
                bad = damaged([replica_tree(f"{folder}/replica-{k}/{name}", offsets) for k in range(replicas)], root, leaves)
                files, rows = {}, []
                for i, (page_id, url) in enumerate(zip(ids, urls, strict=True)):
                    lo, size = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    intact = next((k for k in range(replicas) if k not in bad.get(i, ())), None)
                    payload = None
                    if intact is not None:
                        if intact not in files:
                            fs, path = _at(f"{folder}/replica-{intact}/{name}")
                            files[intact] = fs.open_input_file(path)
                        files[intact].seek(lo)
                        payload = payload_of(zlib.decompress(files[intact].read(size), 31))
                    told = (len(payload), hashlib.sha256(payload).hexdigest()) if payload is not None else (None, None)
                    rows.append((page_id, url, name, lo, size, *told, replicas, len(bad.get(i, ())), bad.get(i, [])))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                for f in files.values():
                    f.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id bigint, url string, name string, offset bigint, length bigint, n_bytes bigint, payload_sha256 string, n_replicas int, n_damaged int, damaged array<int>"
    return manifest.mapInArrow(check, schema)


def write_and_audit(pages: DataFrame, replicas: int = REPLICAS) -> DataFrame:
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest, _ = stored(write_warc(pages, folder, replicas), "manifest")
    return audit(manifest.repartition(max(1, manifest.count()), "name"), folder, replicas)


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_audit(table(spark, sf_dir, "pages")).select("page_id", "n_bytes", "payload_sha256", "n_replicas", "n_damaged")
