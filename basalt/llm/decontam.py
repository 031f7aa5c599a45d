"""Benchmark decontamination by generalised suffix automata over words.

The normalised benchmark items go into an automaton whose symbols are word
numbers.  A document's words stream through it; the length of the longest
match that ends at a word tells whether a window (``WINDOW`` consecutive item
words, or a whole shorter item) ends there, and the state tells whose.  A run of
words that no item has, or that is shorter than the shortest window, can't hold
a window and is skipped before the automaton.

Automata are built by tasks and written to the shared folder as flat arrays.
Each holds about ``GROUP_BYTES`` of items; a larger benchmark gives several,
and a longer item is cut into pieces that overlap by a window less one word, so
no window is lost.  A task streams its texts through one automaton after the
other and holds one at a time.  Neither the driver nor a broadcast holds items.

Defined results: null and empty texts have no words; an item without words has
no window; an empty benchmark hits nothing; a null item id counts as an item
and is named as an empty string; rows repeated in the benchmark with one id are
one item; repeated documents are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import array
import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import column_bytes, column_texts, lean, new_path, parts, ship, stored, table, taken, wanted

WINDOW = 13
#: A document is contaminated from one hit word in so many.
ONE_IN = 20
#: Text of the items of one automaton, and the words of a piece of an item.
GROUP_BYTES = 1 << 20
PIECE_WORDS = 50_000
_SLICE = 256

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class _Builder:
    """A generalised suffix automaton while it grows: a dictionary of transitions for each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, ids: list[int]) -> None:
        last = 0
        for w in ids:
            last = self._extend(last, w)

    def _extend(self, last: int, w: int) -> int:
        after = self.next[last].get(w)
        if after is not None:
            return after if self.size[after] == self.size[last] + 1 else self._clone(last, w, after)
        new = self._state({}, self.size[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.size[p] + 1)
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _state(self, after: dict[int, int], size: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(0)
        return len(self.size) - 1


class Automaton:
    """The automaton as flat arrays, with the windows that end in each state.

    ``edges`` are the sorted numbers state * symbols + symbol and ``targets``
    where they lead; ``ends`` are the sorted numbers state * (window + 1) +
    length of the states where a window of that length ends, whose items are
    ``items`` from ``first`` of it to that of the next.
    """

    _ARRAYS = {"link": "i", "size": "i", "edges": "q", "targets": "i", "ends": "q", "first": "i", "items": "i", "needs": "i"}

    def __init__(self, parts: dict[str, array.array], words: list[bytes], names: list[str], window: int):
        self.__dict__.update(parts)
        self.number = {w: i for i, w in enumerate(words, 1)}
        self.symbols, self.names, self.window = len(words) + 1, names, window
        self.shortest = min([window, *self.needs])

    @classmethod
    def of(cls, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> Automaton:
        """Items of one name may come in several sequences."""
        builder, number, name_at, sequences = _Builder(), {}, {}, []
        for name, words in items:
            if words:
                ids = [number.setdefault(w, len(number) + 1) for w in words]
                sequences.append((name_at.setdefault(name, len(name_at)), ids))
                builder.add(ids)
        symbols = len(number) + 1
        edges = sorted((s * symbols + w, t) for s, row in enumerate(builder.next) for w, t in row.items())
        parts = {"link": array.array("i", builder.link), "size": array.array("i", builder.size), "needs": array.array("i", sorted({min(window, len(ids)) for _, ids in sequences}, reverse=True))}
        parts |= {"edges": array.array("q", [e for e, _ in edges]), "targets": array.array("i", [t for _, t in edges])}
        parts |= {"ends": array.array("q"), "first": array.array("i", [0]), "items": array.array("i")}
        out = cls(parts, list(number), list(name_at), window)
        del builder, edges
        ending: dict[int, set[int]] = {}
        for item, ids in sequences:
            need = min(window, len(ids))
            state = length = 0
            for i, w in enumerate(ids):
                state, length = out.step(state, length, w)
                if i + 1 >= need:
                    ending.setdefault(out._suffix(state, need) * (window + 1) + need, set()).add(item)
        for key in sorted(ending):
            out.ends.append(key)
            out.items.extend(sorted(ending[key]))
            out.first.append(len(out.items))
        return out

    def dump(self) -> bytes:
        """A JSON line of names and lengths, the words, and the arrays, little-endian."""
        words = b" ".join(self.number)
        head = {"window": self.window, "names": self.names, "words": len(words), "arrays": {k: len(getattr(self, k)) for k in self._ARRAYS}}
        data = [np.asarray(getattr(self, k)).astype(f"<{t}").tobytes() for k, t in self._ARRAYS.items()]
        return json.dumps(head).encode() + b"\n" + words + b"".join(data)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        line = data.index(b"\n")
        head = json.loads(data[:line])
        at, parts = line + 1 + head["words"], {}
        for name, kind in cls._ARRAYS.items():
            size = head["arrays"][name] * np.dtype(f"<{kind}").itemsize
            parts[name] = array.array(kind, np.frombuffer(data[at : at + size], f"<{kind}").astype(kind).tobytes())
            at += size
        return cls(parts, data[line + 1 : line + 1 + head["words"]].split(b" ") if head["words"] else [], head["names"], head["window"])

    def _after(self, state: int, w: int) -> int:
        key = state * self.symbols + w
        i = bisect_left(self.edges, key)
        return self.targets[i] if i < len(self.edges) and self.edges[i] == key else -1

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """The longest suffix of what was matched and ``w`` that some item has."""
        while True:
            after = self._after(state, w)
            if after >= 0:
                return after, length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.size[state]

    def _suffix(self, state: int, length: int) -> int:
        """The state of the last ``length`` matched words."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the names of those windows' items."""
        n = len(words)
        mark, items = np.zeros(n, bool), set()
        if n < self.shortest or not self.names:
            return mark, set()
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, n)
        known = np.concatenate([[False], ids > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo < self.shortest:
                continue
            state = length = 0
            for i, w in enumerate(ids[lo:hi].tolist(), lo):
                state, length = self.step(state, length, w)
                if length >= self.shortest:
                    at = state
                    for need in self.needs:
                        if need <= length:
                            at = self._suffix(at, need)
                            key = at * (self.window + 1) + need
                            k = bisect_left(self.ends, key)
                            if k < len(self.ends) and self.ends[k] == key:
                                mark[i + 1 - need : i + 1] = True
                                items.update(self.items[self.first[k] : self.first[k + 1]])
        return mark, {self.names[i] for i in items}


def _pieces(size: int):
    """(item_id, words): the normalised words of items, long ones in pieces that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(column_texts(batch, "item_id"), column_bytes(batch, "text"), strict=True):
                words = words_of(text)
                for i in range(0, max(min(len(words), 1), len(words) - WINDOW + 1), size):
                    out.append((name, b" ".join(words[i : i + size + WINDOW - 1])))
            names, parts = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["item_id", "words"])

    return run


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _build(folder: str):
    """Rows sorted by group: one automaton file for each; rows (part, file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        attempt, now, held, out = TaskContext.get().taskAttemptId(), None, [], []

        def close() -> None:
            fs.create_dir(base, recursive=True)
            out.append((now, f"{now:06d}-{attempt}"))
            with fs.open_output_stream(f"{base}/{out[-1][1]}") as f:
                f.write(Automaton.of(held).dump())

        for batch in batches:
            for part, name, words in zip(*(taken(batch, c).to_pylist() for c in ("part", "item_id", "words")), strict=True):
                if part != now:
                    if held:
                        close()
                    now, held = part, []
                held.append((name, words.split()))
        if held:
            close()
        parts, files = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(files, pa.string())], ["part", "file"])

    return run


class Automata:
    """The files that together hold every item; iterating loads one at a time, a single one stays with its worker."""

    _held: dict[str, Automaton] = {}

    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files

    def __iter__(self) -> Iterator[Automaton]:
        fs, base = _open(self.folder)
        for name in self.files:
            path = f"{base}/{name}"
            if path not in self._held:
                self._held.clear()
                with fs.open_input_file(path) as f:
                    self._held[path] = Automaton.load(f.read())
            yield self._held[path]

    def slices(self, texts: list | pa.RecordBatch) -> Iterator:
        """Few texts at a time for a single automaton; else a whole batch goes through each before the next is loaded."""
        size = _SLICE if len(self.files) <= 1 else max(1, len(texts))
        for i in range(0, len(texts), size):
            yield texts[i : i + size]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each text (words): which words are hit, and the names of the items."""
        out = [(np.zeros(len(words), bool), set()) for words in texts]
        for a in self:
            for words, (mark, names) in zip(texts, out, strict=True):
                m, items = a.scan(words)
                mark |= m
                names |= items
        return out


def automata(benchmark: DataFrame) -> Automata:
    """The automata of a benchmark, in the shared folder."""
    spark = benchmark.sparkSession
    ship(spark)
    rows = wanted(benchmark, item_id="string", text="string").select(F.coalesce("item_id", F.lit("")).alias("item_id"), "text")
    pieces, _ = stored(rows.mapInArrow(_pieces(PIECE_WORDS), "item_id string, words binary").distinct(), "pieces")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(groups)))
    dealt = dealt.repartition(min(groups, parts(spark)), "part").sortWithinPartitions("part", "item_id", "words")
    folder = new_path(spark, "automata")
    built = dealt.mapInArrow(_build(folder), "part bigint, file string").collect()  # names of files, one a GROUP_BYTES of items
    return Automata(folder, [r["file"] for r in sorted(built, key=lambda r: r["part"])])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    ship(docs.sparkSession)
    found = automata(benchmark)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in found.slices(list(column_bytes(batch, "text"))):
                split = [words_of(t) for t in texts]
                for words, (mark, names) in zip(split, found.scan(split), strict=True):
                    hit, names = int(mark.sum()), sorted(names)
                    rows.append((len(words), hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and ONE_IN * hit >= len(words), names))
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([taken(batch, "doc_id"), *cols], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    schema = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>"
    return wanted(docs, doc_id="bigint", text="string").mapInArrow(run, schema)


def _without(data: bytes, words: list[bytes], mark: np.ndarray) -> bytes:
    """The text without its hit words and what lies between two of them; one space is left for each run."""
    flat, at, cut = data.translate(_WORD_BYTES), 0, []
    for word, hit in zip(words, mark.tolist(), strict=True):
        at = flat.index(word, at)
        if hit:
            if cut and cut[-1][2]:
                cut[-1][1] = at + len(word)
            else:
                cut.append([at, at + len(word), True])
        elif cut:
            cut[-1][2] = False
        at += len(word)
    kept, last = [], 0
    for lo, hi, _ in cut:
        kept.append(data[last:lo])
        last = hi
    return b" ".join([*kept, data[last:]])


def cleaned(texts: list[bytes], found: Automata) -> list[bytes | None]:
    """The texts without window occurrences, None for those contaminated by coverage.

    What stands side by side after a cut is scanned again.
    """
    out: list[bytes | None] = list(texts)
    todo, limit = list(range(len(texts))), True
    while todo:
        split = [words_of(out[i]) for i in todo]
        again = []
        for i, words, (mark, _) in zip(todo, split, found.scan(split), strict=True):
            if not mark.any():
                continue
            if limit and ONE_IN * int(mark.sum()) >= len(words):
                out[i] = None
            else:
                out[i] = _without(out[i], words, mark)
                again.append(i)
        todo, limit = again, False
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, without the spans that windows cover; n_chars follows the text."""
    ship(docs.sparkSession)
    found = automata(benchmark)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in found.slices(batch):
                old = taken(some, "text").to_pylist()
                new = cleaned(list(column_bytes(some, "text")), found)
                keep = [x is not None for x in new]
                texts = [None if value is None or x is None else x.decode() for value, x in zip(old, new, strict=True)]
                cols = {n: taken(some, n) for n in names}
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(x) if x is not None else n for x, n in zip(texts, taken(some, "n_chars").to_pylist(), strict=True)], taken(some, "n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
