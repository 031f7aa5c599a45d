"""Secret scan by one combined deterministic automaton.

All rules are compiled together (subset construction, then minimisation) into
one transition array that reads each byte of a text once.  Its accepting
stretches say where matches of a rule end; the start of each, the leftmost one
after the rule's last match, comes from the rule's mirrored automaton run
backwards from the end.  Matches are leftmost, longest and non-overlapping per
rule; those that fail the rule's test are dropped after that.

The first three rules are the base; the others add spans of other kinds.

Defined results: a null text is empty and has no span; null ids and repeated
rows are kept; positions count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basalt.llm.automata import Dfa, any_case
from basalt.llm.common import column_bytes, few, lean, ship, table, taken, wanted

# The hex rule is [0-9a-f]+ with 24 characters at least: runs of under eight, which can't pass, never accept.
# The rules' names and patterns, in the order of their kinds, and the length that a match needs.
_ASSIGN = any_case("(password|passwd|secret|token|api_?key)") + "[\"']?\\x20*[:=]\\x20*[\"']?"
RULES: list[tuple[str, str, int]] = [
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", 6),
    ("access", "AKIA[A-Z0-9]+", 20),
    ("hex", "[0-9a-f]{7}[0-9a-f]+", 24),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    ("google", "AIza[A-Za-z0-9_-]+", 39),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
]
BASE = 3
_HEAD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?")


class Scanner:
    """The forward automaton of all rules and a backward one for each."""

    def __init__(self, rules: list[tuple[str, str, int]] = RULES):
        self.names = [r[0] for r in rules]
        self.least = [r[2] for r in rules]
        forward = Dfa([r[1] for r in rules], anywhere=True)
        # states are numbered by 256, so a step is one addition and one lookup;
        # accepting states come last, so one comparison finds them
        order = sorted(range(len(forward.accepts)), key=lambda s: (forward.accepts[s] != 0, s))
        place = {s: i for i, s in enumerate(order)}
        self.step = [256 * place[t] for s in order for t in forward.table[256 * s : 256 * s + 256].tolist()]
        self.accepts = [forward.accepts[s] for s in order]
        self.first = 256 * sum(not a for a in self.accepts)
        self.start = 256 * place[0]
        self.back = [Dfa([r[1]], anywhere=False, mirrored=True) for r in rules]

    def _begin(self, rule: int, data: bytes, end: int, floor: int) -> int:
        """The leftmost start from ``floor`` of a match that ends at ``end``; -1 if none."""
        dfa, state, found = self.back[rule], 0, -1
        for i in range(end - 1, floor - 1, -1):
            state = int(dfa.table[256 * state + data[i]])
            if state == dfa.dead:
                break
            if dfa.accepts[state]:
                found = i
        return found

    def _passes(self, rule: int, match: bytes) -> bool:
        size = len(match) - (_HEAD.match(match).end() if self.names[rule] == "assign" else 0)
        return size >= self.least[rule]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        last: dict[int, list[int]] = {}  # rule -> ends of its accepting stretches
        step, state, first, accepts = self.step, self.start, self.first, self.accepts
        for i, b in enumerate(data, 1):
            state = step[state + b]
            if state >= first:
                mask, rule = accepts[state >> 8], 0
                while mask:
                    if mask & 1:
                        ends = last.setdefault(rule, [])
                        if ends and ends[-1] == i - 1:
                            ends[-1] = i
                        else:
                            ends.append(i)
                    mask >>= 1
                    rule += 1
        out = []
        for rule, ends in last.items():
            floor = 0
            for end in ends:
                start = self._begin(rule, data, end, floor)
                if start >= 0:
                    floor = end
                    if self._passes(rule, data[start:end]):
                        out.append((start, rule, end))
        return sorted(out)

    def text_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """As spans(), in code points."""
        found = self.spans(data)
        if not found or data.isascii():
            return found
        points = np.cumsum(np.concatenate([[0], (np.frombuffer(data, np.uint8) & 0xC0) != 0x80]))
        return [(int(points[s]), r, int(points[e])) for s, r, e in found]


def _listed(spans: list[tuple[int, int, int]], names: list[str]) -> str:
    return ",".join(f"{names[r]}:{s}:{e}" for s, r, e in spans)


def scan(docs: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            rows = []
            for data in column_bytes(batch, "text"):
                spans = scanner.text_spans(data)
                base = [x for x in spans if x[1] < BASE]
                rows.append((*(sum(r == k for _, r, _ in base) for k in range(BASE)), hashlib.sha256(_listed(base, scanner.names).encode()).hexdigest(), _listed(spans, scanner.names)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([taken(batch, "doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return wanted(docs, doc_id="bigint", text="string").mapInArrow(run, schema)


def redacted(docs: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """All rows of ``docs``, each secret replaced by its kind in brackets; n_chars follows the text."""
    spark = docs.sparkSession
    ship(spark)
    shared, names = spark.sparkContext.broadcast(Scanner(rules)), docs.columns

    def masked(scanner: Scanner, text: str) -> str:
        data, out, at = text.encode(), [], 0
        for start, rule, end in scanner.spans(data):
            if start >= at:
                out += [data[at:start], f"[{scanner.names[rule].upper()}]".encode()]
            at = max(at, end)
        return (b"".join(out) + data[at:]).decode() if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            for some in few(batch):
                texts = [masked(scanner, x) if x else x for x in taken(some, "text").to_pylist()]
                cols = {n: taken(some, n) for n in names}
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    cols["n_chars"] = pa.array([len(x) if x is not None else old for x, old in zip(texts, taken(some, "n_chars").to_pylist(), strict=True)], taken(some, "n_chars").type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(lean(run), docs.schema)


def op7_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
