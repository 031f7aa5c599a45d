"""What the stages of the pipeline leave behind in Python workers, which serve later stages too, and what they hand over at a time."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest

from basalt.llm import decontam, quality, secrets

PACKING = """
import random, re
import pyarrow as pa
from basalt.llm import packing, tokens
from basalt.llm.common import lean

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Task:
    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)

packing.TaskContext = Task
path = tokens.vocabulary_path()
tokens.tokenizer(path).encode("a first word")

def batches():
    rnd = random.Random(3)
    for _ in range(8):
        texts = [" ".join("".join(rnd.choices("abcdefghij", k=9)) for _ in range(100)) for _ in range(500)]
        yield pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], ["doc_id", "text"])

before = held()
n = sum(b.num_rows for b in lean(packing._cut(path))(batches()))
print(n, held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_packing_leaves_no_table_in_its_worker():
    run = subprocess.run([sys.executable, "-c", PACKING], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    n, mb = run.stdout.split()
    assert int(n) == 4000
    assert float(mb) < 40  # the table of 400,000 words alone takes more


class Once:
    """Takes a stage's function out of its mapInArrow."""

    class sparkSession:
        class sparkContext:
            broadcast = staticmethod(lambda x: type("Shared", (), {"value": x}))

        _basalt_shipped = True

    def __init__(self, batch):
        self.columns, self.schema, self.batch = batch.schema.names, batch.schema, batch

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def test_stages_hand_over_a_few_rows_at_a_time(monkeypatch):
    n = 1000
    texts = [None if i % 50 == 7 else f"text {i} of a batch, token = abcdef{i:04d} é" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array([None if t is None else len(t) for t in texts], pa.int64())], ["doc_id", "text", "n_chars"])
    none = decontam.Automata("file:///nowhere", [])
    monkeypatch.setattr(decontam, "automata", lambda benchmark: none)
    model = quality.fit(*(quality.np.empty(0, int),) * 3)
    found = {"quality": quality.kept(Once(batch), model), "decontam": decontam.decontaminated(Once(batch), None), "secrets": secrets.redacted(Once(batch))}
    masked = [t and t.replace(f"token = abcdef{i:04d}", "[ASSIGN]") for i, t in enumerate(texts)]
    for name, out in found.items():
        assert max(b.num_rows for b in out) <= 256, name
        whole = pa.Table.from_batches(out).to_pydict()
        want = masked if name == "secrets" else texts
        assert whole == {"doc_id": list(range(n)), "text": want, "n_chars": [None if t is None else len(t) for t in want]}, name
