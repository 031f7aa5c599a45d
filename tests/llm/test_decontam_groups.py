"""Several automata, items in overlapping pieces, and their form on disk, against plain search."""

import random

from basalt.llm import decontam


def marks(words, windows):
    hit, names = [False] * len(words), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if found := windows.get(tuple(words[i : i + n])):
                names |= found
                hit[i : i + n] = [True] * n
    return hit, names


def windows_of(items):
    out: dict = {}
    for name, words in items:
        n = min(decontam.WINDOW, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            out.setdefault(tuple(words[i : i + n]), set()).add(name)
    return out


def test_many_automata(spark, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP_BYTES", 300)
    monkeypatch.setattr(decontam, "PIECE_WORDS", 7)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randint(0, 30)}"
    items = [(str(i % 20), [word() for _ in range(rnd.choice([1, 3, 12, 13, 14, 60]))]) for i in range(40)]
    bench = spark.createDataFrame([(int(n), " ".join(w)) for n, w in items], "item_id bigint, text string")
    docs = [[word() for _ in range(30)] + items[rnd.randrange(40)][1] + [word() for _ in range(5)] for _ in range(60)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    windows = windows_of(items)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontam.contamination(table, bench).collect()}
    for i, words in enumerate(docs):
        hit, names = marks(words, windows)
        assert got[i] == (sum(hit), sorted(names))
    assert len(decontam.automata(bench).files) > 3


def test_stored_form():
    rnd = random.Random(2)
    items = [(f"n{i}", [b"%d" % rnd.randint(0, 5) for _ in range(rnd.randint(1, 40))]) for i in range(30)] + [("é", [b"one"]), ("none", [])]
    built = decontam.Automaton.of(items)
    again = decontam.Automaton.load(built.dump())
    windows = windows_of(items)
    for _ in range(50):
        words = [b"%d" % rnd.randint(0, 5) for _ in range(rnd.randint(0, 60))] + [b"one"]
        hit, names = marks(words, windows)
        for a in (built, again):
            mark, found = a.scan(words)
            assert mark.tolist() == hit and found == names
    empty = decontam.Automaton.load(decontam.Automaton.of([]).dump())
    assert empty.scan([b"a"] * 20)[1] == set()
