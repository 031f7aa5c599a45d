"""The whole pipeline against a plain chain of its stages, on rows with nulls, empty texts, repeats, copies and clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from basalt.llm import packing, quality, secrets
from basalt.llm.tokens import vocabulary_path

CLASHING = ("fp", "text_key", "__id", "__key", "__kept_id", "root", "best", "y", "mark", "part", "rank", "start", "length", "n_hit")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in CLASHING)


def made():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["the", "and", "stone", "river", "light", "Über", "naïve", "moon"]) + rnd.choice(["", "ed", "ing", "s", str(rnd.randint(0, 400))])
    good = lambda n=60: " ".join(word() for _ in range(n))
    bad = lambda: rnd.choice([good().upper() + "!!", good().replace(" ", "*** "), " ".join(["buy"] * 60)])
    items = [(1, good(30)), (2, "Seven bright Words, only."), (3, None), (4, "...")]
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = [(i, int(i % 3 > 0)) for i in range(200)]
    words = items[0][1].split()
    rows += [(300, rows[1][1]), (301, rows[2][1] + " more"), (1, rows[1][1]), (302, None), (303, ""), (None, rows[4][1]), (None, good()), (304, " \n\t")]
    rows += [(310, good(400) + " " + " ".join(words[3:20]) + " " + good(400)), (311, good(20) + " " + " ".join(words) + " " + good(20)), (312, good(300) + "; SEVEN--bright\nwords only " + good(100)), (313, good(300) + " ".join(words[:12]) + " " + good(50))]
    rows += [(320, good() + " token = abcdef123 " + good(5)), (321, good() + " AKIA" + "Q" * 17 + " é " + "0f" * 13), (322, good() + " secret:'short' passwd=\"longenough\""), (323, good(3000))]
    return [(i, t, "en", "x", None if t is None else len(t), *range(len(CLASHING))) for i, t in rows], labels, items


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def one_of_each(rows):
    prints, group = [fingerprint(t or "") for _, t in rows], list(range(len(rows)))
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    moved = True
    key = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    best = {}
    for (i, t), g in zip(rows, group, strict=True):
        rank = (i is None, i or 0, key(t))
        if g not in best or rank < best[g][0]:
            best[g] = (rank, (i, t))
    return [row for _, row in best.values()]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without_items(text, items):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = set()
    for _, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
    first = True
    while True:
        found = list(WORD.finditer(lower(text)))
        w, hit = [m[0] for m in found], [False] * len(found)
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit[a : a + n] = [True] * n
        if not any(hit):
            return text
        if first and 20 * sum(hit) >= len(w):
            return None
        first, parts, last, i = False, [], 0, 0
        while i < len(found):
            j = i
            while j < len(found) and hit[j]:
                j += 1
            if j > i:
                parts.append(text[last : found[i].start()])
                last = found[j - 1].end()
            i = max(j, i + 1)
        text = " ".join([*parts, text[last:]])


def without_secrets(text):
    found = []
    for kind, (name, pattern, least) in enumerate(secrets.RULES):
        for m in re.finditer(pattern, text, re.ASCII):
            size = len(m[0])
            if name == "assign":
                size -= re.match(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", m[0]).end()
            if size >= least:
                found.append((m.start(), kind, m.end()))
    out, at = "", 0
    for start, kind, end in sorted(found):
        if start >= at:
            out += text[at:start] + f"[{secrets.RULES[kind][0].upper()}]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, items = made()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_chain(spark, folder):
    rows, _, items = made()
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def fine(text):
        f = quality.features((text or "").encode())
        r = model.ratio[f]
        length = float(np.sqrt((r * r).sum()))
        margin = model.bias + (float((model.weight[f] * r).sum()) / length if length else 0.0)
        return 1 / (1 + np.exp(-(model.slope * margin + model.shift))) >= 0.3

    left = [(r[0], r[1]) for r in rows if fine(r[1])]
    assert 150 < len(left) < len(rows)
    left = one_of_each(left)
    cut = [(i, t and without_items(t, items)) for i, t in left]
    left = [(i, new) for (i, new), (_, t) in zip(cut, left, strict=True) if not t or new is not None]
    left = [(i, t and without_secrets(t)) for i, t in left]
    assert {310, 312, 320, 321, 322, 323} <= {i for i, _ in left} and 311 not in {i for i, _ in left}
    encode, want = Tokenizer.from_file(vocabulary_path()), Counter()
    for i, t in left:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), packing.LENGTH):
            part = ids[s : s + packing.LENGTH]
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    held: dict = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
