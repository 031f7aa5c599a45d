"""The quality model against plain solvers, its features against words, and the rows it keeps."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from basalt.llm import quality


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_fit_against_plain_solvers(monkeypatch):
    """Log-count ratios from their definition; the descent reaches the optimum that a plain projected gradient finds."""
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 60)
    rows = [np.unique(np.concatenate([rng.integers(0, 40, 8), 50 + 10 * y + rng.integers(0, 10, 4)])).astype(np.int32) for y in labels]
    found, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
    ratio = quality.log_count_ratio(found, ends, labels)
    total = [sum(len(r) for r, y in zip(rows, labels, strict=True) if y == c) + quality.DIMS for c in (0, 1)]
    for f in range(80):
        p = [(1 + sum(f in r for r, y in zip(rows, labels, strict=True) if y == c)) / total[c] for c in (0, 1)]
        assert abs(ratio[f] - np.log(p[1] / p[0])) < 1e-12
    x = np.zeros((60, 81))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt((ratio[r] ** 2).sum())
        x[i, 80] = 1
    y = 2.0 * labels - 1
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(60), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, quality.COST)
    best = 0.5 * alpha @ q @ alpha - alpha.sum()
    monkeypatch.setattr(quality, "EPOCHS", 1000)
    weight, bias, margin = quality.descend(found, ends, labels, ratio)
    w = np.append(weight[:80], bias)
    primal = 0.5 * w @ w + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()
    assert np.allclose(margin, x @ w) and abs(primal + best) < 2e-2 * abs(best)


def test_features_against_words():
    shape = lambda w, last: 2 * (3 if re.search("[A-Z]", w) and not re.search("[a-zé]", w) and len(w.encode()) > 1 else 2 if "A" <= w[0] <= "Z" else 1 if re.search("[a-zé]", w) and not re.search("[A-Z]", w) else 0) + (len(w.encode()) > 1 and bool(re.search("[^0-9A-Za-zé]{2}$", w))) + 8 * (w == last)
    rnd = random.Random(9)
    for _ in range(200):
        words = [rnd.choice(["ab", "Ab", "AB", "A", "1", "é", "aB", "x!!", "!!", "?", "É?", "ab"]).replace("É", "é") for _ in range(rnd.randint(0, 12))]
        s = [shape(w, words[i - 1] if i else None) for i, w in enumerate(words)]
        want = {quality.GRAMS + a for a in s} | {quality.GRAMS + 16 + 16 * a + b for a, b in zip(s, s[1:])} | {quality.GRAMS + 16 + 256 + 256 * a + 16 * b + c for a, b, c in zip(s, s[1:], s[2:])}
        got = quality.features(" ".join(words).encode())
        assert {f for f in got.tolist() if f >= quality.GRAMS} == want and len(got) <= len(want) + max(0, len(" ".join(words).encode()) - 2)


def test_kept_rows(spark):
    rows = [(i, t, 1) for i, t in [(1, "good text here"), (1, "good text here"), (2, None), (3, ""), (None, "x" * 200_000)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").withColumns({c: F.lit(1) for c in ("y", "mark", "found", "held_out")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    flat = quality.train(docs, labels.limit(0))
    kept = quality.kept(docs, flat)
    assert kept.columns == docs.columns and bag(kept) == bag(docs)
    reject = quality.Model(flat.ratio, flat.weight, 0.0, 0.0, -5.0)
    assert quality.kept(docs, reject).count() == 0 and quality.kept(docs.limit(0), flat).count() == 0
