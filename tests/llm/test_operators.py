"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from basalt.llm import ann, automata, bitpack, decontam, html, packing, quality, secrets, simhash, substring, warc
from basalt.llm.common import new_path, stored
from basalt.llm.tokens import tokenizer, vocabulary_path

SCHEMA = "doc_id bigint, text string, fp int, fingerprint string, component_id int, text_key int, rank int, start int"


def texts():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "x" * 300]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(25)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    out = [*base, base[0], base[0] + " end", base[1].upper(), None, "", "  \n", "one", "one two", "a b", passage + " tail", "head " + passage, (passage + "\n") * 3]
    out += ["token = abcdef12 AKIA" + "Z" * 16 + " é " + "0f" * 12, "password: short, secret:='" + "k" * 7 + "'", " ".join(rnd.choice(words) for _ in range(30_000))]
    return out


@pytest.fixture(scope="module")
def rows():
    found = list(enumerate(texts()))
    return [*found, (0, found[0][1]), (None, found[3][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_simhash(docs, none, rows):
    def bits(t):
        w = split(lower(t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = [bits(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Counter((i, f"{p:016x}", least.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True))
    assert bag(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0
    clashing = docs.withColumns({c: F.lit(1) for c in ("kept_id", "kept_key", "known", "root", "best")})
    kept = simhash.without_near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(set(group))


def test_simhash_blocks_and_forest(spark, monkeypatch):
    rnd = random.Random(3)
    prints = sorted({rnd.getrandbits(64) & ~(1 << 63) for _ in range(20)} | {sum(1 << b for b in rnd.sample(range(12), rnd.randint(0, 12))) for _ in range(120)})
    want = list(range(len(prints)))
    for _ in range(8):
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    want[i] = want[j] = min(want[i], want[j])
    monkeypatch.setattr(simhash, "BLOCK", 16)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    from basalt.llm.components import components

    root = {r["node"]: r["root"] for r in components(edges)[0].collect()}
    assert [root.get(p, p) for p in prints] == [prints[w] for w in want]


def test_tokens_equal_the_library(rows):
    from tokenizers import Tokenizer

    own, whole = tokenizer(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    odd = ["don't STOP 12½ a\x1cb", "<|endoftext|> x<|startoftext|>", "ΣΑΣ İstanbul ﬁ", "日本語 テスト", "a b\x85c", "é é", "²³ªº", "\U0001f600!!"]
    for t in [*odd, *(t for _, t in rows)]:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]


def test_tokens_of_random_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    own, whole, rnd = tokenizer(vocabulary_path()), Tokenizer.from_file(vocabulary_path()), random.Random(7)
    some = ["'"] * 4 + [*"  strevmld.,!\"-\n\t09²½ªµßéÉÿÞ×÷\x85\xa0\x00\x7f", "'s", "'ll", "'re's", "<|", "word", "Word's"]
    for rare in ([], ["\x1c", "日本", "e\u0301", "<|endoftext|>", "\u2003", "’", "\U0001f600"]):
        texts = ["".join(rnd.choice(rare) if rare and rnd.random() < 0.05 else rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
        want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == want
        monkeypatch.setattr("basalt.llm.tokens.BATCH_CHARS", 20)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == want
        monkeypatch.undo()


def test_tokens_are_looked_up_once_a_batch():
    from basalt.llm.tokens import WordTokenizer

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    own = WordTokenizer(vocabulary_path())
    own.now = Counted()
    assert len(list(own.encode_all(["The same words, again and again. " * 1000] * 5))) == 5
    assert Counted.asked < 100


def test_packing_looks_tokens_up_once_a_batch(monkeypatch):
    import pyarrow as pa

    class Counted(dict):
        asked = 0

        def get(self, *args):
            Counted.asked += 1
            return super().get(*args)

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(tokenizer(vocabulary_path()), "now", Counted())
    text = "The same words, again and again. " * 1000
    batch = pa.record_batch([pa.array([1, 2, None], pa.int64()), pa.array([text, None, text])], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(packing._cut(vocabulary_path())(iter([batch])))).to_pylist()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["part"], r["rank"]) for r in rows] == [
        (1, 0, 4096, 8001, 3, 0), (1, 4096, 3905, 8001, 3, 0), (2, 0, 1, 1, 3, 0), (None, 0, 4096, 8001, 3, 1), (None, 4096, 3905, 8001, 3, 1)
    ]
    assert Counted.asked < 100


def test_bit_packing(docs, none, rows):
    for width in (1, 5, 15, 16, 17, 32):
        ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
        assert (bitpack.unpack(bitpack.pack(ids, width), width, 1001) == ids).all()
    encode, at, want = tokenizer(vocabulary_path()), 0, Counter()
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = encode.encode(t or "")
        want[(i, at, len(ids) // 4, zlib.crc32(ids))] += 1
        at += len(ids) // 4
    assert bag(bitpack.write_and_read(docs, vocabulary_path()), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert bitpack.write_and_read(none, vocabulary_path()).count() == 0


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 49408, n).astype(np.uint32) for n in (0, 1, 5000, 9000, 3)]
    for width in (16, 17):
        with open(tmp_path / "f", "wb") as f:
            w = bitpack.Writer(f, width)
            for i, p in enumerate(parts):
                w.add(i, p)
            w.close()
        import pyarrow as pa

        r, whole = bitpack.Reader(pa.OSFile(str(tmp_path / "f"))), np.concatenate(parts)
        assert all((r.document(i) == p).all() for i, p in enumerate(parts))
        assert (r.ids(4000, 9001) == whole[4000:9001]).all()


def test_packing(docs, none, rows):
    encode = tokenizer(vocabulary_path())
    found = packing.pack_documents(docs, vocabulary_path()).collect()
    sequences, total = {}, 0
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.LENGTH
    assert sorted(sequences) == list(range(len(sequences)))
    want = Counter()
    for i, t in rows:
        ids = encode.encode(t or "")
        n = len(ids) // 4
        total += n
        for s in range(0, n, packing.LENGTH):
            e = min(n, s + packing.LENGTH)
            want[(i, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == want
    assert len(sequences) <= -(-total // packing.LENGTH) + 1
    assert packing.pack_documents(none, vocabulary_path()).count() == 0


def test_decontamination(spark, docs, none, rows):
    items = [(1, rows[2][1] and " ".join(split(rows[2][1])[:40])), (2, "One!"), (3, None), (4, "..."), (5, " ".join(split(rows[4][1])[3:16])), (5, "one"), (None, "w1 w2")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc_id int")
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows: dict = {}
    for i, t in items:
        w = word(t)
        n = min(13, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    want = Counter()
    for i, t in rows:
        w = word(t)
        mark, names = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    names |= found
                    mark[a : a + n] = [True] * n
        hit = sum(mark)
        want[(i, len(w), hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0 and 20 * hit >= len(w))] += 1
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(decontam.contamination(docs, bench), *cols) == want
    assert decontam.contamination(none, bench).count() == 0
    assert not any(r["n_hit"] for r in decontam.contamination(docs, bench.limit(0)).collect())
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns and not any(r["n_hit"] for r in decontam.contamination(left, bench).collect())
    assert left.count() == sum(n for k, n in want.items() if not k[5])


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24])


def test_secrets(docs, none, rows):
    scanner, rnd = secrets.Scanner(), random.Random(5)
    pieces = ["token", "secret", "Api_Key", "=", ":", " ", '"', "'", "abc", "é", "AKIA", "AKIAX" * 4, "0123abcdef", "-", "password", "Z9", "\n"]
    for _ in range(3000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        assert [x for x in scanner.text_spans(t.encode()) if x[1] < 3] == base_spans(t), t
    want = Counter((i, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base_spans(t or "")).encode()).hexdigest()) for i, t in rows)
    assert bag(secrets.scan(docs), "doc_id", "base_sha256") == want
    assert secrets.scan(none).count() == 0
    clean = secrets.redacted(docs)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    assert not any(r["n_access"] + r["n_hex"] for r in secrets.scan(clean).collect())


def test_automata_match_re():
    rnd = random.Random(2)
    for p in ["a(b|cd)*e?", "[^b-d]+x{3}", "(ab?|c)+d", "\\x41[0-9]?\\."]:
        dfa = automata.Dfa([p], anywhere=False)
        for _ in range(500):
            t = "".join(rnd.choice("abcdexA1.") for _ in range(rnd.randint(0, 8)))
            s = 0
            for b in t.encode():
                s = dfa.table[256 * s + b]
            assert bool(dfa.accepts[s]) == bool(re.fullmatch(p, t)), (p, t)


def test_repeated_passages(docs, none, rows, monkeypatch):
    words = [split(t) for _, t in rows]
    count = Counter(tuple(w[a : a + 35]) for w in words for a in range(len(w) - 34))
    want = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        want[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())] += 1
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(substring.without_repeats(docs), *cols) == want
    assert substring.without_repeats(none).count() == 0
    # small chunks and ranges; then a sketch so small that nearly every window passes it
    monkeypatch.setattr(substring, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(substring, "RANGE_BITS", 9)
    assert bag(substring.without_repeats(docs), *cols) == want
    monkeypatch.setattr(substring, "LEAST_BITS", 8)
    monkeypatch.setattr(substring, "CELLS_PER_WORD", 0)
    assert bag(substring.without_repeats(docs), *cols) == want


def test_rising_numbers():
    for v in ([], [0], [0, 0, 1, 127, 128, 300, 70_000, 1 << 40]):
        assert substring.risen(substring.rising(np.array(v, np.int64))).tolist() == v


def test_quality(spark, none):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["the", "and", "stone", "river", "light"]) + rnd.choice(["", "ed", "ing"]) for _ in range(40))
    bad = lambda: rnd.choice([good().upper() + "!!", good().replace(" ", "*** "), " ".join(["buy"] * 40)])
    data = [(i, good() if i % 3 else bad(), i, int(i % 3 > 0)) for i in range(400)] + [(400, None, 0, None), (401, "", 0, None), (None, "x", 0, None)]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in data], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, _, y in data] + [(5, 1, 0)], "doc_id bigint, quality int, text int")
    out = quality.scored(docs, quality.train(docs, labels)).collect()
    truth = {i: y for i, _, _, y in data}
    held = [r for r in out if r["held_out"] and truth[r["doc_id"]] is not None]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0
    assert {r["score"] for r in quality.scored(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.scored(none, quality.train(none, labels)).count() == 0


PAGE = """<html><head><title>t</title><script>var a="<p>x</p>"</script></head><body><nav><ul><li>Home<li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>T{0} &amp; more</h1><span>by me</span></header><p>First   <b>bold{0}
<p>Second&nbsp;&lt;{0}&gt;<br>line<aside>side</aside><p>Third {0}<div class="share">Share</div><form>f</form></article><div id="comments"><p>Nice</p></div><footer>&copy;</footer>"""


def test_html(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", PAGE.format(i)) for i in range(12)] + [(None, None, None), (20, "x", ""), (21, "http://h0.example", "just text"), (22, "http://h0.example/", "<p>a<p>b")]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, host int, rule string")
    got = {r["page_id"]: r for r in html.main_text(pages).collect()}
    for i in range(12):
        assert got[i]["text"] == f"T{i} & more\n\nFirst bold{i}\n\nSecond <{i}> line\n\nThird {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    assert (got[None]["text"], got[20]["text"], got[21]["text"], got[22]["text"]) == ("", "", "just text", "a\n\nb")
    assert html.main_text(pages.limit(0)).count() == 0
    w = {r["host"]: html.loaded(r["wrapper"]) for r in html.wrappers(pages.where("page_id < 12")).collect()}
    assert "(<p>" in html.expression(w["h1.example"]) and "TEXT" in html.expression(w["h1.example"])


def test_html_odd_sources():
    for s in ("<", "<a", "<!--", "<div" * 50, "<div>" * 2000 + "x", "</p></div>", "<script>", "&#0; &amp", '<a href="', "<p class='ad>x"):
        html.extract(s)


def test_html_names_and_siblings():
    """Class names with slashes, the region in the second of two siblings of one shape, elements that nothing closes."""
    assert html.extract('<body><div class="w-1/2"><p>One two</p><p>three</p></div></body>') == "One two\n\nthree"
    page = '<body><div class="row"><p>menu</p></div><hr><p>x</p><div class="row"><article><p>The text</p></article></div></body>'
    assert html.extract(page) == "The text"
    rule = html.rule_of(html.merged(html.wrapper_of(html.Page(page)), html.wrapper_of(html.Page(page.replace("The text", "Other")))))
    assert html.extract(page, rule) == "The text"
    assert html.extract("<article><p>a<button>b<svg>c</article>") == "abc"


def test_warc_audit_finds_damage(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "é" * i) for i in range(300)] + [(None, None, None), (5, "http://x/5", "again")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, offset int").repartition(2)
    folder = new_path(spark, "warc-test")
    manifest, _ = stored(warc.write_warc(pages, folder), "manifest")
    clean = warc.audit(manifest, folder).collect()
    want = Counter((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(), 0) for i, _, t in rows)
    assert Counter((r["page_id"], r["n_bytes"], r["payload_sha256"], r["n_damaged"]) for r in clean) == want
    hurt = clean[17]
    path = f"{folder}/replica-1/{hurt['name']}".removeprefix("file://").removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[hurt["offset"] + 3] ^= 1
    open(path, "wb").write(data)
    found = [(r["name"], r["offset"], r["damaged"]) for r in warc.audit(manifest, folder).collect() if r["n_damaged"]]
    assert found == [(hurt["name"], hurt["offset"], [1])]
    # the other replica damaged elsewhere: none has the stored root any more
    other = next(r for r in clean if r["name"] == hurt["name"] and r["offset"] != hurt["offset"])
    second = f"{folder}/replica-0/{hurt['name']}".removeprefix("file://").removeprefix("file:")
    whole = open(second, "rb").read()
    worse = bytearray(whole)
    worse[other["offset"] + 1] ^= 4
    open(second, "wb").write(worse)
    found = {(r["offset"], tuple(r["damaged"]), r["payload_sha256"] is None) for r in warc.audit(manifest, folder).collect() if r["n_damaged"]}
    assert found == {(hurt["offset"], (1,), False), (other["offset"], (0,), False)}
    worse[hurt["offset"] + 1] ^= 4
    open(second, "wb").write(worse)
    found = {(r["offset"], tuple(r["damaged"]), r["payload_sha256"] is None) for r in warc.audit(manifest, folder).collect() if r["n_damaged"]}
    assert found == {(hurt["offset"], (0, 1), True), (other["offset"], (0,), False)}
    open(second, "wb").write(whole)
    half = len(data) // 2
    open(path, "wb").write(data[:half])
    lost = {(r["name"], r["offset"]) for r in clean if r["name"] == hurt["name"] and r["offset"] + r["length"] > half} | {(hurt["name"], hurt["offset"])}
    assert {(r["name"], r["offset"]) for r in warc.audit(manifest, folder).collect() if r["n_damaged"]} == lost
    assert warc.write_and_audit(pages.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((900, 16)).astype(np.float32)
    v[300:600] = v[0]  # one vector held by a third of all rows
    odd = [(5000, None), (5100, [0.0] * 16), (5200, [None] + [1.0] * 15), (5300, [float("nan")] * 16), (5400, [1.0] * 3), (None, [1.0] * 16)]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(i, x, 1) for i, x in odd] + [(7, v[7].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got: dict = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    x, hit = v.astype(np.float64), 0
    assert sorted(got) == list(range(0, 900, 100)) and all(len(g) == 10 for g in got.values())
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10].tolist()
        hit += len(set(best) & {i for i, _ in found})
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and all(s == d[i] for i, s in found)
        if q in (0, 300, 400, 500):
            assert [i for i, _ in found] == best
    assert hit >= 0.9 * 90
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id < 4")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2), (0, 3)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = stored(stage(spark, docs, folder), "stage")
        assert out.columns == names and 0 < out.count() <= docs.count(), name
        docs = out
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert not any(r["n_hit"] for r in decontam.contamination(docs, bench).collect())
    groups = simhash.near_duplicates(corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)).collect()
    assert all(r["doc_id"] == r["component_id"] for r in groups)
    pieces = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall_of_whole_tables(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found: dict = {}
    for r in ann.nearest(table).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits.append(len(found[q] & set(ids[np.lexsort((ids, d))[:10]].tolist())))
    assert np.mean(hits) >= 9.5 and min(hits) >= 7
