"""Main text: what must stay, what must go, odd and deep pages, and an independent extractor over whole tables of pages."""

import html.parser

import pytest

from basalt.llm import html as wrappers

MENU = "<nav><ul><li><a>Home</a></ul></nav>"


def rule(*pages):
    w = wrappers.wrapper_of(wrappers.Page(pages[0]))
    for p in pages[1:]:
        w = wrappers.merged(w, wrappers.wrapper_of(wrappers.Page(p)))
    assert wrappers.loaded(wrappers.dumped(w)) == w
    return wrappers.rule_of(w)


def test_repeated_articles_are_no_template():
    same = f"<body>{MENU}<article><h1>T</h1><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><p>Body</p></article></body>"
    other = [f"<body>{MENU}<article><h1>T{i}</h1><ul><li>a{i}</ul><p>Other {i}</p></article></body>" for i in range(5)]
    assert wrappers.extract(same, rule(*[same] * 9, *other)) == "T\n\none\n\ntwo\n\nc1\n\nc2\n\nBody"


def test_template_outside_articles_counts_different_pages():
    page = lambda i: f"<body><div class=wrap><p class=a>Standing {'long ' * 80}</p><h2>By us</h2><p class=b>Body {i} of words</p><p class=c>More {i * i}</p></div></body>"
    assert wrappers.extract(page(3), rule(*map(page, range(9)))) == "Body 3 of words\n\nMore 9"
    assert wrappers.extract(page(0), rule(*[page(0)] * 20, page(1))).startswith("Standing long")


def test_all_articles_of_a_region():
    assert wrappers.extract("<main><article class=a><p>First</p></article><article class=b><p>Second, longer</p></article></main>") == "First\n\nSecond, longer"


def test_names_are_judged_whole():
    inside = '<div class="social-history"><p>kept</p></div><p class="header">too</p><div class="header"><h2>h</h2></div>'
    gone = '<div class="share-buttons">x</div><div class="social">x</div><p class="notice">x</p><div id="ad_slot">x</div><ul class="siteMenu"><li>x</ul><article class="comment">x</article>'
    assert wrappers.extract(f"<article>{inside}{gone}</article>") == "kept\n\ntoo\n\nh"
    assert wrappers.extract('<body><div class="header">x</div><div class="text"><p>kept text of the page</p></div></body>') == "kept text of the page"
    titled = '<body><div class="entry-header"><h1>The title</h1></div><div class="entry-content"><p>kept text of the page</p></div><div class="entry-footer">x</div><div class="related-posts"><p>x</p></div></body>'
    assert wrappers.extract(titled) == "The title\n\nkept text of the page"
    assert wrappers.extract(titled.replace("kept", "kept " * 50)).startswith("The title\n\nkept kept")
    assert wrappers.extract('<body><div class="widget"><p>all there is</p></div></body>') == "all there is"


@pytest.mark.parametrize("depth", [10, 300, 20_000])
def test_deep_pages(depth):
    page = lambda t: "<div>" * depth + f"{MENU}<article><p>{t}</p></article>" + "</div>" * depth
    assert wrappers.extract(page("x y")) == "x y"
    if depth < 1000:
        assert wrappers.extract(page("c"), rule(page("a"), page("b"))) == "c"


def test_wide_pages():
    page = lambda n, o: "<body>" + "".join(f"<{'section' if (i * i + o) % 7 else 'div'} class=k{chr(97 + (i * 7 + o) % 26)}{chr(97 + i % 25)}>t{i}</div></section>" for i in range(n)) + f"<article><p>main {o}</p></article></body>"
    assert wrappers.extract(page(2050, 5), rule(page(2100, 0), page(2001, 3))) == "main 5"
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    assert wrappers.extract(long).count("word") == 30_000


def name(i):
    return "k" + "".join(chr(97 + i // 26**d % 26) for d in range(3))


def test_every_child_of_a_host_counts():
    page = lambda i: "<body><div class=wrap>" + "".join(f"<p class={name(k)}>Standing {k}</p>" for k in range(1500)) + f"<div><p>Body {i} of words</p></div></div></body>"
    assert wrappers.extract(page(3), rule(*map(page, range(9)))) == "Body 3 of words"


def test_hosts_of_many_shapes(spark):
    # each page names its article, its body text's place and some standing lines in its own way
    articles = [(i, "http://a.b/", f"<body><div class=side>x</div><article class={name(i)}><p>Text {i}</p></article></body>") for i in range(1500)]
    lines = "".join(f"<p class={name(k)}>{'Standing ' * 4}{k}</p>" for k in range(2500))
    plain = [(i, "http://c.d/", f"<body><div class=wrap>{lines}<div><p>Body {i} of words</p></div></div></body>") for i in range(2000, 2012)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(articles + plain, "page_id bigint, url string, html string").repartition(4)).collect()}
    assert got == {i: f"Text {i}" for i in range(1500)} | {i: f"Body {i} of words" for i in range(2000, 2012)}


def test_matching():
    import random

    rnd = random.Random(4)
    for exact in (1 << 14, 0):
        for _ in range(200):
            a, b = ([rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))] for _ in range(2))
            old, wrappers.EXACT = wrappers.EXACT, exact
            try:
                pairs = wrappers.matched(a, b)
            finally:
                wrappers.EXACT = old
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


class Plain(html.parser.HTMLParser):
    """Text of the blocks of article elements, by the standard library's parser."""

    INLINE = set("a b i em strong span small sup sub code u".split())
    SKIPPED = set("script style nav footer aside form title".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.depth = self.skipped = 0
        self.blocks, self.run = [], []
        self.feed(source)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(self.run).split())
        if text and self.depth:
            self.blocks.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append(" ")
        elif tag not in self.INLINE:
            self.cut()
        self.depth += tag == "article"
        self.skipped += tag in self.SKIPPED or dict(attrs).get("class") == "ad"

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.depth -= tag == "article"
        self.skipped -= tag in self.SKIPPED or (tag == "div" and self.skipped > 0)

    def handle_data(self, data):
        if self.depth and not self.skipped:
            self.run.append(data)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_whole_tables_against_a_plain_parser(spark, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    want = {r["page_id"]: "\n\n".join(Plain(r["html"] or "").blocks) for r in rows.collect()}
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(rows).collect()}
    assert got == want
