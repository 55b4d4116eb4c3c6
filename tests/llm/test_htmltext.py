from __future__ import annotations

import pytest

from sumire.llm import htmltext

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; text", "plain & text"),
    ("<p>a<p>b<br>c", "a\nb c"),
    ("<html><head><title>t</title><style>x</style></head><body><nav>n</nav><article><h1>H</h1><p>a  b\n c</p><script>s('</p>')</script></article><footer>f</footer>", "H\na b c"),
    ("<body><header>top</header><main><p>x &lt;y&gt; &eacute;&#233;&#xe9; &nbsp;z</p></main><aside>s</aside>", "x <y> ééé z"),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
    ("<div class='ad banner'>buy</div><div>keep</div><div id=comments><p>c</p></div>", "keep"),
    ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"),
    ("<article><p>x<form><input></form></p><div class=sidebar>s</div><div role=navigation>n</div><p hidden>h</p>y</article>", "x\ny"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<p>a<!-- no <p>x --> b<![CDATA[z]]></p>", "a b"),
    ("<p>5 < 6 and <b>bold</b>er<i> i</i></p>", "5 < 6 and bolder i"),
    ("<p>open <b>tag <script>never ends", "open tag"),
    ("<article><section class='related'>r</section><blockquote>q</blockquote><pre>p\n  q</pre></article>", "q\np q"),
    ("<body class='has-sidebar'><article class='post comments-open'><p>x</p></article><article class='comment even'><p>c</p></article></body>", "x"),
    ("<div class='wrap with-nav'><div class='main-nav'>n</div><p>x</p></div>", "x"),
    ("<div class='cookie-notice'>n</div><div id='site-footer'>f</div><section id=comments><p>c</p></section><p>x &copy; y</p>", "x © y"),
    ("<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
    ("<b>" * 20_000 + "deep", "deep"),
    ("<div>" * 20_000 + "deep", "deep"),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_main_text(n):
    html, want = CASES[n]
    out = []
    if html:
        for top in htmltext.contents(htmltext.parse(html, {})):
            out += htmltext.blocks(top)
    assert "\n".join(out) == want


def test_query(spark, tables):
    pages = [(i, f"http://h{i}.org/", html) for i, (html, _) in enumerate(CASES)] + [(None, None, "<p>a"), (0, "odd", "<p>b"), (0, "odd", "<p>b")]
    out = htmltext.op7_html(spark, tables(pages=pages))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, f"http://h{i}.org/", t, len(t)) for i, (_, t) in enumerate(CASES)] + [(None, None, "a", 1), (0, "odd", "b", 1), (0, "odd", "b", 1)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert htmltext.op7_html(spark, tables(pages=[])).collect() == []


def test_style_tree_finds_what_a_site_repeats(spark, tables):
    pages = [(i, f"http://site.org/{i}", f"<article><p>Own text {i}.</p><div class='box{i}'>Read more about our terms.</div><div class=para>Other words {i * 7}.</div></article>") for i in range(12)]
    pages += [(100 + i, "http://small.org/", f"<article><p>Own text {i}.</p><div class=box>Read more about our terms.</div></article>") for i in range(3)]
    got = {r.page_id: r.text for r in htmltext.op7_html(spark, tables(pages=pages)).collect()}
    assert got[3] == "Own text 3.\nOther words 21." and got[101] == "Own text 1.\nRead more about our terms."


@pytest.mark.parametrize("rows", [20_000, 0])
def test_copies_of_a_page_are_one(spark, tables, monkeypatch, rows):
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", rows)
    pages = [(i, "http://copies.org/", "<article><div class=c>The same in all copies.</div></article>") for i in range(30)]
    pages += [(100 + i, "http://site.org/", f"<div class=a>{i}</div><div class=b>same</div>") for i in range(9)]
    got = {r.page_id: r.text for r in htmltext.op7_html(spark, tables(pages=pages)).collect()}
    assert {got[i] for i in range(30)} == {"The same in all copies."} and got[104] == "4"


def test_table_has_the_articles_alone(spark, sf_dir):
    got = htmltext.op7_html(spark, sf_dir).collect()
    assert len(got) == 50 and all(r.n_chars == len(r.text) and "©" not in r.text and "track(" not in r.text for r in got)
    assert got[0].text.count("\n") > 2


def test_low_branches_against_counted_entropies(spark):
    """The style tree once more: pages parsed by the standard library, styles' paths and texts counted by hand."""
    import math
    import random
    from collections import Counter, defaultdict
    from html.parser import HTMLParser

    rng = random.Random(12)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    pages = []
    for i in range(60):
        host = f"h{i % 4}.org"
        body = "".join(f"<div class='p{'ab'[k % 2]}'><span>{word()} {i if k % 3 else ''}</span>{'<ul><li>x</ul>' * rng.randrange(2)}</div>" for k in range(rng.randrange(1, 5)))
        pages.append((i, f"http://{host}/{i}", f"<body><div class=top><p>Same on all.</p></div>{body}<section class=s{i % 2}><p>{word()}</p></section></body>"))
    pages += [(100, "http://h1.org/again", pages[1][2]), (101, "http://h9.org/", "<div class=top>x</div>"), (102, None, None)]

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.top = ["html", [], ""]
            self.stack = [self.top]

        def handle_starttag(self, tag, attrs):
            names = " ".join(sorted(dict(attrs).get("class", "").split()))
            node = [tag + ("." + "".join("#" if c.isdigit() else c for c in names) if names else ""), [], ""]
            self.stack[-1][1].append(node)
            self.stack.append(node)

        def handle_endtag(self, tag):
            while self.stack[-1][0].split(".")[0] != tag:  # li is left open
                self.stack.pop()
            self.stack.pop()

        def handle_data(self, data):
            for n in self.stack:
                n[2] += "|" + " ".join(data.split())

    seen = defaultdict(set)
    for _, url, html in pages:
        if html is None:
            continue
        tree = Tree()
        tree.feed(html)
        host, whole, todo = url.split("/")[2], tree.top[2], [(tree.top, ())]
        while todo:
            node, path = todo.pop()
            for x in node[1]:
                at = (*path, x[0])
                if x[0].split(".")[0] in htmltext.BLOCK - htmltext.ROOTS:
                    seen[host, at, 0].add((">".join(y[0] for y in x[1]), whole))
                    seen[host, at, 1].add((x[2], whole))
                todo.append((x, at))
    importance = defaultdict(float)
    for (host, at, kind), features in seen.items():
        n, counts = len(features), Counter(f for f, _ in features)
        if n >= htmltext.PAGES:
            h = -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)
            importance[host, at] += h * (htmltext.DEEP if kind else 1 - htmltext.DEEP)
    import xxhash

    def name(path):
        h = 0
        for style in path:
            h = xxhash.xxh64_intdigest(f"{h}/{style}") - (1 << 63)
        return h

    want = {(host, name(at)) for (host, at), x in importance.items() if x < htmltext.LOW}
    got = {(r.host, r.path) for r in htmltext.low_branches(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and len(want) >= 4


def test_columns_named_like_those_added(spark):
    pages = [(i, f"http://site.org/{i}", f"<div class=a>{i}</div><div class=b>same</div>", "x", 7, "y", [1]) for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, host int, __host string, __low array<int>")
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and {(r.page_id, r.text) for r in got.collect()} == {(i, str(i)) for i in range(9)}
