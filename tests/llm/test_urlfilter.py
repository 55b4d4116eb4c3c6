from __future__ import annotations

import pytest

from sumire.llm import urlfilter

PAGES = [
    (1, "http://a.example.com/en/x?q=1", ""),
    (2, "HTTP://WWW.Example.COM/en/x#f", None),
    (3, "https://x.www.example.com/en/", "<p>"),
    (4, "https://notexample.com/en/", ""),
    (5, "https://com/anything", ""),
    (6, "https://a.net/es/1", ""),
    (7, "https://a.net/de/1", ""),
    (8, "https://net/fr/1", ""),
    (9, "https://b.org/x", '<a href="http://a.net/es/2">l</a><A class=q HREF=//a.net/y>'),
    (10, "https://c.org", "<a href='https://b.org'>b</a>"),
    (11, "https://d.org/p://q/r?s", "<a href=https://sub.example.com/>"),
    (12, "no scheme", ""),
    (13, None, '<a href="http://a.net/">x</a>'),
    (14, "", ""),
    (15, "https://bad.net/es/", '<a href="https://lost.org/">'),
    (16, "x://https://y/z", ""),
    (17, "https://só.net/es/é", ""),
    (18, "https://a.com", ""),
    (19, "https://a.com?x", ""),
    (None, "https://a.net/fr/", ""),
    (20, "https://a.net/fr/", ""),
    (20, "https://a.net/fr/", ""),
    (21, "https://multi\nline.net/es/a\nb?c", ""),
]


@pytest.fixture
def folder(tables):
    return tables(pages=PAGES)


def test_rules(spark, folder):
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.op3_url_filter(spark, folder).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/")
    assert got[2] == ("www.example.com", "/en/x", "www.example.com/en/")
    assert got[3] == ("x.www.example.com", "/en/", "www.example.com/en/")
    assert got[4] == ("notexample.com", "/en/", "com/")
    assert got[5] == ("com", "/anything", "com/")
    assert got[6] == ("a.net", "/es/1", "net/es/") and got[7] == ("a.net", "/de/1", None) and got[8] == ("net", "/fr/1", "net/fr/")
    assert got[12] == got[13] == got[14] == ("", "", None)
    assert got[16] == ("https:", "//y/z", None)
    assert got[18] == ("a.com", "", None) and got[21] == ("multi\nline.net", "/es/a\nb", "net/es/")


def test_distrust_goes_back_along_links(spark, folder):
    got = {r.page_id: r.verdict for r in urlfilter.op3_url_filter(spark, folder).collect()}
    assert got[9] == "block"  # links to a blocked host alone
    assert got[7] == "block"  # the other pages of its host are blocked
    assert got[11] == "allow" and got[12] == got[13] == got[14] == "allow"
    assert got[15] == got[6] == "block" and got[2] == "allow"


def test_sql(spark, sf_dir, folder, duck, rows):
    assert rows(urlfilter.op3_url_filter(spark, folder)) == duck(urlfilter.SQL["op3_url_filter"], folder)
    assert rows(urlfilter.op3_url_filter(spark, sf_dir)) == duck(urlfilter.SQL["op3_url_filter"])


def test_empty_and_no_python_in_the_plan(spark, tables):
    folder = tables(pages=[])
    out = urlfilter.op3_url_filter(spark, folder)
    assert out.collect() == [] and out.columns == ["page_id", "host", "path", "rule", "verdict"]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_many_linkers_to_a_blocked_host(spark, tables, duck, rows):
    """How many others link to a blocked host changes nothing; links to good hosts do. Extra columns don't matter."""
    pages = [(0, "https://bad.net/es/", None)] + [(i, f"https://l{i}.org/", "<a href=https://bad.net/es/>x</a>") for i in range(1, 60)]
    pages += [(100, "https://mixed.org/", "<a href='https://bad.net/es/'>x</a>" + "<a href='https://good.com/'>y</a>" * 9), (101, "https://good.com/", None)]
    pages += [(200 + i, f"https://ring{i}.org/", f"<a href='https://ring{(i + 1) % 30}.org/'>x</a>" + "<a href=https://l1.org>z</a>" * (i == 0)) for i in range(30)]
    folder = tables(pages=pages)
    out = urlfilter.op3_url_filter(spark, folder)
    got = {r.page_id: r.verdict for r in out.collect()}
    assert {got[i] for i in range(60)} == {"block"} and got[100] == got[101] == "allow"
    assert rows(out) == duck(urlfilter.SQL["op3_url_filter"], folder)
    more = spark.read.parquet(f"{folder}/pages.parquet").selectExpr("*", "1 AS host", "'x' AS verdict", "2 AS __blocked", "3 AS rule")
    assert {r.page_id: r.verdict for r in urlfilter.judge(more).collect()} == got


def test_ranks_against_plain_iteration(spark):
    import random

    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): rng.randrange(1, 5) for a in hosts for b in rng.sample(hosts, 3) if a != b}
    seeds = {h: rng.random() for h in hosts[:5]}
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    ranks = dict.fromkeys(hosts, 0.0)
    for _ in range(300):
        ranks = {h: 0.15 * seeds.get(h, 0.0) + 0.85 * sum(ranks[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts}
    from sumire.llm._shared import Scratch

    ways = urlfilter.shares(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")).selectExpr("src AS a", "dst AS b", "share")
    got = urlfilter.spread(spark.createDataFrame(list(seeds.items()), "host string, seed double"), ways, Scratch(spark, "test"), 1e-6)
    for r in got.collect():
        assert abs(r["rank"] - ranks[r.host]) < 1e-5
