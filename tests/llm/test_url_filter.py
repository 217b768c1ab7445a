"""URL filter: rules, links and classes against plain Python."""

import random
import re

import pytest

from tarnwave.llm.url_filter import RULES, UrlRule, judge_urls

from .fixtures import CLASHING


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2], m[3] or "") if m else ("", "", "")


def rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), r.name), default=None)


def brute(pages, edges, rules):
    """pages: (id, url). edges: (url, url)."""
    root = {}

    def at(url):
        h, p, q = parts(url)
        return h + (p or "/") + q

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    said = {}
    for u in [u for _, u in pages] + [u for e in edges for u in e]:
        h, p, _ = parts(u)
        r = rule(h, p, rules)
        if h and r:
            said.setdefault(at(u), set()).add(r.verdict)
    for a, b in edges:
        root[find(at(a))] = find(at(b))
    classes = {}
    for x in list(root):
        classes.setdefault(find(x), set()).update(said.get(x, ()))
    out = []
    for i, u in pages:
        h, p, _ = parts(u)
        r, own = rule(h, p, rules), classes.get(find(at(u)), set()) if h and at(u) in root else set()
        out.append((i, h, p, r and r.name, r.verdict if r else "allow" if "allow" in own else "block" if "block" in own else "allow"))
    return sorted(out, key=repr)


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", *[F.lit("clash").alias(c.split()[0]) for c in CLASHING.split(", ") if not c.startswith(("host", "path"))], F.lit(1).alias("host"), F.lit(1).alias("rule"), F.lit(1).alias("node"))


def told(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("html,to", [
    ('<link rel="canonical" href="http://b.com/de/1">', "block"), ("<LINK href='//b.com/de/1' REL=Canonical />", "block"), ('<link rel="alternate canonical" href=http://b.com/de/1>', "block"),
    ('<meta http-equiv="refresh" content="0; url=http://b.com/de/1">', "block"), ("<meta content='5;URL=\"http://b.com/de/1\"' http-equiv=Refresh>", "block"), ('<link rel="canonical" href="http://b.com/de/1#top">', "block"),
    ('<link rel="stylesheet" href="http://b.com/de/1">', "allow"), ('<a href="http://b.com/de/1">', "allow"), ('<meta http-equiv="refresh" content="30">', "allow"), ('<link rel="canonical" href="">', "allow"),
    ('<link rel="canonical" href="mailto:b@b.com/de/1">', "allow"), ('<link rel="canonical" href="/de/1">', "block"), ('<link rel="canonical" href="x">', "allow"), ('<link rel="canonical" href="http://c.org/x">', "allow"), (None, "allow"),
])
def test_links(spark, html, to):
    got = judge_urls(table(spark, [(1, "https://a.com/en/page", html)])).collect()[0]
    assert (got["rule"], got["verdict"]) == (None, to)


def test_classes_against_union_find(spark):
    r = random.Random(2)
    url = lambda: f"{r.choice(['http', 'https'])}://{r.choice(['', 'www.', 'M.'])}{r.choice('abcd')}.{r.choice(['com', 'com', 'net', 'net', 'org', 'example.org'])}/{r.choice(['de', 'fr', 'en', 'es'])}/{r.randrange(30)}{r.choice(['', '?q=1', '#top'])}"
    pages, edges, rows = [], [], []
    for i in range(400):
        u = url()
        html = "<p>"
        if r.random() < 0.3:
            to = url()
            edges.append((u, to))
            html += r.choice([f'<link rel="canonical" href="{to}">', f'<meta http-equiv="refresh" content="0;url={to}">'])
        pages.append((i, u))
        rows.append((i, u, html))
    hub = "http://hub.net/x"
    for i in range(400, 600):  # one target with a third of all links, a long chain, and a block at its end
        pages.append((i, f"http://s{i}.net/"))
        rows.append((i, f"http://s{i}.net/", f'<link rel="canonical" href="{hub}">'))
        edges.append((f"http://s{i}.net/", hub))
    known = [(f"http://c{i}.net/", f"http://c{i + 1}.net/") for i in range(60)] + [("http://c60.net/", "http://z.com/de/"), ("http://c0.net", hub), (None, hub), (hub, None)]
    pages += [(None, None), (700, ""), (701, "no scheme"), (702, "http://"), (703, "x://org"), (703, "x://org"), (704, "http://org/"), (705, "http://c30.net/#f"), (706, "http://notorg/es/")]
    rows += [(i, u, None) for i, u in pages[-9:]]
    redirects = spark.createDataFrame(known, "source string, target string")
    got = told(judge_urls(table(spark, rows).repartition(5), redirects=redirects, small=50))
    assert got == brute(pages, edges + [e for e in known if None not in e], RULES)
    assert ("block" in {v for i, *_, v in got if i == 450}) and got == told(judge_urls(table(spark, rows), redirects=redirects))


def test_allow_has_precedence(spark):
    links = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [(1, "http://a.net/", links("http://b.com/de/")), (2, "http://c.net/", links("http://a.net/")), (3, "http://d.net/", links("http://c.net/") + links("http://e.org/x")), (4, "http://f.org/", links("http://b.com/de/")), (5, "http://g.net/", links("http://h.com/de/"))]
    got = {r["page_id"]: (r["verdict"], r["aliased"]) for r in judge_urls(table(spark, rows)).collect()}
    assert got == {1: ("allow", True), 2: ("allow", True), 3: ("allow", True), 4: ("allow", False), 5: ("block", True)}


def test_empty_tables_and_no_rules(spark):
    assert judge_urls(table(spark, [])).collect() == []
    got = judge_urls(table(spark, [(1, "http://a.com/de/", "")]), rules=()).collect()
    assert [tuple(r)[:5] for r in got] == [(1, "a.com", "/de/", None, "allow")]
    got = judge_urls(table(spark, [(1, "http://a.com/de/", "")]), rules=(UrlRule("block", "a.com", ""), UrlRule("allow", "com", "/d"))).collect()
    assert (got[0]["rule"], got[0]["verdict"]) == ("com/d", "allow")
