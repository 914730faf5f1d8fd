import html
import random
import urllib.parse

import duckdb

from segspark.llm._components import connected_components
from segspark.llm.url_filter import OP1_SQL, UrlRule, op1_url_filter, resolve, url_filter

SCHEMA = "page_id long, url string, html string"
RULES = [UrlRule("block", "bad.com", "/"), UrlRule("allow", "bad.com", "/good/"), UrlRule("allow", "fine.org", "/")]


def link(to):
    return f'<html><LINK href="{to}" rel="canonical"></html>'


def test_blocks_reach_aliases_and_allows_win(spark):
    pages = [
        (1, "http://x.net/a", link("http://y.net/b")),
        (2, "http://y.net/b", '<meta http-equiv="refresh" content="0; url=http://www.BAD.com/z">'),
        (3, "http://z.net/c", link("http://bad.com/good/q")),
        (4, "http://bad.com/n", link("http://fine.org/")),
        (5, "http://u.net/", None),
        (6, "http://v.net/1", link("/2")),
        (7, "http://v.net/2", link("http://bad.com/1")),
        (8, "http://w.net/1", link("http://bad.com/7")),
        (9, "http://w.net/1", link("http://fine.org/7")),
    ]
    got = {r["page_id"]: (r["verdict"], r["rule"], r["via_alias"]) for r in url_filter(spark.createDataFrame(pages, SCHEMA), RULES).collect()}
    assert got == {
        1: ("block", None, True),
        2: ("block", None, True),
        3: ("allow", None, True),
        4: ("block", "bad.com/", False),
        5: ("allow", None, False),
        6: ("block", None, True),
        7: ("block", None, True),
        8: ("allow", None, True),
        9: ("allow", None, True),
    }


CASES = [
    ("http://a.net/x/y", "/login?next=http://d.com/de/1", "a.net/login?next=http://d.com/de/1"),
    ("http://c.com/q/y", "../de/1", "c.com/de/1"),
    ("http://c.com/q/y", "p?a=1&amp;b=2", "c.com/q/p?a=1&b=2"),
    ("http://c.com/q/y?z", "?k=./..", "c.com/q/y?k=./.."),
    ("http://c.com/q/y", "#top", None),
    ("http://c.com", "a/./b/..", "c.com/a/"),
    ("http://c.com/q/", "HTTPS://D.com", "D.com"),
    ("http://c.com/q/", "//d.com/../x/", "d.com/x/"),
    ("http://c.com/q/", "mailto:a@b.c", None),
    ("http://c.com/q/", "x:y/z", None),
    ("no host", "/x", None),
]


def split(url):
    u = urllib.parse.urlsplit(url)
    return u.netloc.lower() + u.path + ("?" + u.query if "?" in url.partition("#")[0] else "")


def test_links_are_resolved():
    for base, to, want in CASES:
        u = urllib.parse.urlsplit(base)
        found = resolve(u.netloc, u.path, to)
        assert (found and found.removeprefix("x://")) == want, (base, to)


def test_a_thousand_links_like_the_standard_library():
    dice = random.Random(6)
    for _ in range(1000):
        base = f"http://h{dice.randint(1, 3)}.com" + "".join("/" + dice.choice(["a", "b.c", "d~"]) for _ in range(dice.randint(0, 4))) + dice.choice(["", "/"])
        front = dice.choice(["", "", "/", "/", "//k.net/", "http://m.org/", "https://N.org/"])
        # The library leaves dot segments of links with a host as they are.
        parts = [dice.choice(["x", "y.z", "...", "q"] + ["..", "."] * (len(front) < 2)) for _ in range(dice.randint(1, 6))]
        to = front + "/".join(parts) + dice.choice(["", "/", "?p=../.", "?a#b", "#c", "&amp;d"])
        u = urllib.parse.urlsplit(base)
        assert resolve(u.netloc, u.path, to).removeprefix("x://").lower() == split(urllib.parse.urljoin(base, html.unescape(to))).lower(), (base, to)


def test_resolved_links_against_sql(spark, tmp_path):
    pages = [(i, base, link(to)) for i, (base, to, _) in enumerate(CASES)]
    dice = random.Random(7)
    some = ["..", ".", "de", "fr", "1", "x"]
    for i in range(300):
        base = f"http://s{dice.randint(1, 9)}.{dice.choice(['com', 'net'])}/" + "/".join(dice.choices(some[2:], k=dice.randint(0, 3)))
        to = dice.choice(["", "/", "//s1.net/", "http://s2.com/"]) + "/".join(dice.choices(some, k=dice.randint(1, 4))) + dice.choice(["", "/", "?u=http://d.com/de/", "?a&amp;b", "#c"])
        pages.append((100 + i, base, link(to)))
    spark.createDataFrame(pages, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df = op1_url_filter(spark, str(tmp_path))
    want = con.execute(OP1_SQL)
    order = [[c[0] for c in want.description].index(c) for c in df.columns]
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    verdict = {r[0]: r[4] for r in rows}
    assert verdict[0] == "allow" and verdict[1] == "block" and sum(r[5] for r in rows) > 20


def test_redirect_table_and_odd_rows(spark):
    pages = [(1, "http://x.net/a", ""), (2, None, None), (None, "no scheme", "<html>"), (3, "http://X.NET/a#f", link("::")), (4, "://", "x"), (1, "http://x.net/a", "")]
    moved = spark.createDataFrame([("http://x.net/a", "http://bad.com/"), (None, "http://bad.com/"), ("http://x.net/a", "http://x.net/a")], "source string, target string")
    extra = spark.createDataFrame([(*r, "v", 1) for r in pages], SCHEMA + ", verdict string, component int")
    got = sorted((r["page_id"] or 0, r["host"], r["verdict"]) for r in url_filter(extra, RULES, moved).collect())
    assert got == [(0, "", "allow"), (1, "x.net", "block"), (1, "x.net", "block"), (2, "", "allow"), (3, "x.net", "block"), (4, "", "allow")]


def test_no_pages(spark):
    assert url_filter(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (60, 0), (5, 6), (None, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, **dict.fromkeys(range(200, 250), 100), 300: 300}


def test_all_links_of_a_page_against_sql(spark, tmp_path):
    moved = lambda to: f"<META content='0; url={to}' http-equiv=refresh>"
    pages = [
        (1, "http://x.net/a", link("http://y.net/b") + "\n" + link("http://q.com/de/1")),
        (2, "http://z.net/c", moved("http://w.net/") + moved("http://q.com/de/2")),
        (3, "http://v.net/1", link("/2") + link("//u.net/") + moved("3") + moved("http://q.com/fr/1")),
        (4, "http://u.net/", None),
        (5, "http://v.net/3", ""),
        (6, "http://t.net/", '<link rel=canonical href=http://s.net/ <link rel=canonical href=http://q.com/de/3>' + "<link rel=icon href=http://q.com/de/4>"),
    ]
    spark.createDataFrame(pages, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    got = op1_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(OP1_SQL)
    rows = sorted(map(tuple, got.select(*(c[0] for c in found.description)).collect()))
    assert rows == sorted(found.fetchall())
    assert [(r[0], r[4], r[5]) for r in rows] == [(1, "block", True), (2, "block", True), (3, "allow", True), (4, "allow", True), (5, "allow", True), (6, "allow", False)]


def web(seed=4):
    """Some thousand pages: chains, a target with a thousand aliases, cliques of links, blocks
    that meet allows, several links on a page, pages without links, and repeated addresses."""
    import random

    r = random.Random(seed)
    moved = lambda to: f'<meta http-equiv="refresh" content="0; url={to}">'
    ends = ["http://a.com/de/1", "http://b.com/fr/2", "http://www.example.org/es/3", "http://c.net/plain", "http://d.com/xx/"]
    pages = [(f"http://alias{i}.net/{i}", r.choice([link, moved])("http://hub.net/")) for i in range(1000)] + [("http://hub.net/", link("http://q.com/de/hub"))]
    for c in range(120):
        n = r.randrange(2, 30)
        chain = [(f"http://chain{c}.net/{i}", moved(f"/{i + 1}")) for i in range(n)]
        pages += chain + [(f"http://chain{c}.net/{n}", link(r.choice(ends).replace("://", f"://c{c}.")) if c % 3 else None)]
    for k in range(200):
        to = [f"http://k{k}-{j}.net/x?y={j}" for j in range(r.randrange(1, 5))]
        pages += [(t, "".join(r.choice([link, moved])(r.choice([*to, *(e.replace("://", f"://k{k}.") for e in ends)])) for _ in range(r.randrange(0, 4)))) for t in to for _ in range(r.randrange(1, 3))]
    pages += [(f"http://q.com/{r.choice(['de', 'fr', 'en'])}/{i}", None) for i in range(300)] + [(None, link("http://q.com/de/9")), ("no scheme", moved("http://q.com/de/8"))] * 50
    r.shuffle(pages)
    return [(i, u, h) for i, (u, h) in enumerate(pages)]


def by_union_find(pages):
    import re

    def key(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        return (m[1].lower(), m[2], m[3] or "") if m and m[1] else None

    def rule(k):
        fit = [(len(h + p), h + p, v) for v, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")) if (k[0] == h or k[0].endswith("." + h)) and k[1].startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for _, url, html in pages:
        k = key(url)
        for to in re.findall(r'href="([^"]*)"|url=([^"]*)"', html or "") if k else ():
            to = to[0] or to[1]
            to = key(to if "://" in to else f"x://{k[0]}{to}")
            up[root(k)] = root(to)
    votes = {}
    for k in list(up):
        votes.setdefault(root(k), set()).add(rule(k)[1])
    out = []
    for page, url, _ in pages:
        k = key(url)
        name, verdict = rule(k) if k else (None, None)
        spread = next((v for v in ("allow", "block") if k in up and v in votes[root(k)]), None)
        out.append((page, k[0] if k else "", k[1] if k else "", name, verdict or spread or "allow", verdict is None and spread is not None))
    return out


def test_thousands_of_pages_against_union_find_and_sql(spark, tmp_path):
    pages = web()
    assert len(pages) > 4000
    spark.createDataFrame(pages, SCHEMA).repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, op1_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "via_alias").collect()))
    assert got == by_union_find(pages)
    assert sum(r[5] for r in got) > 1500 and sum(r[5] and r[4] == "block" for r in got) > 1000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(f"SELECT page_id, host, path, rule, verdict, via_alias FROM ({OP1_SQL})").fetchall()) == got
