"""The site style tree against plain Python, and pages that a reader of markup can lose text of."""

import collections
import math
import random

import pytest


def pages_of(rng):
    """Two hosts whose pages share menus, a box within the article, and now and then a text."""
    rows = []
    for i in range(60):
        host = "a.example" if i % 3 else "b.example"
        menu = "".join(f"<li>{w}" for w in ("Home", "News", "About", "Help")[: rng.choice([4, 4, 4, 3])])
        body = "".join(f"<p>{rng.choice(['Story', 'Tale'])} {rng.randrange(30)}</p>" for _ in range(rng.randint(1, 5)))
        box = "<div class=box><p>Read us</p><p>each day</p></div>" if rng.random() < 0.9 else ""
        rows.append((i, f"http://{host}/{i}", f"<html><body><div class=top><ul>{menu}</ul></div><article><h1>Head {i}</h1>{body}{box}</article><div class=end>Bye</div></body></html>"))
    return rows


def test_importances_by_brute_force(spark):
    from faintdip.llm.html_text import GAMMA, host_of, importance, parsed, style_nodes

    rows = pages_of(random.Random(5))
    want = {}
    for host in {host_of(u) for _, u, _ in rows}:
        on, texts, layouts, above = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(lambda: collections.defaultdict(list)), {}
        for i, u, page in rows:
            if host_of(u) != host:
                continue
            every, found = parsed(page)
            for e in every:
                on[e.node].add(i)
                layouts[e.node][i].append(tuple(e.kids))
                above[e.node] = above[e.up.node] + [e.node] if e.up else [e.node]
            for e, t in found:
                texts[e.node, t].add(i)
        for node, where in on.items():
            m = len(where)
            below = [(len(p), len(on[n])) for (n, _), p in texts.items() if node in above[n]]
            entropy = sum(k * (math.log(k, m2) if m2 > 1 else 0) for k, m2 in below)
            content = 1 - entropy / sum(k for k, _ in below) if below and m > 1 else 1
            shapes = collections.Counter(tuple(x) for x in layouts[node].values())
            shown = -sum(k / m * math.log(k / m, m) for k in shapes.values()) if m > 1 else 1
            want[host, node] = (m, content, shown, content + (1 - content) * (1 - GAMMA ** (len(shapes) - 1)) * shown)
    got = {(r["host"], r["node"]): tuple(r)[2:] for r in importance(style_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert set(got) == set(want) and len(want) > 15
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    assert min(v[3] for v in want.values()) < 0.1 < 0.9 < max(v[3] for v in want.values())


def test_tree_decides_within_and_beside_articles(spark):
    from faintdip.llm.html_text import extract

    rows = pages_of(random.Random(6))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (1 << 20, 0):
        got = {r["page_id"]: r["text"] for r in extract(df.repartition(3), bound=bound).collect()}
        for i, _, page in rows:
            assert "Read us" not in got[i] and "Home" not in got[i] and "Bye" not in got[i]
            assert got[i].startswith(f"Head {i}\n") and got[i].count("\n") == page.count("Story") + page.count("Tale")


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p>a</p><svg width="1"/><p>b</p></article>', "a\nb"),
    ("<article><p>a</p><svg><text>no</text></svg><math/><p>b</p></article>", "a\nb"),
    ("<article><title-card>a</title-card><p>b</p><video-js>c</video-js></article>", "a\nb\nc"),
    ("<article><p>a</p><textarea><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><script>var x = 1;<p>b</p></article>", "a\nb"),
    ("<article><p>a<script>if (a<b) '</p>'</script><p>b</article>", "a\nb"),
    ('<article class="post comments-open"><p>a</article>', "a"),
    ('<div id="main" class="no-sidebar"><p>a</div>', "a"),
    ('<div class="content with-sidebar"><article><p>a</article><div class=sidebar>b</div></div>', "a"),
    ('<article><p>a</p><p class="legal">b</p><h2 class="related">c</h2><div class="related">d</div></article>', "a\nb\nc"),
    ("<article>" + "<div>" * 3000 + "a" + "</div>" * 3000 + "<p>b</article>", "a\nb"),
    ("<article>" + "<textarea>" * 2000 + "<p>b</article>", "b"),
    ("<article>" + "<p>word </p>" * 20_000 + "</article>", "\n".join(["word"] * 20_000)),
    ("<", "<"),
    ("<!-- a", ""),
])
def test_nothing_is_lost(page, text):
    from faintdip.llm.html_text import main_text

    assert main_text(page) == text


def test_odd_tables(spark):
    from faintdip.llm.html_text import extract

    rows = [(1, None, None), (1, None, None), (None, "http://h/", "<p>x"), (2, "http://h/", ""), (3, "no url", "<article><p>y</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as salt", "3 as low", "4 as text")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "http://h/", "x", 1), (2, "http://h/", "", 0), (3, "no url", "y", 1)], key=str)
    assert extract(df.limit(0)).count() == 0
