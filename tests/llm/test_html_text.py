"""Main text against hand-written pages and the best stretch by brute force."""

import random

from gleaner.llm import html_text as h

COSTS = {"li": 8.0, "nav": 8.0, "a": 6.0, "div": 3.0, "footer": 8.0, "p": 0.01, "h1": 0.01, "b": 0.01, "br": 0.01, "ul": 8.0}
PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy now</div><header>Site head</header>
<article><h1>Title &lt;one&gt;</h1><p><b>First&nbsp;  line &copy; &am<br>goes
on.<p>Second <a href='a>b'>li<i>n</i>k</a> text &#233;&#x41;</p><div id="cookie-notice"><p>We use cookies</p></div><ul><li>Item 1<li>Item 2</ul>
<aside>side</aside><form><input value="q"> Search</form><table><tr><td>cell</td></tr></table><p>a < b</p>
<section id="comments"><article class="comment"><p>Nice post</p></article></section></article>
<div hidden>not shown</div><footer>&copy; foot"""
TEXT = "Title <one>\nFirst line © &am goes on.\nSecond link text éA\nItem 1\nItem 2\ncell\na < b"


def test_page_with_everything():
    assert h.extract(PAGE, COSTS) == TEXT


def test_page_without_content_element():
    words = "some longer body of text that reads like an article and goes on for a while"
    page = f"<body><ul><li><a href=1>one</a><li><a href=2>two</a></ul><div><p>{words}</p><p>{words}</p></div><ul><li><a href=3>x</a></ul><div class='footer'>end {words}</div>"
    assert h.extract(page, COSTS) == f"{words}\n{words}"


def test_odd_pages():
    assert h.extract(None, COSTS) == h.extract("", COSTS) == h.extract("<p>", COSTS) == h.extract("<script>x", COSTS) == ""
    assert h.extract("just words", COSTS) == "just words"
    assert h.extract("<article>" + "<p>x y</p>" * 20000 + "</article>", COSTS).count("\n") == 19999
    assert h.extract('<article><p class="a>b" title="q>uoted">in</p></article>', COSTS) == "in"
    assert h.extract("<article>" + "\"'<" * 3000, COSTS)  # broken quotes end in time


def test_scan_finds_the_best_sum():
    rng = random.Random(5)
    for _ in range(300):
        tags = [rng.choice(["<p>", "<li>", "<b>", "<div>"]) if rng.random() < 0.5 else f"w{i} " * rng.randint(1, 6) for i in range(rng.randint(1, 12))]
        values = [len(t.split()) if t[0] == "w" else -COSTS[t[1:-1]] for t in tags]
        best = max([sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)] + [0])
        got = h.extract("".join(tags), COSTS).split()
        inside = [w for t in tags for w in t.split() if t[0] == "w"]
        at = next((i for i in range(len(inside)) if inside[i:i + len(got)] == got), 0)
        assert inside[at:at + len(got)] == got
        covered = [i for i, t in enumerate(tags) if t[0] == "w" and set(t.split()) & set(got)]
        assert abs((sum(values[covered[0]:covered[-1] + 1]) if covered else 0) - best) < 1e-9


def test_query_on_rows(spark):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0)]
    df = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in h.main_text(df, keep=("url",)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert h.main_text(df.limit(0)).collect() == []
    costs = h.learn(df)
    assert costs["nav"] > 1 and costs["h1"] == 0.01
