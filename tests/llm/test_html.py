import random
from collections import defaultdict

from pyspark.sql import functions as F

from lectern.llm import html


def text(page):
    return html.Page(page).text()


def test_main_text_only():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>top</header>
    <nav><ul><li><a href=x>menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>
    line &copy; &#8364;<p>Two<br>parts<ul><li>a<li>b</ul><div class="share">share</div><form>f</form><footer>foot</footer><section id="comments"><article><p>reader</p></article></section></article>
    <aside>side</aside><div class="ad">buy</div><footer>bottom</footer></body></html>"""
    assert text(page) == "Title & more\nOne bold line © €\nTwo parts\na\nb"


def test_broken_markup():
    assert text(None) == "" and text("") == "" and text("plain &lt;text") == "plain <text"
    assert text("<article><p><b>unclosed<br><p>next <i>crossed <b>tags</i></b> end") == "unclosed\nnext crossed tags end"
    assert text("<article><p>cut off <a href='x") == "cut off"
    assert text("<div class='page-with-sidebar'><article><p>kept</p></article></div>") == "kept"
    assert text("<main><p>m</p></main><p>outside</p>") == "m"
    assert text("<article><p>a<!-- <p>no --> b</p><!-- never ends") == "a b"
    assert text("<article><table><tr><td>1<td>2<tr><td>3</table><p>x &am</article>") == "1\n2\n3\nx &am"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("<article><p>" + "long " * 100000) == ("long " * 100000).strip()
    assert text("<article><svg><p>no</p></svg><P CLASS=Ad>no</P><p hidden>no</p><p>yes</p>") == "yes"


def test_depth_has_no_limit():
    assert text("<div>" * 3000 + "<nav>MENU<p>item</nav><p>kept" + "</div>" * 3000) == "kept"
    page = "<span>" * 3000 + "a" + "</span>" * 3000 + "</div>" * 3000 + "<p>b"
    assert text(page) == "a\nb"


SITE = """<body><div class="x1"><a href="/a">Start</a> <a href="/b">About us</a></div><div class="x2">We use small files.</div>
<article><h1>Story {i}</h1><p>Told at length, {i} times over and over again.</p><div>Read more every day</div></article><div>Latest: {i}</div><p>Made by hand</p></body>"""


def test_templates_are_found_without_rules_of_names(spark):
    """Menu, notice and a box within the article recur; what is left of a page is its own."""
    rows = [(i, f"http://site.org/{i}", SITE.replace("<article>", "<section>").replace("</article>", "</section>").format(i=i)) for i in range(12)]
    rows += [(100 + i, f"http://article.org/{i}", SITE.format(i=i)) for i in range(12)]
    rows += [(200 + i, f"http://nav.org/{i}", f"<body><nav><a>Home</a></nav><h1>Tale {i}</h1><p>Words of the tale {i}.</p><footer>All rights</footer></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast_hashes in (html.BROADCAST_HASHES, 0):
        found = {r["page_id"]: r["text"] for r in html.extract(df, names=False, broadcast_hashes=broadcast_hashes).collect()}
        assert found[3] == "Story 3\nTold at length, 3 times over and over again.\nLatest: 3"
        assert found[103] == "Story 3\nTold at length, 3 times over and over again."
        assert found[203] == "Tale 3\nWords of the tale 3."


def test_templates_equal_brute_force(spark):
    rng = random.Random(3)
    boxes = [f"<div><p>box {i}</p></div>" for i in range(12)]
    rows = []
    for i in range(300):
        host = rng.choice("aaab")
        rows.append((i, f"http://{host}.org/{i}", f"<body><p>own words number {rng.randrange(150)} in a longer line of text</p>{''.join(rng.sample(boxes, 3) if rng.random() < 0.2 else boxes[:2])}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts, where = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        tree, host = html.Page(page), url[7]
        texts[host].add(tree.text())
        for h in tree.hashes():
            where[host, h].add(tree.text())
    want = sorted((h, len(v)) for (host, h), v in where.items() if len(v) >= 10 and len(v) >= 0.1 * len(texts[host]))
    got = html.templates(html.page_hashes(df), share=0.1).collect()
    assert sorted((r["hash"], r["pages"]) for r in got) == want and len(want) > 4


def test_site_templates(spark):
    box = "<div><p>Follow us</p><ul><li>here</li></ul></div>"
    rows = [(i, f"http://Site.org/{i}", f"<body><p>Story {i} is told at some length here.</p>{box}<div>own {i}</div>") for i in range(12)]
    rows += [(100 + i, f"http://few.org/{i}", f"<body><p>Tale {i} is told at some length here.</p>{box}") for i in range(3)]
    rows += [(200 + i, "http://copy.org/x", "<article><h1>Same</h1><div><p>The same whole article on many pages.</p></div></article>") for i in range(12)]
    rows += [(300, None, None), (301, "http://e.org", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("blocks", F.lit(1))
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()]
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    by = {i: t for i, t, _ in found}
    assert by[3] == "Story 3 is told at some length here.\nown 3" and by[101].endswith("Follow us\nhere")
    assert by[205] == "Same\nThe same whole article on many pages." and by[300] == by[301] == ""
    assert sum(i == 0 for i, _, _ in found) == 2
    assert html.extract(df.where("false")).count() == 0


def test_copied_pages_stay_whole(spark):
    article = "<article><div><p>first part</p></div><ul><li>one</li><li>two</li></ul><section><p>third part</p></section></article>"
    plain = "<body><h1>A page</h1><p>of short</p><p>paragraphs</p></body>"
    box = "<div><p>Follow us</p></div>"
    rows = [(i, f"http://copy.org/{i}", article) for i in range(15)] + [(100 + i, f"http://plain.org/{i}", plain) for i in range(15)]
    rows += [(200 + i, f"http://mixed.org/{i}", f"<body><p>Story {i % 12} at some length</p>{box}</body>") for i in range(40)]
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {found[i] for i in range(15)} == {"first part\none\ntwo\nthird part"}
    assert {found[100 + i] for i in range(15)} == {"A page\nof short\nparagraphs"}
    assert all(found[200 + i] == f"Story {i % 12} at some length" for i in range(40))
