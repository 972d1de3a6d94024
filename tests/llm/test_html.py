from __future__ import annotations

from curatrix.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="top">Site name</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap-{n}"><div class="post-{n} body"><h1>Caf&eacute; &amp; bar {n}</h1><p>First   paragraph of number {n} with <a href="x">a link</a>.<p>Second &lt;one&gt;<br>on two lines.
<ul><li>item one<li>item two</ul><div class="ad">Buy now</div><form>Mail <input></form></div><aside>Related</aside></div>
<div id="comments"><p>I liked it very much indeed, thank you for writing all of this down.</p></div><footer>&copy; me</footer></body></html>"""
TEXT = "Café & bar {n}\n\nFirst paragraph of number {n} with a link.\n\nSecond <one> on two lines.\n\nitem one\n\nitem two"


def test_page():
    assert H.extract_page(PAGE.format(n=3), None) == TEXT.format(n=3)
    assert H.extract_page(None, None) == "" and H.extract_page("just text", None) == "just text"
    assert H.extract_page("<p>a < b & c<p>d <b>e", None) == "a < b & c\n\nd e"


def test_consensus_helps_a_page_that_misleads(spark):
    short = PAGE.format(n=99).replace("First   paragraph of number 99 with <a href=\"x\">a link</a>.", "x").replace("<aside>Related</aside>", "<div class=blurb>" + "A long unrelated blurb. " * 40 + "</div>")
    rows = [(i, f"https://u@Host.example:80/{i}", PAGE.format(n=i)) for i in range(12)] + [(99, "https://host.example/99", short), (100, None, None), (101, "nohost", "")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()}
    assert all(got[i].text == TEXT.format(n=i) and got[i].n_chars == len(got[i].text) for i in range(12))
    assert "unrelated blurb" not in got[99].text and got[99].text.startswith("Café & bar 99")
    assert got[100].text == "" and got[101].n_chars == 0
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_broken_page():
    source = "<div>" * 3000 + "<p " + 'a="' * 2000 + "text" + "<p>x" * 3000
    assert H.extract_page(source, None).endswith("x")


def test_nothing_of_an_article_is_cut(spark):
    items = "".join(f"<li>entry {i} of a long list" for i in range(40))
    listed = f"<body><article><h1>Head</h1><p>Before.</p><ul>{items}</ul><p>After.</p></article></body>"
    whole = "\n\n".join(["Head", "Before.", *(f"entry {i} of a long list" for i in range(40)), "After."])
    assert H.extract_page(listed, None) == whole
    rows = "".join(f"<tr><td>row {i}<td>{i}" for i in range(40))
    assert H.extract_page(f"<body><article><p>Before.</p><table>{rows}</table></article>", None).startswith("Before.\n\nrow 0\n\n0\n\nrow 1")
    led = "<body><div class=page><h1>Head {n}</h1><div class=lead>" + "lead " * 35 + "</div><div class=body>" + "body " * 65 + "</div></div></body>"
    plain = "<body><article><h1>H</h1><p>Words before.</p><ul><li>one</ul></article></body>"
    pages = [(i, f"http://led/{i}", led.format(n=i)) for i in range(5)] + [(9, "http://mixed/9", listed)] + [(10 + i, f"http://mixed/{i}", plain) for i in range(3)]
    mixed = [(20 + i, f"http://half/{i}", led.format(n=i) if i % 2 else "<body><div class=page><div class=body>just a body</div></div>") for i in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages + mixed, "page_id long, url string, html string")).collect()}
    want = lambda n: f"Head {n}\n\n{' '.join(['lead'] * 35)}\n\n{' '.join(['body'] * 65)}"
    assert all(got[i] == want(i) for i in range(5)) and got[9] == whole
    assert all(got[10 + i] == "H\n\nWords before.\n\none" for i in range(3))
    assert all(got[20 + i] == (want(i) if i % 2 else "just a body") for i in range(6))


WRAPPED = "<body><nav><a href=/>Home</a></nav><div class='{c}'><h1>Title</h1><p>{t}</p><div class='sidebar'><p>Side words.</p></div></div><div id=comments><p>{r}</p></div><footer>f</footer></body>"


def test_a_container_with_most_of_a_page_is_kept_whatever_its_name():
    words = " ".join(["word"] * 60)
    for c in ("layout has-sidebar", "content-with-sidebar", "post widget-area", "single-post share-enabled", "read-more-wrapper"):
        assert H.extract_page(WRAPPED.format(c=c, t=words, r="No."), None) == f"Title\n\n{words}", c
    long = " ".join(["remark"] * 300)
    assert H.extract_page(WRAPPED.format(c="post", t=words, r=long), None) == f"Title\n\n{words}"


def test_an_article_outside_the_winning_path_is_not_lost(spark):
    words = " ".join(["word"] * 60)
    usual = "<body><div class=story><h1>T</h1><p>" + words + "</p></div><div class=box><p>Box.</p></div></body>"
    odd = "<body><div class=story><p>A teaser.</p></div><article class=long><h1>Real</h1><p>" + words + "</p></article></body>"
    rows = [(i, f"http://a/{i}", usual.replace("<div class=box><p>Box.</p></div>", "")) for i in range(9)] + [(20, "http://a/x", odd), (20, "http://a/x", odd)]
    got = [(r.page_id, r.text) for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got)[-2:] == [(20, f"A teaser.\n\nReal\n\n{words}")] * 2
    tie = [(1, "http://t/1", "<body><div class=a><p>one</p></div></body>"), (2, "http://t/2", "<body><div class=b><p>two</p></div></body>")]
    assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(tie, "page_id long, url string, html string")).collect()} == {1: "one", 2: "two"}
