import random
import time

from pyspark.sql import functions as F

from chronolex.llm import html_text as H

from .helpers import SF

LONG = "A long sentence with several words, some commas, and enough length to count as a paragraph of prose."


def test_semantic_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><article><h1>Head &amp; line</h1><p>{LONG}
    <p>Short.<br>Next&nbsp;line</p><aside>Side</aside><p>Last &lt;b&gt; &#233;</p></article><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == "\n\n".join(["Head & line", LONG, "Short. Next line", "Last <b> é"])


def test_page_of_divs():
    page = f"""<body><div id="cookie-banner">We use cookies, lots of them, for you, and more, and more.</div><div class="topNav"><a href=x>Home</a></div>
    <div class="wrapper with-sidebar"><div class="content"><h2>Title</h2><p>{LONG}</p><p>{LONG} Two.</p><ul><li>one</li><li>two</li></ul></div>
    <div class="sidebar"><p>{LONG} side</p></div></div><form><p>Name</p><input name=a></form><div class="advert">Buy, now, this, or, that</div>
    <section id="comments"><p>{LONG} I think, well, no.</p><article class="comment"><p>{LONG} me too</p></article></section><div class="site-footer">Bye</div></body>"""
    assert H.main_text(page) == "\n\n".join(["Title", LONG, LONG + " Two.", "one", "two"])


def test_siblings_of_the_best_container_are_kept():
    page = f"<body><div><section><p>{LONG}</p><p>{LONG}</p></section><section><p>{LONG} end</p></section><p>{LONG} tail</p><div><a href=1>one</a> <a href=2>two</a></div></div></body>"
    assert H.main_text(page) == "\n\n".join([LONG, LONG, LONG + " end", LONG + " tail"])


LINKS = "<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul>"
JUNK = [
    '<nav><a href=/>Home</a> <a href=/b>About</a></nav>',
    '<div class="share-buttons"><a href=x>Share this, now, please</a></div>',
    '<aside><p>Elsewhere, there is more, and more, to be read about it.</p></aside>',
    '<script>var a = "<p>no</p>";</script>',
    '<style>p { color: red }</style>',
    '<form><label>Mail</label><input><button>Send</button></form>',
    '<div class="comments"><p>First, I think, this is all wrong, or right, or neither.</p></div>',
    '<div id="cookie-notice">We use cookies, of many kinds, for all, and everyone.</div>',
    '<div style="display:none">Hidden, fully, from all readers, as it should be.</div>',
    '<footer>Written by me</footer>',
]


def test_nothing_of_the_article_is_dropped():
    """Titles in headers, lists of sources, linked paragraphs and marked tables are text of the article."""
    body = f"<p>{LONG}</p><h2>References</h2>{LINKS}<p><a href=3>A paragraph that is one link</a></p>"
    want = [LONG, "References", "First source", "Second source", "A paragraph that is one link"]
    assert H.main_text(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p></header>{body}</article></body>") == "\n\n".join(["Title", "By me", *want])
    assert H.main_text(f"<body><div class=page><div class='post-header'><h1>Title</h1></div><div class=content>{body}<p>{LONG} end</p></div></div></body>") == "\n\n".join(["Title", *want, LONG + " end"])
    table = "<table class=legal><tr><td>Term</td><td class=notice>Meaning of it</td></tr></table>"
    assert H.main_text(f"<article><p>{LONG}</p>{table}</article>") == "\n\n".join([LONG, "Term", "Meaning of it"])
    assert H.main_text(f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short, and kept.</p></div></div></body>") == "\n\n".join([LONG, LONG, "Short, and kept."])


def test_wrappers_of_the_article_stay():
    for wrapper in ('form action="/"', 'div class="page-with-sidebar"', 'div class="content-sidebar"', 'section id="widget"'):
        page = f"<body><nav><a href=/>Home</a></nav><{wrapper}><input name=q><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class=sidebar><p>Side, side, side.</p></div></{wrapper.split()[0]}></body>"
        assert H.main_text(page) == "\n\n".join(["Title", LONG, LONG]), wrapper
    assert H.main_text(f"<body><article><p>Short.</p></article><div class=comments><p>{LONG}</p><h1>Me</h1></div></body>") == "Short."


def test_composed_pages():
    """Pages built of known blocks, with junk anywhere between them, in five layouts: the blocks come back, in order."""
    rng = random.Random(8)
    layouts = ["<article>{}</article>", "<main>{}</main>", "<div class=outer><div class=text>{}</div></div>", "<div id=content>{}</div>", "<section>{}</section>"]
    for n in range(200):
        blocks, parts = [], []
        for k in range(rng.randint(4, 9)):
            words = " ".join(rng.choice("river stone light under morning carried slowly seven".split()) for _ in range(rng.randint(12, 40)))
            text = f"Block {k} {words}, and so on, until the end."
            blocks.append(text)
            tag = rng.choice(["p", "p", "p", "blockquote", "pre", "h2"])
            parts.append(f"<{tag}>{text.replace(' ', rng.choice([' ', chr(10), '  ']), 3)}</{tag}>")
            if rng.random() < 0.5:
                parts.append(rng.choice(JUNK))
        around = [rng.choice(JUNK) for _ in range(3)]
        page = f"<html><body>{around[0]}{LINKS}{around[1]}{layouts[n % 5].format(''.join(parts))}{around[2]}</body></html>"
        assert H.main_text(page) == "\n\n".join(blocks), page


def test_broken_markup():
    assert H.main_text("<p>one<p>two <b>bold</p>tail") == "one\n\ntwo bold\n\ntail"
    assert H.main_text('<p title="it\'s>x">a < b</p><script>never closed') == "a < b"
    assert H.main_text("plain text, no tags") == "plain text, no tags"
    assert H.main_text("<!-- only a comment") == ""
    assert H.main_text("") == H.main_text(None) == ""
    assert H.main_text("<div hidden>no</div><p>yes</p>") == "yes"


def test_long_and_deep_pages_are_linear():
    began = time.time()
    assert H.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert H.main_text(f"<article>{'<p>' + LONG * 3 + '</p>'}" * 5000).count("\n\n") == 4999
    H.main_text("<a title='" * 300)
    assert time.time() - began < 20


def test_query_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.digest(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == H.main_text(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)
        assert got[r.page_id].url == r.url and "track(" not in got[r.page_id].text


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(None, None, None), (1, None, ""), (2, "u", "<p>x</p>"), (2, "u", "<p>x</p>"), (3, "u", "<p>" + "word " * 300_000)], "page_id long, url string, html string")
    pages = pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted((r.page_id or 0, r.n_chars) for r in H.digest(pages).collect())
    assert got == [(0, 0), (1, 0), (2, 1), (2, 1), (3, 1_499_999)]
    assert H.digest(pages.limit(0)).count() == 0


def test_names_alone_drop_no_text():
    """Text in math and xmp, wrappers with odd names, named paragraphs, articles in parts and titles over containers stay."""
    assert H.main_text(f"<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is here.</p><xmp><b>raw & bold</b></xmp><p>{LONG}</p></article>") == "\n\n".join(["Energy E=m is here.", "<b>raw & bold</b>", LONG])
    assert H.main_text(f"<body><div id=legal><p>{LONG}</p><p>{LONG} Two.</p></div><div><p>Short aside.</p><a href=1>x</a></div></body>").startswith(f"{LONG}\n\n{LONG} Two.")
    for named in ('p class="press-promotion"', 'p class="star-spangled-banner"', 'p id="share"', 'blockquote class="reply"'):
        page = f"<article><p>{LONG}</p><{named}>Shares, and what they said, were news.</{named.split()[0]}><p>{LONG}</p></article>"
        assert H.main_text(page) == "\n\n".join([LONG, "Shares, and what they said, were news.", LONG]), named
    assert H.main_text(f'<article><p>{LONG}</p><p class="ad">Buy!</p><p class="share"><a href=1>Share this text with all others</a></p></article>') == LONG
    follow = f"<body><nav><a href=/>Home</a></nav><div class=content><p>{LONG}</p><div class='follow-up'><p>What came after it, a year later.</p></div><p>{LONG}</p></div></body>"
    assert H.main_text(follow) == "\n\n".join([LONG, "What came after it, a year later.", LONG])
    assert H.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG} Two.</p></article></body>") == "\n\n".join([LONG, LONG, LONG + " Two."])
    assert H.main_text(f"<body><div><h1>Title</h1><div><div class=c><p>{LONG}</p><p>{LONG}</p></div></div></div></body>") == "\n\n".join(["Title", LONG, LONG])
    assert H.main_text(f"<body><header><h1>Site</h1></header><div><div><p>{LONG}</p></div></div></body>") == LONG
