import re
import time
from html import unescape

from tidemark.llm import html_text as H
from tidemark.llm import registry

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">More of it</a></li></ul></nav>'
BODY = "<h1>Title &amp; more</h1><p>First part of the text, with <b>bold</b>\n words.<br><p>Second part &lt;here&gt;, it is long enough.</p><ul><li>one item</li><li>two items</li></ul>"
TEXT = "Title & more\nFirst part of the text, with bold words.\nSecond part <here>, it is long enough.\none item\ntwo items"


def page(inner):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{NAV}<!-- c --><div class="ad">Buy this now, it is good.</div>{inner}<footer>&copy; all of us, and a long line of words in the foot.</footer></body></html>'


def test_templates():
    shells = [
        f"<article>{BODY}</article>",
        f'<div class="post-12 entry">{BODY}</div><div class="sidebar"><p>{"side words, many of them. " * 30}</p></div>',
        f'<main><header class="site"><h2>Site</h2></header>{BODY}</main>'.replace('<header class="site"><h2>Site</h2></header>', ""),
        f'<div id="content">{BODY}<div class="comments"><p>{"a reader says this and that, at length. " * 20}</p></div><form><p>Name</p><button>Send</button></form></div>',
        f'<div class="cookie-notice"><p>{"We use cookies, as all do. " * 20}</p></div><section class="story">{BODY}<aside>Other</aside></section>',
    ]
    for shell in shells:
        assert H.Page(page(shell)).text(None) == TEXT, shell


def test_broken_markup():
    assert H.Page("").text(None) == ""
    assert H.Page("just words").text(None) == "just words"
    assert H.Page("<p>one<p>two</div></p>three").text(None) == "one\ntwo\nthree"
    assert H.Page("<script>never closed <p>x</p>").text(None) == ""
    assert H.Page('<div title="a > b">in</div>').text(None) == "in"
    assert H.Page("a < b and c > d").text(None) == "a < b and c > d"


def test_parts_do_not_hide_the_article(spark):
    long = "A part of the story, it is rather long and goes on. " * 12
    parts = [f"<section><p>{long}</p></section><section><p>{long}</p></section>", f'<div class="part"><p>{long}</p></div><div class="note"><p>{long}</p></div>', f"<blockquote><p>{long}</p></blockquote><p>After it.</p>", f"<table><tr><td>{long}</td><td>{long}</td></tr></table>"]
    shells = ("<article>%s</article>", '<div class="story">%s</div>', "<main>%s</main>")
    rows = [(i * 4 + k, f"http://h{i}{k}.example/x", page(shell % f"<h1>Headline</h1><p>Lead.</p>{part}")) for i, shell in enumerate(shells) for k, part in enumerate(parts)]
    out = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        for k, after in enumerate((2, 2, 1, 2)):
            assert out[i * 4 + k] == "\n".join(["Headline", "Lead.", *[long.strip()] * after, *["After it."] * (k == 2)])


def test_left_out_end_tags():
    want = "First words of it.\nLast words of it."
    for odd in ('<svg viewBox="0 0 1 1"/>', "<svg><text>No</text></svg>", "<select><option>No", "<object data='x'>", "<iframe src='x'>", "<template>", "<noscript><p>No</p></noscript>"):
        for head in ("<head><title>T</title>", "<head><meta charset=x></head>", "<head><noscript><img src=x></noscript>"):
            for body in ("<body>", ""):
                html = f"<html>{head}{body}<article><p>First words of it.</p>{odd}<p>Last words of it.</p></article>"
                assert H.Page(html).text(None) == want, html
    late = "<article><p>First words of it.</p><div><select><option>No</div><p>Last words of it.</p></article><select></select>"
    assert H.Page(late).text(None) == want
    assert H.Page("<head><title>T</title>Just words").text(None) == "Just words"


def test_consensus_of_a_host(spark):
    """One page has more words beside the article than in it; its host knows better."""
    side = f'<div class="teasers"><p>{"Other stories, they go on and on, and on. " * 40}</p></div>'
    good = [(i, "http://h.example/x", page(f'<div class="text-{i}">{BODY}{BODY}</div><div class="teasers"><p>Short.</p></div>'), "p") for i in range(6)]
    rows = [*good, (7, "http://h.example/y", page(f'<div class="text-7">{BODY}</div>{side}'), "p"), (8, None, None, "p"), (8, None, None, "p"), (9, "x", "", "p"), (10, "http://h.example/z", page(f"<article>{BODY}</article>"), "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in H.main_text(pages).collect()}
    assert out[7].text == TEXT and out[0].text == TEXT + "\n" + TEXT and out[10].text == TEXT
    assert out[8].text == out[9].text == "" and out[8].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in out.values())
    assert H.main_text(pages).count() == len(rows)
    assert H.main_text(pages.limit(0)).count() == 0


def test_frames_are_not_left_out():
    """Class names that tell a state, and one class word around all of the text, do not cost an article."""
    for shell in (
        '<div class="post has-sidebar">%s</div>',
        '<div class="content no-comments">%s</div>',
        '<div class="entry comments-open">%s</div>',
        '<div class="page-content ad-free">%s</div>',
        '<div class="post subscribe-enabled">%s</div>',
        '<div class="overflow-hidden">%s</div>',
        '<div class="content sidebar">%s</div>',
        '<form id="main-form"><div class="text">%s</div></form>',
        '<div class="sidebar">%s</div>',
        '<div class="related"><article>%s</article></div>',
        '<div class="layout"><div class="comments"><div class="widget">%s</div></div></div>',
    ):
        assert H.Page(page(shell % (BODY * 2))).text(None) == TEXT + "\n" + TEXT, shell


def test_what_is_not_article_goes_however_long():
    for shell in (
        '<article>%s</article><div id="comments">{0}</div>',
        '<article>%s<section class="reader-comments">{0}</section></article>',
        '<div class="story">%s</div><aside>{0}</aside>',
        '<div class="story">%s</div><div class="relatedPosts">{0}</div>',
        '<div class="story">%s</div><div role="complementary">{0}</div>',
        '<div class="story">%s</div><div style="display: none">{0}</div><div hidden>{0}</div>',
        '<div class="story">%s<form><p>Name of the reader</p><input></form></div>',
        '<div class="story"><span class="ad">{0}</span>%s</div>',
    ):
        other = "<p>" + "a reader says this and that, at length. " * 12 + "</p>"
        assert H.Page(page(shell.format(other) % BODY)).text(None) == TEXT, shell


def test_a_brief_article_beside_many_comments():
    other = "<p>" + "a reader says this and that, at length. " * 60 + "</p>"
    for shell in ("<article>%s</article><div class='comments'>{0}</div>", "<main><div>%s</div></main><aside>{0}</aside>"):
        assert H.Page(page(shell.format(other) % "<h1>Head</h1><p>It is brief.</p>")).text(None) == "Head\nIt is brief."


def test_inline_advert_within_a_paragraph():
    assert H.Page(page(f'<article><p>One <span class="promo">buy it</span> two.</p>{BODY}</article>')).text(None) == "One two.\n" + TEXT


def test_time_is_linear_in_length_and_depth():
    odd = ["<a " * 100_000, '<a b="' * 100_000, "<a " * 100_000 + ">", "<!--" * 100_000, "<div>x" * 20_000, "<ul>" * 20_000 + "<li>y" * 20_000, "<div>" * 5_000 + "</span>" * 50_000]
    odd += ["<p><td>" + "<li><tr>" * 20_000, "<a b=\"x' c='y\">t" * 30_000, "<article>" * 3_000 + "<section>x</section>" * 20_000, "<div class='sidebar'>z" * 20_000, "&" * 300_000]
    for html in odd:
        began = time.process_time()
        made = H.Page(html)
        made.text(None), made.votes()
        assert time.process_time() - began < 10, html[:20]
    assert H.Page('<p title="x>hello').text(None) == "hello"
    assert H.Page("<div>" * 20_000 + "deep").text(None) == "deep"


def test_many_hosts_are_joined_by_salted_hosts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/x", page(f"<article>{BODY}</article>")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(H, "BROADCAST_ROWS", 2)
    assert [r.text for r in H.main_text(pages).collect()] == [TEXT] * 30


def plain_article(html):
    """The article's blocks by plain string work; the pages' articles hold h1, p, b and br only."""
    own = re.split(r"</?(?:p|h1)>", html.split("<article>")[1].split("</article>")[0])
    blocks = [" ".join(unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in own]
    return "\n".join(b for b in blocks if b)


def test_pages_keep_their_articles(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = registry.op5_html_text(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)
