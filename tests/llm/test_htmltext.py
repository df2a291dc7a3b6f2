import html
import re
import time

import pytest

from pagefold.llm import htmltext

TREE = htmltext.fitted()
LONG = "This is a paragraph of the article with words enough to be read as text by anyone."


def text(page):
    return htmltext.main_text(page, TREE)


def test_tree_fits_its_table():
    rows = htmltext.table_rows()
    assert all(htmltext.classify(TREE, r) == r[-1] for r in rows)


def test_page_with_an_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div>
    <article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>One.</p><div class="related">Other things to read.</div>
    <section id="comments"><p>{LONG} I agree.</p></section><p>a &lt; b&nbsp;&copy; &am</p></article><aside>{LONG}</aside><footer>&copy; x</footer></body></html>"""
    assert text(page) == f"Title & more\n\n{LONG}\n\nOne.\n\na < b © &am"


def test_page_without_a_main_container():
    page = f'<body><div class="menu"><a href=x>Home</a> <a href=y>About</a></div><div><h2>Head</h2><p>{LONG}</p><p>{LONG} <a href=z>link</a></p></div><form><label>{LONG}</label></form><div id="cookie-banner">{LONG}</div></body>'
    assert text(page) == f"Head\n\n{LONG}\n\n{LONG} link"


def test_broken_markup():
    assert text("<article><p>a < b <a title='x>y'>c</a><scr") == "a < b c"
    assert text("<article><p>kept</p><script>never closed <p>x</p>") == "kept"
    assert text("<article>one<!-- open <p>x") == "one"
    assert text("<article><p>x</p></div></nav></article>") == "x"
    assert text(None) == text("") == text("<nav>x</nav>") == ""


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub("<br>|</?b>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner))
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def test_edges(spark):
    data = [(1, None, None, 0), (1, "u", "<article>x</article>", 0), (1, "u", "<article>x</article>", 0), (None, "v", f"<article>{'<p>word</p>' * 50_000}</article>", 0)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text int")
    rows = htmltext.extract(pages).collect()
    assert sorted(len(r.text) for r in rows) == [0, 1, 1, 6 * 50_000 - 2] and rows[0].asDict().keys() == {"page_id", "url", "text"}
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_elements_left_open_do_not_take_the_page():
    article = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    want = f"Title\n\n{LONG}"
    assert text(f"<html><head><title>T</title><meta charset=x><body>{article}") == want
    assert text(f"<html><head><title>T</title><style>p{{}}</style>{article}") == want
    assert text(f"<head><title>T<body>{article}") == want
    for tag in ("button", "object", "audio", "video", "canvas", "svg", "select", "math", "iframe", "noscript", "template"):
        assert text(f"<body><{tag} class=ad>{article}") == want, tag
        assert text(f"<body><{tag}>{article}<footer><{tag}>closed</{tag}></footer>") == want, tag
        if tag != "math":  # a formula's text stays
            assert text(f"<body><article><h1>Title</h1><{tag}><p>gone</p></{tag}><p>{LONG}</p></article>") == want, tag
    assert text(f"<body><article><h1>Title</h1><svg><svg>in</svg>out</svg><p>{LONG}</p></article>") == want
    assert text("<button>" * 100_000 + article) == want and text("<svg>" * 100_000 + article) == want


def test_wrappers_named_after_furniture_keep_their_article():
    article = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    want = f"Title\n\n{LONG}"
    for name in ("has-sidebar", "no-sidebar", "with-header", "ad-free", "hasSidebar", "layout sidebar-right"):
        assert text(f"<body><div class='{name}'>{article}</div>") == want, name
        assert text(f"<body><div class='{name}'><main><div><h1>Title</h1><p>{LONG}</p></div></main></div>") == want, name
    plain = f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div></div><footer>x</footer>"
    assert LONG in text(f"<body><div>{plain}") and text(f"<body><div class='no-sidebar'>{plain}") == text(f"<body><div>{plain}")
    # Furniture inside the article, teasers beside it, and what is hidden or in a nav stay out.
    assert text(f"<body><div class='has-sidebar'><article><h1>Title</h1><p>{LONG}</p><div class='related'>{LONG}</div></article></div>") == want
    assert text(f"<body>{article}<div class='related'><article><p>{LONG} teaser</p></article></div>") == want
    assert text(f"<body><div class='related'><article><p>{LONG} teaser</p></article></div>{article}") == want
    assert text(f"<body><div class='has-sidebar sidebar-right'>{article}<div class='related'><article><p>{LONG} teaser</p></article></div></div>") == want
    assert text(f"<body><article><h1>Title</h1><p>{LONG}</p><div id='comments'><article><p>{LONG} I agree.</p></article></div></article>") == want
    assert text(f"<body><div hidden>{article}</div>") == text(f"<body><nav>{article}</nav>") == ""


def test_labelled_pages_and_pages_of_one_block():
    for page in htmltext.PAGES:
        assert all(b[0].startswith("+") == (b[0] in text(page).split("\n\n")) for b in htmltext.blocks(page)), page
    for n in (1, 3, 10, 15, 40, 150, 1000):
        words = "word " * n
        for page in (f"<p>{words}</p>", f"<html><body><p>{words}</p></body></html>", words, f"<div>{words}</div>"):
            assert text(page) == words.strip(), (n, page)
    assert text("<p><a href=x>Home</a></p>") == ""


def test_hints_name_whole_classes_of_any_block():
    article = "<article><h1>Title</h1><p>{0}</p>{1}</article>"
    for tag in ("div", "section", "td", "th", "dd", "ul", "p"):
        inner = f"<{tag} class='{{}}'>{LONG} here</{tag}>"
        inner = f"<table><tr>{inner}<td>cell</td></tr></table>" if tag in ("td", "th") else f"<dl>{inner}</dl>" if tag == "dd" else inner
        cell = "\n\ncell" if tag in ("td", "th") else ""
        for name in ("comments", "related-posts", "sidebar-right", "cookie-banner"):
            assert text(article.format(LONG, inner.format(name))) == f"Title\n\n{LONG}{cell}", (tag, name)
        for name in ("related-work", "share-price-history", "commentary"):
            assert text(article.format(LONG, inner.format(name))) == f"Title\n\n{LONG}\n\n{LONG} here{cell}", (tag, name)
    left_open = f"<article><h1>Title</h1><table><tr><td class=comments>{LONG} I agree<td>one<tr><td>two</table><p>{LONG}</p></article>"
    assert text(left_open) == f"Title\n\none\n\ntwo\n\n{LONG}"


def test_quotation_marks_open_values_only_behind_an_equals_sign():
    assert text("<article><p data-x=don't>Real text of it.</p><p>it isn't gone, as it stands here.</p></article>") == "Real text of it.\n\nit isn't gone, as it stands here."
    assert text(f"<article><p a='x>y' b = \"c>d\" e=f\"g>{LONG}</p><p title=\"open>One.</p></article>") == f"{LONG}\n\nOne."
    assert text(f"<article><p 'odd\" a=b='c>{LONG}</p></article>") == LONG


def test_formulas_hidden_words_and_comments_under_other_names():
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> be a number.</p></article>") == "Let x=1 be a number."
    assert text(f"<article><p>{LONG}</p><p hidden>{LONG} too</p><div style='display:none'>and this</div></article>") == f"{LONG}\n\n{LONG} too\n\nand this"
    for name in ("user-comments", "reader-comments-2", "comment-author", "articleComments", "site-nav", "left_sidebar"):
        assert text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} I agree.</p></div></article>") == LONG, name
    for name in ("no-comments", "has-sidebar", "comment-free", "commentary", "nav-history"):
        assert text(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} I agree.</p></div></article>") == f"{LONG}\n\n{LONG} I agree.", name


def test_time_is_linear_in_nesting():
    def took(n):
        begin = time.process_time()
        htmltext.blocks("<div>" * n + "</b></section>" * n + "<p>x</p>")
        return time.process_time() - begin

    took(1000)
    assert took(80_000) < 16 * max(took(10_000), 0.02)


def test_a_kept_column_called_text_is_refused(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    with pytest.raises(ValueError, match="rename"):
        htmltext.extract(pages, keep=("url", "text"))
