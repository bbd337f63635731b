"""Main text of pages with known articles."""

import html
import re

from sourcelens.llm.main_text import extract, main_text

ARTICLE = "First paragraph of it, with commas, and words enough.\nA second one, just as long as the first one was.\nOk."


def page(before="", inside="", after="", tag="div class=content"):
    name = tag.split()[0]
    body = "".join(f"<p>{p}</p>" for p in ARTICLE.split("\n"))
    return f"<!DOCTYPE html><html><head><title>No</title></head><body>{before}<{tag}>{body}{inside}</{name}>{after}</body></html>"


def test_what_is_left_out():
    comment = "Nice, really nice, I like it, and I would read it again, any day."
    for other in [f"<nav><ul><li><a href=/>{comment}</a></li></ul></nav>", f"<header><p>{comment}</p></header>",
                  f"<div class='site-header'><p>{comment}</p></div>", f"<footer><p>{comment}</p></footer>",
                  f"<aside><p>{comment}</p></aside>", f"<div id='sidebar'><p>{comment}</p></div>",
                  f"<div class='cookie-notice'><p>{comment}</p></div>", f"<div class=ad><p>{comment}</p></div>",
                  f"<form><p>{comment}</p><input></form>", f"<script>var x = '<p>{comment}</p>';</script>",
                  f"<style>p {{ content: '{comment}' }}</style>", f"<section id=comments><p>{comment}</p></section>",
                  f"<div class='commentList'><div><p>{comment}</p></div></div>", f"<!-- <p>{comment}</p> -->",
                  f"<div role=navigation><p>{comment}</p></div>", f"<div style='display: none'><p>{comment}</p></div>"]:
        assert main_text(page(before=other)) == ARTICLE, other
        assert main_text(page(after=other)) == ARTICLE, other
        assert main_text(page(inside=other)) == ARTICLE or "header" in other, other
        assert main_text(page(inside=other, tag="article")) == ARTICLE or "header" in other, other


def test_articles_in_what_is_left_out():
    c = "Nice, really nice, I like it, and I would read it again, any day, as I did, twice, this week."
    for other in [f"<section class=comments><article class=comment><p>{c}</p></article><article class=comment><p>{c}</p></article></section>",
                  f"<section id=comments><ol><li><article><header>Jo</header><p>{c}</p></article></li></ol></section>",
                  f"<aside><article class=card><h3>More</h3><p>{c}</p></article><article class=card><p>{c}</p></article></aside>",
                  f"<div class=related><div><article><p>{c}</p></article></div><article><p>{c}</p></article></div>",
                  f"<nav><article><p>{c}</p></article></nav>", f"<footer><article><p>{c}</p></article></footer>",
                  f"<div><article class='comment odd'><p>{c}</p></article></div>"]:
        for tag in ("main", "article", "div class=content"):
            assert main_text(page(inside=other, tag=tag)) == ARTICLE, (other, tag)
            assert main_text(page(before=other, tag=tag)) == ARTICLE, (other, tag)
            assert main_text(page(after=other, tag=tag)) == ARTICLE, (other, tag)
    # an end tag that is missing, also where an outer element's stands
    body = "".join(f"<p>{p}</p>" for p in ARTICLE.split("\n"))
    for start in ("<nav><a href=/>x</a>", "<header>Title", "<aside>Buy", "<div id=sidebar>Buy"):
        assert main_text(f"<body>{start}<article>{body}</article></body>") == ARTICLE, start
    assert main_text(f"<body><div id=wrap><div class=ad>Buy<article>{body}</article></div></body>") == ARTICLE
    # comments stay out if the page is cut off in them
    assert main_text(f"<body><main>{body}<section class=comments><article><p>{c}</p></article><article><p>{c}") == ARTICLE
    # a class that only says that comments are open
    assert main_text(f"<body><article class='post comments-open'>{body}</article></body>") == ARTICLE


def test_a_wrapper_never_takes_the_page_along():
    body = "".join(f"<p>{p}</p>" for p in ARTICLE.split("\n"))
    c = "Nice, really nice, I like it, and I would read it again, any day, as I did, twice, this week."
    nav = "<nav><a href=/>Home</a></nav>"
    for start, end in [("<form id=aspnetForm method=post><input type=hidden name=v value=1>", "</form>"),
                       ("<form><div class=content>", "</div></form>"),
                       ("<div class='layout has-sidebar'><article>", "</article><div class=sidebar><p>Buy</p></div></div>"),
                       ("<div class='post no-comments'>", "</div>"), ("<div class='page-with-sidebar'><main>", "</main></div>"),
                       ("<div class='sidebar-layout'><div class='widget-area-right'><h1>Of it</h1>", "</div></div>"),
                       ("<div id=comments-page><article>", "</article></div>"), ("<form><div class='two-column sidebar'><article>", "</article></div></form>")]:
        text = main_text(f"<html><body>{nav}{start}{body}{end}<footer><p>{c}</p></footer></body></html>")
        assert text.removeprefix("Of it\n") == ARTICLE, start
    # more comments than article: the article alone stays
    many = "".join(f"<article class=comment><p>{c}</p></article>" for _ in range(40))
    for other in (f"<section id=comments><h1>Comments</h1>{many}</section>", f"<div class=comments>{many}</div>", f"<aside class=related><h1>More</h1>{many}</aside>"):
        assert main_text(page(after=other, tag="article")) == ARTICLE
    # forms of fields, notices
    assert main_text(f"<body><form><label>Name</label><input><p>{c}</p></form><article>{body}</article></body>") == ARTICLE
    assert main_text(f"<body><div class=cookie-notice><p>{c}</p></div></body>") == ""


def test_deep_and_stray_tags_take_time_in_proportion():
    import time
    for make in (lambda n: "<div>" * n + "<p>Some words, of a paragraph, that counts.</p>" * 50 + "</div>" * n, lambda n: "<p>Some words, of it</p>" + "</b></section>" * n,
                 lambda n: "<div><section>" * n + "</table>" * n + "<p>Some words, of a paragraph, that counts.</p>",
                 lambda n: "".join(f"<div class='ad x{k}'><p>Some words, of a paragraph, that counts.</p>" for k in range(n))):
        t0 = time.perf_counter()
        main_text(make(50_000))
        assert time.perf_counter() - t0 < 4


def test_blocks_references_and_white_space():
    text = main_text("<article><h1>A &amp; B</h1><p>one<br>two \n\t <b>th</b>ree&nbsp;&eacute;<p>four<ul><li>five<li>six</ul></article>")
    assert text == "A & B\none two three é\nfour\nfive\nsix"


def test_siblings_of_the_best_container_are_kept():
    lead = "<p>A lead that stands before the container, long enough to be kept, as plain text, with no link in it at all.</p>"
    assert main_text(f"<body><div>{lead}<div>" + "".join(f"<p>{p}</p>" for p in ARTICLE.split("\n") * 4) + "</div></div></body>").startswith("A lead")


def test_link_lists_score_little():
    links = "<div class=x>" + "".join(f"<p><a href=/{k}>Something, to read, about many things, number {k}</a></p>" for k in range(30)) + "</div>"
    assert main_text(page(before=links)) == ARTICLE


def test_broken_pages():
    assert main_text(None) == main_text("") == ""
    assert main_text("<p>3 < 4 and 5 > 4, or so they say to us all") == "3 < 4 and 5 > 4, or so they say to us all"
    assert main_text("<div class=ad>Buy<article><p>Text of the article, after an advert that never closes.</article>") == \
        "Text of the article, after an advert that never closes."
    assert main_text("<article><p>a<script>x</p>") == "a"
    assert len(main_text("<a href=\"" * 3000)) >= 0
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_articles_of_the_given_pages(spark):
    """The pages' own articles, cut out by their tag."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h\d)\b[^>]*>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(odd_pages):
    got = extract(odd_pages).collect()
    assert len(got) == odd_pages.count()
    by_id = {r.page_id: r for r in got}
    assert by_id[4].text == by_id[5].text == "" and by_id[4].n_chars == 0
    assert by_id[6].text == "short" and by_id[8].n_chars > 100_000
    assert extract(odd_pages.limit(0)).count() == 0
