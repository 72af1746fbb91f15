"""Main texts of pages: known articles, marks that lists name, and templates that only wrappers tell."""

import random

from pyspark.sql import functions as F

from rowsense.llm import html_extract

ROWS = "page_id long, url string, html string"


def texts(spark, pages, host="h.example"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], ROWS)
    return [r["text"] for r in html_extract.extract(df).orderBy("page_id").collect()]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


def test_long_comments_never_replace_the_article(spark):
    rng = random.Random(1)
    for box in ('<section class="comments">{}</section></article>', '<div id="comments">{}</div></article>', '</article><section class="comments">{}</section>', '<div class="sidebar">{}</div></article>'):
        known, pages = [], []
        for _ in range(5):
            title, body, other = words(rng, 3), words(rng, 10), "".join(f"<p>{words(rng, 30)}</p>" for _ in range(10))
            known.append(f"{title}\n{body}")
            pages.append(f"<html><body><article><h1>{title}</h1><p>{body}</p>{box.format(other)}</body></html>")
        assert texts(spark, pages) == known


def test_an_article_keeps_what_pages_share(spark):
    rng = random.Random(2)
    bodies = [words(rng, 40) for _ in range(5)]
    page = "<body><article><h1>T</h1><p>Breaking news from our staff</p><div class=byline>By A. Author</div><p>{}</p><p>All rights of the reader remain.</p></article></body>"
    assert texts(spark, [page.format(b) for b in bodies]) == [f"T\nBreaking news from our staff\nBy A. Author\n{b}\nAll rights of the reader remain." for b in bodies]


def test_all_articles_but_teasers(spark):
    two = "<body><article><h1>T</h1><p>First part of it</p></article><article class='second'><p>Second part</p></article><article class='teaser'><p>Read this too</p></article></body>"
    assert texts(spark, [two] * 4) == ["T\nFirst part of it\nSecond part"] * 4


def test_marks_within_articles(spark):
    outs = ["<button>Share now</button>", "<form><label>Email</label></form>", "<label>Email</label>", '<div class="reader-comments"><p>So true</p></div>', '<ul class="user-comments-list"><li>Yes</li></ul>', '<div class="related-posts"><p>Other</p></div>',
            '<div class="ad-300x250">Buy</div>', '<ins class="adsbygoogle">Buy</ins>', '<div aria-label="advertisement">Buy</div>', '<div aria-label="Related articles">x</div>', '<div class="flex flex-col mt-4 p-2 w-full shrink-0 border rounded sidebar">Side</div>']
    kept = ['<h2 id="side-effects">Side effects</h2>', '<section id="related-work"><p>Related work</p></section>', '<h2 id="market-share">Share</h2>', '<p class="legal-text">Legal</p>', '<section id="discussion"><p>Talk</p></section>', '<p aria-label="x">Labelled</p>']
    page = "<body><article><h1>T</h1><p>Text here</p>{}<p>End</p></article></body>"
    for i, x in enumerate(outs):
        assert texts(spark, [page.format(x)], f"o{i}") == ["T\nText here\nEnd"], x
    assert texts(spark, [page.format("".join(kept))]) == ["T\nText here\nSide effects\nRelated work\nShare\nLegal\nTalk\nLabelled\nEnd"]


def renamed(rng, k):
    """A page of a host whose template's marks are names that no list knows, and its article."""
    title, body = words(rng, 4), [words(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 5))]
    remarks = "".join(f'<div class="qq"><b class="w">{words(rng, 1)}</b><p>{words(rng, rng.randint(12, 25))}</p></div>' for _ in range(rng.randint(1, 4)))
    page = (f'<html><body><div class="zz0"><a href="/a">Home</a><a href="/b">News</a></div><article><h1>{title}</h1><p>{body[0]}</p><div class="k9">Buy our things today, they are cheap</div>'
            + "".join(f"<p>{b}</p>" for b in body[1:]) + f'<div class="v7">{remarks}</div></article><div class="zz1">About us and our pages</div></body></html>')
    return page, "\n".join([title, *body])


def test_wrappers_tell_what_no_list_names(spark):
    rng = random.Random(3)
    made = [renamed(rng, k) for k in range(12)]
    assert texts(spark, [p for p, _ in made]) == [a for _, a in made]
    # Alone, a page has no template, so its marks stay.
    lone = [html_extract.main_text(p, None) for p, _ in made]
    assert all(a != b and "Buy our things" in b for (_, a), b in zip(made, lone))


def test_sections_and_lists_of_an_article_stay(spark):
    rng = random.Random(4)
    known, pages = [], []
    for _ in range(6):
        heads, bodies = [words(rng, 2) for _ in range(4)], [words(rng, 30) for _ in range(4)]
        known.append("\n".join(["T", "Intro text", *(x for h, b in zip(heads, bodies) for x in (h, b))]))
        pages.append("<article><h1>T</h1><p>Intro text</p><div class=parts>" + "".join(f"<div class=part><h2>{h}</h2><p>{b}</p></div>" for h, b in zip(heads, bodies)) + "</div></article>")
    assert texts(spark, pages) == known


def test_hosts_without_article_elements(spark):
    rng = random.Random(5)
    known, pages = [], []
    for _ in range(8):
        body = [words(rng, 30) for _ in range(3)]
        known.append("\n".join(body))
        pages.append('<body><div class="zz">Menu one two</div><div class="x1"><div class="x2">' + "".join(f"<p>{b}</p>" for b in body) + "</div></div><div class=yy>Imprint of this host</div></body>")
    assert texts(spark, pages) == known


def test_odd_pages(spark):
    rows = [(1, None, "<article><p>a &amp; b</p></article>"), (1, None, "<article><p>a &amp; b</p></article>"), (2, "http://h/", None), (3, "http://h/", ""), (4, "x", "plain text"), (None, "http://h/", "<p>one<p>two"), (6, "http://d/", "<div class=a>" * 700 + "deep" + "</div>" * 700)]
    df = spark.createDataFrame(rows, ROWS).withColumn("host", F.lit("c")).withColumn("rules", F.lit(1)).withColumn("page", F.lit("p"))
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(df).collect())
    assert got == [("1", "a & b", 5)] * 2 + [("2", "", 0), ("3", "", 0), ("4", "plain text", 10), ("6", "deep", 4), ("None", "one\ntwo", 7)]
