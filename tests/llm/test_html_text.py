import itertools
import re
import time

import pytest

from textmill.llm import html_text as H

TREE = H.trained()


def text(page):
    return H.main_text(page, TREE)


def test_table_is_learnt():
    """The tree decides every row of its own table as labelled."""
    assert all(H.decide(TREE, r[:-1]) == bool(r[-1]) for r in H.TABLE)


PARA = "Dies ist ein Absatz mit genug Wörtern, um als Inhalt zu gelten, und er endet hier."


@pytest.mark.parametrize(
    "junk",
    [
        "<nav><ul><li><a href='/a'>Start</a></li><li><a href='/b'>Über uns</a></li></ul></nav>",
        f"<footer>&copy; 2024 {PARA}</footer>",
        f"<header><p>{PARA}</p></header>",
        f"<aside>{PARA}</aside>",
        f"<div class='sidebar left'><p>{PARA}</p></div>",
        f"<div id=cookie-notice>{PARA}</div>",
        f"<div class=\"ad\">{PARA}</div>",
        f"<section id='comments'><div class='comment'><p>{PARA}</p></div></section>",
        f"<form><label>Name</label><input name=x><p>{PARA}</p></form>",
        f"<script>var t = '<p>{PARA}</p>';</script>",
        f"<style>p {{ content: '{PARA}' }}</style>",
        f"<!-- <p>{PARA}</p> -->",
        f"<div hidden>{PARA}</div>",
        f"<div style='display: none'>{PARA}</div>",
        "<p><a href=x>mehr</a> <a href=y>noch mehr</a> <a href=z>alles</a></p>",
        f"<noscript>{PARA}</noscript>",
    ],
)
def test_furniture_goes(junk):
    for page in (f"<html><body>{junk}<article><h1>Der Titel</h1><p>{PARA}</p><p>Kurz.</p></article></body></html>", f"<body><div><h1>Der Titel</h1><p>{PARA}</p><p>{PARA}</p></div>{junk}</body>"):
        got = text(page)
        assert got == f"Der Titel {PARA} " + ("Kurz." if "Kurz" in page else PARA)


def test_decoding_and_space():
    assert text("<article><p>A &amp; B&nbsp;\n\t &#228;&#x1F600; &lt;b&gt; x<b>y</b>z</p>\n<p>\n</p><p>Ende</p></article>") == "A & B ä😀 <b> xyz Ende"
    assert text("<article><p>eins<br>zwei<p>drei<li>vier</article>") == "eins zwei drei vier"
    assert text("<article>offen <p>nicht <b>zu") == "offen nicht zu"
    assert text("<p>a < b und c > d, sagt sie in diesem langen Satz aus vielen Wörtern.</p>") == "a < b und c > d, sagt sie in diesem langen Satz aus vielen Wörtern."


def test_comments_inside_the_article_go():
    assert text(f"<article><p>{PARA}</p><div class='comments'><p>{PARA} Anders.</p></div></article>") == PARA


@pytest.mark.parametrize(
    "cards",
    [
        f"<section class='comments'><article class='comment'><p>{PARA}</p></article></section>",
        f"<div><article class='comment'><p>{PARA}</p></article><article id='reply-7'><p>{PARA}</p></article></div>",
        f"<div><article class='teaser'><h3><a href='/x'>Noch ein Artikel</a></h3><p>{PARA}</p></article></div>",
        "<div><article><h3><a href='/x'>Noch ein Artikel</a></h3></article><article><a href='/y'>Und ein anderer</a></article></div>",
    ],
)
def test_body_outside_of_articles(cards):
    """Articles that hold reader comments or teasers don't hide the body."""
    for page in (f"<body><div class='post'><p>{PARA}</p><p>{PARA}</p></div>{cards}</body>", f"<body>{cards}<div class='post'><p>{PARA}</p><p>{PARA}</p></div></body>"):
        assert text(page) == f"{PARA} {PARA}"


def test_names_of_an_article():
    """What an article's class says of tags and layout is not furniture."""
    assert text(f"<body><article class='post-1 post category-x tag-news has-sidebar comments-open'><p>{PARA}</p></article></body>") == PARA


@pytest.mark.parametrize("name", "tags side notice legal alert share search related banner".split())
def test_vague_names_are_outvoted(name):
    """Whole sentences stay, whatever a class may mean; scraps and links go."""
    assert text(f"<article><h1>Titel</h1><p>{PARA}</p><div class='{name}'><p>{PARA} Mitte.</p></div><p>{PARA}</p></article>") == f"Titel {PARA} {PARA} Mitte. {PARA}"
    assert text(f"<article><p>{PARA}</p><div class='{name}'>Politik <a href=x>Sport</a></div><p>{PARA}</p></article>") == f"{PARA} {PARA}"
    assert text(f"<body><div><p>{PARA}</p><p>{PARA}</p></div><div class='{name}'>{PARA}</div></body>") == f"{PARA} {PARA}"
    assert text(f"<body><div><p>{PARA}</p></div><div class='{name}'>{PARA * 6}</div></body>") == f"{PARA} {PARA * 6}"


PLAIN = [" ".join(f"wort{i}x{j}" for j in range(n)) for i, n in enumerate((8, 40, 100))]


@pytest.mark.parametrize("name", "menu menu-plan social commentary navigation footer login promo subscribe consent skip skip-list recommendation modal signup toolbar pager newsletter sidebar".split())
def test_names_of_furniture_are_outvoted(name):
    """In an article, text of 40 words and more stays, whatever its class may mean; scraps and links go."""
    around = [f"{PARA} {i}" for i in range(6)]
    page = "<article><h1>Titel</h1><p>" + "</p><p>".join(around[:3]) + f"</p><div class='{name}'>{{}}</div><p>" + "</p><p>".join(around[3:]) + "</p></article>"
    for inner in PLAIN[1:]:
        assert text(page.format(inner)) == " ".join(["Titel", *around[:3], inner, *around[3:]])
    if name == "commentary":  # which no rule knows
        return
    for junk in ("Politik <a href=x>Sport</a>", " ".join(f"<a href=x>{w}</a>" for w in PLAIN[1].split())):
        assert text(page.format(junk)) == " ".join(["Titel", *around])
    assert text(page.format(PLAIN[0])) == " ".join(["Titel", *around])


@pytest.mark.parametrize("name", ["ad", "ads", "sponsor", "comment", "comments", "reply", "disqus"])
def test_adverts_and_comments_go(name):
    """Their text looks like any other, so the name decides at every length."""
    for inner in PLAIN:
        assert text(f"<article><p>{PARA}</p><p>{PARA}</p><div class='{name}'>{inner}</div></article>") == f"{PARA} {PARA}"


@pytest.mark.parametrize("line", ["Copyright 2020 Firma. All rights reserved.", "© 2024 Verlag und Söhne", "(c) by Firma 1999", "Alle Rechte vorbehalten. Verlag", "&copy; Firma GmbH, Berlin 2021. Impressum"])
def test_copyright_lines_go(line):
    assert text(f"<body><div><p>{PARA}</p><p>{PARA}</p></div><div>{line}</div></body>") == f"{PARA} {PARA}"
    assert text(f"<body><div><p>{PARA}</p><p>Copyright ist ein Thema, das seit Jahren umstritten ist, sagt sie.</p></div></body>").endswith("sagt sie.")


def test_without_names(spark, small):
    """With all names blanked, the text of the driver's pages still comes out
    (where the article is longer than what stands beside it)."""
    pages = [p for p in spark.read.parquet(f"{small}/pages.parquet").collect() if len(text(p["html"]).split()) >= 20]
    assert len(pages) > 10
    for p in pages:
        blank = re.sub(r"(class|id|role)=(\"[^\"]*\"|'[^']*')", r"\1=''", p["html"])
        assert blank != p["html"] or "class" not in p["html"]
        assert text(blank) == text(p["html"]) != ""


def test_what_surrounds_the_page():
    """An element around title and text is no furniture; what it holds may be."""
    page = f"<body><form id=f class='sidebar-layout'><nav><a href=x>Start</a></nav><h1>Titel</h1><p>{PARA}</p><div class=ad>{PARA}</div><p>{PARA}</p></form></body>"
    assert text(page) == f"Titel {PARA} {PARA}"
    assert text(f"<body><article><h2><a href=x>Kasten</a></h2></article><div id=content><h1>T</h1><p>{PARA}</p><p>{PARA}</p></div></body>") == f"T {PARA} {PARA}"
    assert text(f"<body><h1>T</h1><p>{PARA}</p><div class=comments>{'<p>' + PARA + '</p>'}{'<p>' + PARA + '</p>'}</div></body>") == f"T {PARA}"


#: Ranges of words, link density, words and link densities beside, and what the tree must say there.
WORDS, BESIDE, DENSITY = (1, 2, 5, 8, 12, 20, 45, 90, 300), (0, 2, 6, 16, 40, 100), (0.0, 0.2, 0.9, 1.0)


@pytest.mark.parametrize(
    ("case", "want"),
    [
        (lambda w, d, b, a, db, da, e, h, m: e == 1 or h == 3 or m == -1, False),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 2 and m == 1 and d <= 0.2 and w >= 45, True),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 2 and m == 0 and d <= 0.2 and w >= 300, True),
        (lambda w, d, b, a, db, da, e, h, m: h == 2 and (w <= 20 or d >= 0.9 or (m == 0 and w <= 90)), False),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 0 and m == 1 and d <= 0.2, True),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 0 and m == 0 and d <= 0.2 and w >= 8, True),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 0 and m == 1 and db == da == 0 and b >= 6 and a >= 6, True),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 1 and m == 1 and d <= 0.2 and w >= 12, True),
        (lambda w, d, b, a, db, da, e, h, m: not e and h == 1 and m == 0 and d <= 0.2 and w >= 90, True),
        (lambda w, d, b, a, db, da, e, h, m: h == 1 and (w <= 5 or d >= 0.9 or (m == 0 and w <= 20)), False),
        (lambda w, d, b, a, db, da, e, h, m: m < 1 and d >= 0.9 and db >= 0.9 and da >= 0.9, False),
    ],
)
def test_what_the_tree_has_learnt(case, want):
    rows = itertools.product(WORDS, DENSITY, BESIDE, BESIDE, (0.0, 0.5, 1.0), (0.0, 0.5, 1.0), (0, 1), (0, 1, 2, 3), (-1, 0, 1))
    assert all(H.decide(TREE, (*r, heading)) == want for r in rows if case(*r) for heading in (0, 1))


def test_words_and_links_decide():
    """Each kind of feature turns some verdict: words, own and neighbours' links and words."""
    used, todo = set(), [TREE]
    while todo:
        t = todo.pop()
        if len(t) > 1:
            used.add(t[0])
            todo += t[2:]
    assert {0, 1} <= used and used & {2, 3} and used & {4, 5}


@pytest.mark.parametrize("part", ["<a \"", "<div>", "</p>", "<!", "<a =\"", "<script ", "<div class=\"ad\">", "</script ", "&", "<a<a", "<", "<div class='", "<title>", "<svg><title/>", "<li><p>"])
def test_time_is_linear(part):
    start = time.perf_counter()
    text(part * (1_000_000 // len(part)) + "</p>" * 1000)
    assert time.perf_counter() - start < 20


def test_marks():
    assert text(f"<article><div/>{PARA}</div><p title='a > b'>eins</p></article>") == f"{PARA} eins"
    assert text(f"<article><svg><title/><path/></svg><p>{PARA}</p></article>") == PARA
    assert text(f"<article><p>{PARA}</p><p class=\"x>zwei</p></article>") == f"{PARA} zwei"
    assert text(f"<article><p>{PARA}</p><![CDATA[ weg ]]><?php weg ?><!-->da</article><a href='x") == f"{PARA} da"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<>", "</p>", "<script>", "<a", "<!--", "plain"])
def test_broken(page):
    assert isinstance(text(page), str)


def test_query(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    extra = pages.withColumn("text", pages.url).withColumn("n_chars", pages.page_id)
    got = {r["page_id"]: r for r in H.extract(extra).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        import html

        want = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|div|ul|li)>", body)]
        r = got[p["page_id"]]
        assert r["n_chars"] == len(r["text"]) and r["text"] == " ".join(x for x in want if x)
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "")], "page_id long, url string, html string")
    assert [(r["text"], r["n_chars"]) for r in H.extract(odd).collect()] == [("", 0)] * 3 and H.extract(odd.limit(0)).count() == 0
    bad = spark.sql("SELECT 1L AS page_id, 'u' AS url, cast(concat(X'3C61727469636C653E61FF62') AS string) AS html")
    assert H.extract(bad).first()["text"] == "a\ufffdb"
    assert text(f"<article><p>{'wort ' * 200_000}</p></article>") == ("wort " * 200_000).strip()
