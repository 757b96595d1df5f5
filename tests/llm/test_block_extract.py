import random
import time

from hanagram.llm import block_extract as b
from hanagram.llm.block_extract import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy this now, it is the best of the best and you will love it for all of the days.</div>
<article><h1>A &amp; B</h1><p>The first  paragraph is of some length and has
 a line<br>break in it, with the usual words.</p><p>Short.<p>Unclosed &#233;&nbsp;x<div class="share">Share</div>
<p>Then <a href="x">a link</a> in the text of the article, which goes on for a while.</p></article>
<aside><p>The sidebar has words of its own that go on and on for the sake of it, and more.</p></aside>
<section id="comments"><p>The reader says that this is the best article of all that were on this page.</p></section>
<form><label>Mail</label><input></form><div id="cookie-notice">We use cookies on this site.</div>
<footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "A & B\n\nThe first paragraph is of some length and has a line break in it, with the usual words.\n\nShort.\n\nUnclosed é x\n\nThen a link in the text of the article, which goes on for a while."


def test_without_article_element():
    long = "This is the text of the story, and it has many of the words that are in a text for people to read. " * 2
    page = f"<body><ul class=menu><li><a href=a>One</a></ul><div><a href=x>Home</a></div><p>{long}</p><p>Yes.</p><p>{long}</p><p>© x</p></body>"
    assert main_text(page) == f"{long.strip()}\n\nYes.\n\n{long.strip()}"


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "<", "<p", "<script>x", "<!-- x", "<article><p>a</p>")] == ["", "", "", "", "", "", "a"]
    assert main_text("<article>" + "<p>word</p>" * 20000) == "\n\n".join(["word"] * 20000)


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 2), (2, None, None, 3), (None, "v", "<p>", 4)], "page_id long, url string, html string, text int")
    rows = extract(df).collect()
    assert len(rows) == 4 and {r["n_chars"] for r in rows} == {len(main_text(PAGE)), 0}
    assert extract(df.where("false")).count() == 0


def test_second_pass_against_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        root = b.Container("", None, False, None)
        article = b.Container("article", root, False, None)
        article.article = article
        places = [root, article, b.Container("div", root, False, None), b.Container("section", article, False, article), b.Container("aside", article, True, article)]
        found = [b.Block(rng.choice(places), heading=rng.random() < 0.2) for _ in range(rng.randrange(12))]
        labels = ["bad" if x.container.boiler else rng.choice(["good", "bad", "open", "open"]) for x in found]

        def nearest(k, ids, ok):
            return next((labels[i] for i in ids if labels[i] != "open" and ok(found[i])), None)

        want = []
        for k, x in enumerate(found):
            before, after = range(k - 1, -1, -1), range(k + 1, len(found))
            if labels[k] != "open":
                want.append(labels[k] == "good")
            elif x.container.article:
                inside = lambda y: y.container.article is article and not y.container.boiler
                l, r = nearest(k, before, inside), nearest(k, after, inside)
                want.append((r == "good") if x.heading and r else "good" in (l, r) or l is r is None)
            else:
                l, r = nearest(k, before, lambda y: True), nearest(k, after, lambda y: True)
                up = x.container.up or x.container
                mine = {labels[i] for i, y in enumerate(found) if labels[i] != "open" and x.container in (y.container, y.container.up or y.container)}
                wider = {labels[i] for i, y in enumerate(found) if labels[i] != "open" and up in (y.container, y.container.up or y.container)}
                want.append((mine or wider) == {"good"} or ((r == "good") if x.heading else (l, r) == ("good", "good")))
        assert b.second_pass(found, labels) == want


def test_density_and_neighbours_decide_within_an_article():
    prose = "This is the text of the story, and it has many of the words that are in a text for people to read."
    links = "".join(f"<li><a href={i}>Other story {i}</a></li>" for i in range(4))
    page = f"<article><h1>Title</h1><p>{prose}</p><h2>More</h2><ul>{links}</ul><div class=ad><p>{prose}</p></div><h2>Next</h2><p>{prose}</p><p>{'Lorem ipsum dolor ' * 8}</p></article>"
    assert main_text(page).split("\n\n") == ["Title", prose, "Next", prose, ("Lorem ipsum dolor " * 8).strip()]


def test_broken_markup_takes_linear_time():
    for unit, end in (("<a ", ""), ("<a ", ">"), ('<p title="', ""), ('<p title="', ">"), ('<a ">" ', ""), ("<div>", ""), ("</section>", ""), ("<!--", ""), ("<![", ""), ("&#9", ";"), ("a", ">"), ("<p a='", ">")):
        began = time.time()
        n = 5_000_000 if unit in ("<a ", '<p title="') else 1_000_000
        main_text(("<p " if unit == "a" else "") + unit * (n // len(unit)) + end)
        assert time.time() - began < 20, unit
    began = time.time()
    main_text("<div>" * 50_000 + "</section>" * 50_000 + "<p>" + "<ul>" * 50_000 + "</p>" * 50_000)
    assert time.time() - began < 40
    assert main_text("<article><p>" + "&#" + "9" * 6000 + "; &#0000000065; a < b &lt;</p></article>") == "� A a < b <"
