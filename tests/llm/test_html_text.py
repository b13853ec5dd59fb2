import numpy as np

from eventide.llm import html_text
from tests.llm.helpers import empty

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="post">
<header>Site</header><nav><ul><li>Home<li>About</ul></nav><div class="ad">Buy</div><div id="cookie-notice">ok</div>
<article><header><h1>Head &amp;  line</h1></header><p>One <b>two
three.<p>Four<!-- x --> five&nbsp;six &eacute;.<aside>beside</aside><form>send<input></form><div class="comments"><p>first!</p></div>
<ul><li>a<li>b</ul></article><section class="sidebar">S</section><footer>F</footer>"""


def test_article_only():
    assert html_text.main_texts([PAGE])[0][0] == "Head & line\nOne two three.\nFour five six é.\na\nb"


def test_names_that_enclose_or_stand_in_an_article():
    def text(page):
        return html_text.main_texts([page])[0][0]

    assert text("<div class='container has-sidebar'><article><p>kept</article></div>") == "kept"
    assert text("<main><div class='content-with-nav'><p>kept</div></main>") == "kept"
    assert text("<article><div class='article-header'><h1>Headline</h1></div><p>body</article>") == "Headline\nbody"
    assert text("<article><div class='header'><h1>Headline</h1></div><p>body</article>") == "Headline\nbody"
    # an enclosing name or form: the article inside is the only one
    assert text("<form><div class='modal'><article><p>kept</article></div></form>") == "kept"
    # teasers beside an article stay away
    assert text("<article><p>kept</article><div class='related'><article><p>teaser</article></div>") == "kept"
    assert text("<aside><article><p>teaser</article></aside><article><p>kept</article>") == "kept"
    # nothing would be left
    assert text("<article><div class='widget'><p>all of it</div></article>") == "all of it"
    for name in ("ad", "ad-slot-2", "site-header", "cookie-notice", "share-buttons", "post-comments", "newsletter_form"):
        assert text(f"<article><p>kept</p><div class='x {name}'>gone</div></article>") == "kept", name


def test_extract_equals_all_pages_of_a_host_at_once(spark):
    rng = np.random.default_rng(7)
    notes = [" ".join(f"n{k}w{i}" for i in range(int(rng.integers(8, 30)))) for k in range(6)]
    rows = []
    for i in range(60):
        own = [" ".join(f"p{i}w{int(x)}" for x in rng.integers(0, 50, 12)) for _ in range(2)]
        body = [*own, *(notes[int(k)] for k in rng.integers(0, 6, 2))]
        rng.shuffle(body)
        text = "".join(f"<div>{b}</div>" for b in body)
        rows.append((i, f"http://h{i % 3}/{i}", f"<article>{text}</article>" if i % 10 == 0 else f"<body>{text}</body>"))
    got = {r.page_id: (r.text, r.blocks_removed) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), window=5).collect()}
    for h in range(3):
        mine = [(i, page) for i, url, page in rows if url.startswith(f"http://h{h}/")]
        want = html_text.main_texts([page for _, page in mine])
        assert [got[i] for i, _ in mine] == want
    assert sum(removed for _, removed in got.values()) > 50


def test_a_page_without_article_loses_what_its_host_repeats():
    menu = "<div>one two three four five six seven eight nine ten</div>"
    pages = [f"<body>{menu}<p>page {i} has its own words {i} here</p><div>imprint and so on of the very same publisher here</div>" for i in range(5)]
    assert [t for t, _ in html_text.main_texts(pages)] == [f"page {i} has its own words {i} here" for i in range(5)]
    article = "<article>" + menu + "</article>"
    assert html_text.main_texts([article, article])[0][0].startswith("one two")  # a copied article is kept


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(1)
    for length in (1, 2, 3, 5, 8):
        tokens = rng.integers(0, 3, 120).astype(np.uint64)
        page = np.sort(rng.integers(0, 6, 120))
        want = np.zeros(120, bool)
        spans = {}
        for i in range(120 - length + 1):
            if page[i] == page[i + length - 1]:
                spans.setdefault(tuple(tokens[i : i + length]), []).append(i)
        for at in spans.values():
            if len({page[i] for i in at}) > 1:
                for i in at:
                    want[i : i + length] = True
        assert (html_text.repeated(tokens, page, length) == want).all()


def test_awkward_rows(spark):
    rows = [(1, "http://a/x", PAGE, "t"), (1, "http://a/x", PAGE, "t"), (2, None, None, "t"), (3, "", "", "t"), (4, "x", "<<p>a < b<p", "t"), (None, "y", "<p>" + "w " * 50_000, "t"), (5, "z", "plain &#0; &bogus; text", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), window=2).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[2] == ""
    assert html_text.extract(empty(spark, "page_id long, url string, html string")).count() == 0


def test_repeats_are_found_over_all_windows_of_a_host(spark):
    note = "<div>this very long notice of the publisher stands on two distant pages only of the host</div>"
    rows = [(i, f"http://h/{i}", f"<body>{note if i in (3, 77) else ''}<p>page {i} has its own words {i} here</p>") for i in range(100)]
    rows += [(200, "http://h/200", "<article>the article of a page</article>"), (300, "http://other/", f"<body>{note}<p>alone</p>"), (300, "http://other/", f"<body>{note}<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = None
    for window, parts in ((256, 1), (2, 1), (7, 13)):
        got = html_text.extract(pages.repartition(parts), window=window)
        got = sorted((r.page_id, r.text, r.blocks_removed) for r in got.collect())
        want = want or got
        assert got == want and len(got) == len(rows)
    assert (3, "page 3 has its own words 3 here", 1) in got and (77, "page 77 has its own words 77 here", 1) in got
    assert [g[1].startswith("this very long") for g in got[-2:]] == [True, True] and (200, "the article of a page", 0) in got


def test_a_notice_inside_most_articles_of_a_host_goes(spark):
    """No class name tells it; lines and passages that some articles share, copies and editions of an article stay."""
    notice = "<p>write to the publisher of this site for rights in any of its texts</p>"
    line = "<p>one line of ten words or so that some articles share</p>"
    own = [f"<h1>head {i}</h1><p>" + " ".join(f"p{i}w{j}" for j in range(30)) + "</p>" for i in range(40)]
    rows = [(i, f"http://h/{i}", f"<article>{own[i]}{line if i % 2 else ''}{notice if i % 8 else ''}</article>") for i in range(40)]
    rows += [(100 + i, "http://h/copy", rows[0][2]) for i in range(60)]  # copies count once, whatever they lack
    long = "<p>" + " ".join(f"same{j}" for j in range(60)) + "</p>"
    rows += [(200 + i, f"http://editions/{i}", f"<article><h1>edition {i} of the text</h1>{long}</article>") for i in range(9)]
    rows += [(300 + i, f"http://few/{i}", f"<article>{own[i]}{notice}</article>") for i in range(4)]  # too few to tell
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for window, parts in ((256, 1), (4, 7)):
        got = {r.page_id: (r.text, r.blocks_removed) for r in html_text.extract(pages.repartition(parts), window=window).collect()}
        assert len(got) == len(rows)
        for host in ("h", "editions", "few"):
            mine = [(i, page) for i, url, page in rows if url.startswith(f"http://{host}/")]
            assert [got[i] for i, _ in mine] == html_text.main_texts([page for _, page in mine])
        assert not any("publisher" in got[i][0] for i in range(40)) and got[1][0].endswith("some articles share") and got[1][1] == 1
        assert all("same59" in got[200 + i][0] for i in range(9)) and all("publisher" in got[300 + i][0] for i in range(4))
