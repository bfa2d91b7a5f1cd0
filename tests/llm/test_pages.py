"""Main text of pages."""

import pytest

from antecede.llm.html_text import extract, main_text

LONG = "A sentence that is long enough to be the body of an article, and goes on for a while. "
PAGES = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body><nav><a href=1>Home</a></nav>"
     "<article><h1>T &amp; U</h1><p><b>One\n  two<br><p>three</p></article><footer>f</footer></body></html>", "T & U\nOne two\nthree"),
    (f"<div class='menu'><a>x</a></div><div id=content><h1>Title</h1><p>{LONG}<p>short<p>{LONG}</div><div class=comments><p>{LONG}</div>",
     f"Title\n{LONG.strip()}\nshort\n{LONG.strip()}"),
    ("<main><p>in main</p><aside>no</aside></main><p>outside</p>", "in main"),
    ("<article><p>kept<div class='ad'>buy <div>now</div></div><form><p>x</form>tail</article>", "kept\ntail"),
    ("<div class='with-sidebar'><article><p>body</p></article></div>", "body"),
    ("<nav>never closed<article><p>body</p></article>", "body"),
    ("<article><p>a &lt;b&gt; &eacute;&nbsp;&#233;&#x41;</p><!-- <p>no</p> --><p title='a>b'>c</p></article>", "a <b> é éA\nc"),
    ("<article><ul><li>one<li class=ad>ad<li>two</ul></article>", "one\ntwo"),
    ("<article><ol><li class=comment><p>a<ul><li>b</li></ul><p>c</li><li>d</ol><p>e</article>", "d\ne"),
    ("plain text only", "plain text only"),
    ("<p>unclosed <b>bold", "unclosed bold"),
    ("", ""),
    (None, ""),
    ("<script>only()</script>", ""),
    ("<article>" + "<p>x</p>" * 20_000 + "</article>", "\n".join(["x"] * 20_000)),
    ("<" * 3_000, "<" * 3_000),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page,text", [
    *((f"<body><div class='{c}'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div class='site-footer'>foot</div>", f"Title\n{LONG.strip()}\n{LONG.strip()}")
      for c in ("content has-sidebar", "page no-sidebar", "site header-fixed", "widget")),
    ("<article class='post comments-open'><p>body</p></article>", "body"),
    ("<article><h2 id='how-to-share-files'>Share</h2><p>a</p><h2 id='ad-hoc-networks'>Ad hoc</h2></article>", "Share\na\nAd hoc"),
    ("<article><section id='discussion'><p>a</p></section><section id='related-work'><p>b</p></section><section id='comments'><p>c</p></section></article>", "a\nb"),
    ("<form><div>x</div><main><p>in a form</p></main></form>", "in a form"),
    (f"<div class='post-navigation'>next</div><div><p>{LONG}</p></div><div class='comments'>{'<p>' + LONG + '</p>'}{'<p>' + LONG + '</p>'}</div>", LONG.strip()),
    ("<div class='comments'><p>only this</p></div>", "only this"),
    ("<article><p>a</p></article><div class='comments'><article class='comment-body'><p>b</p></article></div>", "a"),
])
def test_marks_name_whole_elements(page, text):
    assert main_text(page) == text


STORY = "".join(f"<p>{LONG}" for _ in range(4))
TOLD = "\n".join([LONG.strip()] * 4)


@pytest.mark.parametrize("page,text", [
    (f"<main>{STORY}<article class='card'><h3>Card</h3><p>teaser</article><article class='card'><p>more</article></main>", TOLD),
    (f"<div id=content>{STORY}</div><article><p>a teaser</p></article>", TOLD),
    (f"<article>{STORY}</article><article class='ad'><p>buy this now</p></article>", TOLD),
    (f"<article>{STORY}</article><article class='ad sponsored'>{STORY * 3}</article>", TOLD),
    (f"<div class='cookie-banner'>{STORY * 3}</div><div id=story>{STORY}</div>", TOLD),
    (f"<main><article><p>one, a short note</article><article><p>two, a short note</article></main>", "one, a short note\ntwo, a short note"),
    (f"<main><h1>Head</h1><article>{STORY}</article></main>", TOLD),
    *((f"<article>{STORY}<div class='{c}'><p>{LONG}</div></article>", TOLD) for c in (
        "ad-300x250", "google_ads_1", "advert-inline", "newsletter-signup-form", "related-articles", "user-comments", "sticky-sidebar", "share-buttons")),
    *((f"<article>{STORY}<div class='{c}'><p>{LONG}</div></article>", f"{TOLD}\n{LONG.strip()}") for c in (
        "share-prices", "comments-open", "no-ads", "category-ads", "ad-hoc", "social-science", "with-sidebar", "adventure", "header-fixed")),
])
def test_regions_and_marks_are_chosen_by_what_they_hold(page, text):
    assert main_text(page) == text


ADVERTS = "<div class=ad>buy</div>" * 3


@pytest.mark.parametrize("page,text", [
    (f"<div><a href=1>Home</a></div><div><h1>Head</h1><p>{'a' * 10}<p>{'b' * 10}<p>{'c' * 300}</div>",
     f"Head\n{'a' * 10}\n{'b' * 10}\n{'c' * 300}"),
    (f"<div><p>{'c' * 300}</p>{ADVERTS}<p>{'d' * 40}</p><p>{'e' * 30}</p><p>fffff</p></div>", f"{'c' * 300}\n{'d' * 40}\n{'e' * 30}\nfffff"),
    (f"<div><p>{LONG}</p><p>see <a href=x>{LONG}</a></p><p>{LONG}</p></div><div><p><a href=y>{LONG}</a></p></div>",
     f"{LONG.strip()}\nsee {LONG.strip()}\n{LONG.strip()}"),
    (f"<div><span><a href=1>{LONG}</a></span></div><div><p>{LONG}<p>{LONG}<ul><li>one<li>two</ul></div>",
     f"{LONG.strip()}\n{LONG.strip()}\none\ntwo"),
    ("<div>" * 3_000 + f"<p>{LONG}</p>" + "</div>" * 3_000, LONG.strip()),
])
def test_the_text_is_widened_to_its_element(page, text):
    assert main_text(page) == text


def test_links_do_not_make_a_surge():
    links = "".join(f"<p><a href=x>{LONG}</a></p>" for _ in range(5))
    assert main_text(f"<body>{links}<div></div><p>{LONG}</p></body>") == LONG.strip()


def test_extract_keeps_rows(spark):
    table = spark.createDataFrame(
        [(i, None if i == 1 else f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, "n", "<p>x", "x"), (0, "again", PAGES[0][0], "x")],
        "page_id long, url string, html string, text string",
    )
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(table).collect()}
    assert len(got) == len(PAGES) + 2
    for i, (_, text) in enumerate(PAGES):
        assert got[i, None if i == 1 else f"u{i}"] == (text, len(text))
    assert extract(table.limit(0)).collect() == []
