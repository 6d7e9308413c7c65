"""Names of layouts and states around an article empty no page (operator 3)."""

import pytest

from tidemark.llm import html_text

MENU, FOOT = "<nav><a>menu</a></nav><div class='cookie-banner'><p>We use cookies.</p></div>", "<div class='site-footer'><p>About us</p></div><footer>f</footer>"
COMMENTS = "<div id='comments' class='comments-area'><p>Leave a reply</p><article class='comment'><p>A reader wrote a very long remark about what stands above it.</p></article></div>"
LAYOUTS = ["has-sidebar", "nav-open", "content with-sidebar", "menu-closed", "two-col right-sidebar", "no-comments", "page sidebar", "is-promo", "search-active", "widget-enabled", "col-2 no-banner"]
ARTICLES = ["post sponsored", "post has-comments", "search-result", "promo", "related", "post sidebar-none"]


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("main", ["article", "main", "div itemprop='articleBody'", "section role='main'"])
def test_layouts(name, main):
    page = f"<body class='x'>{MENU}<div class='{name}'><{main}><h1>A title</h1><p>The text.</p><p>More text.</p>{COMMENTS}</{main.split()[0]}>{COMMENTS}</div>{FOOT}</body>"
    assert html_text.main_text(page) == ("A title\nThe text.\nMore text.", 3)


@pytest.mark.parametrize("name", ARTICLES)
def test_articles(name):
    page = f"<body>{MENU}<div class='page'><article class='{name}'><h1>A title</h1><p>The text that is told on this page is longer than that of any of its readers' remarks put together.</p><div class='share-buttons'>Share</div></article>{COMMENTS}</div>{FOOT}</body>"
    assert html_text.main_text(page)[0].split("\n")[0] == "A title" and html_text.main_text(page)[1] == 2


@pytest.mark.parametrize("name", [*LAYOUTS, "search-results"])
def test_pages_without_articles(name):
    text = "The text of this page is told in one paragraph of some more words than a notice about cookies or a footer would take."
    page = f"<body>{MENU}<div class='{name}'><h1>A title</h1><p>{text}</p><div class='menu-main'><p>Menu</p></div></div>{FOOT}</body>"
    assert html_text.main_text(page) == (f"A title\n{text}", 2)


def test_noise_beside_an_article():
    others = "".join(f"<div class='{x}'><p>noise {x}</p></div>" for x in ("sidebar", "left-sidebar", "ad", "ads-top", "related-posts", "newsletter-signup", "social", "site-header", "header", "advertising", "post-comments"))
    page = f"<body>{MENU}{others}<article><p>The text.</p>{others}</article><article class='promo'><p>Buy this now, as it is far longer than the text of the page itself.</p></article>{FOOT}</body>"
    assert html_text.main_text(page) == ("The text.", 1)


def test_only_noise():
    assert html_text.main_text(f"<body>{MENU}<div class='menu'>one</div>{FOOT}</body>") == ("", 0) and html_text.main_text("<div class='ads'></div>") == ("", 0)
