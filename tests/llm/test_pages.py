"""Whole texts of pages: what belongs to the article stays, what does not goes."""

import pytest

from lensfold.llm.html_text import main_text

LONG = "This paragraph has a good number of words, with commas, so that it counts as prose, and goes on for a while."
MORE = "Another paragraph of the same article, which is also long enough, says a little more about the matter at hand."
ARTICLE = f"<article><h1>Title</h1><p>{LONG}</p><p>{MORE}</p>%s</article>"
TEXT = f"Title\n{LONG}\n{MORE}"

#: (html, text) of whole pages.
PAGES = {
    "plain": (ARTICLE % "", TEXT),
    "data-id": (ARTICLE % "<div data-id='related'>Kept part of it.</div>", f"{TEXT}\nKept part of it."),
    "data-role": (ARTICLE % "<div data-role='menu'>Kept part of it.</div>", f"{TEXT}\nKept part of it."),
    "title says hidden": (ARTICLE % "<p title='the hidden truth'>Kept.</p>", f"{TEXT}\nKept."),
    "note says hidden": (ARTICLE % "<p data-note='is hidden now'>Kept.</p>", f"{TEXT}\nKept."),
    "hidden": (ARTICLE % "<p hidden>Gone.</p><div style='color:red; DISPLAY : none'>Gone.</div><p aria-hidden=true>Gone.</p>", TEXT),
    "heading overlay": (ARTICLE % "<h2 id='overlay-networks'>Overlay networks</h2>", f"{TEXT}\nOverlay networks"),
    "heading search": (ARTICLE % "<h2 id='search'>Search</h2>", f"{TEXT}\nSearch"),
    "paragraph related": (ARTICLE % "<p id='related-work'>Related work is rare.</p>", f"{TEXT}\nRelated work is rare."),
    "section menu": (ARTICLE % f"<section id='menu-design'><h2>Menus</h2><p>{LONG}</p></section>", f"{TEXT}\nMenus\n{LONG}"),
    "section search": (ARTICLE % f"<section id='search'><h2>Search</h2><p>{LONG}</p></section>", f"{TEXT}\nSearch\n{LONG}"),
    "social history": (ARTICLE % "<div class='social-history'>A short part.</div>", f"{TEXT}\nA short part."),
    "alert system": (ARTICLE % "<div class='alert-system'>A short part.</div>", f"{TEXT}\nA short part."),
    "advert inside": (ARTICLE % "<div class='ad'>Buy now</div><div class='ad-banner'>Buy now</div>", TEXT),
    "share inside": (ARTICLE % "<div class='share-buttons'><a href=x>Tell</a> <a href=y>Post</a></div>", TEXT),
    "related inside": (ARTICLE % "<div class='related-posts'><h3>Related</h3><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>", TEXT),
    "newsletter inside": (ARTICLE % "<div class=newsletter><p>Sign up.</p></div>", TEXT),
    "aside inside": (ARTICLE % "<aside>An aside, with words.</aside>", TEXT),
    "comments beside": (ARTICLE % "" + f"<div id='comments'><p>{LONG}</p></div>", TEXT),
    "responses beside": (ARTICLE % "" + f"<section id='responses'><p>I think so, too.</p><p>{LONG}</p></section>", TEXT),
    "furniture around": (f"<header><a href=/>Home</a></header><nav><a href=a>A</a></nav>{ARTICLE % ''}<footer>2020</footer>", TEXT),
    "form around": (f"<body><form action=x><input type=hidden><div><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div></form>", TEXT),
    "form around article": (f"<body><form><input name=q>{ARTICLE % ''}</form>", TEXT),
    "form inside": (ARTICLE % "<form><p>Your mail</p><input name=m><button>Send</button></form>", TEXT),
    "title in a box": (f"<body><div class=title><h1>Title</h1></div><div><p>{LONG}</p><p>{MORE}</p></div>", TEXT),
    "short boxes": (f"<body><div><h1>Title</h1></div><div><p>{LONG}</p><p>{MORE}</p></div><div>Short end.</div>", f"{TEXT}\nShort end."),
    "list, quote, table": (
        f"<body><div id=c><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div><ul><li>One<li>Two</ul><blockquote>Said so.</blockquote><table><tr><td>1<td>2</table>",
        f"{TEXT}\nOne\nTwo\nSaid so.\n1\n2",
    ),
    "sources": (
        f"<body><div><h1>Title</h1><p>{LONG}</p><p>{MORE}</p><ul><li><a href=a>A first source with a long title</a><li><a href=b>A second source with a long title</a><li><a href=c>A third source with a long title</a></ul></div>",
        f"{TEXT}\nA first source with a long title\nA second source with a long title\nA third source with a long title",
    ),
    "menu without nav": (f"<body><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Shop</a></ul><div><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div>", TEXT),
    "boxes by name": (f"<body><div class='siteHeader'>Site</div><div class=sidebar><p>{LONG}</p></div><div id=x><h1>Title</h1><p>{LONG}</p><p>{MORE}</p></div><div id=footer>End</div>", TEXT),
    "wrapper named": (f"<body><div class='page has-sidebar'>{ARTICLE % ''}</div><div class='notice'>Note.</div>", TEXT),
    "scripts and references": (f"<script>if (a < b) 'p'</script><style>p {{}}</style>{ARTICLE % '<p>Fish &amp; chips &#233;&nbsp;&lt;b&gt;<br>and\n\n  more</p>'}", f"{TEXT}\nFish & chips é <b> and more"),
    "two articles": (f"<body>{ARTICLE % ''}{ARTICLE % ''}", f"{TEXT}\n{TEXT}"),
    "no prose": ("<body><div>Only this.</div>", "Only this."),
    "nothing": ("<body><nav>Menu</nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, text = PAGES[name]
    assert main_text(html) == text
    assert main_text(html.replace("<body>", "<!DOCTYPE html><html><head><title>T</title></head><body>") + "\n") == text
