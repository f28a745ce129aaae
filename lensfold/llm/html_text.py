"""Main text of web pages by tree scoring.

A page is parsed into a tree of elements. Each paragraph gives points, for its length and its commas, less its share of
link text, to the element that holds it, and fractions of them to that element's ancestors. If the element with most points
is in an ``article`` or ``main``, all of that is the text but for furniture; beside an article its headings, paragraphs and
siblings with a fair part of its points belong to it. On other pages its siblings at all levels do, but for furniture and menus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lensfold.llm.common import column

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/][^<>]*>|</?[a-zA-Z][^<>]*$", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# HTML element names by their part in the page.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("nav footer aside script style noscript template iframe button select option textarea title head svg canvas object dialog menu input datalist audio video map xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class, id or role that mark page furniture.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer masthead topbar toolbar pagination pager comment comments commentlist disqus respond replies cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended newsletter subscribe subscription signup login search widget skip disclaimer responses reactions feedback".split())
#: Words that may stand beside those in a name without changing what it names.
NEUTRAL = frozenset("site main page box list wrapper wrap container area block bar top bottom left right inner outer links link posts post articles buttons button form section module item items global primary secondary mobile desktop icons icon stories more content header col column panel thread count message text title".split())
HEADERS = frozenset("header siteheader pageheader".split())
FURNITURE_PARTS = re.compile(r"comment(?!ar)|sidebar|advert|sponsor|breadcrumb|cookie|newsletter|navbar|navigation|footer|masthead", re.I)
PROTECTED = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "up", "kids", "score", "dropped", "named", "inside", "chars", "links", "n_links")

    def __init__(self, tag: str, up: Node | None, dropped: bool, named: bool = False, inside: bool = False):
        self.tag, self.up, self.kids, self.score, self.dropped, self.named, self.inside = tag, up, [], 0.0, dropped, named, inside
        self.chars = self.links = self.n_links = 0


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-cased name; the first of a name counts, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_dropped(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the tag, or an attribute that hides it, makes an element furniture; ``inside`` an article or main."""
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside
    if not attributes or tag in PROTECTED:
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(attributes.get("style", "")))


def is_named(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether a class, id or role may name an element as furniture: never a heading, nor inside an article a paragraph.

    Inside an article, all words of a name must be such words or neutral ones: ``related-posts``, but not ``related-work``.
    """
    if tag == "form":
        return True
    if tag in HEADINGS or (inside and (tag == "p" or tag in INLINE)):
        return False
    for name in " ".join(attributes.get(c, "") for c in ("class", "id", "role")).split():
        words = {w.lower() for w in _WORD.findall(name)} | {w for w in re.split(r"[\W_\d]+", name.lower()) if w}
        parts = {w.lower() for w in _WORD.findall(name)}
        if inside:
            if words & FURNITURE and (parts <= FURNITURE | NEUTRAL or name.lower() in FURNITURE):
                return True
        elif words & (FURNITURE | HEADERS) or FURNITURE_PARTS.search(name):
            return True
    return False


def parse(html: str) -> Node:
    """The tree of a page; leaves of ``kids`` are strings. Elements left open end with their parents, as browsers do it."""
    root = here = Node("html", None, False)
    at, low = 0, None
    articles = 0

    def close(node: Node) -> Node:
        nonlocal articles
        articles -= node.tag in ("article", "main")
        return node.up

    for m in iter(lambda: _TAG.search(html, at), None):
        if m.start() > at:
            here.kids.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            node = here
            while node is not root and node.tag != tag:
                if node.tag in ("article", "main", "td", "table") and tag in INLINE:
                    node = root
                    break
                node = node.up
            if node is not root:
                while here is not node:
                    here = close(here)
                here = close(here)
            continue
        if tag in ("html", "body"):
            continue
        shut = ("p",) if tag in CLOSES_P else SELF_CLOSING.get(tag)
        if shut:
            node = here
            while node is not root and node.tag not in shut and (node.tag in INLINE or node.tag in ("p", "li", "dt", "dd", "td", "th") and tag != "p"):
                node = node.up
            if node.tag in shut:
                while here is not node:
                    here = close(here)
                here = close(here)
        if tag in VOID:
            here.kids.append(" " if tag != "hr" else Node(tag, here, True))
            continue
        attributes, inside = attributes_of(m[3]) if m[3] else {}, articles > 0
        node = Node(tag, here, here.dropped or is_dropped(tag, attributes, inside), is_named(tag, attributes, inside), inside)
        here.kids.append(node)
        if tag in RAW:
            low = low or html.lower()
            end = low.find(f"</{tag}", at)
            stop = html.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(html)
        elif not m[3].endswith("/") or tag in CLOSES_P:
            here = node
            articles += tag in ("article", "main")
    if at < len(html):
        here.kids.append(html[at:])
    drop_named(root)
    return root


def drop_named(root: Node) -> None:
    """Drop what is furniture by its name, or a form, unless it holds most of the page's text or is a part of the article.

    The page's text is that of articles and mains that have no such name; without them that of paragraphs, without these all
    text. Inside an article a named element goes if it is mostly links, or holds no heading and little of the paragraphs.
    """
    order = [root]
    for node in order:
        order += [kid for kid in node.kids if isinstance(kid, Node) and not kid.dropped]
    if not any(node.named for node in order):
        return
    # (characters in innermost articles, in paragraphs, in all, in links, in headings) below each element
    held: dict[Node, tuple[int, int, int, int, int]] = {}
    for node in reversed(order):
        kids = [held[kid] for kid in node.kids if isinstance(kid, Node) and not kid.dropped]
        article, prose, every, links, headings = (sum(k[i] for k in kids) for i in range(5))
        every += sum(len(kid.strip()) for kid in node.kids if isinstance(kid, str))
        article = every if node.tag in ("article", "main") and not node.named and not article else article
        held[node] = article, every if node.tag == "p" else prose, every, every if node.tag == "a" else links, every if node.tag in HEADINGS else headings
    whole = held[root]
    kind = next((i for i in range(3) if whole[i]), 2)
    for node in order:
        own = held[node]
        if node.named and node.tag not in PROTECTED and 2 * own[kind] <= whole[kind]:
            little = not own[4] and 5 * own[1] <= whole[1]
            node.dropped = not node.inside or node.tag == "form" or little or 2 * own[3] > own[2] - own[4]
        node.dropped = node.dropped or bool(node.up and node.up.dropped)


def blocks(node: Node) -> Iterator[tuple[Node, str, int, int]]:
    """(innermost block element, text, characters of link text, links) of each block below ``node``, in page order."""
    held: list[str] = []
    linked = links = 0

    def flush(owner: Node) -> Iterator[tuple[Node, str, int, int]]:
        nonlocal linked, links
        if text := " ".join(unescape("".join(held)).split()):
            yield owner, text, min(linked, len(text)), links
        held.clear()
        linked = links = 0

    # An explicit stack, as nesting has no limit: (node, next child, block that owns its text, inside a link)
    stack = [(node, 0, node, False)]
    while stack:
        here, k, owner, link = stack.pop()
        if k == len(here.kids):
            if here is owner:
                yield from flush(owner)
            continue
        stack.append((here, k + 1, owner, link))
        kid = here.kids[k]
        if isinstance(kid, str):
            held.append(kid)
            linked += len(kid.strip()) * link
        elif not kid.dropped:
            if kid.tag in INLINE:
                links += kid.tag == "a"
                stack.append((kid, 0, owner, link or kid.tag == "a"))
            else:
                yield from flush(owner)
                stack.append((kid, 0, kid, link))


def score(root: Node) -> Node | None:
    """Give points and return the element with most of them; None if no paragraph gave any."""
    holders: list[Node] = []
    for owner, text, linked, links in blocks(root):
        node = owner
        while node:
            node.chars += len(text)
            node.links += linked
            node.n_links += links
            node = node.up
        if owner.tag in HEADINGS:
            continue
        points = ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        node, share = owner.up if owner.tag in ("p", "pre", "blockquote", "li", "td") and owner.up else owner, 1.0
        while node and share > 0.1:
            if not node.score:
                node.score += 25 if node.tag in ("article", "main") else 5 if node.tag in ("div", "section") else 0
                holders.append(node)
            node.score += points * share
            node, share = node.up, share / 2 if share == 1 else share / 1.5
    best = None
    for node in holders:
        value = node.score * (1 - node.links / max(1, node.chars))
        if value > 0 and (best is None or value > best[0]):
            best = value, node
    return best[1] if best else None


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if the page has no text outside of its furniture."""
    root = parse(html or "")
    best = score(root)
    if best is None:
        return "\n".join(text for _, text, _, _ in blocks(root))
    while best.tag in INLINE | {"p"} and best.up:
        best = best.up
    node = container = best
    while node := node.up:
        if node.tag in ("article", "main"):
            container = node
    if container.tag == "main":
        parts = [container]
    elif container.tag == "article":
        parts = beside(container, container.score * 0.2)
    else:  # nothing says where the article ends: all that is no furniture, and no menu, belongs to it
        parts = [root]
    for part in parts:
        if part.tag not in ("article", "main"):
            drop_menus(part)
    return "\n".join(text for part in parts for _, text, _, _ in blocks(part))


def beside(article: Node, least: float) -> list[Node]:
    """An article and those siblings that belong to it: headings, paragraphs, and what has a fair part of its points, unless mostly links."""
    out = []
    for kid in article.up.kids if article.up else [article]:
        if isinstance(kid, Node) and not kid.dropped:
            fair = kid.tag == "p" or kid.tag in HEADINGS or kid.score >= max(10, least)
            if kid is article or (fair and kid.links < 0.5 * max(1, kid.chars)):
                out.append(kid)
    return out


def drop_menus(node: Node) -> None:
    """Leave out lists and boxes of links with short texts, where no ``article`` or ``main`` says what belongs to the text."""
    stack = [node]
    while stack:
        for kid in stack.pop().kids:
            if isinstance(kid, Node) and not kid.dropped:
                listed = kid.tag in ("ul", "ol", "div", "section", "table", "dl")
                if listed and kid.n_links >= 3 and kid.links > 0.6 * kid.chars and kid.links < 20 * kid.n_links:
                    kid.dropped = True
                else:
                    stack.append(kid)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``, from the whole html.

    Null and empty pages, and pages without text, give an empty text and 0. Broken or unfinished markup is read as far as
    it goes. Rows are independent: repeated rows get equal answers, null ids and urls pass through, other columns are not
    read. Memory follows the longest page.
    """
    pages = pages.select("page_id", "url", "html")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(h) for h in column(part, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "page_id"), column(part, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(read, schema)
