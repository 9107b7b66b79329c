"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with the path of tags (and
their classes) from the root to it.  Over a page, every path gets two ratios:
text length per block and punctuation marks per block.  Articles repeat one
path with long, punctuated blocks; menus, notices and adverts have paths of
short blocks.  Both ratios are laid out in page order, smoothed over the
neighbouring blocks, fused into one score, and the paths whose score passes a
threshold drawn from the page's own spread are content.  Whatever else stands
in the elements that hold those blocks (headings, lists, quotes) belongs to the
article too, unless the markup itself names it as something else.

Markup informs the scores: where a page has an ``article`` or a ``main``, text
outside of them counts with the weight ``OUTSIDE``.  It does not decide: an
``article`` none of whose paths passes is left out, and one with such a path is
kept whole.  Inside of them only unmistakable names rule text out.
"""

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkprint.llm.common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg math noembed noframes xmp object".split())
DROPPED = frozenset(
    "head nav header footer aside form menu dialog button select option fieldset audio video canvas datalist".split()
)
#: Words in class, id, role or aria-label that name what is no article text.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer colophon copyright legal sidebar aside rail widget related recommended "
    "trending popular cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social comment comments commentlist disqus reply replies respond "
    "discussion pagination pager skip toolbar toc tags contentinfo complementary".split()
)
#: Inside an article a section may be called discussion, legal or related; only these names are trusted there, ...
NAMED_INSIDE = frozenset("ad ads advert adverts advertisement adbox comments commentlist disqus share newsletter navbar breadcrumb breadcrumbs".split())
#: ... these beside a word for posts, ...
NAMED_LISTS, POSTS = frozenset("related recommended trending popular".split()), frozenset("posts articles stories links".split())
#: ... and only in names without any word but these and ``NAMED`` (``share-buttons``, but not ``market-share``).
FURNITURE = POSTS | frozenset("area bar block box button buttons container form icons inline list section slot unit wrap wrapper".split())
#: Names of an article inside an article that is a reader's comment.
REMARKS = frozenset("comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Beside such a word (``has-sidebar``) a name tells how the page is laid out.
ABOUT_LAYOUT = frozenset("has no with without".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul li dd dt td th tr tbody thead tfoot".split()
)
#: An opening tag also closes an open element of these names, as far up as the fence.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Weight of the scores of text outside of what a page marks as its article.
OUTSIDE = 0.02
PUNCTUATION = ".,;:!?…。，、；：！？؟،।"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
NAME_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")
WHOLE_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Element:
    tag: str
    names: frozenset = frozenset()
    dropped: bool = False


@dataclass
class Block:
    path: tuple
    chain: tuple
    texts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    found = " ".join(a or b or c for a, b, c in NAME_ATTRIBUTE.findall(attributes))
    return frozenset(SPLIT_NAME.split(CAMEL.sub(" ", found).lower())) - {""}


def _no_article(attributes: str) -> bool:
    """Whether a whole name (a class, an id, a role, a label) unmistakably is that of no article text."""
    for kind, a, b, c in WHOLE_ATTRIBUTE.findall(attributes):
        value = a or b or c
        for name in value.split() if kind.lower() == "class" else [value]:
            words = frozenset(SPLIT_NAME.split(CAMEL.sub(" ", name).lower())) - {""}
            if words <= NAMED | FURNITURE and (words & NAMED_INSIDE or words & NAMED_LISTS and words & POSTS):
                return True
    return False


def blocks(page: str) -> list[Block]:
    """Non-empty text blocks of a page in order, without what its markup rules out."""
    out: list[Block] = []
    stack: list[Element] = []
    block: Block | None = None
    dropped = links = 0
    at, end = 0, len(page)

    def text(data: str) -> None:
        nonlocal block
        if dropped or not data:
            return
        if block is None:
            if data.isspace():
                return
            outer = tuple(e for e in stack if e.tag not in INLINE)
            block = Block(tuple((e.tag, *sorted(e.names)) for e in outer), outer)
            out.append(block)
        block.texts.append(data)
        if links:
            block.linked += len(data)

    def pop(to: int) -> None:
        nonlocal dropped, links, block
        while len(stack) > to:
            e = stack.pop()
            dropped -= e.dropped
            links -= e.tag == "a"
            if e.tag not in INLINE:
                block = None

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
            else:
                if tag not in INLINE:
                    block = None
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = at if attributes.rstrip().endswith("/") else close.end() if close else end
            continue
        if tag not in INLINE:
            block = None
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            closed, fence = SIBLINGS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in fence:
                    break
                if stack[i].tag in closed:
                    pop(i)
                    break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        names = _names(attributes)
        # The head of an article (its title) is not the head of the page.
        inside = any(e.tag in ("article", "main") for e in stack)
        named = bool(names & NAMED) and not names & ABOUT_LAYOUT and tag not in ("html", "body", "article", "main")
        if named and inside:
            named = tag not in HEADINGS and _no_article(attributes)
        if tag == "article" and names & REMARKS:
            named = any(e.tag == "article" for e in stack)
        rules_out = named or tag in DROPPED and not (tag == "header" and inside)
        stack.append(Element(tag, names, rules_out))
        dropped += rules_out
        links += tag == "a"
    for b in out:
        b.text = " ".join(html.unescape("".join(b.texts)).split())
    return [b for b in out if b.text]


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.25, 0.5, 0.25])
    padded = np.concatenate([x[:1], x, x[-1:]])
    return np.convolve(padded, kernel, "valid")


def content_paths(found: list[Block], spread: float = 0.5, weights: np.ndarray | float = 1.0) -> set:
    """Paths whose smoothed, fused and weighted ratios pass ``spread`` deviations of the page's scores."""
    length, marks, count = {}, {}, {}
    for b in found:
        length[b.path] = length.get(b.path, 0) + len(b.text)
        marks[b.path] = marks.get(b.path, 0) + sum(map(b.text.count, PUNCTUATION))
        count[b.path] = count.get(b.path, 0) + 1
    text_ratio = _smooth(np.array([length[b.path] / count[b.path] for b in found]))
    mark_ratio = _smooth(np.array([(marks[b.path] + 0.1) / count[b.path] for b in found]))
    fused = text_ratio / text_ratio.max() * mark_ratio / mark_ratio.max() * weights
    scores: dict = {}
    for b, s in zip(found, fused, strict=True):
        scores.setdefault(b.path, []).append(s)
    means = {p: float(np.mean(s)) for p, s in scores.items()}
    bar = min(spread * float(fused.std()), max(means.values()))
    return {p for p, s in means.items() if s >= bar}


def main_text(page: str | None) -> str:
    """The article of a page; empty if it has none."""
    if not page:
        return ""
    within = lambda b, *tags: any(e.tag in tags for e in b.chain)
    linked = lambda b: b.linked > 0.6 * len(b.text) and not b.text.endswith((".", "!", "?"))
    found = [b for b in blocks(page) if within(b, "article", "main") or not linked(b)]
    if not found:
        return ""
    marked = np.array([within(b, "article", "main") for b in found])
    chosen = content_paths(found, weights=np.where(marked, 1.0, OUTSIDE) if marked.any() else 1.0)
    content = [b for b in found if b.path in chosen]
    page_level = {id(e) for b in found for e in b.chain if e.tag in ("html", "body")}
    holders = {id(holder(b)) for b in content if b.chain} - page_level
    mains = {id(e) for b in content for e in b.chain if e.tag == "main"}

    def belongs(b: Block) -> bool:
        if b.path in chosen:
            return True
        up = {id(e) for e in b.chain}
        return bool(up & holders) or bool(up & mains) and within(b, *HEADINGS)

    return " ".join(b.text for b in found if belongs(b))


def holder(b: Block) -> Element:
    """The outermost article around a block; without one the element that directly holds it or its paragraph."""
    articles = [e for e in b.chain if e.tag == "article"]
    if articles:
        return articles[0]
    return b.chain[-2] if b.chain[-1].tag == "p" and len(b.chain) > 1 else b.chain[-1]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A map over the rows.  Null html gives the empty text; null ids, null urls and
    repeated rows pass through.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield [b["id"], b["url"], texts, [len(t) for t in texts]]

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(narrow, run, f"{id_col} long, {url_col} string, text string, n_chars long")
