"""Main text of web pages by tag-path ratios.

The text of a page stands at the ends of root-to-leaf tag paths.  For each path the
ratios of text length and of punctuation to its number of text blocks are taken over
the whole page, smoothed over the paths that come before and after it, and fused;
paths whose fused ratio reaches the threshold, a share of the ratios' standard
deviation, are content.  Facts of the path enter the ratio as factors: roles that
never hold content (menus, forms, footers, hidden or scripted parts) and reader
comments count as 0, text inside links is taken off, an ``article`` or ``main``
raises its paths, and a class, id or role that may name something else halves them.
A container that such a name says outright counts as 0, unless it holds most of the
text or is the article; where that would leave no text at all, names bar nothing.

The content paths tell which element is the article: the landmarks that hold them,
or else the smallest element around them.  All its blocks are the result, in page
order, but for barred ones and for paragraphs named as something else that miss the
threshold.  Without a landmark, paths that are nearly all links stay out too.

Defined results: a null or empty page has no text; unclosed and stray tags, comments
and references are read as browsers do, as far as paths need it; pages are read one
by one, so repeated rows, ties and empty tables need no rule; other columns are not
read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import per_row

#: Element names.
SKIPPED = "script|style|noscript|template|textarea|svg|select|iframe|object|annotation|annotation-xml|canvas|title|video|audio"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup
    mtext munder munderover semantics""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head nav footer aside form menu dialog button fieldset legend datalist".split())
LANDMARKS = frozenset(("article", "main"))
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
             "tfoot": {"tr", "td", "th", "tbody"}}
KEEPS_OPEN = frozenset("ul ol dl table div section article main blockquote body html".split())
#: Words of class, id and role that mark what is not the article, and those that do so only on their own.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo sidebar menu nav navbar breadcrumb
    breadcrumbs footer masthead topbar cookie cookies gdpr consent newsletter signup pagination pager popup complementary
    contentinfo""".split())
DOUBTFUL = frozenset("""alert banner copyright disclaimer hidden legal login modal navigation notice notices overlay popular promotion
    promotions recommended related respond search share sharing social subscribe toolbar trending widget""".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Words beside a doubtful one that leave its sense, and words that turn it into a state of something else.
BESIDE = frozenset("""area articles bar block bottom box btn button buttons container content form global group header icons inner item
    items js left link links list main message module news outer page panel posts primary right secondary section site sr only skip
    stories strip top unit wrap wrapper""".split())
STATES = frozenset("closed disabled enabled has have no not off on open with without".split())
WORD = re.compile(r"[^\s_-]+")
NOT_SHOWN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""")
NAMED = re.compile(r"""(?i)(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + SKIPPED + r""")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
                   r"""((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)>|<[!?][^>]*>""", re.S | re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
SMOOTHING = np.array([0.25, 0.5, 0.25])
THRESHOLD, LANDMARK_FACTOR, LINK_SHARE, NAME_FACTOR = 0.6, 50.0, 0.8, 0.5
#: Why an element is left out: what its class, id or role is called, what it is, or that it holds comments of readers;
#: DOUBT and OWN_NAME only lower the ratio, OWN_NAME (a paragraph's) so that it has to reach the threshold by itself.
BY_NAME, BY_KIND, BY_COMMENTS, DOUBT, OWN_NAME = 1, 2, 3, 4, 5


class Block:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: tuple, text: str, links: int):
        self.path, self.text, self.links = path, text, links


def called(marks: str) -> int:
    """What the words of class, id and role say: comments, something else (BY_NAME), or perhaps something else (DOUBT)."""
    found = 0
    for token in marks.lower().split():
        parts = set(WORD.findall(token))
        if parts & STATES:
            continue
        if parts & COMMENTS:
            return BY_COMMENTS
        if parts & MARKS or (parts & DOUBTFUL and parts <= DOUBTFUL | BESIDE) or token in ("site-header", "page-header"):
            found = BY_NAME
        elif parts & DOUBTFUL:
            found = found or DOUBT
    return found


def role(name: str, attributes: str, inside: bool) -> int:
    """Whether an element never holds content, and why; ``inside`` a landmark a header is the article's own."""
    if name in NEVER or (name == "header" and not inside):
        return BY_KIND
    if not attributes:
        return 0
    if NOT_SHOWN.search(attributes):
        return BY_KIND
    if name in ("html", "body"):
        return 0
    why = called(" ".join(a or b or c for _, a, b, c in NAMED.findall(attributes)))
    if why and name in HEADINGS:
        return DOUBT
    return OWN_NAME if name == "p" and why in (BY_NAME, BY_COMMENTS) else why


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page with their paths; a path's parts are (name, label, why it is left out, number)."""
    out: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []  # name, label, why it is left out, number of the element
    pieces: list[str] = []
    link_from, links, number = -1, 0, 0

    def flush() -> None:
        nonlocal pieces, links, link_from
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                if link_from >= 0:
                    links += sum(map(len, pieces[link_from:]))
                out.append(Block(tuple(stack), text, min(links, len(text))))
            pieces, links = [], 0
            link_from = 0 if link_from >= 0 else -1

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            pieces.append(html[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, attributes = name.lower(), m[4].strip()
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                pieces.append("" if name == "wbr" else " ")
            continue
        if name in INLINE:
            if name == "a":
                if link_from >= 0:
                    links += sum(map(len, pieces[link_from:]))
                link_from = -1 if m[2] else len(pieces)
            elif not m[2] and attributes and (why := role(name, attributes, True)):
                flush()
                number += 1
                stack.append((name, name, why, number))
            elif m[2] and any(x[0] == name for x in stack[-2:]):
                flush()
                while stack.pop()[0] != name:
                    pass
            continue
        flush()
        if m[2]:
            if any(x[0] == name for x in stack):
                link_from = -1
                while stack.pop()[0] != name:
                    pass
            continue
        if any(x[0] == "p" for x in stack[-3:]):  # a block closes an open paragraph
            while stack.pop()[0] != "p":
                pass
        closes = CLOSED_BY.get(name)
        while closes and stack and stack[-1][0] not in KEEPS_OPEN:
            if stack.pop()[0] in closes and (not stack or stack[-1][0] not in closes):
                break
        if not attributes.endswith("/"):
            number += 1
            inside = any(x[0] in LANDMARKS for x in stack)
            label = name
            if attributes and (c := NAMED.search(attributes)):
                label = f"{name}.{(c[2] or c[3] or c[4] or '').strip()}"
            stack.append((name, label, role(name, attributes, inside), number))
    if at < len(html):
        pieces.append(html[at:])
    flush()
    return out


def spared(blocks: list[Block], shown: np.ndarray) -> set[int]:
    """Elements left out by name that hold the article all the same; ``shown`` is the length of each block's own text.

    They hold half or more of the text of all ``article`` elements (without any, of
    ``main``; without any, of the page), or are such an element themselves, unless in
    another article or in an element that is left out.
    """
    total = shown
    for name in ("article", "main"):
        of = np.array([any(x[0] == name for x in b.path) for b in blocks])
        if shown[of].any():
            total = np.where(of, shown, 0.0)
            break
    held: dict[int, float] = {}
    for b, weight in zip(blocks, total.tolist(), strict=True):
        for x in b.path:
            if x[2] == BY_NAME:
                held[x[3]] = held.get(x[3], 0.0) + weight
    out = {k for k, weight in held.items() if weight > 0 and 2 * weight >= total.sum()}
    for b in blocks if held else ():
        article = False
        for x in b.path:
            if x[2] == BY_NAME and x[3] not in out:
                if article or x[0] not in LANDMARKS:
                    break
                out.add(x[3])
            article |= x[0] == "article"
    return out


def has(blocks: list[Block], *whys: int) -> np.ndarray:
    return np.array([any(x[2] in whys for x in b.path) for b in blocks])


def path_ratios(blocks: list[Block], never: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path number of each block; fused ratio and share of linked text of each path.

    A path is the names and first labels of its elements; blocks that are barred or
    that names speak against have paths of their own, so they don't weigh on the others.
    """
    chars = np.array([len(b.text) for b in blocks], np.float64)
    linked = np.array([b.links for b in blocks], np.float64)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], np.float64)
    named, own = has(blocks, BY_NAME, BY_COMMENTS, DOUBT, OWN_NAME), has(blocks, OWN_NAME)
    index: dict[tuple, int] = {}
    which = np.array([index.setdefault((tuple(x[1] for x in b.path), *flags), len(index))
                      for b, *flags in zip(blocks, never.tolist(), named.tolist(), own.tolist(), strict=True)], np.int64)
    n = len(index)
    count = np.bincount(which, minlength=n)
    length = np.bincount(which, np.where(never, 0, chars - linked), n) / count
    points = np.bincount(which, np.where(never, 0, marks), n) / count

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, 1, mode="edge")
        return SMOOTHING[0] * padded[:-2] + SMOOTHING[1] * padded[1:-1] + SMOOTHING[2] * padded[2:]

    ratio = np.sqrt(length * smooth(length) * (1 + smooth(points)))
    ratio[np.bincount(which, named, n) > 0] *= NAME_FACTOR
    return which, ratio, np.bincount(which, linked, n) / np.bincount(which, chars, n)


def outermost(b: Block, name: str) -> int:
    """Number of a block's outermost element of this name; 0 without one."""
    return next((x[3] for x in b.path if x[0] == name), 0)


def content(blocks: list[Block], by_name: bool = True) -> np.ndarray:
    """Which blocks are the article; without ``by_name``, names leave nothing out."""
    never, named = has(blocks, BY_KIND), has(blocks, BY_NAME, BY_COMMENTS)
    can_retry = by_name and bool((named & ~never).any())
    if can_retry:
        comments = has(blocks, BY_COMMENTS)
        shown = np.array([len(b.text) - b.links for b in blocks], np.float64)
        stay = spared(blocks, np.where(never | comments, 0.0, shown))
        never = never | comments | np.array([any(x[2] == BY_NAME and x[3] not in stay for x in b.path) for b in blocks])
    which, ratio, link_share = path_ratios(blocks, never)
    articles = np.array([outermost(b, "article") for b in blocks])
    mains = np.array([outermost(b, "main") for b in blocks])
    marked = np.bincount(which, ((articles > 0) | (mains > 0)) & ~never) > 0
    ratio = np.where(marked, ratio * LANDMARK_FACTOR, np.where(link_share > LINK_SHARE, 0.0, ratio))
    landmark = marked.any() and ratio[marked].max() > 0 and ratio[marked].max() >= ratio.max()
    chosen = ratio >= max(THRESHOLD * float(ratio.std()), 1e-9)
    if landmark:
        chosen &= marked
    picked = chosen[which] & ~never
    if not picked.any():
        return content(blocks, False) if can_retry else picked
    if landmark:
        # All blocks of the landmarks that hold content; a main around such articles gives its title and content paths only.
        core, outer = set(articles[picked].tolist()) - {0}, set(mains[picked].tolist()) - {0}
        title = np.array([any(x[0] == "h1" for x in b.path) for b in blocks])
        alone = (articles == 0) & np.isin(mains, list(outer))
        within = np.isin(articles, list(core)) | (alone & title if core else alone)
    else:
        paths = [tuple(x[3] for x in b.path) for b, p in zip(blocks, picked.tolist(), strict=True) if p]
        common = paths[0]
        for p in paths[1:]:
            k = 0
            while k < min(len(common), len(p)) and common[k] == p[k]:
                k += 1
            common = common[:k]
        if len(common) > 1 and common in paths:  # a lone paragraph: its neighbours belong to it, unless they are the whole page
            of = blocks[int(np.flatnonzero(picked)[paths.index(common)])].path
            if of[-1][0] in ("p", "pre", "blockquote") and of[-2][0] != "body":
                common = common[:-1]
        within = np.array([tuple(x[3] for x in b.path[:len(common)]) == common for b in blocks]) & ~(link_share[which] > LINK_SHARE)
    return picked | (within & ~never & ~has(blocks, OWN_NAME))


def main_text(html: str | None) -> str:
    blocks = blocks_of(html) if html else []
    return "\n\n".join(b.text for b, k in zip(blocks, content(blocks).tolist(), strict=True) if k) if blocks else ""


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keep`` columns, the main ``text`` of each page and its number of code points."""
    def work(part: pa.RecordBatch) -> list:
        texts = [main_text(x) for x in part.column(html).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return per_row(pages, html, list(keep), "text string, n_chars long", work)
