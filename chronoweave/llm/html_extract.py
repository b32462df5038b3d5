"""Main text of web pages: flat blocks of text, classified by a decision tree.

A page is read once, from tag to tag, into blocks: runs of text between block-level tags.  A block is
described by its words and the share of them that stand in links, by the same two figures of the
blocks before and behind it, and by what it lies in.  A decision tree (CART, gini), grown on the
small labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: Their content is no text.
_RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp"}
_SKIP = {"svg", "math", "canvas", "object", "audio", "video", "select", "button", "head"}
#: In a head; any other tag ends a head whose end tag is left out.
_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_PAGE_PARTS = {"nav", "menu", "footer", "aside", "form", "dialog", "header"}
#: Words of class names and ids that say what a container is, whatever stands beside them.
_SURE = re.compile(r"(?:nav|navbar|navigation|menu|breadcrumbs?|footer|foot|sidebar|aside|widget|ads?|advert\w*|adsense|sponsor\w*|cookies?|consent|gdpr|newsletter|comments?|commentlist|disqus|pagination|pager|masthead|topbar)")
#: Words that say so alone or beside words of these three lists, but may be about anything else.
_MAYBE = re.compile(r"(?:promo\w*|banner|notice|alert|popup|modal|overlay|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|replies|respond|toolbar|copyright|disclaimer|header)")
_NEUTRAL = re.compile(r"(?:\d*|box|boxes|wrap|wrapper|container|outer|inner|list|item|items|area|block|section|bar|links?|top|bottom|left|right|main|site|page|post|entry|global|primary|secondary|content|col|column|row|sticky|fixed|text|form|buttons?|icons?|media|news|group|panel|tab|thread|reader|user)")
#: What a page has or lacks is not what a container is.
_ABOUT = re.compile(r"(?:has|no|with|without|is|not|hide|show|js|hidden|toggle)[-_]")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")

#: Of a block; the tree's inputs in order.  The box is the innermost container that its class, id or role speaks of.
FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "in_article", "in_part", "sure", "maybe", "comment", "box_words", "box_links", "heading", "page_has_article")


def _named(value: str) -> tuple[bool, bool]:
    """What a class or id says: surely a part of the page beside its text, maybe one."""
    sure = maybe = other = False
    for name in value.split():
        if _ABOUT.match(name):
            continue
        parts = [p for p in re.split(r"[-_]+", name) if p]
        known = [_SURE.fullmatch(p) is not None for p in parts]
        weak = [_MAYBE.fullmatch(p) is not None for p in parts]
        plain = all(k or w or _NEUTRAL.fullmatch(p) for p, k, w in zip(parts, known, weak, strict=True))
        if any(known) and plain:
            sure = True
        elif any(known) or any(weak):
            maybe = True
            other |= not plain
        elif not plain:
            other = True
    return sure or maybe and not other, maybe and other


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Text and features of each block that has text, in page order."""
    found: list[list] = []
    text: list[str] = []
    words_linked = 0
    # of the place reached: in article, in part, sure, maybe, comment, heading, skipped, box
    state: tuple = (0, 0, 0, 0, 0, 0, 0, None)
    stack: list[tuple] = []  # tag, and the state outside it
    links = at = 0
    raw = ""

    def take(piece: str) -> None:
        nonlocal words_linked
        if piece and not state[6]:
            piece = html.unescape(piece)
            text.append(piece)
            if links:
                words_linked += len(piece.split())

    def flush() -> None:
        nonlocal words_linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                n = joined.count(" ") + 1
                linked = min(words_linked, n)
                found.append([joined, n, linked / n, *state])
                if state[7] is not None:
                    state[7][0] += n
                    state[7][1] += linked
            text.clear()
        words_linked = 0

    def leave(tags: set[str], within: set[str] | None = None) -> None:
        """Out of the innermost of these tags, and of all in it; with ``within``, only if nothing else lies in it."""
        nonlocal state
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                state = stack[i][1]
                del stack[i:]
                return
            if within is not None and stack[i][0] not in within:
                return

    while True:
        if raw:  # up to its end tag only
            end = re.compile(rf"</{raw}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            raw = ""
        m = _TAG.search(page, at)
        take(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
        if not closing and tag not in _HEAD and stack and stack[-1][0] == "head":
            leave({"head"})
        if tag in _INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            take(" ")
            continue
        if tag in _RAW:
            if not closing:
                raw = tag
            continue
        flush()
        if tag in _VOID or attrs.endswith("/") and tag in _SKIP:
            continue
        if closing:
            if any(t[0] == tag for t in stack):
                leave({tag})
            links = 0 if tag in ("nav", "ul", "article", "div", "section") else links
            continue
        if tag not in ("option", "optgroup"):  # blocks end a button or a list of choices whose end tag is left out
            leave({"button", "select"}, {"option", "optgroup", "button", "select"})
        if tag == "p":
            leave({"p"}, {"p"})
        elif tag in ("article", "main"):
            # neither lies in a menu, nor main in any other part
            leave({"nav", "menu"} if tag == "article" else {"nav", "menu", "header", "footer", "aside"}, None)
            links = 0
        elif tag == "header" and any(t[0] == "nav" for t in stack):
            leave({"nav"})
        stack.append((tag, state))
        article, part, sure, maybe, comment, heading, skipped, box = state
        if tag in _SKIP:
            skipped = 1
        elif tag == "article":
            article, maybe = 1, 0
        elif tag == "main":
            article, part, sure, maybe, box = 1, 0, 0, 0, None
        elif tag in _PAGE_PARTS and not (tag == "header" and article):
            part = 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = 1
        if attrs and tag not in ("body", "html"):
            for name, value in _ATTR.findall(attrs):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id"):
                    if re.search(r"(?:^|[\s_-])(?:comments?|commentlist|disqus)(?:$|[\s_-])", value) and not _ABOUT.match(value):
                        comment = 1  # comments are often articles themselves
                    if tag in ("article", "main"):
                        continue
                    yes, perhaps = _named(value)
                    if yes or perhaps:
                        box = [0, 0]
                        sure, maybe = sure or int(yes), maybe or int(perhaps)
                elif name == "role" and value in _ROLES:
                    sure, box = 1, [0, 0]
        state = (article, part, sure, maybe, comment, heading, skipped, box)
    flush()
    has = float(any(b[3] for b in found))
    out = []
    for i, b in enumerate(found):
        before, behind = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        near = [*((before[1], before[2]) if before else (0, 0)), *((behind[1], behind[2]) if behind else (0, 0))]
        box = b[10]
        out.append((b[0], [b[1], b[2], *near, *b[3:8], *((box[0], box[1] / max(box[0], 1)) if box else (0, 0)), b[8], has]))
    return out


#: The labelled table: pages in which a block that is main text begins with a + at its first word.
_LONG = "The river had risen in the night and by morning the lower fields were under water, so the council met early to decide what should be done about the bridge."
_MID = "Nobody expected the vote to be so close this year."
_SHORT = "It was late."
_LINKS = "<a href=1>Home</a> <a href=2>Blog</a> <a href=3>About us</a>"
LABELLED: list[str] = [
    f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>+Flood</h1><p>+{_LONG}</p><p>+{_SHORT}</p></article><footer>&copy; 2020 Example</footer>",
    f"<div class='ad'>Buy our shoes now and save a lot of money today.</div><article><h1>+{_MID}</h1><p>+{_LONG}</p></article><aside><p>{_MID}</p></aside>",
    f"<header><p>{_MID}</p></header><main><h2>+Vote</h2><p>+{_SHORT}</p><p>+{_MID}</p><ul><li>+One</li><li>+Two</li></ul></main><footer><p>{_LONG}</p></footer>",
    f"<article><p>+{_LONG}</p><p><a href=x>+Read the report</a></p><div class=related><a href=1>Other news of the day</a></div></article><div id=comments><p>{_LONG}</p><p>Nice</p></div>",
    f"<div id=cookie-notice><p>We use cookies to improve your experience on this site and others.</p></div><article><p>+{_SHORT}</p><p>+{_LONG}</p><form><p>{_MID}</p></form></article>",
    f"<div class='top menu'><a href=1>Home</a> <a href=2>Blog</a></div><div><p>+{_LONG}</p><p>+{_LONG}</p><p>+{_SHORT}</p></div><div>Contact</div><div class=sidebar><p>{_LONG}</p></div>",
    f"<div><a href=1>Home</a> | <a href=2>Blog</a> | <a href=3>About us</a></div><h1>+Flood</h1><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p><div><a href=4>Imprint</a></div>",
    f"<ul><li><a href=1>Home</a></li><li><a href=2>Sport</a></li><li><a href=3>Money</a></li></ul><p>+{_LONG}</p><p>+{_LONG}</p><ul><li><a href=1>Terms</a></li><li><a href=2>Privacy</a></li></ul>",
    f"<article><h1>+Bridge</h1><p>+{_MID} <a href=1>here</a></p><section class=comments><article class=comment><p>{_LONG}</p></article></section></article>",
    f"<div role=navigation><p>{_MID}</p></div><main><p>+{_MID}</p><div class='newsletter-signup'><p>{_MID}</p></div><p>+{_SHORT}</p></main><div role=contentinfo>{_LONG}</div>",
    f"<p>+{_LONG}</p><p>+{_SHORT}</p><p>+{_LONG}</p>",
    f"<div>Login</div><div>+{_LONG}</div><div>+{_LONG}</div><div>Share</div>",
    f"<article><header><h1>+Vote</h1></header><p>+{_SHORT}</p><footer><p>{_MID}</p></footer></article><nav>{_LONG}</nav>",
    f"<p>+{_MID}</p>",
    "<p>+Up</p>",
    f"<article><p><a href=1>+{_LONG}</a></p><p><a href=1>+{_MID}</a></p><h2><a href=1>+{_MID}</a></h2><p>+{_LONG}</p></article><ul><li><a href=1>{_MID}</a></li></ul>",
    "<main><p>+Up</p><p><a href=1>+Down</a></p></main>",
    f"<div>+{_LONG}</div><div><a href=1>{_MID}</a></div><div><a href=1>{_MID}</a></div><div>+{_LONG}</div>",
    # containers whose names may mean something else: text and links of the whole of them tell
    f"<div class='market share'><p>+{_LONG}</p><p>+{_MID}</p><p>+{_SHORT}</p></div>",
    f"<main><div class='social-policy report'><h2>+Vote</h2><p>+{_LONG}</p><p>+{_MID}</p><p>+{_LONG}</p></div></main>",
    f"<article><div class='alert-fatigue study'><p>+{_LONG}</p><p>+{_MID}</p></div><div class='share-it now'>{_LINKS}</div></article>",
    f"<article><p>+{_LONG}</p><div class='social-stuff'><a href=1>Share</a> <a href=2>Send</a></div><p>+{_MID}</p></article>",
    f"<div class='header-story'><h1>+Flood</h1><p>+{_LONG}</p><p>+{_LONG}</p></div><div class='related-stuff'>{_LINKS}</div>",
    f"<article><p>+{_MID}</p><div class='promo-xyz'><a href=1>{_MID}</a></div><div class='login-here'><a href=1>Log in</a></div><p>+{_LONG}</p></article>",
    f"<div class='layout has-sidebar'><article><h1>+Up</h1><p>+{_LONG}</p><p>+{_SHORT}</p></article><div class='sidebar sticky'><p>{_LONG}</p><p>{_MID}</p></div></div>",
    f"<div class='social share'><p>{_MID}</p></div><article><p>+{_LONG}</p></article><div class='promo banner'><p>{_LONG}</p></div><div class=copyright>{_SHORT}</div>",
    f"<div class=header><p>{_LONG}</p></div><div class=content><h1>+Vote</h1><p>+{_LONG}</p><p>+{_MID}</p></div><div class=footer><p>{_LONG}</p><p>{_MID}</p></div>",
    f"<aside><h3>Flood</h3><p>{_LONG}</p><p>{_MID}</p></aside><main><h1>+Bridge</h1><p>+{_LONG}</p></main>",
    f"<article><h2>+Two</h2><p>+{_LONG}</p><table><tr><td>+One</td><td>+Two</td></tr></table><blockquote>+{_MID}</blockquote><pre>+{_SHORT}</pre></article>",
    f"<section id=disqus><h3>Vote</h3><article><p>{_MID}</p><p>{_LONG}</p></article></section><article><p>+{_LONG}</p></article>",
    f"<form><p>Mail</p><p>{_LONG}</p></form><article><p>+{_MID}</p><p>+{_MID}</p></article><dialog><p>{_LONG}</p></dialog>",
]


def table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    rows = [(features, int(text.startswith("+"))) for page in LABELLED for text, features in blocks(page)]
    return np.array([x for x, _ in rows], np.float64), np.array([y for _, y in rows])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A tree: (label,) at a leaf, else (feature, bound, tree for <= bound, tree for > bound)."""
    if depth == 0 or len(set(y)) < 2:
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, float(bound), low
    if best is None:
        return (int(y.mean() >= 0.5),)
    _, f, bound, low = best
    return f, bound, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


_TREE: list[tuple] = []


def is_main(features: list[float]) -> bool:
    if not _TREE:
        _TREE.append(grow(*table()))
    t = _TREE[0]
    while len(t) > 1:
        t = t[2] if features[t[0]] <= t[1] else t[3]
    return bool(t[0])


def main_text(page: str | None) -> str:
    """Main blocks of a page, one to a line; empty for null, empty and text-free pages."""
    return "\n".join(text for text, features in blocks(page or "") if is_main(features))


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Null and empty html give an empty text; repeated rows come back as often; other columns are not
    looked at.  Broken markup is read as far as it goes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    # ids go as text: beside nulls pandas would make them floats
    own = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = own.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
