"""HTML extraction by tree scoring.

A tolerant tag scanner builds an element tree (unclosed p, li, td and the like end where HTML ends them). Elements that
are never article text (scripts, forms, nav, footer, ...) and elements whose class, id or role names a menu, advert,
notice, sidebar or comment section fall away first. A class or id doesn't count against an element that holds an article
or main element of some size, nor against elements of one name that hold most of the page's unlinked text, unless an
article stands beside them; if nothing is left, no class or id counts. Each paragraph then passes points for its length and its commas
to its ancestors, halved after the parent and falling with the distance; each ancestor's points are discounted by its link density. The container
with most points stays together with those siblings that score near it or read like running text; their blocks, in
page order, are the result.

Null and empty pages give an empty text; a page without any container gives the text of what is left of its body. Of
containers of equal points the one met first in the walk of the tree stays, the same in every run. Pages of any length
are read whole, and the tree is walked without recursion. An unclosed script, style or the like ends
with the page, as in browsers; an unclosed drawing, formula, object, template or noscript is left out by its tag alone.
Repeated rows give repeated results; columns beyond page_id, url and html are ignored.
Character references are decoded, white space inside a block becomes one space, blocks are joined by two line feeds.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|["'])*+)>|<[!?][^>]*+>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden|itemprop)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""", re.I)
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object".split())
#: Of those, the ones whose content is markup: without an end tag they don't swallow the page.
_MARKUP = frozenset("noscript template svg math object".split())
#: Never article text.
DROP = RAW | frozenset("head nav footer aside form button select option input label fieldset dialog menu canvas audio video map applet".split())
BLOCK = frozenset("html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header hgroup details summary center hr".split())
#: An opening tag ends the open elements on the right, up to the nearest of the stops.
_ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "figcaption"}
_ITEM = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
_SCOPE = frozenset("td th table article section main div body aside footer nav header li blockquote".split())
_UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|site-header|page-header|topbar|toolbar|cookies?|consent|gdpr|notice|popup|pop-up|modal|overlay|subscribe|newsletter|signup|login|social|share|sharing|shares|related|recommend\w*|comments?|comment-list|disqus|replies|respond|pagination|pager|skip-link|legal|copyright|widget|outbrain|taboola|alert)(?=$|[\s_-])", re.I)
#: Says what an element has, not what it is.
_STATE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[-_]\S*", re.I)
#: Unlinked characters of an article beside which an element that holds most of a page may be dropped for its name.
LEAST_ARTICLE = 250
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-content|entry-content|post-body|story|main|content|hentry|blog-post)(?=$|[\s_-])", re.I)
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TEXTUAL = frozenset("p pre td blockquote li dd".split())
COMMA = re.compile("[,،、，]")


class Node:
    __slots__ = ("tag", "kids", "parent", "attrs", "score", "chars", "links")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list = []
        self.score = 0.0
        self.chars = self.links = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)}


def unwanted(node: Node) -> bool:
    """Whether the element's tag or role, or being hidden, tells that it is no part of an article."""
    if node.tag in DROP:
        return True
    if not node.attrs:
        return False
    at = _attributes(node.attrs)
    if "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I):
        return True
    return at.get("role", "").lower() in _ROLE


def _names(node: Node) -> tuple[str, bool]:
    """The unlikely word in an element's class and id, or an empty text, and whether a likely one stands there."""
    if not node.attrs:
        return "", False
    at = _attributes(node.attrs)
    names = _STATE.sub("", f"{at.get('class', '')} {at.get('id', '')}")
    m = _UNLIKELY.search(names)
    return m[0].strip(" \t\r\n\f_-").lower() if m else "", bool(_LIKELY.search(names)) or at.get("itemprop") == "articleBody"


def parse(page: str) -> Node:
    """The element tree; strings among the children are text with references decoded."""
    root = top = Node("#root", None)
    at, end = 0, len(page)
    unclosed: set[str] = set()  # raw elements that have no end tag further on
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            top.kids.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                # a stray end tag of inline markup doesn't end the block it stands in
                if tag not in BLOCK and tag not in DROP and node.tag in BLOCK:
                    node = root
                    break
                node = node.parent
            if node is not root:
                top = node.parent
            elif tag == "p":
                top.kids.append(Node("p", top))
            continue
        if tag in _ENDS_P:
            node = top
            while node.tag not in _SCOPE and node is not root:
                if node.tag == "p":
                    top = node.parent
                    break
                node = node.parent
        if tag in _ITEM:
            closes, stops = _ITEM[tag]
            node = top
            while node is not root and node.tag not in stops:
                if node.tag in closes:
                    top = node.parent
                node = node.parent
        new = Node(tag, top, m[3])
        top.kids.append(new)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            if stop:
                at = stop.end()
            else:
                unclosed.add(tag)
                at = at if tag in _MARKUP else end
            continue
        top = new
    return root


def _prune(root: Node, by_name: bool = True) -> None:
    """Drops unwanted elements and counts the characters and the linked characters of the others."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        node.kids = [k for k in node.kids if isinstance(k, str) or not unwanted(k)]
        # the header of a page goes, that of an article has its title
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag != "header" or _inside(k, ("article", "main"))]
        stack += [k for k in node.kids if not isinstance(k, str)]
    _count(order)
    if by_name and (out := _misnamed(root, order)):
        for node in order:
            node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in out]
        _count(order)


def _count(order: list[Node]) -> None:
    for node in reversed(order):
        node.chars = node.links = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(k.strip())
            else:
                node.chars += k.chars
                node.links += k.links
        if node.tag == "a":
            node.links = node.chars


def _misnamed(root: Node, order: list[Node]) -> set[int]:
    """Ids of the elements to drop for their class or id. order has parents before children."""
    named = {id(n): _names(n) for n in order}
    plain = lambda n: n.chars - n.links
    # articles that aren't themselves called a comment or the like
    cores = [n for n in order if n.tag in ("article", "main") and not (named[id(n)][0] and not named[id(n)][1])]
    least = 0.2 * max(map(plain, cores), default=0)
    holders: set[int] = set()
    for n in cores:
        up = n.parent if plain(n) >= least else None
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent
    by_word: dict[str, list[Node]] = {}
    beside: list[Node] = []
    stack = [root]
    while stack:
        for k in stack.pop().kids:
            if isinstance(k, str):
                continue
            word, likely = named[id(k)]
            if word and not likely and k.tag not in ("html", "body", "article", "main") and id(k) not in holders:
                by_word.setdefault(word, []).append(k)
                continue
            if not word and (likely or k.tag in ("article", "main")):
                beside.append(k)
            stack.append(k)
    out = {id(n) for nodes in by_word.values() for n in nodes}
    left: dict[int, int] = {}
    for n in reversed(order):
        left[id(n)] = 0 if id(n) in out else plain(n) - sum(plain(k) - left[id(k)] for k in n.kids if not isinstance(k, str))
    for nodes in by_word.values():
        text = sum(map(plain, nodes))
        # text that most of the page consists of may go only beside an article of some size
        if 2 * text > plain(root) and not any(left[id(n)] >= max(LEAST_ARTICLE, 0.2 * text) for n in beside):
            out -= {id(n) for n in nodes}
    return out


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.tag in tags:
            return True
    return False


def _own_text(node: Node) -> str:
    """The text of a node and of its inline descendants."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        for k in reversed(n.kids) if n is node else n.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in BLOCK:
                stack.append(k)
    return " ".join(out)


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def best_container(root: Node) -> list[Node]:
    """The container of most points and the siblings kept with it, in page order."""
    met: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        stack += [k for k in node.kids if not isinstance(k, str)]
        text = _own_text(node) if node.tag in _TEXTUAL or node.tag in ("div", "section", "article", "main", "body") else ""
        text = text.strip()
        if len(text) < 25:
            continue
        points = 1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)
        # text that stands in a container itself is a paragraph of that container
        up, level = (node.parent if node.tag in _TEXTUAL else node), 0
        while up is not None and up.tag != "#root" and level < 5:
            if up.tag in BLOCK:
                if not up.score:
                    met.append(up)
                up.score += points if level == 0 else points / 2 if level == 1 else points / (level * 3)
                level += 1
            up = up.parent
    # an article or main element is told by its name, even if its text is short
    stack = [root]
    while stack:
        node = stack.pop()
        stack += [k for k in node.kids if not isinstance(k, str)]
        if node.chars and (node.tag in ("article", "main") or node.attrs and _LIKELY.search(" ".join(_attributes(node.attrs).get(k, "") for k in ("class", "id", "itemprop")))):
            if not node.score:
                met.append(node)
            node.score += 25
    if not met:
        return [root]
    final = {id(n): n.score * (1 - density(n)) for n in met}
    best = max(met, key=lambda n: final[id(n)])
    while best.parent is not None and best.parent.tag in ("p", "li", "td", "tr", "tbody", "ul", "ol", "table", "blockquote", "pre") and best.parent.tag != "#root":
        best = best.parent
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least, kept = max(10.0, 0.2 * final[id(best)]), []
    for k in best.parent.kids:
        if isinstance(k, str):
            continue
        text = _own_text(k) if k.tag in ("p", "pre", "blockquote") else ""
        # several articles or parts of one page stay together
        peer = k.tag == best.tag and k.tag in ("article", "main") and final.get(id(k), 0) >= 0.2 * final[id(best)]
        if k is best or peer or final.get(id(k), 0) >= least or k.tag in ("h1", "h2", "h3") and k.chars or text and density(k) < 0.25 and (len(text) > 80 or re.search(r"[.!?](?:\s|$)", text)):
            kept.append(k)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order; inline elements don't break a block."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [top]
        while stack:
            node = stack.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                now.append(node)
            elif node.tag == "br":
                now.append(" ")
            else:
                if node.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(node.kids))
        flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    for by_name in (True, False):
        root = parse(page)
        _prune(root, by_name)
        text = "\n\n".join(blocks(best_container(root)))
        if text:
            return text
    return ""


def _run(batches):
    for batch in batches:
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, RESULT)
