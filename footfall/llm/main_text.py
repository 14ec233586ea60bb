"""Main text of web pages by scoring the tree.

Paragraphs pass points for their length and commas to their ancestors, less
where the text is links. The container with the most points is the article;
siblings that look like parts of it are kept with it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML standard by their role in a page.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "nav footer aside form button select option textarea input label fieldset iframe object embed "
    "applet audio video canvas map menu dialog head title noscript template svg math".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar tablist".split()
)
# Words of class and id names that mark what is not the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo "
    "promotion nav navbar navigation menu submenu breadcrumb breadcrumbs pager pagination sidebar "
    "sidenav rail aside footer header masthead topbar toolbar notice cookie cookies consent gdpr "
    "popup modal overlay alert disclaimer newsletter subscribe subscription signup login share "
    "sharing social comment comments commentlist disqus respond reply replies discussion feedback "
    "reviews related recommended recommendations widget search form copyright legal outbrain taboola "
    "skip hidden".split()
)
LIKELY = frozenset(
    "article body content entry hentry main page post text blog story column".split()
)

# Of the marks, those of other people's text; words that say what else
# a page has; elements that may also wrap a whole page.
TALK = frozenset(
    "comment comments commentlist disqus respond reply replies discussion feedback reviews".split()
)
STATES = frozenset("has no with without".split())
WRAPPERS = frozenset("form fieldset".split())
# Words of a heading that announces what a text rests on.
SOURCES = frozenset(
    "source sources reference references note notes footnotes citations bibliography literature "
    "quellen literatur fuentes referencias références".split()
)
SHORT = 250

# A quote opens a value only behind an equals sign. As the last character looked at
# is '>', an open tag always ends, so every character is read a bounded number of times.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style)\b(?:.*?</\1\s*>|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>"
    r"|<[!?/][^>]*>"
    r"|[^<]+|<",
    re.S | re.I,
)
_OPEN_END = re.compile(r"<[a-zA-Z/!?]")
# Levels up to which points fade with the distance; beyond, they count as at it.
FADING = 256
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_NAME_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SENTENCE_END = re.compile(r"[.!?…。！？]['\")\]»”]*$")

# Every block closes an open paragraph.
_PARAGRAPH = ({"p"}, {"td", "th", "table", "button"})
# Elements that a new element of the same kind closes, up to a boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table", "div", "body"}),
}


class _Node:
    __slots__ = (
        "tag", "parent", "children", "dropped", "bonus", "block", "chars", "links", "score", "order",
        "anchors", "home", "far",
    )

    def __init__(self, tag: str, parent: _Node | None, order: int):
        self.tag = tag
        self.parent = parent
        self.children: list[_Node | str] = []
        self.dropped = False
        self.bonus = 0.0
        self.block = tag in BLOCK
        self.chars = self.links = self.anchors = 0
        self.score = self.far = 0.0
        self.order = order
        # The nearest block that holds the node, or the node.
        self.home: _Node = self if self.block or parent is None else parent.home


def _judge(
    node: _Node, attributes: str, inside_article: bool, marks: frozenset[str], wrappers: bool
) -> None:
    """Marks what can be told from the element itself.

    `marks` are the words of names that drop an element. A class name that is such a
    word drops; one that only holds it does unless another name is likely. Names
    like has-sidebar tell of other elements. Forms stay with `wrappers`.
    """
    tag = node.tag
    if tag in DROPPED and not (wrappers and tag in WRAPPERS) or (tag == "header" and not inside_article):
        node.dropped = True
        return
    if tag in ("article", "main"):
        node.bonus += 25.0
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return
    parts: set[str] = set()
    found: set[str] = set()
    bare = likely = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for word in value.split():
                pieces = set(_NAME_PART.findall(word))
                if pieces & STATES:
                    continue
                parts |= pieces
                if pieces & marks:
                    found |= pieces & marks
                    bare = bare or word in marks
                elif pieces & LIKELY:
                    likely = True
        elif name == "role" and value in DROPPED_ROLES:
            node.dropped = True
        elif name == "role" and value in ("article", "main"):
            node.bonus += 25.0
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            node.dropped = True
        elif name == "style" and _HIDDEN.search(value):
            node.dropped = True
    if tag in ("body", "html", "article", "main"):
        return
    if found and not (inside_article and found <= {"header"}):
        only_header = found <= {"header"} and parts & LIKELY
        if not only_header and (bare or not likely):
            node.dropped = True
    elif parts & LIKELY:
        node.bonus += 15.0


def parse(html: str, marks: frozenset[str] = UNLIKELY, wrappers: bool = False) -> _Node:
    """Element tree of a page; unclosed and stray tags are mended simply.

    A tag that the page ends in is no text. The depths at which each kind of element
    is open are kept, so closing one looks at no other ancestors.
    """
    root = here = _Node("html", None, 0)
    order = articles = 0
    path = [root]
    opened_at: dict[str, list[int]] = {}
    blocks = [0]
    end = html.rfind(">") + 1
    rest = html[end:]
    opened = _OPEN_END.search(rest)

    def deepest(kinds) -> int:
        return max((opened_at[k][-1] for k in kinds if opened_at.get(k)), default=0)

    def close(level: int) -> None:
        nonlocal articles, here
        while len(path) > level:
            node = path.pop()
            opened_at[node.tag].pop()
            articles -= node.tag == "article"
            if node.block:
                blocks.pop()
        here = path[-1]

    for token in _TOKEN.finditer(html, 0, end):
        tag = token.group(3)
        if tag is None:
            text = token.group()
            if text[0] != "<" or text == "<":
                here.children.append(text)
            continue
        tag = tag.lower()
        if token.group(2):
            level = deepest((tag,))
            # An inline end tag does not reach out of its block.
            if level and (tag in BLOCK or blocks[-1] < level):
                close(level)
            continue
        if tag in ("html", "body"):
            continue
        for rule in (_PARAGRAPH if tag in BLOCK else None, _CLOSES.get(tag)):
            if rule is None:
                continue
            level = deepest(rule[0])
            if level and level > deepest(rule[1]):
                close(level)
        order += 1
        node = _Node(tag, here, order)
        _judge(node, token.group(4), articles > 0, marks, wrappers)
        here.children.append(node)
        if tag in VOID or token.group(4).endswith("/") and tag in ("svg", "path", "use"):
            continue
        articles += tag == "article"
        opened_at.setdefault(tag, []).append(len(path))
        if node.block:
            blocks.append(len(path))
        path.append(node)
        here = node
    here.children.append(rest[: opened.start()] if opened else rest)
    return root


def _blocks(node: _Node) -> list[tuple[_Node, str, int]]:
    """(containing block, text, characters inside links) of a subtree, in page order."""
    found: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    linked = 0

    def close(owner: _Node) -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append((owner, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    owner = node
    stack: list[tuple[_Node, int, int]] = [(node, 0, 0)]
    while stack:
        current, at, depth = stack.pop()
        if at == 0 and current.block and current is not node:
            close(owner)
            owner = current
        if at < len(current.children):
            stack.append((current, at + 1, depth))
            child = current.children[at]
            if isinstance(child, str):
                pieces.append(child)
                if depth:
                    linked += len(" ".join(child.split()))
            elif not child.dropped:
                if child.tag == "br":
                    pieces.append(" ")
                else:
                    stack.append((child, 0, depth + (child.tag == "a")))
        elif current.block and current is not node:
            close(owner)
            owner = current.parent.home
    close(owner)
    return found


def _ancestors(node: _Node):
    while node.parent is not None:
        node = node.parent
        yield node


def _nodes(root: _Node) -> list[_Node]:
    """All elements, parents before their children."""
    out = [root]
    for node in out:
        out.extend(child for child in node.children if not isinstance(child, str))
    return out


def _density(node: _Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _score(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[_Node]:
    """Adds up sizes and points; returns the candidate containers.

    Sizes, and points that come from more than `FADING` levels below, are carried
    from children to parents once.
    """
    candidates: dict[int, _Node] = {}
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.links += linked
        owner.anchors += bool(linked)
        if owner.tag in HEADINGS:
            continue
        points = 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3.0)
        points *= 1.0 - linked / len(text)
        # Text of a plain division stands in it; a paragraph's points go up.
        holder = owner if owner.tag in ("div", "section", "article", "main", "html") else owner.parent
        node, level = holder, 0
        while node is not None and level < FADING:
            node.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            candidates.setdefault(node.order, node)
            node, level = node.parent, level + 1
        if node is not None:
            node.far += points
    for node in reversed(nodes):
        if node.far:
            node.score += node.far / (3 * FADING)
            candidates.setdefault(node.order, node)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.anchors += node.anchors
            node.parent.far += node.far
    return list(candidates.values())


_LISTS = frozenset("ul ol dl table div section".split())


def main_text(html: str | None) -> str:
    """The article of a page: its blocks, joined by two line breaks.

    Null, empty and text-free pages give the empty text. Lists and divisions that are
    mostly links stay between paragraphs of the article, around sentences, and
    under headings that announce sources. Where little is left beside
    what names or forms have dropped, the page is read again: with the marks of
    other people's text alone, and if there still is no text, without any. The
    text is then taken if it is four times as long as a short one or ten times as
    long as any other.
    """
    if not html:
        return ""
    text, dropped = _read(html, UNLIKELY, False)
    if not dropped:
        return text
    for marks in (TALK, frozenset()):
        other, _ = _read(html, marks, True)
        if other and len(other) >= (4 if len(text) < SHORT else 10) * len(text):
            return other
        if text:
            break
    return text


def _droppable(nodes: list[_Node]) -> bool:
    """Whether names or wrapping elements have dropped something with text of its own."""
    return any(n.dropped and n.children and (n.tag not in DROPPED or n.tag in WRAPPERS) for n in nodes)


def _read(html: str, marks: frozenset[str], wrappers: bool) -> tuple[str, bool]:
    """The article under the given marks, and whether others could change it."""
    root = parse(html, marks, wrappers)
    nodes = _nodes(root)
    return _article(root, nodes), _droppable(nodes)


def _article(root: _Node, nodes: list[_Node]) -> str:
    blocks = _blocks(root)
    candidates = _score(nodes, blocks)
    if not candidates:
        return "\n\n".join(text for owner, text, _ in blocks if owner.tag in HEADINGS)
    worth = {n.order: (n.score + (n.bonus if n.score else 0.0)) * (1.0 - _density(n)) for n in candidates}
    best = max(candidates, key=lambda n: (worth[n.order], -n.order))
    top = worth[best.order]
    for node in _ancestors(best):
        if node.tag in ("article", "main") or (node.parent is not None and node.bonus >= 15.0):
            best = node
    keep = {best.order}
    if best.parent is not None and best.tag not in ("article", "main"):
        for sibling in best.parent.children:
            if isinstance(sibling, str) or sibling.dropped or not sibling.chars:
                continue
            length, density = sibling.chars, _density(sibling)
            if sibling.tag in HEADINGS:
                good = density < 0.25
            elif sibling.tag in ("p", "pre", "blockquote"):
                good = density < 0.25
            else:
                good = worth.get(sibling.order, 0.0) >= max(5.0, 0.2 * top) and density < 0.5
            if good and length:
                keep.add(sibling.order)
    elif best.tag == "article" and best.parent is not None:
        for sibling in best.parent.children:
            if (
                not isinstance(sibling, str)
                and not sibling.dropped
                and sibling.tag == "article"
                and worth.get(sibling.order, 0.0) >= 0.2 * top
            ):
                keep.add(sibling.order)

    def menu(node: _Node) -> bool:
        return node.tag in _LISTS and node.anchors > 1 and _density(node) > 0.5

    # Of each node, whether it is part of the article, and the outermost part of it
    # that is mostly links and holds the node.
    inside: dict[int, bool] = {}
    links: dict[int, int | None] = {}
    for node in nodes:
        above = node.parent is not None and inside[node.parent.order]
        inside[node.order] = above or node.order in keep
        outer = links[node.parent.order] if above and node.order not in keep else None
        if outer is None and above and node.order not in keep and menu(node):
            outer = node.order
        links[node.order] = outer
    kept = _kept_links(
        [(owner, text, linked, links[owner.order]) for owner, text, linked in blocks if inside[owner.order]]
    )
    return "\n\n".join(
        text
        for owner, text, _ in blocks
        if inside[owner.order] and (links[owner.order] is None or links[owner.order] in kept)
    )


def _kept_links(blocks: list[tuple[_Node, str, int, int | None]]) -> set[int]:
    """Link-rich parts that belong to the article.

    Those that stand between its paragraphs, hold a sentence around their links, or
    follow a heading that announces sources. Others lead to other pages.
    """
    plain = [at for at, (owner, _, _, part) in enumerate(blocks) if part is None and owner.tag not in HEADINGS]
    kept: set[int] = set()
    sources = False
    for at, (owner, text, linked, part) in enumerate(blocks):
        if owner.tag in HEADINGS:
            words = re.findall(r"\w+", text.lower())
            sources = len(words) <= 4 and not SOURCES.isdisjoint(words)
        if part is None:
            continue
        between = plain and plain[0] < at < plain[-1]
        sentence = 0 < linked < len(text) and _SENTENCE_END.search(text)
        if between or sentence or sources:
            kept.add(part)
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """`page_id, url, text, n_chars` of every page.

    `pages` needs `page_id`, `url` and `html`; other columns are ignored, null ids
    and urls stay null, repeated rows each get a row and an empty table gives
    none. Null html is empty.
    """

    def read(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("CAST(page_id AS long) AS page_id", "url", "html").mapInArrow(
        read, "page_id long, url string, text string, n_chars long"
    )
