"""Main text of web captures by composite text density."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import short_batches

# Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
# never part of the main text
BOILERPLATE = set(
    "head script style noscript template nav header footer aside button select textarea input option iframe object embed "
    "svg canvas audio video map menu dialog title".split()
)
# words in class, id or role that mark what is around the text
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget banner "
    "complementary contentinfo alert dialog".split()
)
# words that only say which one, where or how many, so they leave a mark beside them as it is
NEUTRAL = set(
    "area bar block body bottom box button buttons col column container content form group icon icons inner item items left link links list "
    "main outer page post posts primary right row secondary section signup site slot top unit user users wrap wrapper".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# an open element of this name ends when one of these begins
CLOSES = {
    "p": set(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
        "header hgroup hr main menu nav ol p pre search section summary table ul".split()
    ),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
CLOSERS = set().union(*CLOSES.values())
# an open list item, cell or paragraph outside the nearest of these stays open
FENCES = set("ul ol dl table td th article aside section main body div blockquote nav header footer".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only behind an equals sign
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>",
    re.S,
)
# a name and its value, which is read over as a whole, so that nothing inside it is taken for a name
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+))?+")
_MARK_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])\d+")
_SPACE = re.compile(r"\s+")
# the end of a sentence, also of scripts without spaces
_SENTENCE = re.compile(r"[.!?…。！？؟।][\"'”’»)\]]*(?:\s|$)")
SENTENCE_WORDS = 4


@dataclass(slots=True, eq=False)
class Node:
    """An element with the characters and tags below it, of which links hold some."""

    name: str
    parent: Node | None = None
    dropped: bool = False
    # the mark, or form, for which the element is left out unless it holds the text
    doubt: str = ""
    parts: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    sum: float = 0.0

    @property
    def out(self) -> bool:
        return self.dropped or self.doubt != ""


def extract_main_text(captures: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The article of each web capture, as blocks in page order joined by line feeds.

    General: the call records of this library hold no web pages. The whole page
    becomes a tree of elements. Every element has a density: characters per tag,
    adjusted down by the share of characters and tags in links. The sum of the
    densities of an element's children marks the element that holds the text; the
    threshold is the least density on the path from that element up to the body.
    The text is the topmost element on the path with a heading or with another child as dense as the threshold. Elements
    that can't be text (menus, headers, footers, sidebars, scripts, hidden ones) have no density. Neither have forms and
    elements with a class, id or role that only says what is around a text (`ad-box`, `cookie-notice`, `comment-list`, not
    `has-sidebar`), unless they hold the page's `main` element or `h1`, or nothing else on the page reads as text.

    Returns `key`, `url` and text ('' if there is none). Other columns are not
    read. Null or empty html gives ''. An empty table gives an empty result.
    """
    rows = short_batches(captures).select(F.col(key), F.col(url), F.col(html).alias("_html"))

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    extract.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.select(key, url, F.arrow_udf(extract, "string")(F.col("_html")).alias("text"))


def main_text(page: str) -> str:
    body = parse(page)
    clear_doubts(body)
    measure(body)
    return "\n".join(blocks(main_element(body)))


def parse(page: str) -> Node:
    """The tree of a page. Missing end tags are supplied, stray ones passed over."""
    root = node = Node("body")
    at, end = 0, len(page)
    last, comment = page.rfind(">"), page.rfind("<!--")
    opened: Counter[str] = Counter()
    while at < end:
        # no tag ends behind the last bracket
        token = _TOKEN.search(page, at) if at <= max(last, comment) else None
        if token is None:
            node.parts.append(page[at:])
            break
        if token.start() > at:
            node.parts.append(page[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            if opened[name]:
                node = close(node, name)
            continue
        if name in ("html", "body"):
            node = node.parent if node.name == "head" else node
            continue
        if name in CLOSERS:
            node = imply_ends(node, name)
        child = Node(name, node, node.dropped or name in BOILERPLATE)
        if not child.dropped:
            child.dropped, child.doubt = judge(name, token[3])
        node.parts.append(child)
        if name in RAW:
            # its content is no markup: it ends at its own end tag only
            closing = re.compile(rf"</{re.escape(name)}\s*/?\s*>", re.I).search(page, at)
            if not child.dropped:
                child.parts.append(page[at : closing.start() if closing else end])
            at = closing.end() if closing else end
        elif name not in VOID and not token[3].endswith("/"):
            node = child
            opened[name] += 1
    return root


def close(node: Node, name: str) -> Node:
    """The element that is open after an end tag."""
    found = node
    while found.parent is not None and found.name != name:
        # an end tag of an inline element does not end the blocks around it
        if name in INLINE and found.name not in INLINE:
            return node
        found = found.parent
    return found.parent if found.parent is not None else node


def imply_ends(node: Node, name: str) -> Node:
    """Ends open elements that can't hold a new one, with what is open inside them."""
    found = node
    while found.parent is not None and found.name not in FENCES:
        if name in CLOSES.get(found.name, ()):
            node = found.parent
        found = found.parent
    if found.parent is not None and found.name in ("td", "th") and name in CLOSES[found.name]:
        return imply_ends(found.parent, name)
    return node


def judge(name: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is hidden, and the mark, or form, that speaks against its text."""
    given: dict[str, str] = {}
    for attribute, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        # of two attributes with one name the first counts
        given.setdefault(attribute.lower(), entities.unescape(value.strip(value[:1]) if value[:1] in ("'", '"') else value).lower())
    if "hidden" in given or given.get("aria-hidden", "").strip() == "true":
        return True, ""
    if name not in ("main", "body"):
        for attribute in ("class", "id", "role"):
            for token in given.get(attribute, "").split():
                parts = {p for p in _MARK_PARTS.split(token) if p and not p.isdigit()}
                # one word of another kind makes it a name for something else: no-header, ad-free, page-with-menu
                if parts & MARKS and parts <= MARKS | NEUTRAL:
                    return False, token
    return False, "form" if name == "form" else ""


def clear_doubts(body: Node) -> None:
    """Keeps doubted elements that are around the page: those with its `main` element or `h1`.

    If nothing else on the page reads as text, the one with the largest density sum is kept too, with the doubted ones around it
    from the outermost on until something does, and with others of the same name and mark.
    """
    doubted, todo = [], [body]
    while todo:
        node = todo.pop()
        if node.doubt:
            doubted.append(node)
        if node.name in ("main", "h1"):
            around = node.parent
            while around is not None:
                around.doubt = ""
                around = around.parent
        todo.extend(p for p in node.parts if isinstance(p, Node) and not p.dropped)
    doubted = [n for n in doubted if n.doubt]
    if not doubted or reads(body):
        return
    held = {}
    for top in doubted:
        measure(top)
        held[top] = max(densest(top).sum, top.density)
    around, node = [], max(doubted, key=held.__getitem__)
    while node is not None:
        if node.doubt:
            around.append(node)
        node = node.parent
    kept = set()
    for node in reversed(around):
        # another form is another form, but what bears one mark is of one kind
        if node.doubt != "form":
            kept.add((node.name, node.doubt))
        node.doubt = ""
        if reads(body):
            break
    for node in doubted:
        if (node.name, node.doubt) in kept:
            node.doubt = ""


def reads(body: Node) -> bool:
    """Whether a block outside doubted elements reads as text: a sentence of some words."""
    return any(_SENTENCE.search(b) and len(b.split()) >= SENTENCE_WORDS for b in blocks(body))


def measure(top: Node) -> None:
    """Densities of an element and all below it, from the leaves up."""
    order, todo = [], [top]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if isinstance(p, Node) and not p.out)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.sum = 0.0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.out:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.name == "a")
                node.sum += part.density
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        # characters per tag; the more of both lies in links, the less it counts
        plain = 1 - node.link_chars / max(1, node.chars)
        node.density = node.chars / max(1, node.tags) * plain * (1 - node.link_tags / max(1, node.tags + 1))


def densest(top: Node) -> Node:
    """The element with the largest sum."""
    best, todo = top, [top]
    while todo:
        node = todo.pop()
        if node.sum > best.sum:
            best = node
        todo.extend(p for p in node.parts if isinstance(p, Node) and not p.out)
    return best


def main_element(body: Node) -> Node:
    """The element with the largest sum, widened along its path to the body by the path's threshold."""
    best = densest(body)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for node in reversed(path):
        others = [p for p in node.parts if isinstance(p, Node) and not p.out and p not in path]
        heading = node.parent is not None and any(p.name in HEADINGS and p.chars for p in others)
        if node is best or heading or any(p.chars and p.density >= threshold and p.name not in INLINE for p in others):
            return node
    return best


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below an element, white space folded; inline elements do not end a block."""
    found, current = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(current))).strip()
        current.clear()
        if text:
            found.append(text)

    todo: list = [top]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            current.append(part)
        elif not part.out:
            if part.name == "br":
                current.append("\n")
            block = part.name not in INLINE
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(part.parts))
    flush()
    return found
