"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text: what isn't shown, scripts, styles, and the controls of forms.
NEVER = frozenset("head script style title noscript template button select option textarea input iframe object embed svg math canvas audio video map noembed noframes xmp".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: A start tag ends an open element of these names, unless one of the barriers was opened since.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Roles and words of a class or id that name menus, headers, footers, sidebars, notices, adverts, forms and comments.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs "
    "comment comments reply replies disqus respond discussion share sharing social related recommended newsletter subscribe subscription signup popup modal overlay footer foot copyright login search toolbar pagination pager masthead".split()
)
#: Words that say nothing beside a noise word: a name of these only is noise as a whole.
PLAIN_WORDS = frozenset("area bar block body box container content count form inner item left link links list main message outer panel reader right section site thread top user widget widgets wrap wrapper".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are text themselves, where others only hold some.
PARAGRAPHS = frozenset("p blockquote pre ul ol dl table figure".split())

#: Part of its density that a node with a noise name counts with.
PENALTY = 0.1
#: A name that could as well be a wrapper's is only believed of a node with less than this part of the page's unlinked text.
WRAPPER = 0.5
#: A block beside the heart that is no paragraph belongs to the article if its children's densities sum to this part of the heart's sum.
KIN = 0.2

_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: What a name says of a node: nothing; a header; perhaps noise, or only in a part of it; noise; noise and never a wrapper; not shown.
NO, HEADER, MAYBE, YES, SURE, NEVER_TEXT = range(6)

NOISE_TAGS = {"nav": SURE, "menu": SURE, "footer": SURE, "header": HEADER, "aside": MAYBE, "form": MAYBE, "dialog": MAYBE}


class Node:
    __slots__ = ("tag", "up", "parts", "named", "noise", "block", "scopes", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, named: int = NO):
        self.tag, self.up, self.named, self.noise = tag, up, named, False
        self.parts: list[Node | str] = []
        self.block: Node = self if tag not in INLINE or up is None else up.block  # the nearest element that is no inline one
        self.scopes: dict[str, Node | None] = up.scopes if up else {}
        if tag in _SCOPED:
            self.scopes = {name: None if tag in barriers else self.scopes.get(name) or (self if tag in names else None) for name, (names, barriers) in ENDS.items()}
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


_SCOPED = frozenset(x for names, barriers in ENDS.values() for x in names | barriers)


def _named(tag: str, attributes: str) -> int:
    if tag in NEVER:
        return NEVER_TEXT
    found = NOISE_TAGS.get(tag, NO)
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return NEVER_TEXT
        if name in ("class", "id"):
            for one in value.split():
                words = _WORD.findall(_CAMEL.sub(" ", one).lower())
                if NOISE_WORDS.intersection(words):
                    found = max(found, YES if NOISE_WORDS.union(PLAIN_WORDS).issuperset(words) else MAYBE)
                elif "header" in words and PLAIN_WORDS.issuperset({*words} - {"header", "page"}):
                    found = max(found, HEADER)
        elif name == "role" and value.lower() in NOISE_ROLES:
            found = max(found, YES)
    return MAYBE if tag in ARTICLE and found == YES else found


def parse(page: str) -> Node:
    """The page's elements below one root.

    Elements that end implicitly are ended, markup without a name is skipped,
    an end tag without an open element of its name ends nothing, and an inline
    element is not ended from within another block. Every tag takes constant
    time, apart from the elements that it ends. What a script, style, title or
    textarea holds runs to its end tag, and without one to the end of the page,
    as in browsers.
    """
    root = at = Node("#root", None)
    opened: dict[str, list[Node]] = defaultdict(list)
    place, size = 0, len(page)

    def close(node: Node) -> Node:
        """Close all that is open down to the node; what it stands in."""
        here = at
        while here is not node.up:
            opened[here.tag].pop()
            here = here.up
        return here

    while place < size:
        found = _MARKUP.search(page, place)
        if not found:
            rest = page[place:]
            cut = re.search(r"<[/!?a-zA-Z][^>]*$", rest)  # a tag that the page's end cut off
            at.parts.append(rest[: cut.start()] if cut else rest)
            break
        if found.start() > place:
            at.parts.append(page[place : found.start()])
        place = found.end()
        ends, tag, attributes = found[1] or found[4], (found[2] or found[5] or "").lower(), found[3] or found[6] or ""
        if not tag:
            continue
        if ends:
            if opened[tag]:
                node = opened[tag][-1]
                if tag not in INLINE or node.block is at.block:
                    at = close(node)
            elif tag == "p":
                at.parts.append(Node("p", at))
            continue
        if tag in ENDS_P:
            if at.block.tag == "p":
                at = close(at.block)
        elif tag in ENDS:
            if at.scopes.get(tag):
                at = close(at.scopes[tag])
        if (tag in ARTICLE or tag == "body") and opened["head"]:
            at = close(opened["head"][0])  # a head that was never ended
        if tag in ("html", "body"):
            continue  # all is body but for the head, which is never text
        node = Node(tag, at, _named(tag, attributes))
        at.parts.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, place)
            place = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
            opened[tag].append(node)
    return root


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out  # in page order, so every node after its parent


def _count(root: Node) -> list[Node]:
    """Take out what is never text; characters and tags of every node, and how many of them belong to links."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.parts = [" " if isinstance(p, Node) and p.named == NEVER_TEXT else p for p in node.parts]
        stack += [p for p in node.parts if isinstance(p, Node)]
    nodes = _order(root)
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return nodes


def _believe_names(nodes: list[Node]) -> None:
    """Decide which names are believed: a node is noise if it, or one around it, has a noise name that isn't a wrapper's.

    A header is noise only outside articles.
    """
    plain = lambda n: n.chars - n.link_chars
    whole = outside = plain(nodes[0])
    for node in nodes:  # first as if clear names were always believed
        node.noise = node.up is not None and (node.up.noise or node.up.named >= YES)
        if node.named >= YES and not node.noise:
            outside -= plain(node)
    within = set()
    for node in nodes:
        if node.tag in ARTICLE or id(node.up) in within:
            within.add(id(node))
        clear = node.named == SURE or node.named == YES and (outside > 0 or plain(node) < WRAPPER * whole)
        perhaps = (node.named == MAYBE or node.named == HEADER and id(node) not in within) and plain(node) < WRAPPER * whole
        node.noise = clear or perhaps or (node.up is not None and node.up.noise)


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters by tags, times the logarithm of characters by characters in links and tags by links, to a base that grows with the links' share in the node and in the page."""
    if not chars:
        return 0.0
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * math.log(max(ratio, 1.0)) / math.log(1 + base)


def _measure(nodes: list[Node]) -> float:
    """The composite density of every node, and the sum of its block children's, where noise counts less. Returns the links' share in the page."""
    root = nodes[0]
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        if node.up is not None and node.tag not in INLINE:
            node.up.total += node.density * (PENALTY if node.noise else 1.0)
    return share


def _texts(parts: list[Node | str], out: list[str]) -> None:
    stack: list[Node | str] = list(reversed(parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.noise:
            out.append("\n")
        elif part.tag in INLINE:
            stack.extend(reversed(part.parts))
        else:
            out.append("\n")
            stack.append("\n")
            stack.extend(reversed(part.parts))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space, white space within them as one space.

    1. Every node's density is measured. Names (elements, roles, classes, ids)
       choose nothing: a node that they call a menu, an advert, comments and
       the like adds PENALTY of its density to its parent's sum; a name that may
       be a wrapper's isn't believed of half the page. An article or main
       element counts as any other.
    2. The heart is the node, noise apart, with the largest sum of its block
       children's densities; of several, the first in page order.
    3. The least density on the heart's path to the body is the threshold. The
       heart's text is the article; beside the path, so are headings, paragraphs
       that reach the threshold, other blocks that reach it and whose own sum is
       KIN of the heart's at least, and the direct texts of nodes on the path
       (those of the body if they reach it), unless they are links mostly.
    Noise within all this is left out. A page of noise only has no text.
    """
    if not page:
        return ""
    root = parse(page)
    nodes = _count(root)
    _believe_names(nodes)
    share = _measure(nodes)
    place = {id(n): i for i, n in enumerate(nodes)}
    heart = max((n for n in nodes if not n.noise), key=lambda n: (n.total, -place[id(n)]))  # the root is never noise
    if not heart.total:
        heart = root
    path = [heart]
    while path[-1].up is not None:
        path.append(path[-1].up)
    around = {id(n) for n in path}
    threshold = min(n.density for n in path)
    out: list[str] = []
    stack: list[Node | list[Node | str]] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            _texts(node, out)
            out.append("\n")
        elif node is heart:
            stack.append(node.parts)
        elif id(node) in around:
            runs: list[Node | list[Node | str]] = []
            run: list[Node | str] = []
            for part in [*node.parts, None]:
                if isinstance(part, str) or part is not None and part.tag in INLINE and id(part) not in around:
                    run.append(part)
                    continue
                chars = sum(len("".join(p.split())) if isinstance(p, str) else p.chars for p in run)
                links = sum(p.link_chars for p in run if isinstance(p, Node))
                if 2 * links < chars and (node is not root or _density(chars, sum(isinstance(p, Node) for p in run), links, 0, share) >= threshold):
                    runs.append(run)
                run = []
                if part is None:
                    continue
                if id(part) in around:
                    runs.append(part)
                elif part.chars and not part.noise and 2 * part.link_chars < part.chars and (part.tag in HEADINGS or part.density >= threshold and (part.tag in PARAGRAPHS or part.total >= KIN * heart.total)):
                    runs.append([part])
            stack += reversed(runs)
    return " ".join(html.unescape("".join(out)).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    text is the main text of the whole html (see main_text), n_chars its code
    points. Null and empty html, and pages without text, give an empty text.
    Null ids and urls stay null, repeated rows are extracted each, an empty
    table gives no rows, other columns play no part. Pages of any length and
    depth take time in proportion to their length. Pages need no shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
