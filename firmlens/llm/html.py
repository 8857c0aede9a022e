"""Main text of web pages by tree scoring.

A page becomes a small tree. Each paragraph gives points for its length and commas to its
ancestors, fewer the farther up; an element's points are discounted by the share of its
text that stands in links. The best container is kept, with siblings that read like it.
What is never article text (menus, forms, scripts, adverts, comments ...) is cut before;
by its class or id only where the page's article does not stand inside it.

Pages are independent: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption option".split()
)
#: A start tag of the left ends open elements of the right, up to the scopes below.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BODIES = frozenset("article main body html".split())
SCOPES = frozenset("ul ol dl table article section main div body td th nav aside header footer form select".split())
#: Never article text.
CUT_TAGS = frozenset("head script style noscript template button select textarea input iframe object embed svg canvas audio video menu dialog title xmp noembed noframes".split())
#: Not article text either, unless the article stands in them.
SOFT_TAGS = frozenset("nav header footer aside form".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar side aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus respond reply replies "
    "share sharing social related recommended recommendations newsletter subscribe signup widget pagination pager toolbar skip".split()
)
#: In a class or id, what follows these tells of the layout around, not of the element.
LAYOUT_WORDS = frozenset("no has with without".split())
GOOD = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
MIN_LINK_DENSITY_TEXT = 25
#: The doubt about an element of SOFT_TAGS.
SOFT = 3

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: The next thing in a tag that matters: its end, or a quoted value after an equals sign.
_STEP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)")
_NAME = re.compile(r"[A-Za-z]+|\d+")


class Node:
    __slots__ = ("doubt", "kids", "links", "parent", "points", "size", "tag", "text", "weight")

    def __init__(self, tag: str, parent: Node | None, weight: float = 0.0):
        self.tag, self.parent, self.weight = tag, parent, weight
        self.kids: list = []  # nodes and strings, in page order
        self.points, self.size, self.links, self.text = 0.0, 0, 0, None
        self.doubt = 0  # what its class or id says: see named()


def cut(tag: str, attrs: str) -> bool:
    if tag in CUT_TAGS:
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in CUT_ROLES or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
        if name == "hidden" and value != "until-found":
            return True
    return False


def named(tag: str, attrs: str) -> int:
    """2 where a class or id consists of CUT_WORDS, 1 where one has such a word among others, else 0."""
    most = 0
    if not attrs or tag in ("body", "html", "article", "main"):
        return most
    for m in _ATTR.finditer(attrs):
        if m[1].lower() not in ("class", "id"):
            continue
        for value in (m[2] or m[3] or m[4] or "").split():
            words = [x.lower() for x in _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
            known = words[: next((i for i, x in enumerate(words) if x in LAYOUT_WORDS), len(words))]
            hits = [x in CUT_WORDS for x in known]
            most = max(most, 2 if hits and len(known) == len(words) and all(hits) else 1 if any(hits) else 0)
    return most


def contents(root: Node) -> dict[int, tuple[int, int, int]]:
    """By id() of a node: the characters of paragraphs, the count of article and main elements, and all characters in it."""
    order, todo, found = [], [(root, False)], {}
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("p", "pre", "blockquote")
        order.append((n, inside))
        todo += [(k, inside) for k in n.kids if isinstance(k, Node)]
    for n, inside in reversed(order):
        chars, bodies, every = 0, int(n.tag in ("article", "main")), 0
        for k in n.kids:
            if isinstance(k, Node):
                c, b, e = found[id(k)]
                chars, bodies, every = chars + c, bodies + b, every + e
            else:
                size = len("".join(k.split()))
                chars, every = chars + size * inside, every + size
        found[id(n)] = chars, bodies, every
    return found


def prune(root: Node, doubtful: list[Node]) -> None:
    """Cut elements by class, id or SOFT_TAGS, unless the article stands in them.

    That is where all article and main elements do; or, for names of mixed words, most
    paragraph text; or, on a page without article and main, most paragraph text for
    SOFT_TAGS, and for a form around a page without paragraphs most text.
    """
    for level in (2, 1, SOFT):
        nodes = [n for n in doubtful if n.doubt == level]
        found = contents(root) if nodes else {}
        all_chars, all_bodies, all_ = found.get(id(root), (0, 0, 0))
        gone: set[int] = set()
        for n in nodes:
            if id(n) not in found:  # went with another
                continue
            chars, bodies, every = found[id(n)]
            keeps = bool(bodies) and bodies == all_bodies
            if level == 1 or level == SOFT and not all_bodies:
                keeps |= 2 * chars > all_chars
            if level == SOFT and not all_bodies and not all_chars and n.tag == "form":
                keeps |= 2 * every > all_
            if not keeps:
                gone.add(id(n))
        for parent in {id(n.parent): n.parent for n in nodes if id(n) in gone}.values():
            parent.kids = [k for k in parent.kids if id(k) not in gone]


def tokens(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, slash, tag, attributes, place after) of each start and end tag; at last the rest, with no tag.

    One pass: comments and declarations are left out, a `<` that begins nothing is text, and
    a tag that never ends is dropped with what follows it.
    """
    pos, end, text, unpaired = 0, len(page), [], set()
    while (at := page.find("<", pos)) >= 0:
        text.append(page[pos:at])
        if page.startswith("<!--", at):
            pos = page.find("-->", at + 4) + 3
            pos = pos if pos > 2 else end
        elif page.startswith(("<!", "<?"), at):
            pos = page.find(">", at) + 1 or end
        elif m := _TAG.match(page, at):
            pos = m.end()
            while (step := _STEP.search(page, pos)) and step[0] != ">":
                quote = step[0][-1]
                closed = -1 if quote in unpaired else page.find(quote, step.end())
                if closed < 0:
                    unpaired.add(quote)
                pos = closed + 1 if closed >= 0 else step.end()
            if not step:
                pos = end
                break
            pos = (yield "".join(text), m[1], m[2].lower(), page[m.end() : step.start()], step.end()) or step.end()
            text = []
        else:
            text.append("<")
            pos = at + 1
    yield "".join([*text, page[pos:]]), "", "", "", end


def tree(page: str) -> Node:
    """The page's elements without those that are cut; end tags that fit nothing are ignored."""
    root = Node("html", None)
    doubtful: list[Node] = []
    stack, skip = [root], 0  # skip: how deep the stack is inside an element that is cut
    names: dict[str, int] = {}  # how many elements of each name are open
    found, resume = tokens(page), None

    def close(depth: int) -> None:
        for n in stack[depth:]:
            names[n.tag] -= 1
        del stack[depth:]

    while True:
        try:
            text, slash, tag, attrs, pos = found.send(resume)
        except StopIteration:
            break
        resume = None
        if text and not skip:
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        if not tag:
            break
        if slash:
            for i in range(len(stack) - 1, 0, -1) if names.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:
                    break
            skip = skip if skip and len(stack) > skip - 1 and len(stack) >= skip else 0
            continue
        if tag in BLOCKS and tag != "br":
            for i in range(len(stack) - 1, 0, -1) if names.get("p") else ():  # a block ends an open paragraph, whatever is open in it
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1) if any(names.get(x) for x in ENDS[tag]) else ():
                if stack[i].tag in ENDS[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPES and stack[i].tag not in ("td", "th"):
                    break
        if skip and len(stack) < skip:
            skip = 0
        gone = bool(skip) or cut(tag, attrs)
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            resume = page.find(">", ended.end()) + 1 or len(page) if ended else len(page)
            continue
        if tag in VOID:
            if not gone and tag in ("br", "hr") and not named(tag, attrs):
                stack[-1].kids.append(Node(tag, stack[-1]))
            continue
        weight = 25.0 if tag in ("article", "main") or re.search(r"articleBody", attrs) else 10.0 if attrs and any(GOOD.search(x[2] or x[3] or x[4] or "") for x in _ATTR.finditer(attrs) if x[1].lower() in ("class", "id")) else 0.0
        node = Node(tag, stack[-1], weight)
        if not gone:
            stack[-1].kids.append(node)
            node.doubt = named(tag, attrs) or SOFT * (tag in SOFT_TAGS)
            if node.doubt:
                doubtful.append(node)
        if not attrs.rstrip().endswith("/") or tag in BLOCKS:
            stack.append(node)
            names[tag] = names.get(tag, 0) + 1
            if gone and not skip:
                skip = len(stack)
    prune(root, doubtful)
    return root


def measure(root: Node) -> list[Node]:
    """Sizes and link sizes bottom-up; the nodes in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    for n in reversed(order):
        for k in n.kids:
            if isinstance(k, Node):
                n.size, n.links = n.size + k.size, n.links + k.links
            else:
                n.size += len("".join(k.split()))
        if n.tag == "a":
            n.links = n.size
    return order


def density(n: Node) -> float:
    return n.links / n.size if n.size else 0.0


def own_text(n: Node) -> str:
    """The text of a node outside the blocks in it."""
    out, todo = [], list(reversed(n.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag not in BLOCKS:
            todo += reversed(k.kids)
    return "".join(out)


def score(order: list[Node]) -> None:
    for n in order:
        if n.tag not in ("p", "pre", "td", "blockquote", "div", "article", "section", "main", "li", "dd", "h2", "h3", "body", "html"):
            continue
        text = own_text(n).strip()
        if not text:
            continue
        points = (min(len(text) / 100, 3.0) + text.count(",") + (1.0 if len(text) >= MIN_LINK_DENSITY_TEXT else 0.0)) * (1 - density(n))
        up, depth = n.parent or n, 0
        while up is not None and depth < 5:
            up.points += points / (1, 2, 6, 9, 12)[depth]
            up, depth = up.parent, depth + 1
    for n in order:
        n.points = (n.points + (n.weight if n.points else 0.0)) * (1 - density(n))


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks in page order, white space squashed."""
    out, now = [], []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(x.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page; empty for null, empty and text-free pages."""
    if not page:
        return ""
    root = tree(page)
    order = measure(root)
    score(order)
    best = max((n for n in order if n.size and (n.tag in BLOCKS or n is root)), key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        return " ".join(blocks([root]))
    top = best  # with the wrappers that hold nothing else
    while top.tag not in BODIES and top.parent and top.parent.tag not in BODIES and not any(k is not top and (k.size if isinstance(k, Node) else k.strip()) for k in top.parent.kids):
        top = top.parent
    kept = []
    for k in top.parent.kids if top.parent else [top]:
        if k is top:
            kept.append(k)
        elif isinstance(k, Node) and best.tag not in BODIES:
            text = own_text(k).strip()
            if top is not best and k.points < 0.2 * best.points:  # beside a wrapper, only what scores
                continue
            reads = k.tag in BLOCKS and density(k) < 0.25 and k.size > 80  # as long as a paragraph, and not a list of links
            if k.points >= max(10.0, 0.2 * best.points) or reads or k.tag in ("h1", "h2") and text:
                kept.append(k)
    return " ".join(blocks(kept))


def extract(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Every row of `pages` with its main text in a new column; null and empty pages have an empty one.

    Rows stay as they are, repeated ones too, and a column named `out` is replaced; tags that
    are open, crossed or cut off are mended.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts: list[str] = []
            for start in range(0, len(column), 128):
                texts += map(main_text, column.slice(start, 128).to_pylist())
            yield pa.array(texts, pa.string())

    return pages.withColumn(out, run(F.col(html)))
