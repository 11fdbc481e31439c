"""Main-text extraction by tree scoring.

A page is cut into tags and text by one expression and put into a tree with the
usual implied ends.  Every paragraph passes points for its length and its commas
to its ancestors: all to the parent, half to the grandparent, a third of that
and less to those above.  A container's points are discounted by its link
density.  The best container and its siblings with enough points are kept; if
the best one stands in an article or main element, that is taken whole.  Menus,
headers, footers, sidebars, notices, adverts, forms and comments are known by
their elements, roles and names and never kept.

Edge cases: a null or empty page, or one without text, gives an empty text; tags
that don't end, wrong nesting and stray ends are repaired; text of any length is
kept whole; rows are extracted one by one, so repeated rows and clashing columns
don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from twinfold.functions.ship import ship

#: Comment, declaration, raw element with its content, tag, or text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/][^>]*>|<|[^<]+",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that a start tag of the key ends when they are open above the nearest one named last.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSE_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "option", "legend"}
DROPPED = frozenset("head nav footer aside form button select input textarea dialog menu canvas".split())
#: Elements that count as if a name told against them.
HINTED = frozenset("object audio video map label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe subscription signup sidebar side rail related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar footer masthead pagination pager paginator login skip widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
NOT_THE_ARTICLE = frozenset("comment comments reply replies response related recommended teaser ad advert promo sponsored".split())
CONTENT = frozenset("article main".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that turn a name that follows or precedes them into a trait of its box.
TRAITS = frozenset("has with no without enabled disabled open closed".split())
#: Characters from which a paragraph in an article's header is taken for its lede, not its byline.
LEDE = 40


class Node:
    __slots__ = ("name", "parent", "items", "dropped", "content", "hint", "points", "chars", "linked")

    def __init__(self, name: str, parent: Node | None, dropped: bool = False, content: bool = False, hint: str = ""):
        self.name, self.parent, self.dropped, self.content, self.hint = name, parent, dropped, content, hint
        self.items: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0


def _hint(value: str) -> str:
    """What a class or id tells against its box: comments, box or nothing."""
    out = ""
    for token in value.split():
        words = re.split(r"[^a-z0-9]+", token)
        if TRAITS.intersection(words):
            continue
        if COMMENTS.intersection(words):
            return "comments"
        if WORDS.intersection(words) or any(w.startswith(("advert", "cookie", "sidebar", "newsletter")) for w in words):
            out = "box"
    return out


def _kind(name: str, rest: str) -> tuple[bool, bool, str]:
    """Whether an element is dropped, whether it is content by name, and what its names tell against it."""
    content, dropped, hint = name in CONTENT, name in DROPPED, "box" if name in HINTED else ""
    if rest and not dropped and "=" in rest or "hidden" in rest:
        for m in NAMES.finditer(rest):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "role":
                dropped |= value in ROLES
                content |= value in ("main", "article")
            elif key == "itemprop":
                content |= value == "articlebody"
            elif key == "style":
                dropped |= "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", "")
            elif key == "hidden" or key == "aria-hidden":
                dropped |= key == "hidden" and rest[m.end() : m.end() + 1] != "=" or value == "true"
            elif name == "article":
                dropped |= any(w in NOT_THE_ARTICLE for w in re.split(r"[^a-z0-9]+", value))
            elif name not in ("html", "body", "main"):
                hint = "comments" if hint == "comments" else _hint(value) or hint
    return dropped, content, hint


def parse(page: str) -> tuple[Node, bool]:
    """The tree, and whether a name tells against any box of it."""
    top = here = Node("html", None)
    hinted = False
    for m in TOKEN.finditer(page):
        name = m["name"]
        if name is None:
            text = m[0]
            if m["raw"] is not None or len(text) > 1 and text[0] == "<" and (text[1] in "!?/" or text[1].isalpha()):
                continue
            here.items.append(entities.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m["end"]:
            node = here
            while node is not top and node.name != name:
                if node.name in ("table", "td", "th") and name not in BLOCK:
                    break
                node = node.parent
            if node is not top and node.name == name:
                here = node.parent
            elif name == "p" or name == "br":
                here.items.append(Node("br", here))
            continue
        if name in ("html", "body"):
            if name == "body":
                while here is not top and here.name == "head":
                    here = here.parent
            continue
        if name in CLOSE_P:
            node = here
            while node is not top and node.name != "p" and node.name not in BLOCK:
                node = node.parent
            if node.name == "p":
                here = node.parent
            if here.name == "head":
                here = here.parent
        if name in ENDS:
            shut, stop = ENDS[name]
            node, at = here, None
            while node is not top and node.name not in stop:
                if node.name in shut:
                    at = node
                node = node.parent
            if at is not None:
                here = at.parent
        dropped, content, hint = _kind(name, m["rest"])
        hinted |= hint != ""
        node = Node(name, here, dropped or here.dropped, content and not dropped, hint)
        if name == "header":
            node.dropped = here.dropped or not _within(here)
        here.items.append(node)
        if name not in VOID and not m["rest"].endswith("/"):
            here = node
        elif name not in VOID and name not in BLOCK:
            here = node if name not in ("path", "use") else here
    return top, hinted


def _within(node: Node | None) -> bool:
    while node is not None:
        if node.content:
            return True
        node = node.parent
    return False


def _settle(top: Node) -> None:
    """Drop the boxes that their names tell against, but for those that hold half of the page's unlinked text or an article."""
    found = [([owner, *_around(owner)], len(text) - linked) for owner, text, linked in blocks(top)]
    articles = {id(x) for up, _ in found for i, node in enumerate(up) if node.content for x in up[i + 1 :] if x.hint}
    held: dict[int, int] = {}
    hinted: dict[int, Node] = {}
    total = 0
    for up, size in found:
        for node in up:
            if node.hint:
                hinted[id(node)] = node
        if any(x.hint == "comments" and id(x) not in articles for x in up):
            continue
        total += size
        for node in up:
            if node.hint:
                held[id(node)] = held.get(id(node), 0) + size
    for i, node in hinted.items():
        node.dropped = i not in articles and (node.hint == "comments" or 2 * held.get(i, 0) < total)


def _around(node: Node) -> Iterator[Node]:
    while (node := node.parent) is not None:
        yield node


def blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """(container, text, characters in links) of every block of text under node, in page order."""
    parts: list[str] = []
    links: list[str] = []
    owner = [node]

    def flush(frame: list) -> tuple[Node, str, int] | None:
        text = " ".join("".join(parts).split())
        linked = len(" ".join("".join(links).split()))
        parts.clear()
        links.clear()
        if frame[3] and frame[0].name == "p" and (len(text) < LEDE or linked):
            return None
        return (owner[0], text, linked) if text else None

    # An explicit stack, since pages may nest deeper than calls can: (node, next item, in a link, in a header).
    stack: list[list] = [[node, 0, False, False]]
    while stack:
        frame = stack[-1]
        at, i, link, header = frame
        if i == len(at.items):
            stack.pop()
            if at.name in BLOCK and (out := flush(frame)):
                yield out
            if stack:
                owner[0] = _block(stack)
            continue
        frame[1] += 1
        x = at.items[i]
        if isinstance(x, str):
            if not header or any(f[0].name in TITLES or f[0].name == "p" for f in stack):
                parts.append(x)
                if link:
                    links.append(x)
        elif x.name == "br":
            parts.append(" ")
        elif not x.dropped:
            if x.name in BLOCK:
                if out := flush(frame):
                    yield out
                owner[0] = x
            stack.append([x, 0, link or x.name == "a", header or x.name == "header"])
    if out := flush([node, 0, False, False]):
        yield out


def _block(stack: list[list]) -> Node:
    return next((f[0] for f in reversed(stack) if f[0].name in BLOCK), stack[0][0])


def extract(page: str | None) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    top, hinted = parse(page)
    if hinted:
        _settle(top)
    found = list(blocks(top))
    if not found:
        return ""
    nodes: dict[int, Node] = {}
    for owner, text, linked in found:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        node, share = (owner if owner.name != "p" and owner.name not in TITLES else owner.parent or owner), 1.0
        depth = 0
        while node is not None:
            nodes[id(node)] = node
            node.chars += len(text)
            node.linked += linked
            if len(text) >= 25 or owner.name == "p":
                node.points += points * share
            depth += 1
            share = 0.5 if depth == 1 else 1 / (3 * depth)
            node = node.parent
    score = lambda n: n.points * (1 - n.linked / n.chars) if n.chars else 0.0
    best = max(nodes.values(), key=score)
    node = best
    while node is not None:  # the outermost article or main element around it
        if node.content:
            best = node
        node = node.parent
    kept = {id(best)}
    if best.parent is not None and not best.content:
        least = max(1.0, 0.2 * score(best))
        for x in best.parent.items:
            if isinstance(x, Node) and not x.dropped and x is not best:
                own = nodes.get(id(x))
                if own is not None and score(own) >= least or x.name in TITLES or x.name == "p" and _prose(x):
                    kept.add(id(x))
    out = []
    for owner, text, _ in found:
        node = owner
        while node is not None and id(node) not in kept:
            node = node.parent
        if node is not None:
            out.append(text)
    return "\n\n".join(out)


def _prose(p: Node) -> bool:
    text, linked = "", 0
    for _, t, k in blocks(p):
        text += t
        linked += k
    return bool(text) and linked <= 0.25 * len(text)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    ship(pages.sparkSession)
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
