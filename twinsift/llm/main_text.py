"""The main text of HTML pages by scoring their tree.

A page is parsed into a tree without what is never main text: scripts, forms, menus, page headers
and footers, sidebars, notices, adverts, reader comments. Each paragraph earns points for length
and commas and passes them to its ancestors, all to its parent, half to the next, and less
further up. Points are discounted by link density. If the best container lies in an article, the
article is kept; if in a main element or one named like content, all of that but lists of links;
else its siblings and the text between them are kept where few of their characters are links.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from twinsift.llm.common import field, whole

COMMENT = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
NAMING = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object select noframes xmp".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul caption option".split())
NEVER = set("nav aside footer form button dialog menu fieldset search select label input audio video canvas head".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = set("p pre blockquote table figure dl".split())
# An end tag or implied end does not reach past these.
WALLS = set("article aside blockquote body div footer form header main nav section table td th ul ol dl li".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}}
IMPLIED_WALL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
                "th": {"table", "tr"}, "option": set()}

# Words of class, id and role that name what is not main text, matched as whole words of the value.
UNWANTED = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted outbrain taboola "
    "sidebar aside widget widgets rail nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs "
    "footer foot footnav masthead topbar header siteheader pageheader "
    "comment comments commentlist respond reply replies disqus discussion responses feedback reviews "
    "cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay lightbox dialog disclaimer paywall "
    "subscribe subscription newsletter signup login share sharing social related recommended recommendations recirc trending "
    "popular skip search searchbox form tags tagcloud toc copyright legal complementary contentinfo alertdialog "
    "sr-only visually-hidden hidden".split())
# Of these the ones that may as well name content: they decide only together with link density or little text.
AMBIGUOUS = set(
    "search searchbox related recommended form tags toc copyright legal popular skip reply respond feedback reviews discussion "
    "responses notice notices alert alerts disclaimer tabs rail widget widgets promotion promoted trending".split())
# Ambiguous words that may be the whole name of a part of an article; the others decide if they are.
PART_NAMES = set("search related form toc copyright legal popular".split())
# A doubtful container with less text than this goes.
LITTLE_TEXT = 200
WANTED = set("article content main body post entry story text maincontent articlebody".split())


class Node:
    __slots__ = ("name", "parent", "children", "score", "good", "chars", "link_chars", "doubt", "in_article", "open_p")

    def __init__(self, name: str, parent: Node | None, good: bool = False):
        self.name, self.parent, self.children = name, parent, []
        self.score, self.good, self.chars, self.link_chars, self.doubt = 0.0, good, 0, 0, False
        # Carried down, so that no tag has to walk up to the root.
        self.in_article = name == "article" or (parent is not None and parent.in_article)
        self.open_p = self if name == "p" else parent.open_p if parent is not None and name not in WALLS else None


def _names(attributes: str) -> tuple[list[tuple[str, set[str]]], bool]:
    """Names in class, id and role, each with the words it is made of, and whether the element is hidden."""
    names, hidden = [], False
    for name, value in NAMING.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            names += [(token, {token, *re.split(r"[-_:]+", token)}) for token in value.split()]
    return names, hidden


def _unwanted(name: str, names: list[tuple[str, set[str]]], hidden: bool, in_article: bool) -> bool:
    """A name that is an unwanted word decides; one that contains such a word does unless another name is wanted."""
    if hidden or name in NEVER:
        return True
    if name in ("body", "html", "main"):
        return False
    # A header inside an article holds its title.
    unwanted = UNWANTED - {"header"} if in_article else UNWANTED
    if name == "header" and not in_article:
        return True
    if any(token in unwanted for token, _ in names):
        return True
    wanted = any(words & WANTED and not words & unwanted for _, words in names)
    return not wanted and any(words & unwanted for _, words in names)


def _doubtful(name: str, names: list[tuple[str, set[str]]], hidden: bool, in_article: bool) -> bool:
    """Unwanted only by names made with ambiguous words, such as related-work or toc-title."""
    if hidden or name in NEVER or name == "header":
        return False
    parts = PART_NAMES if in_article else set()
    clear = [(token, words - AMBIGUOUS) for token, words in names if token not in parts]
    return not _unwanted(name, clear, False, in_article)


def _dropped(node: Node) -> bool:
    """A doubtful element goes if it is mostly links or, unless it is a heading or paragraph, holds little text."""
    if _links(node) > 0.25:
        return True
    return node.name not in HEADINGS and node.name != "p" and node.chars < LITTLE_TEXT


def _without_doubtful(root: Node, nodes: list[Node]) -> list[Node]:
    """The nodes that remain when doubtful elements are judged by what they hold, counted anew."""
    gone = {id(n) for n in nodes if n.doubt and _dropped(n)}
    if not gone:
        return nodes
    for node in nodes:
        node.children = [c for c in node.children if id(c) not in gone]
        node.chars = node.link_chars = 0
    nodes = _in_order(root)
    _measured(nodes)
    return nodes


def parse(html: str) -> Node:
    """The tree of a page, unwanted parts left out; text is kept as written, references decoded."""
    root = Node("#root", None)
    here, skipping, articles = root, [], 0
    at, size = 0, len(html)

    def say(text: str) -> None:
        if text and not skipping:
            here.children.append(unescape(text) if "&" in text else text)

    while at < size:
        sign = html.find("<", at)
        if sign < 0:
            say(html[at:])
            break
        if sign > at:
            say(html[at:sign])
        comment = COMMENT.match(html, sign) if html[sign + 1:sign + 2] in ("!", "?") else None
        if comment:
            at = comment.end()
            continue
        tag = TAG.match(html, sign) or LOOSE_TAG.match(html, sign)
        if not tag:
            if re.match(r"</?[A-Za-z]", html[sign:sign + 3]):
                break  # a tag that never ends
            say("<")
            at = sign + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if closing:
            if skipping:
                # Inside an unwanted element only its own name is followed.
                if name == skipping[-1]:
                    skipping.pop()
                elif name in ("body", "html") or (name in ("article", "main") and name not in skipping):
                    skipping.clear()
                    here = _closed(here, name)
                continue
            here = _closed(here, name)
            continue
        if name in RAW:
            if attributes.endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if skipping:
            if name == skipping[-1] and name not in VOID and not attributes.endswith("/"):
                skipping.append(name)
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                here.children.append("\n" if name == "br" else "" if name == "wbr" else Node("hr", here))
            continue
        here = _implied_end(here, name)
        names, hidden = _names(attributes) if attributes else ([], False)
        unwanted = _unwanted(name, names, hidden, here.in_article)
        doubt = unwanted and _doubtful(name, names, hidden, here.in_article)
        if unwanted and not doubt:
            if not attributes.endswith("/"):
                skipping.append(name)
            continue
        node = Node(name, here, name in ("article", "main") or any(words & WANTED for _, words in names))
        node.doubt = doubt
        here.children.append(node)
        if not attributes.endswith("/") or name in BLOCKS:
            here = node
    return root


def _closed(here: Node, name: str) -> Node:
    node = here
    while node.parent:
        if node.name == name:
            return node.parent
        if node.name in WALLS and name not in WALLS and name not in ("body", "html", "table", "tr"):
            return here
        node = node.parent
    return here


def _implied_end(here: Node, name: str) -> Node:
    """Where a new element belongs: a block ends an open paragraph, an item the item before."""
    if name in BLOCKS and here.open_p:
        here = here.open_p.parent
    if name in IMPLIED:
        node = here
        while node.parent and node.name not in IMPLIED_WALL[name]:
            if node.name in IMPLIED[name]:
                here = node.parent
                if name != "tr":
                    break
            node = node.parent
    return here


def _in_order(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def _measured(nodes: list[Node]) -> None:
    """Characters and link characters below each node, points from its own text passed upwards."""
    for node in nodes:
        own = [c for c in node.children if isinstance(c, str)]
        node.chars = sum(len(t.strip()) for t in own)
    for node in reversed(nodes):
        if node.name == "a":
            node.link_chars = node.chars
        if node.parent:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars


def _links(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _direct(node: Node) -> str:
    """The text of a block without that of blocks inside."""
    out, todo = [], list(reversed(node.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.name not in BLOCKS:
            todo.extend(reversed(child.children))
    return "".join(out)


def _scored(nodes: list[Node]) -> None:
    for node in nodes:
        if node.name not in BLOCKS or node.name in HEADINGS:
            continue
        text = _direct(node).strip()
        if len(text) < 25:
            continue
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - _links(node))
        # A container's own text counts for itself, a paragraph's for its parent.
        up = node if node.name in ("div", "td", "section", "article", "main", "body") else node.parent
        level = 1
        while up and up.name not in ("html", "#root"):
            up.score += points / (level if level < 3 else level * 1.5)
            up, level = up.parent, level + 1


def _text(node: Node) -> list[str]:
    """The blocks of text below a node, in page order."""
    out, run = [], []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        else:
            block = item.name in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return out


def _parts(children: list) -> list[Node]:
    """The blocks among children, and the runs of text and inline elements between them."""
    parts, run = [], None
    for child in children:
        if isinstance(child, Node) and child.name in BLOCKS:
            parts.append(child)
            run = None
            continue
        if run is None:
            run = Node("#run", None)
            parts.append(run)
        run.children.append(child)
        if isinstance(child, str):
            run.chars += len(child.strip())
        else:
            run.chars, run.link_chars = run.chars + child.chars, run.link_chars + child.link_chars
            run.score = max(run.score, child.score)
    return parts


def _keeps(best: Node) -> list[Node]:
    """The best container and what belongs to it, in page order."""
    article = best
    while article and article.name != "article":
        article = article.parent
    if article:
        # Further articles beside it belong to the page if they hold about as much.
        least = max(10.0, 0.2 * article.score * (1 - _links(article)))
        return [c for c in article.parent.children if c is article or (
            isinstance(c, Node) and c.name == "article" and _links(c) < 0.25 and c.score * (1 - _links(c)) >= least)]
    if not best.parent:
        return [best]
    holder = best.parent
    while holder and not (holder.good and holder.name not in ("body", "html")):
        holder = holder.parent
    at_least = max(10.0, 0.2 * best.score * (1 - _links(best)))

    def belongs(part: Node) -> bool:
        if part.name in HEADINGS or part.score * (1 - _links(part)) >= at_least:
            return True
        if holder:
            return part.name in PARAGRAPHS or _links(part) <= 0.5
        return _links(part) < 0.25

    before, after, node, top = [], [], best, holder or best.parent
    while node is not top:
        around = node.parent.children
        at = next(i for i, c in enumerate(around) if c is node)
        before.append([p for p in _parts(around[:at]) if belongs(p)])
        after.append([p for p in _parts(around[at + 1:]) if belongs(p)])
        node = node.parent
    return [*(p for level in reversed(before) for p in level), best, *(p for level in after for p in level)]


def main_text(html: str) -> str:
    """The main text, blocks joined by a space; empty if the page has none."""
    root = parse(html)
    nodes = _in_order(root)
    _measured(nodes)
    nodes = _without_doubtful(root, nodes)
    _scored(nodes)
    best, most = None, 0.0
    for node in nodes:
        score = node.score * (1 - _links(node)) * (1.25 if node.good else 1.0)
        if score > most:
            best, most = node, score
    if best is None:  # nothing long enough to score: the largest article, else the body
        named = [n for n in nodes if n.name in ("article", "main") and n.chars]
        best = max(named, key=lambda n: n.chars, default=None)
        if best is None:
            bodies = [n for n in nodes if n.name == "body"]
            return " ".join(_text(bodies[0] if bodies else root))
    return " ".join(block for node in _keeps(best) for block in _text(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every row.

    Null or empty html gives the empty text. Repeated rows are extracted each, ids and
    urls may be null, other columns are not read, and an empty table gives no rows.
    """
    source = pages.select(field(id_col), field(url_col), whole(html_col).alias("_html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py()) for html in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(extracted, StructType([
        *source.schema.fields[:2], StructField("text", StringType()), StructField("n_chars", LongType())]))
