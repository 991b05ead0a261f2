"""The main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.text import small_batches

# How HTML treats these elements, and which parts of a page are not its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDS_BEFORE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("table ul ol dl body html article section div main select".split())
DROPPED = frozenset(
    "head nav footer aside button select option input menu svg canvas object embed audio video map annotation annotation-xml".split()
) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense adbox adslot sponsor sponsored sponsors promo promotion promoted "
    "banner nav navbar navigation menu submenu sidebar aside footer header masthead comment comments commentlist discussion disqus reply "
    "replies respond cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related "
    "recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login register widget toolbar "
    "pagination pager skip legal copyright".split()
)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
SEMANTIC = frozenset(("article", "main"))

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*+"|'[^'<]*+'|[^>"'<]++|["'])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.IGNORECASE)
_NAMES = re.compile(r"[A-Za-z]+")
_TOKENS = re.compile(r"[^\s\"']+")
_COMMAS = re.compile(r"[,،、，]")

LENGTH_STEP = 100
LENGTH_POINTS = 3
SIBLING_SHARE = 0.2
SIBLING_LEAST = 10.0
MENU_LINKS = 3
# An element that its name, role or place makes doubtful is left out if it is at most this share of the page's text, or if
# at least this share of its own text is links; one whose name only contains a doubtful word, if it is mostly links.
SMALL_SHARE = 0.3
LINK_HEAVY = 0.5
# What text in a doubtful element that stays counts.
DOUBT_SHARE = 0.25
# A result shorter than this share of the densest element that was left out is taken again without leaving any out.
FAR_SHORTER = 0.25
# Further out than this, the share of a paragraph's points that an element gets no longer falls.
LEAST_SHARE_LEVELS = 100


class _Node:
    __slots__ = ("blocks", "chars", "doubt", "dropped", "linked", "links", "number", "outer", "parent", "points", "tag", "text", "weak")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, doubt: int = 0, number: int = 0) -> None:
        self.tag, self.parent, self.dropped, self.doubt, self.number = tag, parent, dropped, doubt, number
        self.points, self.text, self.links, self.blocks = 0.0, 0, 0, 0
        # the nearest doubtful element around it, and characters and link characters within it
        self.outer = None if parent is None else parent if parent.doubt else parent.outer
        self.weak = doubt == 2 or parent is not None and parent.weak
        self.chars = self.linked = 0


def _is_dropped(tag: str, attributes: str) -> bool:
    """Whether an element is no part of any article: by its tag, or since it is hidden."""
    if tag in DROPPED:
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _doubt(tag: str, attributes: str, of_page: bool) -> int:
    """2 if the role, a whole class or id, or the place of an element is one that articles do not have, 1 if part of a class or id is."""
    if tag in ("form", "fieldset", "dialog") or tag == "header" and of_page:
        return 2
    if not attributes or tag in ("html", "body", "article", "main") and "comment" not in attributes:
        return 0
    most = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in UNLIKELY_ROLES:
            return 2
        if name in ("class", "id") and tag not in ("html", "body"):
            for token in _TOKENS.findall(value):
                words = [w in UNLIKELY and not (w == tag == "header") for w in _NAMES.findall(token)]
                most = max(most, 2 if words and all(words) else 1 if any(words) else 0)
    return most


def _parse(page: str, without: frozenset[int] = frozenset()) -> tuple[list[tuple[_Node, str, int]], list[_Node]]:
    """The blocks of a page in order (their element, text and characters within links), and its doubtful elements.

    One pass, no recursion. Elements whose numbers are in ``without`` are left out.
    """
    root = _Node("", None, False)
    stack, blocks, doubtful = [root], [], []
    number = total = total_linked = 0
    runs: list[str] = []
    linked = links = article = forms = paragraphs = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join(html.unescape("".join(runs)).split())
            runs.clear()
            if text:
                node = next(n for n in reversed(stack) if n.tag in BLOCK or n is root)
                blocks.append((node, text, min(linked, len(text))))
        linked = 0

    def close(node: _Node) -> None:
        nonlocal links, article, forms, paragraphs
        while True:
            gone = stack.pop()
            links -= gone.tag == "a"
            article -= gone.tag in SEMANTIC
            forms -= gone.tag == "form"
            paragraphs -= gone.tag == "p"
            if gone.doubt:
                gone.chars, gone.linked = total - gone.chars, total_linked - gone.linked
            if gone is node:
                return

    def add(text: str) -> None:
        nonlocal linked, total, total_linked
        if text and not stack[-1].dropped:
            runs.append(text)
            size = len(" ".join(text.split()))
            total += size
            if links:
                linked += size
                total_linked += size

    while True:
        found = _TAG.search(page, at)
        add(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "p" and not paragraphs:
                flush()
                continue
            if tag == "br":
                add(" ")
                continue
            for node in reversed(stack):
                if node.tag == tag:
                    if tag in BLOCK:
                        flush()
                    close(node)
                    break
                # an inline end tag does not reach beyond its block, nor a cell's beyond its table
                if node.tag in BLOCK and tag not in BLOCK or node.tag == "table" and tag != "table" and tag not in ("body", "html", "div", "article", "main", "section"):
                    break
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P:
            for node in reversed(stack):
                if node.tag == "p":
                    close(node)
                    break
                if node.tag in BLOCK:
                    break
        if tag in ENDS_BEFORE:
            for node in reversed(stack):
                if node.tag in ENDS_BEFORE[tag]:
                    close(node)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
                    continue
                if node.tag in SCOPES or node is root:
                    break
        if tag in VOID:
            add(" ")
            continue
        parent = stack[-1]
        number += 1
        # a label names a field in a form, and is plain text elsewhere
        dropped = parent.dropped or number in without or _is_dropped(tag, found[3]) or tag == "label" and forms > 0
        if dropped and not parent.dropped and tag not in BLOCK:
            add(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if found[3].endswith("/") and tag not in BLOCK:
            continue
        node = _Node(tag, parent, dropped, 0 if dropped else _doubt(tag, found[3], not article and parent.tag in ("", "html", "body")), number)
        if node.doubt:
            node.chars, node.linked = total, total_linked
            doubtful.append(node)
        stack.append(node)
        links += tag == "a"
        article += tag in SEMANTIC
        forms += tag == "form"
        paragraphs += tag == "p"
    flush()
    if len(stack) > 1:
        close(stack[1])
    root.chars = total
    return blocks, [root, *doubtful]


def _menus(blocks: list[tuple[_Node, str, int]]) -> set[int]:
    """Lists of ``MENU_LINKS`` or more items that are nothing but links."""
    lists: dict[int, list[bool]] = {}
    around: dict[int, _Node | None] = {}
    for node, text, linked in blocks:
        path, up = [], node
        while up is not None and up.tag not in ("ul", "ol") and id(up) not in around:
            path.append(id(up))
            up = up.parent
        if up is not None and up.tag not in ("ul", "ol"):
            up = around[id(up)]
        around.update(dict.fromkeys(path, up))
        if up is not None:
            lists.setdefault(id(up), []).append(linked >= 0.9 * len(text))
    return {k for k, only in lists.items() if len(only) >= MENU_LINKS and all(only)}


def _within(node: _Node | None, inside: set[int], known: dict[int, bool]) -> bool:
    """Whether an element or one around it is in a set; what is found is remembered for all on the way."""
    path = []
    while node is not None and id(node) not in known and id(node) not in inside:
        path.append(id(node))
        node = node.parent
    found = node is not None and (id(node) in inside or known[id(node)])
    known.update(dict.fromkeys(path, found))
    return found


def _left_out(doubtful: list[_Node]) -> list[_Node]:
    """The outermost doubtful elements that are a small part of the page, or mostly links."""
    total, out, gone = doubtful[0].chars, [], set()
    for node in doubtful[1:]:
        if node.outer is not None and node.outer.number in gone:
            gone.add(node.number)
        elif node.linked >= LINK_HEAVY * max(1, node.chars) or node.doubt == 2 and node.chars <= SMALL_SHARE * total:
            gone.add(node.number)
            out.append(node)
    return out


def extract(page: str) -> str:
    """The main text of a page, its blocks joined by an empty line.

    Elements that names, roles or places make doubtful are left out first, where they are small or mostly links; what
    stays of them counts less. If that leaves nothing, or far less than the densest of them, nothing is left out.
    """
    blocks, doubtful = _parse(page)
    out = _left_out(doubtful)
    if not out:
        return _best(blocks)
    text = _best(_parse(page, frozenset(n.number for n in out))[0])
    if len(text) < FAR_SHORTER * max(n.chars - n.linked for n in out):
        return _best(blocks, doubts=False)
    return text


def _scored(given: list[list]) -> dict[int, _Node]:
    """All elements with text in them, with their points; text, links and blocks are plain sums over what is inside.

    An element passes half of the points given to it to the one around it, a fourth to the next, and so on by the
    number of levels, down to the share at ``LEAST_SHARE_LEVELS``. Beyond that all are passed on at this share by a running
    sum, so that depth costs no more than the number of elements.
    """
    found: dict[int, _Node] = {}
    near: dict[int, float] = {}
    inside: dict[int, float] = {}
    for node, points, text, links, blocks in given:
        node.text, node.links, node.blocks = text, links, blocks
        inside[id(node)] = points
        up, level = node, 0
        while up is not None and level < LEAST_SHARE_LEVELS:
            up.points += points / (1 if level == 0 else 2 * level)
            near[id(up)] = near.get(id(up), 0.0) + points
            up, level = up.parent, level + 1
        up = node
        while up is not None and id(up) not in found:
            found[id(up)] = up
            up = up.parent
    # what is inside an element has a higher number
    for node in sorted(found.values(), key=lambda n: -n.number):
        total = inside.get(id(node), 0.0)
        node.points += max(0.0, total - near.get(id(node), 0.0)) / (2 * LEAST_SHARE_LEVELS)
        up = node.parent
        if up is not None:
            up.text, up.links, up.blocks = up.text + node.text, up.links + node.links, up.blocks + node.blocks
            inside[id(up)] = inside.get(id(up), 0.0) + total
    return {k: n for k, n in found.items() if n.tag}


def _best(blocks: list[tuple[_Node, str, int]], doubts: bool = True) -> str:
    """The blocks of the best scored container and of its siblings that belong to it, joined by an empty line.

    Paragraphs give points for their length and commas to their ancestors, the further the fewer, discounted by
    their share of link text; a container's points are discounted by its link density. The best container grows
    to the article or main element around it, or else to its parent as long as what that adds is not mostly links. Of
    what it grows by, and of what stands between its siblings that are kept, all blocks stay but those that are mostly
    links or doubtful. Lists of links are menus unless they stand in the best container.
    """
    if not blocks:
        return ""
    every, menus = blocks, _menus(blocks)
    listed: dict[int, bool] = {}
    if menus:
        blocks = [b for b in blocks if not _within(b[0], menus, listed)]
    given: dict[int, list] = {}
    for node, text, linked in blocks:
        density = linked / len(text)
        points = (1 + len(_COMMAS.findall(text)) + min(len(text) // LENGTH_STEP, LENGTH_POINTS)) * (1 - density)
        if node.tag in HEADINGS:
            points = 0.0
        if doubts and node.weak:
            points *= DOUBT_SHARE
        # a paragraph passes its points on; text that stands in a container itself counts for that container
        first = (node.parent or node) if node.tag in ("p", "pre", "li", "td", "th", "dd", "dt", "blockquote") or node.tag in HEADINGS else node
        got = given.setdefault(id(first), [first, 0.0, 0, 0, 0])
        for i, value in enumerate((points, len(text), linked, 1), 1):
            got[i] += value
    scored = _scored(list(given.values()))
    if not scored:
        return "\n\n".join(text for _, text, _ in blocks)
    value = {k: n.points * (1 - n.links / max(1, n.text)) for k, n in scored.items()}
    best = max(scored.values(), key=lambda n: value[id(n)])
    up = best
    while up is not None:
        if up.tag in SEMANTIC:
            best = up
        up = up.parent
    core = best
    if core.tag not in SEMANTIC:
        while best.tag not in ("body", "html") and best.parent is not None and best.parent.tag:
            up = best.parent
            if id(up) not in scored or up.text > best.text and up.links - best.links >= LINK_HEAVY * (up.text - best.text):
                break
            best = up
    kept, least = {id(best)}, max(SIBLING_LEAST, SIBLING_SHARE * value.get(id(best), 0.0))
    if best.tag not in SEMANTIC and best.tag not in ("body", "html"):
        for k, node in scored.items():
            if node.parent is best.parent and value[k] >= least:
                kept.add(k)
        for node, text, linked in blocks:
            if node.parent is best.parent and (node.tag in HEADINGS or node.tag == "p" and len(text) > 80 and linked < 0.25 * len(text)):
                kept.add(id(node))
    inner, wide, around = {}, {}, {}
    plain = core.tag not in ("body", "html")
    fits, stays = [], []
    for node, text, linked in every:
        menu = bool(menus) and _within(node, menus, listed)
        in_core = _within(node, {id(core)}, inner)
        fit = linked < LINK_HEAVY * len(text) and (core.weak or not (doubts and node.weak)) and not menu
        if in_core:
            stay = plain or not menu
        else:
            stay = _within(node, kept, wide) and (fit or not _within(node, {id(best)}, around) and not menu)
        fits.append(fit)
        stays.append(stay)
    held = [n for n, stay in enumerate(stays) if stay]
    if held and best.parent is not None:
        beside: dict[int, bool] = {}
        for n in range(held[0], held[-1]):
            stays[n] = stays[n] or fits[n] and _within(every[n][0], {id(best.parent)}, beside)
    return "\n\n".join(every[n][1] for n, stay in enumerate(stays) if stay)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the article of each whole page, empty if there is none.

    Null html is empty; null ids and urls stay null; equal rows give equal rows; an empty table gives none; other
    columns are ignored. Broken markup never fails: unknown or misplaced tags are skipped.
    """
    small_batches(pages.sparkSession)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py()) if t.is_valid else "" for t in batch.column("html")]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(rows, "page_id bigint, url string, text string, n_chars bigint")
