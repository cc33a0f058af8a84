"""Main-text extraction from web pages by tag-path ratios.

A page is read as blocks of text, each with its root-to-leaf path of block elements. For each path the
text length, punctuation and link text of all its blocks are added up and divided by their number; the
ratios are smoothed over neighbouring blocks in page order and fused into one weight, and paths whose
weight passes a threshold set by the page's own weights are content. Text that the elements or roles say is
no article (nav, footer, form and so on) doesn't count; article and main add weight to a path, and names
like sidebar or comments take weight from it, unless the element holds most of the text. The element that
holds the content is taken whole, but for paths of such names that are no content themselves, and for link
lists outside article and main.

Defined results: a null page, or one without content, has the empty text; markup that is cut off or not
closed is read as browsers do, as far as blocks are concerned; a line break element is white space;
repeated rows are each extracted; an empty table gives no rows. Extra columns are ignored. A link is an
anchor with href; one that is not closed before the next anchor ends with its block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches

# The elements of HTML by kind, and class words of page furniture.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "object", "audio", "video", "canvas"}
#: What can stand in a head; anything else ends it, and so does text.
HEAD = {"base", "basefont", "bgsound", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
#: Words for what is never part of an article, and for its surroundings, which a name in an article may hold by chance.
ALIEN = {
    "ad", "ads", "advert", "advertisement", "adverts", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "gdpr", "modal",
    "newsletter", "popup", "promo", "replies", "respond", "signup", "sponsor", "sponsored", "subscribe",
}
AROUND = {
    "banner", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "notice", "notices", "pager", "pagination",
    "related", "share", "sharing", "sidebar", "skip", "social", "toolbar", "widget",
}
#: What a starting element closes if it is open: the element, and the elements its search stops at.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}

#: A path is content from the paths' mean weight or this share of the heaviest one's, the less of both.
THRESHOLD = 0.1
#: By these a path weighs more in article or main, and less below names of furniture.
MAIN_WEIGHT = 4.0
SUSPECT_WEIGHT = 0.05
#: Blocks on each side that smooth a ratio.
SPAN = 2
#: A path outside article and main, and not of headings, is a link list if its text is links to more than this share.
LINKS = 0.6

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？]")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class _Open:
    __slots__ = ("tag", "path", "skip")

    def __init__(self, tag: str, path: int, skip: bool):
        self.tag, self.path, self.skip = tag, path, skip


class _Paths:
    """Root-to-leaf paths as a tree: a path is its parent's number and the last element's name."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.parent, self.name, self.suspect, self.main = [-1], [""], [False], [False]

    def below(self, parent: int, tag: str, name: str, suspect: bool) -> int:
        key = (parent, name, suspect)
        if key not in self.number:
            self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.name.append(name)
            self.suspect.append(suspect)
            self.main.append(self.main[parent] or tag in MAIN)
        return self.number[key]


def _judged(tag: str, attrs: str, inside_main: bool) -> tuple[str, bool, bool]:
    """(name of the element in paths, whether it is no text of the page by what it is, whether its names say so)."""
    skip = tag in FURNITURE or tag == "header" and not inside_main
    if not attrs or attrs.isspace():
        return tag, skip, False
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    label = found.get("class", "").split()
    style = found.get("style", "").replace(" ", "").lower()
    skip = skip or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or found.get("role", "").lower() in ROLES
    suspect = False
    if tag not in ("html", "body", *MAIN):
        names = [x.lower() for x in (*label, found.get("id", ""))]
        words = {w.lower() for x in (*label, found.get("id", "")) for w in _SPLIT.split(x)}
        suspect = bool(words & ALIEN or (set(names) if inside_main else words) & AROUND)
    return f"{tag}.{label[0]}" if label else tag, skip, suspect


def blocks(page: str) -> tuple[list[tuple[int, str, int]], _Paths]:
    """((path, text, characters in links) of each block that may be text of the page, in page order; the paths)."""
    out: list[tuple[int, str, int]] = []
    paths = _Paths()
    stack: list[_Open] = []
    open_: Counter[str] = Counter()  # tags in the stack
    skips = 0  # elements in the stack whose text doesn't count
    text: list[str] = []
    links, at = 0, 0
    in_link, closed, link_depth = False, False, 0  # closed: by an end tag, so that it may hold blocks

    def end_block() -> None:
        nonlocal links, in_link
        if text:
            clean = " ".join(html.unescape("".join(text)).split()) if not skips else ""
            if clean:
                out.append((stack[-1].path if stack else 0, clean, min(links, len(clean))))
            text.clear()
        links = 0
        in_link = in_link and closed

    def close_to(depth: int) -> None:
        nonlocal in_link, skips
        end_block()
        while len(stack) > depth:
            gone = stack.pop()
            open_[gone.tag] -= 1
            skips -= gone.skip
        in_link = in_link and depth >= link_depth

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            if stack and stack[-1].tag == "head" and html.unescape(piece).strip(" \t\n\f\r"):
                close_to(len(stack) - 1)
            text.append(piece)
            if in_link:
                links += len(piece)

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    add(" ")
                continue
            if open_[tag]:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                close_to(depth)
            elif tag == "p":
                end_block()
            continue
        if stack and stack[-1].tag == "head" and tag not in HEAD:
            close_to(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                at = end.end()
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br":
                add(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = any(k.lower() == "href" for k, *_ in _ATTR.findall(m[3]))
                following = _ANCHOR.search(page, at) if in_link else None
                closed, link_depth = bool(following and following[1]), len(stack)
            continue
        if tag == "html" and stack:  # adds attributes to the one that is open, at most
            continue
        end_block()
        own, stop = CLOSES.get(tag, (set(), set()))
        depth = len(stack) - 1
        while depth >= 0 and any(open_[x] for x in own) and stack[depth].tag not in stop:
            if stack[depth].tag in own:
                close_to(depth)
                if tag not in ("tr", "tbody"):
                    break
            depth -= 1
        while stack and stack[-1].tag == "p":
            close_to(len(stack) - 1)
        if tag in MAIN and (open_["nav"] or open_["header"] or open_["p"]):  # they can't hold it, so they were left open
            close_to(next(d for d, o in enumerate(stack) if o.tag in ("nav", "header", "p")))
        name, skip, suspect = _judged(tag, m[3], any(open_[x] for x in MAIN))
        stack.append(_Open(tag, paths.below(stack[-1].path if stack else 0, tag, name, suspect), skip))
        open_[tag] += 1
        skips += skip
    end_block()
    return out, paths


def path_weights(of: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The weight of each path, given for each block its path, characters, punctuation and characters in links.

    Both ratios, text without links to blocks and punctuation to blocks, are smoothed over SPAN blocks on each
    side with falling shares and taken back to paths; their product, less the share of link text, is the weight.
    """
    nodes, total = np.bincount(of), np.bincount(of, length)
    share = np.bincount(of, linked) / np.maximum(total, 1)
    kernel = SPAN + 1 - np.abs(np.arange(-SPAN, SPAN + 1)).astype(float)
    near = np.convolve(np.ones(len(of)), kernel)[SPAN : SPAN + len(of)]
    weights = []
    for ratio in ((total - np.bincount(of, linked)) / np.maximum(nodes, 1), np.bincount(of, marks) / np.maximum(nodes, 1)):
        each = ratio[of]
        even = np.convolve(each, kernel)[SPAN : SPAN + len(each)] / near
        weights.append(np.bincount(of, (each + even) / 2) / np.maximum(nodes, 1))
    return weights[0] * np.log1p(weights[1] + 0.5) * (1 - share)


def extract(page: str | None) -> str:
    """The page's main text: content blocks joined by a line feed."""
    found, tree = blocks(page or "")
    if not found:
        return ""
    used, of = np.unique([p for p, *_ in found], return_inverse=True)
    length = np.array([len(t) for _, t, _ in found], float)
    linked = np.array([n for *_, n in found], float)
    marks = np.array([len(_PUNCT.findall(t)) for _, t, _ in found], float)
    share = np.bincount(of, linked) / np.bincount(of, length)
    heading = np.array([re.fullmatch(r"h[1-6](\..*)?", tree.name[p]) is not None for p in used])
    in_main = np.array(tree.main)[used]
    # an element whose names tell of furniture is none if it holds most of the text, and all that is in article and main
    mass, main = np.zeros(len(tree.parent)), np.zeros(len(tree.parent))
    mass[used] = np.bincount(of, length - linked)
    main[used[in_main]] = 1
    for p in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[tree.parent[p]] += mass[p]
        main[tree.parent[p]] += main[p]
    suspect = np.zeros(len(mass), bool)
    for p in range(1, len(mass)):
        suspect[p] = suspect[tree.parent[p]] or tree.suspect[p] and (2 * mass[p] <= mass[0] or main[p] < main[0])
    weight = path_weights(of, length, marks, linked) * np.where(in_main, MAIN_WEIGHT, 1) * np.where(suspect[used], SUSPECT_WEIGHT, 1)
    if weight.any():
        content = weight >= min(weight[weight > 0].mean(), weight.max() * THRESHOLD)
    else:  # nothing but links
        content = in_main & ~suspect[used]
    if not content.any():
        return ""
    # the deepest element that holds all content
    count = np.zeros(len(mass), np.int64)
    count[used[content]] = 1
    for p in range(len(mass) - 1, 0, -1):
        count[tree.parent[p]] += count[p]
    holder = int(np.flatnonzero(count == count[0])[-1])
    if not (np.array(tree.parent) == holder).any():  # a block by itself: what holds it
        holder = max(tree.parent[holder], 0)
    up = holder
    while up:  # an article is taken whole
        if tree.name[up].split(".")[0] in MAIN:
            holder = up
        up = tree.parent[up]
    inside = np.zeros(len(mass), bool)
    for p in range(len(mass)):
        inside[p] = p == holder or p > 0 and inside[tree.parent[p]]
    kept = inside[used] & np.where(suspect[used], content, in_main | heading | content & (share <= LINKS))
    return "\n".join(t for (_, t, _), i in zip(found, of.tolist(), strict=True) if kept[i])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [extract(h) for h in batch.pop("html")]
            batch["n_chars"] = [len(t) for t in batch["text"]]
            yield batch

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(taken, "page_id long, url string, text string, n_chars long")
