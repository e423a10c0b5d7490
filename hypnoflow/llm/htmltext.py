"""Main text of web pages by composite text density.

A page becomes a tree of elements. With `clean` (the default), parts that say what they are not (menus, footers, asides,
forms, and elements whose class, id or role names an advert, a notice, a comment section and the like) are marked and
never put out; a form or a class is no reason to drop what holds the article. A class or id marks an element if one of its names consists of
marking words (and words like "box") only; it never marks inline elements, headings, paragraphs, code, items or cells, and within an article
element words that may name a part of the article as well ("related", "notice") count only where the part is less dense than the page.
Scripts, styles and the head never count.

Densities are those of the whole page, marked parts included. A node's composite density is its characters per tag,
weighed by the characters and tags outside links, relative to the body's share of links; every count of zero is taken
as one. A block's density sum is that of its child blocks, a run of text of its own between them counting as one. Then

1. the block with the highest sum (the outermost of equals) is the core;
2. the path from the core to the body sets two thresholds: the core is widened to an outer node for as long as that is
   at least CLIMB times as dense as the core, for where menus and notices come in, density falls; and the least density
   on the path is that of the page as a whole;
3. in the content, but not in an article element, blocks with fewer characters outside links than in them, two links at least
   and a density under the page's are menus of their own and go; beside it, within an article element around it, blocks at least as dense as
   the page belong to it, and so does the last heading before it if it has none.

The plain rule, by which every node of the page's density gives its own densest subtree, lets short notices through:
text without a link is dense. Widening along the path leaves them out.

Defined results: a null or empty page, and one without text, gives the empty string; unclosed and stray tags are put right
as browsers do for the common cases; character references are decoded once; text is never cut. Time is linear in the
page: tags that never end, quotes that never close and elements nested by the million included.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is never text of the page.
NO_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video".split())
#: Elements that are not the article by their name.
DROPPED = frozenset("nav footer aside form button select option textarea input dialog menu".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one of the keys ends an open element among the values, up to the nearest scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
#: Elements that are never dropped for a class or id: a paragraph of a class of its own is still one of the article's.
TEXTUAL = INLINE | HEADINGS | frozenset("p pre blockquote li dt dd td th tr caption figcaption".split())
#: Words of a class or id that mark what is not the article.
NOT_CONTENT = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget toolbar footer masthead share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login comment comments commentlist respond disqus replies pagination pager skip".split()
)
#: Words that say nothing beside these: a name is a mark if all its words are marks or such words, so "ad-box" is one and "ad-hoc" is not.
BESIDE = frozenset(
    "container wrapper wrap box block area bar slot unit list item items link links button buttons icon icons inner outer top bottom left right site global primary secondary main form section "
    "panel post posts article articles story stories media text sticky fixed mobile desktop policy message dialog us".split()
)
#: Marks that may as well name a part of the article: within it they count only where the part is less dense than the page.
AMBIGUOUS = frozenset("overlay notice notification promotion related share sharing social skip widget banner toolbar aside comment".split())
#: An outer node is content too if it is at least this share as dense as the core.
CLIMB = 0.7
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MARKS = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.IGNORECASE)


class Tree:
    """Elements in page order (a child comes after its parent) and the pieces of text between their tags."""

    def __init__(self) -> None:
        self.tag, self.parent, self.drop, self.in_article = ["#root"], [0], [False], [False]
        self.marked: list[bool] = [False]  # said to be no content by class or id only, or a form
        self.doubtful: list[bool] = [False]  # marked only by words that may name a part of the article as well
        self.pieces: list[tuple[int, str]] = []  # (element, text); an empty text is a block boundary

    def add(self, tag: str, parent: int, drop: bool, marked: bool, doubtful: bool) -> int:
        self.doubtful.append(doubtful)
        self.tag.append(tag)
        self.parent.append(parent)
        self.drop.append(drop)
        self.marked.append(marked)
        self.in_article.append(tag in ("article", "main") or self.in_article[parent])
        return len(self.tag) - 1


def _named(value: str) -> set[str]:
    """The words by which a class or id marks what is no content: those of its names that have no other words."""
    found: set[str] = set()
    for name in value.lower().split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words <= NOT_CONTENT | BESIDE:
            found |= words & NOT_CONTENT
    return found


def _unwanted(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool, bool]:
    """Whether the element goes for certain, whether it is marked as what goes unless it holds the article, and whether by doubtful words only."""
    if tag in DROPPED and tag != "form" or tag == "header" and not in_content:
        return True, False, False
    marked, doubtful = tag == "form", tag != "form"
    if not attributes or tag in ("html", "body", "main"):
        return False, marked, False
    if tag == "article":
        return False, any(name.lower() in ("class", "id") and _named(" ".join(values)) for name, *values in _MARKS.findall(attributes)), False
    if _HIDDEN.search(attributes):
        return True, False, False
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES - {"form"}:
            return True, False, False
        if name == "role" and value == "form":
            marked, doubtful = True, False
        words = _named(value) if name in ("class", "id") and tag not in TEXTUAL else set()
        marked, doubtful = marked or bool(words), doubtful and words <= AMBIGUOUS
    return False, marked, marked and doubtful


def _upward(tree: Tree, values: list[int]) -> list[int]:
    """Each node's value with those of all below it."""
    out, parent = list(values), tree.parent
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[parent[i]] += out[i]
    return out


def _in_links(tree: Tree) -> list[bool]:
    out = [False] * len(tree.tag)
    for i in range(1, len(out)):
        out[i] = tree.tag[i] == "a" or out[tree.parent[i]]
    return out


def _drop_marked(tree: Tree) -> None:
    """Drops what is marked, but for layout wrappers: those that hold half of the longest article's text outside links.

    The articles are the article elements (those whose own class is marked, as comments' are, only if there are no others),
    else the main element, else the whole page.
    """
    if not any(tree.marked):
        return
    n = len(tree.tag)
    own, in_link = [0] * n, _in_links(tree)
    for i, piece in tree.pieces:
        if piece and not tree.drop[i] and not in_link[i]:
            own[i] += len("".join(piece.split()))
    chars = _upward(tree, own)
    articles = [i for i in range(n) if tree.tag[i] == "article" and chars[i]]
    cores = [i for i in articles if not tree.marked[i]] or articles or [i for i in range(n) if tree.tag[i] == "main" and chars[i]] or [0]
    longest, inside = max(chars[i] for i in cores), [False] * n
    for i in cores:
        inside[i] = True
    for i in range(1, n):
        inside[i] = inside[i] or inside[tree.parent[i]]
    held = _upward(tree, [c if x else 0 for c, x in zip(own, inside)])
    d = densities(tree) if any(x and y for x, y in zip(tree.doubtful, tree.in_article)) else None
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    for i in range(1, n):
        wrapper = longest > 0 and 2 * held[i] >= longest
        kept = d is not None and tree.doubtful[i] and tree.in_article[i] and d.density[i] >= d.density[body]
        tree.drop[i] = tree.drop[i] or tree.drop[tree.parent[i]] or tree.marked[i] and not wrapper and not kept and tree.tag[i] not in ("article", "main")


def parse(page: str, clean: bool = True) -> Tree:
    """The page's tree; without `clean` nothing is dropped but what is no text."""
    tree, stack, token = Tree(), [0], _TAG
    at, n = 0, len(page)
    open_at: dict[str, list[int]] = {}  # by tag, the places on the stack where one is open
    block = [0]  # by place on the stack, the nearest place at or below that is no inline element

    def text(raw: str) -> None:
        if raw:
            tree.pieces.append((stack[-1], html.unescape(raw) if "&" in raw else raw))

    def close_to(depth: int) -> None:
        if block[-1] >= depth:
            tree.pieces.append((stack[depth - 1], ""))
        for x in reversed(stack[depth:]):
            open_at[tree.tag[x]].pop()
        del stack[depth:], block[depth:]

    def nearest(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < n:
        tag_at = page.find("<", at)
        if tag_at < 0:
            text(page[at:])
            break
        follows = page[tag_at + 1 : tag_at + 2]
        if follows in ("!", "?"):
            text(page[at:tag_at])
            comment = page.startswith("<!--", tag_at)
            end = page.find("-->" if comment else ">", tag_at + (4 if comment else 2))
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = None
        if follows == "/" or "a" <= follows.lower() <= "z":
            m = token.match(page, tag_at)
            if m is None and token is _TAG and follows != "/":
                # quotes that run to the end of the page are none from here on: it is scanned once more only
                token = _LOOSE
                m = token.match(page, tag_at)
        if m is None and follows != "/" and not "a" <= follows.lower() <= "z":
            text(page[at : tag_at + 1])
            at = tag_at + 1
            continue
        if m is None:
            end = page.find(">", tag_at)
            text(page[at:] if end < 0 else page[at:tag_at])  # where no tag ends from here on, the rest is text
            at = n if end < 0 else end + 1
            continue
        text(page[at:tag_at])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if open_at.get(tag):
                close_to(open_at[tag][-1])
            continue
        if tag in ENDS_P:
            if open_at.get("p") and block[-1] == open_at["p"][-1]:
                close_to(block[-1])
        elif tag in ENDS:
            depth = nearest(ENDS[tag] | SCOPES[tag])
            if depth and tree.tag[stack[depth]] in ENDS[tag]:
                close_to(depth)
        if tag not in INLINE:
            tree.pieces.append((stack[-1], ""))
        drop, marked, doubtful = _unwanted(tag, m[3], tree.in_article[stack[-1]]) if clean else (False, False, False)
        node = tree.add(tag, stack[-1], tree.drop[stack[-1]] or drop or tag in NO_TEXT, marked, doubtful)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n  # their content is never article text
        elif tag not in VOID and not (tag in ("svg", "path") and m[3].rstrip().endswith("/")):
            open_at.setdefault(tag, []).append(len(stack))
            block.append(block[-1] if tag in INLINE else len(stack))
            stack.append(node)  # a closing slash means nothing on HTML's own elements
    _drop_marked(tree)
    return tree


def composite(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite text density; page_share: the body's characters in links for each of all its characters."""
    if not chars:
        return 0.0
    c, t, lc, lt, plain = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(math.log(c / plain * lc + page_share * c + math.e))


@dataclass
class Densities:
    """By node: composite density, the sum of its child blocks' densities, characters, those in links, and tags a below it."""

    density: list[float]
    total: list[float]
    chars: list[int]
    links: list[int]
    link_tags: list[int]


def densities(tree: Tree) -> Densities:
    """Of all that is text on the page; sums leave out what was dropped."""
    n, tag, parent, drop = len(tree.tag), tree.tag, tree.parent, tree.drop
    silent = [False] * n
    for i in range(1, n):
        silent[i] = tag[i] in NO_TEXT or silent[parent[i]]
    own, own_links, in_link = [0] * n, [0] * n, _in_links(tree)
    # runs of text between block boundaries and line breaks: (block, characters, of them in links, tags, link tags)
    block = list(range(n))
    for i in range(1, n):
        block[i] = block[parent[i]] if tag[i] in INLINE else i
    runs: list[list[int]] = []
    last, run = -1, None
    for i, piece in tree.pieces:
        if not piece:
            run = None
            continue
        size = len("".join(piece.split()))
        if not size or silent[i]:
            continue
        if run is None or run[0] != block[i] or any(tag[x] == "br" for x in range(last + 1, i)):
            run = [block[i], 0, 0, 0, 0]
            runs.append(run)
        if i != last and i != block[i]:
            run[3] += 1
            run[4] += tag[i] == "a"
        last = i
        own[i] += size
        run[1] += size
        if in_link[i]:
            own_links[i] += size
            run[2] += size
    chars, links = _upward(tree, own), _upward(tree, own_links)
    below = _upward(tree, [int(not silent[i]) for i in range(n)])
    anchors = _upward(tree, [int(tag[i] == "a" and not silent[i]) for i in range(n)])
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    share = max(links[body], 1) / chars[body] if chars[body] else max(links[0], 1) / max(chars[0], 1)
    density = [0.0] * n
    for i in range(n):
        if chars[i]:
            density[i] = composite(chars[i], below[i] - 1, links[i], anchors[i] - (tag[i] == "a"), share)
    total = [0.0] * n
    for i in range(1, n):
        if block[i] == i and not drop[i]:
            total[block[parent[i]]] += density[i]
    for b, c, lc, t, lt in runs:
        if not drop[b]:
            total[b] += composite(c, t, lc, lt, share)
    return Densities(density, total, chars, links, anchors)


def main_text(page: str | None, clean: bool = True) -> str:
    """The article of a page; empty where there is none. Without `clean`, density alone decides."""
    if not page:
        return ""
    tree = parse(page, clean)
    d = densities(tree)
    n, tag, parent, drop = len(tree.tag), tree.tag, tree.parent, tree.drop
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    inside = _below(tree, [body])
    if any(not inside[i] and not drop[i] and p.strip() for i, p in tree.pieces if p):
        body, inside = 0, [True] * n  # text beside the body
    core = max((i for i in range(n) if inside[i] and not drop[i] and tag[i] not in INLINE), key=d.total.__getitem__, default=body)
    path = [core]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    threshold = min(d.density[i] for i in path)
    outer = 0
    for place, i in enumerate(path):
        if d.density[i] < CLIMB * d.density[core]:
            break
        outer = place
    tops = [path[outer]]
    article = next((i for i in path[outer:] if tag[i] == "article"), None)
    content = _below(tree, tops)
    held = _below(tree, [article]) if article is not None else content
    before = [i for i in range(tops[0]) if tag[i] in HEADINGS and not drop[i] and parent[i] in path[outer:] and d.chars[i]]
    if before and not any(content[i] and tag[i] in HEADINGS for i in range(n)):
        content[before[-1]] = True
    menu = [False] * n
    for i in range(1, n):
        own_block = tag[i] not in INLINE
        content[i] = content[i] or content[parent[i]] or held[i] and own_block and d.density[i] >= threshold
        low = own_block and d.density[i] < threshold and 2 * d.links[i] > d.chars[i] and d.link_tags[i] > 1
        menu[i] = menu[parent[i]] or low and i not in path and not tree.in_article[i]
    return " ".join("".join(" " if not p or tag[i] == "br" else p for i, p in tree.pieces if not p or content[i] and not drop[i] and not menu[i]).split())


def _below(tree: Tree, tops: list[int]) -> list[bool]:
    """By node, whether it is one of tops or below one."""
    found = [False] * len(tree.tag)
    for i in tops:
        found[i] = True
    for i in range(1, len(found)):
        found[i] = found[i] or found[tree.parent[i]]
    return found


def extract(pages: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """pages with the main text of their html column."""
    kept = [f for f in pages.schema.fields if f.name.lower() != text]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py(), clean) for p in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch[f.name] for f in kept] + [pa.array(found, pa.string())], [*(f.name for f in kept), text])

    return pages.select(*[f.name for f in kept]).mapInArrow(of, schema)
