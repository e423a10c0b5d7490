"""Main text: pages where density alone decides, densities against a plain version, hostile pages."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from hypnoflow.llm import htmltext

STORY = [f"Sentence number {i} of the story has a few words, as sentences do, and goes on for a while so that it is text." for i in range(8)]
MENU = "".join(f"<div><a href='/{i}'>Topic {i}</a></div>" for i in range(9))
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)
BREAKS = "<br><br>".join(STORY)
WANT = " ".join(STORY)

#: No tag or class says what is what.
BARE = {
    "flat": f"<body><div>{MENU}</div><div>Buy things now.</div><div>{PARAGRAPHS}</div><div>All rights reserved, somewhere.</div></body>",
    "wrapped": f"<body><div><div>{MENU}</div><div><div>{PARAGRAPHS}</div><div>{MENU}</div></div><div>A short notice.</div></div></body>",
    "breaks": f"<body><div>{MENU}</div><div>Buy things now.</div><div>{BREAKS}</div><div>All rights reserved.</div></body>",
    "sections": f"<body><div>{MENU}</div><div><div>{PARAGRAPHS[: len(PARAGRAPHS) // 8 * 4]}</div><div>{PARAGRAPHS[len(PARAGRAPHS) // 8 * 4 :]}</div></div><div>Notice.</div></body>",
    "menu within": f"<body><div>{MENU}</div><div>{PARAGRAPHS}<ul>{''.join(f'<li><a href=x>Other story {i}</a></li>' for i in range(6))}</ul></div></body>",
    "table layout": f"<body><table><tr><td>{MENU}</td><td>{PARAGRAPHS}</td></tr><tr><td>Rights reserved.</td></tr></table></body>",
    "links in text": f"<body><div>{MENU}</div><div>{PARAGRAPHS.replace('story', '<a href=s>story</a>')}</div><div>Notice.</div></body>",
}


@pytest.mark.parametrize("name", BARE)
@pytest.mark.parametrize("clean", [True, False])
def test_density_alone_decides(name, clean):
    got = htmltext.main_text(BARE[name], clean)
    assert got.split() == WANT.split()


def test_marked_parts_go_without_saying():
    page = f"<body><nav>{MENU}</nav><article><h1>Head</h1><p>Short.</p></article><div class='ad'>{PARAGRAPHS}</div><footer>f</footer></body>"
    assert htmltext.main_text(page) == "Head Short."
    assert STORY[0] in htmltext.main_text(page, clean=False)  # by density this page's text is the advert's


def test_lead_and_heading_beside_the_core():
    page = f"<body><div>{MENU}</div><article><h1>Head</h1><div><p>{STORY[0]}</p></div><div>{PARAGRAPHS}</div></article><p>Notice.</p></body>"
    assert htmltext.main_text(page) == f"Head {STORY[0]} {WANT}"
    page = f"<body><div>{MENU}</div><h2>Head</h2><div>{PARAGRAPHS}</div><h3>More</h3><div>{MENU}</div></body>"
    assert htmltext.main_text(page) == f"Head {WANT}"


class Plain(HTMLParser):
    """A well-formed page as nested nodes [tag, children or strings]."""

    def __init__(self):
        super().__init__()
        self.root = ["#root", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        if tag not in htmltext.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def plain_densities(page):
    """The published formula, node by node, each counting its own subtree anew."""
    parser = Plain()
    parser.feed(page)

    def nodes(node):
        yield node
        for child in node[1]:
            if not isinstance(child, str):
                yield from nodes(child)

    def text(node, link=False, only=False):
        link = link or node[0] == "a"
        return sum((len("".join(c.split())) if link or not only else 0) if isinstance(c, str) else text(c, link, only) for c in node[1])

    body = next(x for x in nodes(parser.root) if x[0] == "body")
    share = max(text(body, only=True), 1) / text(body)
    out = []

    def walk(node, link):
        c, lc = text(node), text(node, link, only=True)
        inner = list(nodes(node))[1:]
        t, lt = max(len(inner), 1), max(sum(x[0] == "a" for x in inner), 1)
        if c:
            top, base = max(c / max(lc, 1) * t / lt, 1), math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e)
            out.append(c / t * math.log(top, base))
        else:
            out.append(0.0)
        for child in node[1]:
            if not isinstance(child, str):
                walk(child, link or child[0] == "a")

    walk(parser.root, False)
    return out


def test_densities_against_plain():
    rng = random.Random(3)

    def some(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4) if depth else 0
            words = " ".join(rng.choice(["word", "a", "longer text", "é"]) for _ in range(rng.randrange(0, 9)))
            out.append(words if kind == 0 else f"<{(t := rng.choice(['div', 'section', 'b', 'span', 'ul']))}>{some(depth - 1)}</{t}>" if kind < 3 else f"<a>{words}<i>x</i></a><br>")
        return "".join(out)

    for _ in range(60):
        page = f"<html><body><div>q</div>{some(5)}</body></html>"
        want = plain_densities(page)
        got = htmltext.densities(htmltext.parse(page)).density
        assert len(got) == len(want) and all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got, want))


N = 1_000_000
HOSTILE = {
    "tags that never end": "<p>text</p>" + "<a " * (N // 3),
    "quotes that never close": "<p>text</p>" + "<a x=\"" * (N // 7),
    "mixed quotes": "<p>text</p>" + "<a x='\"" * (N // 8) + ">",
    "nested": "<b>" * (N // 8) + "text" + "</i></b>" * (N // 16),
    "rules in nested": "<b>" * (N // 16) + "<hr>" * (N // 16) + "text",
    "items in nested": "<div>" * (N // 20) + "<li></li>" * (N // 20) + "text",
    "stray ends": "text" + "</p>" * (N // 4),
    "brackets": "text" + "<" * N,
    "comments": "text" + "<!--" * (N // 4),
    "open paragraphs": "<p>text" + "<p><b>" * (N // 12),
    "spaces": "<p class" + " " * N + ">text",
    "one long text": "<article>" + "text " * (N // 5) + "</article>",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    got = htmltext.main_text(HOSTILE[name])
    assert time.process_time() - began < 4 and got.startswith("text")


def test_quotes_outside_values():
    assert htmltext.main_text("<body><p title=it's>One</p><p>don't</p></body>") == "One don't"
    assert htmltext.main_text("<body><p title='a > b'>One</p></body>") == "One"


INSIDE = [
    '<p class="ad-hoc">{}</p>', '<pre><code><span class="token comment">{}</span></code></pre>', '<p class="share-price">{}</p>', '<section id="related-work"><p>{}</p></section>', '<div class="notice-period">{}</div>',
    '<h2 id="promotion-of-health">{}</h2>', '<h2 id="comments-on-the-data">{}</h2>', '<div class="overlay-networks">{}</div>', '<ul><li><a href="/1">{}</a></li><li><a href="/2">Second reference of the list</a></li></ul>',
    '<ol class="references"><li><a href="/1">{}</a></li><li><a href="/2">Another one</a></li></ol>', '<table><tr><td class="ad">{}</td></tr></table>', '<div class="related"><p>{}</p><p>It is told here at some length, without any link.</p></div>',
    '<blockquote class="notice">{}</blockquote>', '<em class="comment">{}</em>', '<div class="token sponsor-list-of-2020">{}</div>',
]
OUTSIDE = [
    '<div class="ad">{}</div>', '<div class="adbox ad-box">{}</div>', '<div id="cookie-banner">{}</div>', '<section class="comments-section"><p>{}</p></section>', '<div class="related-posts"><a href="/1">{}</a><a href="/2">two</a></div>',
    '<div class="newsletter-signup-form">{}</div>', '<ul class="main-nav"><li><a href="/1">{}</a></li></ul>', '<div class="share-buttons"><a href="/1">{}</a></div>', '<div class="post sponsored">{}</div>', '<div class="notice"><a href="/1">{}</a><a href="/2">read it</a></div>',
]
PROSE = "".join(f"<p>Paragraph number {i} of the article says a thing or two about its matter, at no great length.</p>" for i in range(8))


@pytest.mark.parametrize("part", INSIDE)
def test_parts_of_the_article_stay_whatever_their_names(part):
    page = f"<html><body><nav><a href='/'>Home</a><a href='/b'>Other</a></nav><article><h1>Title</h1>{PROSE}{part.format('These words belong to it.')}{PROSE}</article><footer>End</footer></body></html>"
    text = htmltext.main_text(page)
    assert "These words belong to it." in text and "Home" not in text and "End" not in text and text.count("Paragraph number") == 16


@pytest.mark.parametrize("part", OUTSIDE)
def test_marked_parts_go_inside_and_outside(part):
    own = part.format("These words do not belong.")
    for page in (f"<article><h1>Title</h1>{PROSE}{own}{PROSE}</article>", f"{own}<article><h1>Title</h1>{PROSE * 2}</article>", f"<div><h1>Title</h1>{PROSE}{own}{PROSE}</div>"):
        text = htmltext.main_text(f"<html><body>{page}</body></html>")
        assert "do not belong" not in text and text.count("Paragraph number") == 16


def test_names_and_words():
    assert htmltext._named("ad-hoc token notice-period") == set() and htmltext._named("x Ad-Slot_3") == {"ad"} and htmltext._named("cookie-consent-banner") == {"cookie", "consent", "banner"} and htmltext._named("box 3 -") == set()


def plain_selection(tree, d):
    """The text by the rules as the module's docstring has them, with ancestors looked up one by one."""
    n, body = len(tree.tag), next((i for i, t in enumerate(tree.tag) if t == "body"), 0)

    def up(i):
        out = [i]
        while out[-1]:
            out.append(tree.parent[out[-1]])
        return out

    if any(p.strip() and body not in up(i) and not tree.drop[i] for i, p in tree.pieces):
        body = 0
    blocks = [i for i in range(n) if body in up(i) and not tree.drop[i] and tree.tag[i] not in htmltext.INLINE]
    core = max(blocks, key=lambda i: (d.total[i], -i)) if blocks else body
    path = up(core)[: up(core).index(body) + 1]
    least = min(d.density[i] for i in path)
    outer = path[max([k for k in range(len(path)) if all(d.density[i] >= htmltext.CLIMB * d.density[core] for i in path[: k + 1])], default=0)]
    article = next((i for i in path[path.index(outer) :] if tree.tag[i] == "article"), None)
    block = lambda i: tree.tag[i] not in htmltext.INLINE
    content = {i for i in range(n) if outer in up(i)}
    heads = [i for i in range(outer) if tree.tag[i] in htmltext.HEADINGS and not tree.drop[i] and tree.parent[i] in path[path.index(outer) :] and d.chars[i]]
    tops = {outer} | ({heads[-1]} if heads and not any(tree.tag[i] in htmltext.HEADINGS for i in content) else set())
    tops |= {i for i in range(1, n) if article is not None and article in up(i) and block(i) and d.density[i] >= least} if article is not None else set()
    tops |= {i for i in content if i and block(i) and d.density[i] >= least}
    menus = {i for i in range(1, n) if block(i) and i not in path and not tree.in_article[i] and d.density[i] < least and 2 * d.links[i] > d.chars[i] and d.link_tags[i] > 1}
    shown = lambda i: tops & set(up(i)) and not tree.drop[i] and not menus & set(up(i))
    return " ".join("".join(" " if not p or tree.tag[i] == "br" else p for i, p in tree.pieces if not p or shown(i)).split())


def test_selection_against_a_plain_version():
    rng = random.Random(17)
    blocks, leaves = ["div", "section", "article", "ul", "main", "blockquote"], ["p", "h2", "li", "a", "span", "b"]

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            tag = rng.choice(leaves)
            words = " ".join("".join(rng.choices("abcde", k=rng.randrange(1, 8))) for _ in range(rng.choice([1, 2, 4, 30])))
            return f"<{tag}{' href=/x' if tag == 'a' else ''}>{words}</{tag}>"
        tag = rng.choice(blocks)
        name = rng.choice(["", "", "", ' class="ad"', ' class="related"', ' id="notice-period"'])
        return f"<{tag}{name}>" + "".join(part(depth - 1) for _ in range(rng.randrange(1, 6))) + f"</{tag}>"

    shown = 0
    for _ in range(400):
        page = "<html><body>" + "".join(part(4) for _ in range(rng.randrange(1, 4))) + "</body></html>"
        tree = htmltext.parse(page)
        want = plain_selection(tree, htmltext.densities(tree))
        assert htmltext.main_text(page) == want
        shown += bool(want)
    assert shown > 300
