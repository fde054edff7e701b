"""HTML as a tree of block elements and text runs, and labelled pages to learn its parts from."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

# Element names of the HTML standard, by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style title textarea iframe noembed noframes noscript template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
HOLDERS = frozenset("ul ol dl table body html div article section main td th blockquote".split())

# What common class names, ids and roles tell about a block.
HINTS = {
    "content": "article content post entry story main body text",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs toolbar",
    "top": "header masthead topbar logo branding",
    "bottom": "footer copyright legal colophon contentinfo",
    "side": "sidebar aside related widget rail recommended popular trending tags complementary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall dialog",
    "comment": "comment comments disqus reply replies respond discussion",
    "share": "share sharing social follow",
    "form": "form search login register contact",
    "hidden": "hidden invisible",
}
_HINT = {word: kind for kind, names in HINTS.items() for word in names.split()}
KINDS = {
    "article": "article main", "box": "div section center details hgroup", "menu": "nav menu", "top": "header", "bottom": "footer", "side": "aside",
    "form": "form fieldset button select option label legend input search", "list": "ul ol dl dir", "item": "li dt dd", "para": "p blockquote pre address",
    "head": "h1 h2 h3 h4 h5 h6", "table": "table thead tbody tfoot tr td th caption", "figure": "figure figcaption", "page": "html body",
    "media": "svg math canvas object video audio map dialog",
}
_KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|gold|junk)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    """A block element, or (tag ``#text``) a run of inline text, raw."""

    tag: str
    parent: int
    hints: frozenset[str] = frozenset()
    mark: int | None = None
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _hints(attributes: str) -> tuple[frozenset[str], int | None]:
    found, mark = set(), None
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name = name.lower()
        if name in ("gold", "junk"):
            mark = int(name == "gold")
        elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and re.search(r"display\s*:\s*none", value):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            found |= {_HINT[part] for part in map(str.lower, _PART.findall(value)) if part in _HINT}
    return frozenset(found), mark


def parse(page: str) -> list[Node]:
    """Nodes in document order, parents first; the first is the page itself."""
    nodes, stack, links = [Node("html", -1)], [0], 0
    run: Node | None = None
    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        raw = token[0]
        name = token[2] or token[5]
        if name is None:
            if raw.startswith(("<!", "<?")):
                continue
            if run is None:
                run = Node("#text", stack[-1])
                nodes.append(run)
            run.parts.append(raw)
            if links:
                run.linked += len(raw)
            continue
        name, ending, attributes = name.lower(), token[1] or token[4], token[3] or token[6] or ""
        if name in DROPPED:
            if not ending and not attributes.endswith("/"):
                closing = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = closing.end() if closing else size
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if ending else 1
            elif name == "br" and run is not None:
                run.parts.append("\n")
            continue
        if name in ("html", "head"):
            continue
        run = None
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == name:
                    del stack[depth:]
                    links = 0
                    break
            continue
        links = 0 if name not in VOID else links
        if name in CLOSES_P or name in SIBLINGS:
            closed = ("p",) if name in CLOSES_P else SIBLINGS[name]
            for depth in range(len(stack) - 1, 0, -1):
                tag = nodes[stack[depth]].tag
                if tag in closed:
                    del stack[depth:]
                    break
                if tag in HOLDERS:
                    break
        if name in VOID or attributes.endswith("/") and name not in CLOSES_P:
            continue
        hints, mark = _hints(attributes)
        nodes.append(Node(name, stack[-1], hints, mark))
        stack.append(len(nodes) - 1)
    for node in nodes:
        if node.parts:
            node.text = " ".join(html.unescape("".join(node.parts)).split())
            node.parts.clear()
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of what holds for each node."""
    out, mass = [], [len(node.text) - node.linked if node.text else 0 for node in nodes]
    for place in range(len(nodes) - 1, 0, -1):
        mass[nodes[place].parent] += mass[place]
    whole = max(mass[0], 1)
    for place, node in enumerate(nodes):
        held = 10 * mass[place] // whole
        share = f"mass:{(held > 0) + (held > 3) + (held > 7)}"
        if node.tag != "#text":
            kind = _KIND.get(node.tag, "other")
            out.append(["block", f"kind:{kind}", share, *(f"hint:{hint}" for hint in sorted(node.hints))])
            continue
        size, above = len(node.text), nodes[node.parent].tag if node.parent >= 0 else "html"
        own = ["text", share, f"in:{_KIND.get(above, 'other')}", f"size:{(size > 0) + (size > 25) + (size > 80) + (size > 200)}"]
        links = node.linked / max(size, 1)
        own.append(f"linked:{(links > 0) + (links > 0.4) + (links > 0.8)}")
        if node.text[-1:] in tuple(".!?:;\"'”»"):
            own.append("ends")
        if "©" in node.text:
            own.append("rights")
        out.append(own)
    return out


def gold_states(nodes: list[Node]) -> list[int]:
    """Of a labelled page: 0 for blocks outside the article, 1 inside, 2 around it."""
    marks, whole, some = [], [1] * len(nodes), [0] * len(nodes)
    for node in nodes:
        marks.append(node.mark if node.mark is not None else marks[node.parent] if node.parent >= 0 else 0)
    for place in range(len(nodes) - 1, -1, -1):
        node = nodes[place]
        if node.tag == "#text":
            whole[place] = some[place] = marks[place]
        if node.parent >= 0 and (node.tag == "#text" or some[place] or not whole[place]):
            whole[node.parent] &= whole[place]
            some[node.parent] |= some[place]
    return [1 if marks[k] and (nodes[k].tag != "#text") or node.tag == "#text" and marks[k] else 2 if some[k] else 0 for k, node in enumerate(nodes)]


class _Writer:
    """Labelled pages from a few layouts: ``gold`` marks the article, ``junk`` what stands in it but does not belong to it."""

    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        pick = self.pick
        made = ["".join(pick.choice(("ba", "re", "ti", "lon", "de", "mar", "so", "en", "vi", "ka")) for _ in range(pick.randint(1, 4)))
                for _ in range(pick.randint(low, high))]
        style = pick.random()
        if style < 0.1:
            return " ".join(word.upper() + "!!" for word in made)
        if style < 0.2:
            return " ".join(word + pick.choice(("%%%", "###", " |", "***")) for word in made)
        return " ".join(made).capitalize() + pick.choice((".", ".", ".", ".", ""))

    def links(self, low: int, high: int, inside: str = "li") -> str:
        return "".join(f'<{inside}><a href="/x">{self.words(1, 3)}</a></{inside}>' for _ in range(self.pick.randint(low, high)))

    def body(self) -> str:
        pick, out = self.pick, []
        if pick.random() < 0.8:
            out.append(f"<h1>{self.words(2, 9)}</h1>")
        for _ in range(pick.randint(1, 9)):
            kind = pick.random()
            if kind < 0.62:
                text = self.words(*pick.choice(((1, 2), (4, 12), (20, 60), (60, 120))))
                if pick.random() < 0.2:
                    text += f' <a href="/y">{self.words(1, 3)}</a> {self.words(2, 8)}'
                out.append(f"<p>{text}</p>" if pick.random() < 0.8 else f"<p><b>{text}<br>")
            elif kind < 0.72:
                out.append(f"<h2>{self.words(2, 6)}</h2>")
            elif kind < 0.79:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(pick.randint(2, 5))) + "</ul>")
            elif kind < 0.83:
                out.append(f"<blockquote><p>{self.words(8, 30)}</p></blockquote>")
            elif kind < 0.86:
                out.append(f"<table><tr><th>{self.words(1, 2)}</th><td>{self.words(1, 6)}</td></tr></table>")
            elif kind < 0.89:
                out.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif kind < 0.9:
                out.append(f"<pre>{self.words(5, 20)}</pre>")
            elif kind < 0.94:
                out.append(f"{self.words(1, 30)}<br><br>{self.words(3, 20)}")
            else:
                out.append(self.aside().replace(">", " junk>", 1))
        return "".join(out)

    def aside(self) -> str:
        return self.pick.choice((
            lambda: f'<div class="{self.pick.choice(("ad", "ads-box", "advert", "sponsored", "promo"))}">{self.words(2, 30)}</div>',
            lambda: f"<aside><h3>{self.words(1, 3)}</h3><ul>{self.links(2, 5)}</ul></aside>",
            lambda: f"<aside><p>{self.words(5, 40)}</p></aside>",
            lambda: f'<div class="{self.pick.choice(("share", "social-links"))}">{self.links(2, 4, "span")}</div>',
            lambda: f'<div class="{self.pick.choice(("newsletter", "cookie-notice", "notice", "consent-banner", "alert"))}"><p>{self.words(4, 40)}</p>'
                    f"<button>{self.words(1, 2)}</button></div>",
            lambda: f"<form action='/s'><label>{self.words(1, 3)}</label><input><p>{self.words(2, 15)}</p><button>{self.words(1, 1)}</button></form>",
            lambda: f'<div class="{self.pick.choice(("related", "sidebar", "widget popular"))}"><h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul></div>',
        ))()

    def comments(self) -> str:
        each = self.pick.choice(("div", "li", "article"))
        made = "".join(f'<{each} class="comment"><b>{self.words(1, 2)}</b><p>{self.words(3, 60)}</p></{each}>' for _ in range(self.pick.randint(1, 4)))
        return f'<section {self.pick.choice(("id", "class"))}="comments"><h3>{self.words(1, 2)}</h3>{made}</section>'

    def page(self) -> str:
        pick, bare = self.pick, self.pick.random()
        if bare < 0.05:
            return f"<html><body gold>{self.body()}</body></html>"
        if bare < 0.13:
            return "".join(f"<{tag} gold>{self.words(2, 40)}</{tag}>" for tag in pick.choices(("p", "p", "p", "h1", "div"), k=pick.randint(1, 6)))
        if bare < 0.2:
            return f"<nav><ul>{self.links(1, 6)}</ul></nav><article gold>{self.words(1, 30)}</article>"
        top = pick.choice((
            lambda: f"<nav><ul>{self.links(2, 8)}</ul></nav>",
            lambda: f'<header><div class="logo"><a href="/">{self.words(1, 2)}</a></div><nav><ul>{self.links(2, 7)}</ul></nav></header>',
            lambda: f'<div id="header"><h1>{self.words(1, 3)}</h1><p>{self.words(2, 9)}</p></div><div class="menu"><ul>{self.links(2, 7)}</ul></div>',
            lambda: f"<header><p>{self.words(2, 20)}</p></header>",
            lambda: ""))()
        opened, closed = pick.choice((
            ("<article gold>", "</article>"), ("<article gold>", "</article>"), ("<main><article gold>", "</article></main>"), ("<main gold>", "</main>"),
            ('<div class="post-content" gold>', "</div>"), ('<div id="content"><div gold>', "</div></div>"), ("<div gold>", "</div>"),
            ('<section class="story" gold>', "</section>"), ("<table><tr><td gold>", "</td></tr></table>")))
        parts = [top]
        parts += [self.aside() for _ in range(pick.randint(0, 2))]
        parts.append(opened + self.body() + closed)
        if pick.random() < 0.35:
            parts.append(self.comments())
        parts += [self.aside() for _ in range(pick.randint(0, 2))]
        parts.append(pick.choice((
            lambda: f"<footer>&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}</footer>",
            lambda: f'<div class="footer"><p>&copy; {self.words(2, 8)}</p><ul>{self.links(1, 5)}</ul></div>',
            lambda: f"<footer><p>{self.words(4, 30)}</p><ul>{self.links(1, 4)}</ul></footer>",
            lambda: ""))())
        inner = "".join(parts)
        return f"<html><head><title>{self.words(1, 4)}</title></head><body>" + (f'<div class="page">{inner}</div>' if pick.random() < 0.4 else inner) + "</body></html>"


def labelled_pages(count: int, seed: int = 11) -> list[str]:
    """The same labelled pages on every call."""
    writer = _Writer(seed)
    return [writer.page() for _ in range(count)]
