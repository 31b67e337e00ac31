"""Leaf blocks of a web page and their features; labelled pages to learn from."""
from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

# what a browser lays out inside a line; every other element starts a block
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rtc rp s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# an open element of the first kind ends where one of the second begins
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
SCOPE = frozenset("ul ol dl table div section article main body html select td".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    marks: tuple[str, ...]  # features of the ancestors
    tag: str
    linked: int  # characters inside links


@dataclass
class _Open:
    tag: str
    marks: tuple[str, ...]


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)

    def end_block(self) -> None:
        words = html.unescape("".join(self.text)).split() if self.text else []
        if words:
            inner = next((o.tag for o in reversed(self.stack) if o.tag not in INLINE), "body")
            marks = [m for o in self.stack for m in o.marks]
            self.blocks.append(Block(" ".join(words), tuple(dict.fromkeys(marks)), inner, self.linked))
        self.text, self.linked = [], 0


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    found = [f"in:{tag}"]
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.append("hidden")
        elif name == "style":
            if "display:none" in value.replace(" ", ""):
                found.append("hidden")
        elif name in ("class", "id", "role"):
            found.extend(f"name:{p}" for p in NAME_PART.findall(value))
    return tuple(found)


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order; scripts, styles, comments and markup are left out."""
    p, at, links = _Page(), 0, 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            p.text.append(piece)
            if links:
                p.linked += len(piece)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[2] or m[5]) == "/", m[4] or m[7] or ""
        inline = tag in INLINE
        if tag == "br":
            p.text.append(" ")
            continue
        if not inline:
            p.end_block()
        if closing:
            at_open = next((i for i in range(len(p.stack) - 1, -1, -1) if p.stack[i].tag == tag), -1)
            # an inline end tag does not end the block it stands in
            if at_open >= 0 and not (inline and any(o.tag not in INLINE for o in p.stack[at_open + 1 :])):
                del p.stack[at_open:]
        elif tag not in VOID:
            if not inline:
                _close_before(p.stack, tag)
            p.stack.append(_Open(tag, _marks(tag, attributes)))
        if tag == "a":
            links = sum(o.tag == "a" for o in p.stack)
        elif not inline:
            links = sum(o.tag == "a" for o in p.stack)
    p.text.append(page[at:])
    p.end_block()
    return p.blocks


def _close_before(stack: list[_Open], tag: str) -> None:
    """End what a new block element ends: a paragraph, or an item of the same list."""
    for i in range(len(stack) - 1, -1, -1):
        own = stack[i].tag
        if own == "p" or tag in CLOSED_BY.get(own, ()):
            del stack[i:]
            return
        if own in SCOPE:
            return


def _step(n: float, *limits: float) -> int:
    return sum(n >= x for x in limits)


def block_features(blocks: list[Block]) -> list[list[str]]:
    out = []
    total = len(blocks)
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        marks = b.marks
        found = [
            *marks,
            "tag:" + b.tag,
            f"words:{_step(words, 3, 6, 12, 25, 60)}",
            f"linked:{_step(b.linked / n, 0.05, 0.5, 0.9)}",
            f"points:{_step(sum(map(b.text.count, '.,;!?')), 1, 3, 8)}",
            "ends:" + ("point" if b.text[-1] in ".!?:" else "other"),
            f"place:{int(5 * i / total)}",
        ]
        if "©" in b.text or "copyright" in b.text.lower():
            found.append("copyright")
        if "in:article" in marks or "in:main" in marks:
            found.append("inside")
            found.append("inside:" + b.tag)
        out.append(found)
    return out


# ---------------------------------------------------------------- labelled pages
_CONTENT = "content post entry story body text article main page detail".split()
_EXTRA = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar links tabs".split(),
    "head": "header masthead banner branding logo top".split(),
    "foot": "footer foot legal copyright bottom colophon".split(),
    "side": "sidebar aside widget related recommended popular trending rail".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe disclaimer".split(),
    "ad": "ad ads advert advertisement promo promoted sponsor sponsored adsense".split(),
    "share": "share social tags meta author byline login signup search pagination pager".split(),
    "talk": "comment comments reply replies discussion responses disqus thread".split(),
}


_NEUTRAL = "x y box col row wrap inner block clearfix left right lead item large text-md main-area".split()


def _class(r: random.Random, *names: str) -> str:
    """A class attribute with the given names among others that say nothing."""
    own = [*names, *r.sample(_NEUTRAL, r.choice([0, 0, 0, 1, 2]))]
    r.shuffle(own)
    return f' class="{" ".join(own)}"' if own else ""


def _prose(r: random.Random, low: int, high: int) -> str:
    parts = ["ka", "to", "mi", "ren", "sol", "va", "du", "lis", "on", "er", "th", "ique", "ung", "cion"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    out = []
    for w in words:
        out.append(w + r.choice(["", "", "", "", "", ",", ".", ".", "!"]) if r.random() < 0.3 else w)
    return " ".join(out).capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def _links(r: random.Random) -> str:
    n = r.randint(2, 9)
    if r.random() < 0.7:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_prose(r, 1, 3)}</a></li>' for i in range(n)) + "</ul>"
    return " | ".join(f'<a href="/{i}">{_prose(r, 1, 2)}</a>' for i in range(n))


def _extra(r: random.Random, kind: str) -> str:
    name = r.choice(_EXTRA[kind])
    where = r.choice([_class(r, name), f' id="{name}"', _class(r, f"{name}-box"), _class(r, name) + f' role="{name}"']).strip()
    tag = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside"}.get(kind, "section")
    start, end = r.choice([(f"<{tag}>", f"</{tag}>"), (f"<{tag} {where}>", f"</{tag}>"), (f"<div {where}>", "</div>")])
    if kind not in ("menu", "head", "foot", "side"):
        start, end = r.choice([(f"<div {where}>", "</div>"), (f"<section {where}>", "</section>")])
    if kind == "menu":
        body = _links(r)
    elif kind == "head":
        body = f"<h1>{_prose(r, 1, 4)}</h1>" if r.random() < 0.5 else f"<p>{_prose(r, 2, 9)}</p>{_links(r)}"
    elif kind == "foot":
        body = r.choice([f"&copy; {_prose(r, 2, 14)}", f"<p>&copy; 2020 {_prose(r, 1, 8)}</p>{_links(r)}", _prose(r, 4, 20)])
    elif kind == "side":
        body = r.choice([f"<h3>{_prose(r, 1, 4)}</h3>{_links(r)}", f"<p>{_prose(r, 8, 40)}</p>"])
    elif kind == "talk":
        body = f"<h3>{_prose(r, 1, 3)}</h3>" + "".join(
            f'<div class="comment"><b>{_prose(r, 1, 2)}</b><p>{_prose(r, 5, 60)}</p></div>' for _ in range(r.randint(1, 5))
        )
    elif kind == "share":
        body = r.choice([_links(r), f"<span>{_prose(r, 1, 5)}</span>", f'<form><input name="q"><button>{_prose(r, 1, 2)}</button></form>'])
    else:
        body = r.choice([f"<p>{_prose(r, 1, 30)}</p>", _prose(r, 1, 25), f"<p>{_prose(r, 4, 20)}</p><button>{_prose(r, 1, 2)}</button>"])
        if r.random() < 0.2:
            return f"<p {where}>{_prose(r, 1, 25)}</p>"
    return start + body + end


def _form(r: random.Random) -> str:
    options = "".join(f"<option>{_prose(r, 1, 2)}</option>" for _ in range(r.randint(0, 4)))
    return f"<form><label>{_prose(r, 1, 3)}</label><select>{options}</select><input><p>{_prose(r, 2, 12)}</p><button>{_prose(r, 1, 2)}</button></form>"


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_prose(r, 3, 12)}</h1>"] if r.random() < 0.7 else []
    for _ in range(r.randint(1, 9) if parts and r.random() < 0.8 else r.randint(1, 2)):
        kind = r.random()
        if kind < 0.7:
            text = _prose(r, *r.choice([(1, 3), (1, 25), (1, 120)]))
            if r.random() < 0.1:
                text = text.upper().replace(" ", r.choice(["!! ", " "]))
            if r.random() < 0.3:
                text = f"<b>{text}" + ("</b>" if r.random() < 0.6 else "<br>")
            if r.random() < 0.3:
                text += f' <a href="/z">{_prose(r, 1, 4)}</a> {_prose(r, 2, 20)}'
            parts.append(f"<p{_class(r)}>{text}" + ("</p>" if r.random() < 0.8 else ""))
        elif kind < 0.78:
            parts.append(f"<h2>{_prose(r, 1, 8)}</h2>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_prose(r, 2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{_prose(r, 5, 40)}</blockquote>")
        elif kind < 0.96:
            parts.append(f"<table><tr><td>{_prose(r, 1, 6)}</td><td>{_prose(r, 1, 6)}</td></tr></table>")
        else:
            parts.append(f"<pre>{_prose(r, 3, 20)}</pre>")
    name = r.choice(_CONTENT)
    start, end = r.choice(
        [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), (f"<div{_class(r, name)}>", "</div>"), (f"<article{_class(r)}>", "</article>"), (f'<div id="{name}">', "</div>"), (f'<main><article class="{name}">', "</article></main>"), ("", "")]
    )
    return start + "".join(parts) + end


def labelled_pages(n: int, seed: int = 3) -> list[tuple[list[Block], list[int]]]:
    """Pages of varied layout, with each leaf block marked 1 (article) or 0.

    A block of the article is marked by how it was made, so the labels are exact.
    """
    r = random.Random(seed)
    out = []
    for _ in range(n):
        before = [_extra(r, k) for k in ("menu", "head", "notice", "ad", "share") if r.random() < 0.5]
        after = [_extra(r, k) for k in ("side", "ad", "share", "talk", "foot", "notice", "menu") if r.random() < 0.5]
        if r.random() < 0.3:
            after.append(_form(r))
        r.shuffle(before)
        alone = r.random()
        before = [] if alone < 0.15 else before
        after = [] if 0.1 < alone < 0.25 else after
        article = _article(r)
        if r.random() < 0.5:  # something foreign inside the article
            cut = article.rfind("</")
            article = article[:cut] + _extra(r, r.choice(["ad", "share", "talk", "talk", "side", "notice"])) + article[cut:]
        head = f"<html><head><title>{_prose(r, 2, 9)}</title></head><body>" if r.random() < 0.7 else ""
        marked = re.sub(r">([^<>]+)(?=<|$)", r">@@\1", article) if article.startswith("<") else article
        blocks = leaf_blocks(head + "".join(before) + marked + "".join(after) + "</body></html>")
        labels = []
        for b in blocks:
            own = "@@" in b.text
            b.text = " ".join(b.text.replace("@@", "").split()) or "-"
            foreign = any(m[5:] in _FOREIGN for m in b.marks if m.startswith("name:")) or "in:aside" in b.marks or "in:form" in b.marks
            labels.append(int(own and not foreign))
        out.append((blocks, labels))
    return out


_FOREIGN = frozenset(x for k, v in _EXTRA.items() for x in v)
