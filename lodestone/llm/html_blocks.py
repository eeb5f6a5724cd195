"""Blocks of visible text of an HTML page, with what their place in the document says about them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import takewhile

#: What follows a tag's name; a quote opens a value only after an equals sign.
REST = r"""((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)"""
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)" + REST, re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Kinds of elements.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary
table tbody td tfoot th thead tr ul""".split())
UNSHOWN = frozenset("script style title template noscript iframe textarea svg annotation annotation-xml object audio video canvas select noframes".split())
#: Those of raw text: without an end tag they go to the end of the page, as in browsers.
RAW = frozenset("script style title textarea noscript iframe noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind ends open ones of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements, and words in class, id and role, that hold no main text, or hold it.
FRAME = frozenset("nav footer aside form menu dialog button fieldset".split())
AGAINST = frozenset("""ad ads adv advert advertisement adverts advertising adsense adsbygoogle sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside
footer foot comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe subscription
signup login search pagination pager toolbar widget copyright complementary contentinfo""".split())
#: Such words written together, as commentlist or adslot: one of the first, then one of the second.
AGAINST_STARTS = "ads? advert comments? sponsor cookies? newsletter sidebar breadcrumbs? nav navbar navigation footer related subscribe promo popup".split()
AGAINST_ENDS = """area author bar block body bottom box column consent container content count entry field footer form header holder inner item
items label left line link links list main menu message meta nav navigation note notice overlay panel post posts region reply right row section
signup slot space text thread title toggle top unit widget wrap wrapper zone""".split()
COMPOUND = re.compile(f"(?:{'|'.join(AGAINST_STARTS)})(?:{'|'.join(AGAINST_ENDS)})s?")
#: Words that speak against an element only where they are the whole name: legal, but not legal-analysis.
AGAINST_ALONE = frozenset("legal".split())
#: Elements and words that also stand on a wrapper of the whole page, as <form> or sidebar-right do.
WIDE = frozenset("form fieldset".split())
WIDE_HINTS = frozenset("nav navbar navigation menu sidebar aside search widget modal overlay popup legal social".split())
#: From one of these on a class speaks of the page, not of the element, as in has-sidebar or content-with-sidebar.
ABOUT_PAGE = frozenset("has with without no is".split())
HEAD = frozenset("header masthead head".split())
FOR = frozenset("article articlebody main content entry post story".split())


@dataclass(eq=False)
class Hint:
    """An element that speaks against all inside it, the next such one around it, and whether it may be a wrapper of the page."""

    outer: Hint | None
    wide: bool
    lifted: bool = False


@dataclass(eq=False)
class Element:
    """An open element; what it says holds for all inside it."""

    up: Element | None
    tag: str
    depth: int = 0
    inside: bool = False
    header: bool = False
    article: bool = False
    hidden: bool = False
    hint: Hint | None = None


@dataclass(eq=False)
class Block:
    """Text with its place.

    The hint is the innermost that speaks against it, and hints are lifted from the outermost on; ``hidden``
    elements never wrap the page.
    """

    text: str
    place: Element
    linked: int = 0

    @property
    def tag(self) -> str:
        return self.place.tag

    @property
    def inside(self) -> bool:
        return self.place.inside

    @property
    def header(self) -> bool:
        return self.place.header

    @property
    def article(self) -> bool:
        return self.place.article

    @property
    def hidden(self) -> bool:
        return self.place.hidden

    @property
    def hint(self) -> Hint | None:
        hint = self.place.hint
        return None if hint is None or hint.lifted else hint

    @property
    def against(self) -> bool:
        return self.place.hidden or self.hint is not None


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=lambda: [Element(None, "")])
    opened: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    linking: bool = False

    def say(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.pieces.append(text)
            if self.linking:
                self.links.append(text)

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(text, self.stack[-1], len(" ".join("".join(self.links).split()))))
        self.pieces.clear()
        self.links.clear()
        self.linking = False

    def open(self, tag: str, attributes: str) -> None:
        if self.stack[-1].tag == "p":
            self.pop()
        while self.stack[-1].tag in ENDS.get(tag, ()):
            self.pop()
        if tag == "hr":
            return
        up, hints, against, hidden = self.stack[-1], set(), set(), False
        if attributes.strip() and tag not in ("html", "body"):
            for name, value in ATTRIBUTE.findall(attributes):
                if name.lower() in ("class", "id", "role", "itemprop"):
                    for word in value.strip("\"'").split():
                        parts = [x.lower() for x in HINT.findall(word)]
                        said = set(takewhile(lambda x: x not in ABOUT_PAGE, parts))
                        hints |= said
                        against |= {x for x in said if x in AGAINST or COMPOUND.fullmatch(x) or len(parts) == 1 and x in AGAINST_ALONE}
                hidden |= name.lower() == "hidden" or name.lower() == "style" and "display:none" in value.replace(" ", "").lower()
        article = tag in ("article", "main")
        hint = Hint(up.hint, against <= WIDE_HINTS) if against or tag in WIDE else up.hint
        self.opened[tag] += 1
        self.stack.append(Element(
            up, tag, up.depth + 1, up.inside or article or bool(hints & FOR) and not against, up.header or tag == "header" or bool(hints & HEAD and tag != "body"),
            up.article or article, up.hidden or tag in FRAME - WIDE or hidden, hint,
        ))

    def pop(self) -> None:
        self.opened[self.stack.pop().tag] -= 1

    def close(self, tag: str) -> None:
        if self.opened[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()


def ends(page: str, tag: str) -> dict[int, int]:
    """Place after the opening tag, and after its own end tag, of every element of the tag that has one."""
    inner = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b[^>]*(?<!/)>.*?(?:</\1\b|\Z)|<(/?){re.escape(tag)}(?![\w-])" + REST, re.I | re.S)
    found, opened = {}, []
    for m in inner.finditer(page):
        if m[2] is None:
            continue
        if m[2]:
            if opened:
                found[opened.pop()] = m.end()
        elif not m[0].rstrip("> \n").endswith("/"):
            opened.append(m.end())
    return found


def blocks(page: str) -> list[Block]:
    """The text between block-level tags, in page order; inline tags and line breaks don't end a block."""
    held, at = _Page(), 0
    ended: dict[str, dict[int, int]] = {}
    while (token := TOKEN.search(page, at)) is not None:
        held.say(page[at : token.start()])
        at = token.end()
        closing, tag, attributes = token[1], (token[2] or "").lower(), token[3] or ""
        if not tag:
            continue
        if tag in UNSHOWN and not closing:
            if tag in BLOCK:
                held.flush()
            if tag not in RAW:
                if tag not in ended:
                    ended[tag] = ends(page, tag)
                at = ended[tag].get(at, at)
            elif not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "br":
            held.say(" ")
        elif tag == "a":
            held.linking = not closing
        elif tag in BLOCK:
            held.flush()
            held.close(tag) if closing else held.open(tag, attributes)
    held.say(page[at:])
    held.flush()
    return held.blocks
