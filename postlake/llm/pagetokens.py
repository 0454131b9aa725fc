"""HTML pages as streams of block tags and texts."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of the HTML standard by their part in a page.
CONTAINERS = frozenset(
    "html body nav div article section main aside header footer form ul ol dl table thead tbody tfoot figure "
    "blockquote details dialog fieldset menu center search hgroup address".split()
)
BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td th tr dt dd pre hr caption figcaption summary legend option".split())
SKIPPED = frozenset("script style noscript template svg math iframe object textarea select button title canvas audio video head".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BREAKS = frozenset("br wbr img input".split())

# Elements, and parts of class names and ids, that mark what is not the article.
AROUND_TAGS = frozenset("nav aside footer form menu dialog search".split())
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended widget search pagination pager skip toolbar masthead topbar copyright".split()
)
OUTSIDE_TAGS = frozenset(["header"])
OUTSIDE_NAMES = frozenset(["header", "head", "top"])
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")


@dataclass(frozen=True)
class Text:
    """A block's text with the stack of containers it stands in, and the symbol of the block itself."""

    text: str
    path: tuple[str, ...]
    around: bool
    in_main: bool
    block: str = ""


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(source)} if source.strip() else {}


def _around(tag: str, names: tuple[str, ...], held: dict[str, str], in_main: bool) -> bool:
    if tag in AROUND_TAGS or held.get("role", "").lower() in AROUND_ROLES:
        return True
    if not in_main and (tag in OUTSIDE_TAGS or OUTSIDE_NAMES.intersection(names)):
        return True
    if "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", ""):
        return True
    return tag not in ("html", "body", *MAIN_TAGS) and bool(AROUND_NAMES.intersection(names))


def tokens(source: str | None) -> list[str | Text]:
    """Tags of containers and blocks (`name.class` or `/name`) and the texts between them, in order.

    Inline tags are part of the text, `br` is white space in it. Character references are decoded, white
    space becomes one space, empty texts are left out. End tags without start are ignored; end tags of
    blocks are left out because pages leave them out.
    """
    out: list[str | Text] = []
    stack: list[tuple[str, str, bool, bool]] = []  # tag, symbol, boilerplate, inside the article
    block_around, block = False, ""
    parts: list[str] = []
    at, skip = 0, ""
    if not source:
        return out

    def flush() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            around = block_around or any(s[2] for s in stack)
            out.append(Text(text, tuple(s[1] for s in stack), around, any(s[3] for s in stack), block))

    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue
        if not skip:
            parts.append(source[at : m.start()])
        at = m.end()
        if m[1] is not None:
            if not skip:
                parts.append(html.escape(m[1], quote=False))
            continue
        closing, tag, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            continue
        tag = tag.lower()
        if skip:
            # A head ends where the body begins, even without its end tag.
            if (closing and tag == skip) or (skip == "head" and not closing and tag == "body"):
                skip = ""
                if closing:
                    continue
            else:
                if not closing and tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
        if tag in SKIPPED:
            if not closing and not rest.rstrip().endswith("/"):
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    parts.append(" " if tag == "noscript" else "")
                else:
                    skip = tag
            continue
        if tag in BREAKS:
            parts.append(" ")
            continue
        if tag not in CONTAINERS and tag not in BLOCKS:
            continue
        flush()
        block_around, block = False, ""
        if closing:
            if tag in CONTAINERS and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                out.append("/" + tag)
            continue
        held = _attributes(rest)
        names = tuple(p for p in _PART.split(f"{held.get('class', '')} {held.get('id', '')}".lower()) if p and not p.isdigit())
        in_main = any(s[3] for s in stack)
        around = _around(tag, names, held, in_main)
        symbol = ".".join((tag, *names))
        out.append(symbol)
        if tag in CONTAINERS:
            main = tag in MAIN_TAGS or held.get("role", "").lower() == "main" or held.get("itemprop") == "articleBody"
            if not rest.rstrip().endswith("/"):
                stack.append((tag, symbol, around, main))
        else:
            block_around, block = around, symbol
    if not skip:
        parts.append(source[at:])
        flush()
    return out
