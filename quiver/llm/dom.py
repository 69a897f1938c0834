"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo mrow mfrac msup msub msubsup msqrt mroot mtext mover munder munderover mstyle semantics".split())
NOT_SHOWN = frozenset("script style title textarea template iframe svg select option head".split())
RAW = frozenset("script style title textarea iframe".split())    # their content isn't markup; noscript's neither in a head
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_SAME = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
               "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: block-level tags that end an open paragraph
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                   "nav ol p pre section table ul".split())

#: tags that end an open select, option or svg, which can't hold them
BREAKS_OUT = ENDS_P | frozenset("body center dd dt figure li td th tr".split())

#: start and end tags of what hides its content, outside comments and raw content
_HIDING = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe)\b.*?(?:</\1\s*>|\Z)"""
                     r"""|<(?P<end>/?)(?P<tag>template|svg|select)(?=[\s/>])""", re.DOTALL | re.IGNORECASE)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?P<close>>|\Z)""",
                    re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    path: tuple                  # (tag, name parts) of every block-level or named ancestor, outermost first
    text: str
    linked: int                  # code points inside links


def _name_parts(rest: str) -> tuple:
    found = _NAMES.findall(rest)
    return tuple(sorted({p for value in found for p in _PART.findall(_CAMEL.sub("-", value).lower()) if len(p) > 1}))


def _never_closed(html: str) -> set[int]:
    """Where the start tags of template, svg and select without an end tag of their own begin."""
    opened: dict[str, list[int]] = {}
    for m in _HIDING.finditer(html):
        if m["tag"]:
            at = opened.setdefault(m["tag"].lower(), [])
            if not m["end"]:
                at.append(m.start())
            elif at:
                at.pop()
    return {i for at in opened.values() for i in at}


def blocks(html: str) -> list[Block]:
    """All non-empty leaf blocks in page order.

    White space inside a block is one space, character references are decoded.
    A tag or comment cut off by the end of the page is dropped, a ``<`` that
    begins no tag is text. A head ends at the first thing that can't be in it; a
    select, svg or template that is never closed hides nothing after it.
    """
    found: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    pieces: list[str] = []
    linked, links, hidden, at = 0, 0, 0, 0
    endless: set[int] | None = None          # looked up when a page has such a tag

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append(Block(tuple(e for e in stack if e[0] not in INLINE or e[1]), text, linked))
            pieces.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            hidden -= tag in NOT_SHOWN
        del stack[depth:]

    def break_out(tag: str) -> None:
        """Close the hidden elements that can't hold this tag, but none around a template or an svg's HTML."""
        cut = None
        for i in range(len(stack) - 1, -1, -1):
            open_tag = stack[i][0]
            if open_tag in ("template", "foreignobject"):
                break
            if open_tag == "head" and tag not in IN_HEAD or open_tag in ("select", "option", "svg") and tag in BREAKS_OUT:
                cut = i
        if cut is not None:
            pop(cut)

    def add(text: str) -> None:
        nonlocal linked
        if hidden and stack[-1][0] == "head" and text.strip():
            pop(len(stack) - 1)
        if text and not hidden:
            pieces.append(text)
            if links:
                linked += len(text)

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at: m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or not m["close"]:
            continue
        if tag not in INLINE:
            flush()
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # a stray end tag of an inline element closes nothing beyond its block
            if depth is not None and (tag not in INLINE or all(t in INLINE for t, _ in stack[depth:])):
                pop(depth)
            continue
        if hidden:
            break_out(tag)
        if tag == "br":
            add(" ")
        closes = CLOSES_SAME.get(tag, ()) + (("p",) if tag in ENDS_P else ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                pop(i)
                break
            if stack[i][0] not in INLINE:
                break
        if tag in ("template", "svg", "select") and not m["rest"].endswith("/"):
            endless = _never_closed(html) if endless is None else endless
            if m.start() in endless:
                continue
        if tag in RAW or tag == "noscript" and any(t == "head" for t, _ in stack):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m["rest"].endswith("/"):
            stack.append((tag, _name_parts(m["rest"]) if "=" in m["rest"] else ()))
            links += tag == "a"
            hidden += tag in NOT_SHOWN
    flush()
    return found
