"""Pages as sequences of leaf blocks: a forgiving reader of HTML."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

#: Elements that don't end a block (those of formulas among them), that have no content, whose content isn't shown and
#: goes on to the page's end if need be, and whose content isn't shown where they are closed. One of the last that is
#: closed in itself or never closed hides nothing.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNSHOWN = "script|style"
HIDDEN = ("template", "noscript", "title", "svg", "iframe", "annotation", "annotation-xml")
#: An element that opens ends an open one of its kind, up to the element around both.
AROUND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Innermost elements that a path keeps.
DEPTH = 24

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<unshown>{UNSHOWN})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=unshown)\b[^>]*>|\Z)"
    rf"|<(?P<hidden>{'|'.join(reversed(HIDDEN))})(?![^\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<!/)>(?:(?!<(?P=hidden)(?![^\s/>])).)*?</(?P=hidden)(?![^\s/>])[^>]*>"
    r"|<(?P<tag>/?[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<broken>/?[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TRUTH = re.compile(r'data-content="([01])"')


@dataclass(slots=True)
class Block:
    """A run of text between the edges of elements that aren't inline; ``truth`` only in pages made for training."""

    path: tuple[str, ...]
    text: str
    linked: int
    truth: int | None = None


def describe(tag: str, attributes: str) -> str:
    """The element and the words of its class, id and role."""
    if "=" not in attributes:
        return tag
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return " ".join([tag, *sorted(set(re.split(r"[^a-z]+", names.lower())) - {""})])


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in its order, white space within each as one space, character references decoded.

    Elements left open, closed twice or cut off by the page's end are made the best of; comments, scripts, styles and
    the like leave no block. Formulas and what an object shows in its place are text like any other. A null or empty page has none.
    """
    out: list[Block] = []
    if not page:
        return out
    open_: list[str] = []
    paths: list[tuple[str, ...]] = [()]
    truths: list[int | None] = [None]
    counts: dict[str, int] = {}
    held: list[str] = []
    linked = links = at = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if links:
                linked += len(text)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(paths[-1], text, min(linked, len(text)), truths[-1]))
            held.clear()
        linked = 0

    def pop(tag: str) -> None:
        while True:
            gone = open_.pop()
            paths.pop()
            truths.pop()
            counts[gone] -= 1
            if gone == tag:
                return

    for found in _MARKUP.finditer(page):
        say(page[at : found.start()])
        at = found.end()
        tag = found["tag"] or found["broken"]
        if not tag:
            continue
        tag = tag.lower()
        closing = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE or tag in HIDDEN:
            continue
        if tag == "br":
            held.append("\n")
            continue
        flush()
        if closing:
            links = 0
            if counts.get(tag):
                pop(tag)
            continue
        attributes = found["attributes"] or ""
        if tag in VOID or tag == "object" and attributes.endswith("/"):
            continue
        if counts.get("p"):
            pop("p")
        if tag in AROUND:
            for other in reversed(open_[-DEPTH:]):
                if other in AROUND[tag]:
                    break
                if other in SIBLINGS.get(tag, (tag,)):
                    pop(other)
                    break
        open_.append(tag)
        counts[tag] = counts.get(tag, 0) + 1
        paths.append((*paths[-1][1 - DEPTH :], describe(tag, attributes)))
        truth = _TRUTH.search(attributes) if "data-content" in attributes else None
        truths.append(int(truth[1]) if truth else truths[-1])
    say(page[at:])
    flush()
    return out
