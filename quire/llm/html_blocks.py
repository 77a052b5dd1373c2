"""HTML to leaf blocks: text runs between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Contents that are never page text.
SKIPPED = frozenset("script style title template noscript iframe svg math object canvas audio video".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: An opening tag ends these open elements, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)


class Element(NamedTuple):
    tag: str
    words: tuple[str, ...]


class Block(NamedTuple):
    path: tuple[Element, ...]
    text: str
    linked: int  # characters inside links


def name_words(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, in small letters and without a plural s."""
    out = []
    for m in _ATTR.finditer(attributes):
        for w in _WORD.findall(m[1] or m[2] or m[3] or ""):
            w = w.lower()
            out.append(w[:-1] if len(w) > 3 and w.endswith("s") else w)
    return tuple(dict.fromkeys(out))


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page, white space in each made one blank and trimmed."""
    out: list[Block] = []
    path: list[Element] = []
    text: list[str] = []
    state = {"link": 0, "linked": 0}

    def flush() -> None:
        s = " ".join("".join(text).split())
        if s:
            out.append(Block(tuple(path), s, min(state["linked"], len(s))))
        text.clear()
        state["linked"] = 0

    page, at = page or "", 0
    while m := _TOKEN.match(page, at):
        token, at = m[0], m.end()
        if token[0] != "<" or token == "<":
            s = html.unescape(token) if "&" in token else token
            text.append(s)
            if state["link"]:
                state["linked"] += len(s)
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in INLINE:
                state["link"] -= tag == "a" and state["link"] > 0
                continue
            same = _HEADINGS if tag in _HEADINGS else (tag,)  # any heading's end tag ends the open heading
            for k in range(len(path) - 1, -1, -1):
                if path[k].tag in same:
                    flush()
                    state["link"] = 0
                    del path[k:]
                    break
            continue
        if tag in SKIPPED:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if token.endswith("/>") and tag in ("svg", "math"):
                continue
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            state["link"] += tag == "a"
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        state["link"] = 0
        if tag in _P_ENDERS and path and any(e.tag == "p" for e in path[-3:]):
            k = max(i for i, e in enumerate(path) if e.tag == "p")
            del path[k:]
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            k = len(path)
            for i in range(len(path) - 1, -1, -1):
                if path[i].tag in bounds:
                    break
                if path[i].tag in ends:
                    k = i
            del path[k:]
        if tag == "hr":
            continue
        path.append(Element(tag, name_words(token) if "=" in token else ()))
    flush()
    return out
