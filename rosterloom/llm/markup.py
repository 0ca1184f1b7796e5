"""A tolerant reader of HTML: a stream of texts, opening and closing tags, in time proportional to the page."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: A well-formed tag; no part of it crosses the next "<" or ">", so a failed attempt reads no further than that.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"'=]*)((?:\s+[^\s"'<>/=]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))?)*)\s*(/?)>""")
_NAME = re.compile(r"[^\s/>]+")
_SPACE = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
# Elements whose content isn't markup.
RAW = frozenset("script style textarea xmp noembed".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Ends the attributes of an element that closes itself.
CLOSED = " /"


def _odd_tag(html: str, at: int, ended: set[str]) -> tuple[int, str, str]:
    """End, name and attributes of a tag that isn't well formed; quotes count right behind an equals sign only.

    ended: quotes of which no more are in the rest of the page. A tag that never ends takes the rest.
    """
    n = len(html)
    m = _NAME.match(html, at)
    name, at, found = m[0].lower(), m.end(), []
    while True:
        space = _SPACE.match(html, at)
        at = space.end()
        if at >= n or html[at] == ">":
            return min(n, at + 1), name, "".join(found) + (CLOSED if space[0].endswith("/") else "")
        key = _KEY.match(html, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            stop = html.find(quote, at + 1) if quote in ('"', "'") and quote not in ended else -1
            if stop >= 0:
                value, at = html[at + 1 : stop], stop + 1
            else:
                if quote in ('"', "'"):
                    ended.add(quote)
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.append(f' {key[0]}="{value.replace(chr(34), "&quot;")}"')


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) or ("close", name, ""); comments, declarations and raw contents are left out."""
    at, n, ended = 0, len(html), set()
    while at < n:
        start = html.find("<", at)
        if start != at:
            yield "text", html[at : start if start >= 0 else n], ""
        if start < 0:
            return
        m = _TAG.match(html, start)
        if m:
            closing, name, raw, at = m[1], m[2].lower(), m[3] + (CLOSED if m[4] else ""), m.end()
        elif (after := html[start + 1 : start + 3]) and (after[0].isascii() and after[0].isalpha() or after[0] == "/" and after[1:].isascii() and after[1:].isalpha()):
            closing = after[0] == "/"
            at, name, raw = _odd_tag(html, start + 1 + closing, ended)
        else:
            if after.startswith(("!", "?", "/")):
                for opening, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
                    if html.startswith(opening, start):
                        stop = html.find(end, start + (2 if opening == "<!--" else len(opening)))
                        at = stop + len(end) if stop >= 0 else n
                        break
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        if closing:
            yield "close", name, ""
            continue
        yield "open", name, raw
        if name in RAW and not raw.endswith(CLOSED):
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            yield "close", name, ""


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out
