"""HTML as a flat list of marks, each with the text that follows it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

#: a tag whose attributes are names with quoted values, without references; what is none of these is left to HTMLParser
TAG = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9]*="[^"<>&]*")*)[ \t\n\r\f]*>')
ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9]*)="([^"]*)"')
#: elements whose text is no markup
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


@dataclass(slots=True)
class Mark:
    """A tag ("" before the first), whether it closes, its attributes, and the chunks of text up to the next tag."""

    tag: str = ""
    closes: bool = False
    attributes: dict[str, str | None] = field(default_factory=dict)
    chunks: list[str] = field(default_factory=list)


class _Marks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.marks = [Mark()]
        self.handle_starttag = lambda tag, attrs: self.marks.append(Mark(tag, False, dict(attrs)))
        self.handle_endtag = lambda tag: self.marks.append(Mark(tag, True))
        self.handle_data = lambda data: self.marks[-1].chunks.append(data)


def _split(html: str) -> list[str] | None:
    """Text, then (slash, tag, attributes, text) over and over, of a page that is plain tags and text; None of any other."""
    parts = TAG.split(html)
    # each < begins a tag that was found
    if html.count("<") != len(parts) // 4:
        return None
    parts[2::4] = tags = [t.lower() for t in parts[2::4]]
    if not RAW.isdisjoint(tags) or any(map(_both, parts[1::4], parts[3::4])):
        return None
    if "&" in html:
        parts[::4] = [unescape(t) if "&" in t else t for t in parts[::4]]
    return parts


def _both(a: str, b: str) -> bool:
    return a != "" and b != ""


def attributes(told: dict | str) -> dict[str, str | None]:
    return told if isinstance(told, dict) else {k.lower(): v for k, v in ATTRIBUTE.findall(told)} if told else {}


def _parsed(html: str) -> list[Mark]:
    p = _Marks()
    p.feed(html)
    p.close()
    return p.marks


def marks(html: str) -> list[Mark]:
    parts = _split(html)
    if parts is None:
        return _parsed(html)
    found = [Mark(tag, c != "", attributes(a), [text] if text else []) for c, tag, a, text in zip(parts[1::4], parts[2::4], parts[3::4], parts[4::4])]
    return [Mark("", False, {}, [parts[0]] if parts[0] else []), *found]


def steps(html: str) -> Iterator[tuple[str, bool, dict | str, str]]:
    """(tag, closes, attributes, text after it) of a page's marks; attributes as ``attributes`` reads them."""
    parts = _split(html)
    if parts is None:
        return ((m.tag, m.closes, m.attributes, "".join(m.chunks)) for m in _parsed(html))
    return zip(("", *parts[2::4]), (False, *map(bool, parts[1::4])), ("", *parts[3::4]), parts[::4])
