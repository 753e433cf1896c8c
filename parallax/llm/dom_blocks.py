"""DOM leaf blocks of a page: runs of text between block-level tags, with their ancestors.

A small tolerant reader: unclosed and stray tags, unclosed paragraphs, comments, and script or
style content with tags inside are handled; a tag cut off at the end of the page is dropped.  Skipped
elements end at their own end tag; of one that has none only the tag is skipped (script, style
and textarea go on to the end of the page, as in browsers).  A head without end tag ends
where something stands that a head can't hold.
"""
from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names by the way they are rendered.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul button label select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea title".split())
TO_THE_END = frozenset("script style textarea".split())  # raw elements that no missing end tag ends
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
SKIPPED = frozenset("head select option button object math canvas audio video".split())
CLOSED_BY = {"p": BLOCK - {"button", "label", "select"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass(slots=True)
class Block:
    text: str
    tags: tuple[str, ...]
    names: frozenset[str]  # words of the ancestors' class, id and role
    nearest: frozenset[str]  # those of the nearest ancestor that has any
    linked: int  # characters inside links
    label: str | None = None  # of a labelled page


@dataclass(slots=True)
class _Open:
    tag: str
    names: tuple[str, ...] = ()
    label: str | None = None


@dataclass(slots=True)
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    blocks: list[Block] = field(default_factory=list)
    in_head: bool = False  # a head was opened and not yet left here

    def leave_head(self) -> None:
        self.in_head = False
        at = next((k for k, e in enumerate(self.stack) if e.tag == "head"), None)
        if at is not None:
            del self.stack[at:]

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                label = next((e.label for e in reversed(self.stack) if e.label is not None), None)
                self.blocks.append(Block(text, tuple(e.tag for e in self.stack), frozenset(n for e in self.stack for n in e.names),
                                         frozenset(next((e.names for e in reversed(self.stack) if e.names), ())), self.linked, label))
            self.parts, self.linked = [], 0

    def add(self, text: str) -> None:
        if self.in_head and self.stack and self.stack[-1].tag == "head" and not text.isspace():
            self.leave_head()
        if any(e.tag in SKIPPED for e in self.stack):
            return
        self.parts.append(text)
        if any(e.tag == "a" for e in self.stack):
            self.linked += len(text.strip())

    def open(self, tag: str, attributes: str) -> None:
        if self.in_head and tag not in IN_HEAD:
            self.leave_head()
        self.in_head |= tag == "head"
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                above = self.stack[k].tag
                if tag in CLOSED_BY.get(above, ()):
                    del self.stack[k:]
                    break
                if above in BLOCK:
                    break
        elif tag == "br":
            self.add(" ")
        if tag not in VOID:
            names, label = [], None
            for name, *value in ATTRIBUTE.findall(attributes) if "=" in attributes else ():
                name, value = name.lower(), "".join(value)
                if name in ("class", "id", "role", "itemprop"):
                    names += [x.lower() for x in NAME_PART.findall(value)]
                elif name == "data-label":
                    label = value
            self.stack.append(_Open(tag, tuple(names), label))

    def close(self, tag: str) -> None:
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].tag == tag), None)
        if tag in BLOCK:
            self.flush()
        if at is not None and (tag in BLOCK or not any(e.tag in BLOCK for e in self.stack[at + 1 :])):
            del self.stack[at:]
        elif at is not None:
            del self.stack[at]


def _closed(tag: str, attributes: str) -> bool:
    return tag == "svg" and attributes.rstrip().endswith("/")


def _raw_end(page: str, tag: str, at: int) -> int | None:
    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return end.end() if end else None


def _raw_ends(page: str, tag: str, at: int) -> dict[int, int]:
    """Where the elements of this tag that open from `at` on end, by the end of their opening tag."""
    open_, ends = [], {}
    while m := TAG.search(page, at):
        at, name = m.end(), (m.group(2) or "").lower()
        if name == tag:
            if not m.group(1):
                if not _closed(tag, m.group(3)):
                    open_.append(at)
            elif open_:
                ends[open_.pop()] = at
        elif name in TO_THE_END and not m.group(1) and not (tag == "svg" and open_ and m.group(3).rstrip().endswith("/")):
            end = _raw_end(page, name, at)
            if end is None:
                break
            at = end
    return ends


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's non-empty blocks in page order."""
    reader, at, page = _Reader(), 0, page or ""
    ends: dict[str, dict[int, int]] = {}  # of raw elements, found in one pass for each tag
    while m := TAG.search(page, at):
        if m.start() > at:
            reader.add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            reader.close(tag)
        elif tag in RAW:
            if tag in BLOCK:
                reader.flush()
            if tag in TO_THE_END:
                at = _raw_end(page, tag, at) or len(page)
            elif not _closed(tag, m.group(3)):
                if tag not in ends:
                    ends[tag] = _raw_ends(page, tag, m.start())
                at = ends[tag].get(at, at)
        else:
            reader.open(tag, m.group(3))
            if m.group(3).rstrip().endswith("/") and tag not in VOID and tag not in BLOCK:
                reader.close(tag)
    if at < len(page):
        reader.add(page[at:])
    reader.flush()
    return reader.blocks
