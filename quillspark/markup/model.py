"""The document model: what every reader makes and every writer takes.

A node is a tuple whose first item names its kind.

Blocks: ("heading", level, inlines) ("para", inlines) ("code", language, lines) ("bullets", items) ("numbers", start, items)
("quote", blocks) ("rule",) ("table", aligns, header, rows) ("math", raw, nodes); an item is (checked or None, blocks), a cell
a list of inlines, an align one of "left", "center", "right".

Inlines: ("text", s) ("break",) ("emph", inlines) ("strong", inlines) ("strike", inlines) ("code", s)
("link", inlines, url, title) ("image", inlines, url, title) ("math", raw, nodes).
"""

from __future__ import annotations

from dataclasses import dataclass, field

SPACES = " \t\n\r\f\v"
DIGITS = "0123456789"


@dataclass
class Meta:
    title: str | None = None
    author: str | None = None
    date: str | None = None
    section: str | None = None
    manual: str | None = None

    def byline(self) -> str | None:
        parts = [p for p in (self.author, self.date) if p is not None]
        return " · ".join(parts) if parts else None

    def shown(self) -> bool:
        return not (self.title is None and self.author is None and self.date is None)


@dataclass
class Doc:
    blocks: list = field(default_factory=list)
    meta: Meta = field(default_factory=Meta)


def flat(inlines: list) -> str:
    """The text of inlines without markup; a break is a space, math its source."""
    out = []
    for node in inlines:
        kind = node[0]
        if kind in ("text", "code", "math"):
            out.append(node[1])
        elif kind == "break":
            out.append(" ")
        else:
            out.append(flat(node[1]))
    return "".join(out)


def lower_ascii(s: str) -> str:
    return s.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def joined(parts: list[list], separator: tuple = ("break",)) -> list:
    """Non-empty inline lists with a separator between them."""
    out: list = []
    for part in parts:
        if part:
            out += ([separator] if out else []) + part
    return out
