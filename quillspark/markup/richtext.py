"""The RTF writer."""

from __future__ import annotations

import re

from . import texmath
from .model import Doc, flat

# The colour table.
COLORS = ((95, 175, 255), (0, 190, 190), (95, 195, 95), (215, 175, 0), (200, 120, 245), (150, 150, 150), (220, 95, 95), (0, 0, 0), (235, 235, 235))
TABLE_WIDTH = 9360
_TOGGLES = {"emph": "i", "strong": "b", "strike": "strike"}


def _escaped(found: re.Match) -> str:
    c = found[0]
    if c == "\n":
        return "\\line\n"
    if c < "\x80":
        return "\\" + c
    units = c.encode("utf-16-le", "surrogatepass")
    return "".join(f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2))


def escape(s: str) -> str:
    return re.sub(r"[\\{}\n]|[^\x00-\x7f]", _escaped, s)


def write(doc: Doc) -> str:
    colors = "".join(f"\\red{r}\\green{g}\\blue{b};" for r, g, b in COLORS)
    head = "{\\rtf1\\ansi\\ansicpg1252\\deff0\\viewkind4\n{\\fonttbl{\\f0\\fswiss Helvetica;}{\\f1\\fmodern Courier;}}\n{\\colortbl;" + colors + "}\n\\uc1\\f0\\fs24\n"
    if doc.meta.shown():
        if doc.meta.title is not None:
            head += f"\\fs48\\b {escape(doc.meta.title)}\\b0\\fs24\\par\n"
        line = doc.meta.byline()
        if line is not None:
            head += f"\\fs20\\cf6 {escape(line)}\\cf0\\fs24\\par\n"
        head += "\\par\n"
    return head + "".join(map(_block, doc.blocks)) + "}\n"


def _block(b: tuple) -> str:
    kind = b[0]
    if kind == "heading":
        return f"\\fs{ {1: 48, 2: 36}.get(b[1], 28)}\\b {_inlines(b[2])}\\b0\\fs24\\par\n"
    if kind == "para":
        return _inlines(b[1]) + "\\par\n"
    if kind == "code":
        return "\\f1 " + "\\line\n".join(map(escape, b[2])) + "\\f0\\par\n"
    if kind == "bullets":
        return "".join(_item("\\'b7", i) for i in b[1])
    if kind == "numbers":
        return "".join(_item(f"{n}.", i) for n, i in enumerate(b[2], b[1]))
    if kind == "quote":
        return f"\\li720\n{''.join(map(_block, b[1]))}\\li0\n"
    if kind == "rule":
        return "\\pard\\brdrb\\brdrs\\brdrw10\\brsp20 \\par\\pard\n"
    if kind == "math":
        return f"\\qc {escape(texmath.render(b[2]))}\\par\\ql\n"
    width = TABLE_WIDTH // max(1, len(b[2]))
    edges = "".join(f"\\cellx{width * (i + 1)}" for i in range(len(b[2])))
    return _row(edges, b[1], b[2], "\\b ", "\\b0") + "".join(_row(edges, b[1], row, " ", "") for row in b[3])


def _row(edges: str, aligns: list, cells: list, on: str, off: str) -> str:
    out = f"\\trowd{edges}\n"
    for i, cell in enumerate(cells):
        align = aligns[i] if i < len(aligns) else "left"
        out += f"\\intbl\\q{align[0]}{on}{_inlines(cell)}{off}\\cell "
    return out + "\\row\n"


def _item(mark: str, item: tuple) -> str:
    checked, blocks = item
    box = {None: "", True: "[x] ", False: "[ ] "}[checked]
    return f"\\li360 {mark}\\tab {box}{''.join(map(_block, blocks))}\\li0\n"


def _inlines(nodes: list) -> str:
    return "".join(map(_inline, nodes))


def _inline(node: tuple) -> str:
    kind = node[0]
    if kind == "text":
        return escape(node[1])
    if kind == "break":
        return "\\line\n"
    if kind in _TOGGLES:
        return f"\\{_TOGGLES[kind]} {_inlines(node[1])}\\{_TOGGLES[kind]}0 "
    if kind == "code":
        return f"\\f1 {escape(node[1])}\\f0 "
    if kind == "math":
        return escape(texmath.render(node[2]))
    if kind == "link":
        return f"{_inlines(node[1])} ({escape(node[2])})"
    return f"[image: {escape(flat(node[1]))}] ({escape(node[2])})"
