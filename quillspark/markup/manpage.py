"""The man page writer."""

from __future__ import annotations

import re

from . import texmath
from .model import Doc, flat


def escape(s: str, code: bool = False) -> str:
    s = s.replace("\\", "\\[rs]")
    if code:
        s = s.replace("-", "\\-")
    return re.sub("[^\\x00-\\x7f]", lambda m: f"\\[u{ord(m[0]):04X}]", s)


def _quote(s: str) -> str:
    return '"' + s.replace('"', "\\(dq") + '"'


def _guard(s: str) -> list[str]:
    """Lines none of which is a request."""
    return [("\\&" if line[:1] in (".", "'") and line else "") + line for line in s.split("\n")]


def write(doc: Doc, name: str = "", section: str = "7") -> str:
    upper = re.sub("[a-z]+", lambda m: m[0].upper(), name)
    parts = [upper, section, doc.meta.date or "", "", doc.meta.manual or ""]
    while parts and not parts[-1]:
        parts.pop()
    return ".TH " + " ".join(_quote(escape(p)) for p in parts) + "\n" + "".join(map(_block, doc.blocks))


def _block(b: tuple) -> str:
    kind = b[0]
    if kind == "heading":
        text = _inlines(b[2])
        return f".{'SH' if b[1] == 1 else 'SS'} {_quote(text)}\n" if b[1] <= 2 else f".PP\n\\fB{text}\\fR\n"
    if kind == "para":
        return ".PP\n" + "\n.br\n".join(_guard(_inlines(b[1]))) + "\n"
    if kind == "code":
        return ".nf\n.ft CR\n" + "\n".join("\n".join(_guard(escape(line, code=True))) for line in b[2]) + "\n.ft R\n.fi\n"
    if kind == "bullets":
        return "".join(f".IP \\(bu 2\n{_item(i)}" for i in b[1])
    if kind == "numbers":
        return "".join(f".IP {n}. 4\n{_item(i)}" for n, i in enumerate(b[2], b[1]))
    if kind == "quote":
        return f".RS\n{''.join(map(_block, b[1]))}.RE\n"
    if kind == "rule":
        return ".PP\n\\l'\\n(.lu'\n"
    if kind == "math":
        return ".PP\n" + "\n".join(_guard(escape(texmath.render(b[2])))) + "\n"
    aligns = [*b[1], *["left"] * len(b[2])][: len(b[2])]
    rows = "".join("\t".join(map(_inlines, row)) + "\n" for row in [b[2], *b[3]])
    return f".TS\nallbox;\n{' '.join(a[0] for a in aligns)}\n.\n{rows}.TE\n"


def _item(item: tuple) -> str:
    checked, blocks = item
    box = {None: "", True: "[x] ", False: "[ ] "}[checked]
    if len(blocks) == 1 and blocks[0][0] == "para":
        return box + "\n".join(_guard(_inlines(blocks[0][1]))) + "\n"
    return box + "".join(map(_block, blocks))


def _inlines(nodes: list) -> str:
    return "".join(map(_inline, nodes))


def _inline(node: tuple) -> str:
    kind = node[0]
    if kind == "text":
        return escape(node[1])
    if kind == "break":
        return "\n"
    if kind == "strike":
        return _inlines(node[1])
    if kind in ("emph", "strong"):
        return f"\\f{'I' if kind == 'emph' else 'B'}{_inlines(node[1])}\\fR"
    if kind == "code":
        return f"\\f(CR{escape(node[1], code=True)}\\fR"
    if kind == "math":
        return escape(texmath.render(node[2]))
    if kind == "link":
        return f"{_inlines(node[1])} ({escape(node[2])})"
    return f"[image: {escape(flat(node[1]))}] ({escape(node[2])})"
