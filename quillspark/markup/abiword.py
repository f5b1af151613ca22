"""The AbiWord XML writer."""

from __future__ import annotations

from . import texmath
from .model import Doc, flat
from .web import escape

_PROPS = {"emph": "font-style:italic", "strong": "font-weight:bold", "strike": "text-decoration:line-through", "code": "font-family:Courier New"}


def write(doc: Doc) -> str:
    out = [
        '<?xml version="1.0" encoding="UTF-8"?>\n<abiword xmlns="http://www.abisource.com/awml.dtd" xmlns:xlink="http://www.w3.org/1999/xlink"'
        ' template="false" fileformat="1.1">\n<section>\n'
    ]
    if doc.meta.title is not None:
        out.append(_para("Heading 1", [], _span([_PROPS["strong"]], escape(doc.meta.title))))
    line = doc.meta.byline()
    if line is not None:
        out.append(_para("Normal", ["font-style:italic"], escape(line)))
    out += [_block(b, 0) for b in doc.blocks]
    return "".join(out) + "</section>\n</abiword>\n"


def _span(props: list[str], inside: str) -> str:
    return f'<c props="{escape("; ".join(props))}">{inside}</c>' if props else inside


def _para(style: str, props: list[str], inside: str) -> str:
    joined = "; ".join(p for p in props if p)
    return f'<p style="{escape(style)}"' + (f' props="{escape(joined)}"' if joined else "") + f">{inside}</p>\n"


def _margin(quotes: int) -> str:
    """Half an inch for each quote around."""
    return f"margin-left:{quotes // 2}{'.5' if quotes % 2 else ''}in" if quotes else ""


def _block(b: tuple, quotes: int) -> str:
    kind, margin = b[0], _margin(quotes)
    if kind == "heading":
        return _para(f"Heading {min(b[1], 3)}", [margin], _inlines(b[2]))
    if kind == "para":
        return _para("Normal", [margin], _inlines(b[1]))
    if kind == "code":
        return "".join(_para("Plain Text", [margin], _span([_PROPS["code"]], escape(line))) for line in b[2] or [""])
    if kind == "bullets":
        return "".join(_item("• ", i, margin) for i in b[1])
    if kind == "numbers":
        return "".join(_item(f"{n}. ", i, margin) for n, i in enumerate(b[2], b[1]))
    if kind == "quote":
        return "".join(_block(x, quotes + 1) for x in b[1])
    if kind == "rule":
        return _para("Normal", [margin], "-" * 40)
    if kind == "math":
        return _para("Normal", ["text-align:center", margin], escape(texmath.render(b[2])))
    cells = []
    for r, row in enumerate([b[2], *b[3]]):
        for c, cell in enumerate(row):
            place = f"top-attach:{r}; bot-attach:{r + 1}; left-attach:{c}; right-attach:{c + 1}"
            cells.append(f'<cell props="{place}">\n{_para("Normal", [], _span([] if r else [_PROPS["strong"]], _inlines(cell)))}</cell>\n')
    return f"<table>\n{''.join(cells)}</table>\n"


def _item(mark: str, item: tuple, margin: str) -> str:
    """One paragraph: of an item's blocks only those with text of their own are shown."""
    box = {None: "", True: "[x] ", False: "[ ] "}[item[0]]
    return _para("Normal", ["margin-left:0.35in", margin], escape(mark + box) + " ".join(map(_inside, item[1])))


def _inside(b: tuple) -> str:
    if b[0] in ("para", "heading"):
        return _inlines(b[-1])
    if b[0] == "code":
        return _span([_PROPS["code"]], escape(" ".join(b[2])))
    return escape(texmath.render(b[2])) if b[0] == "math" else ""


def _inlines(nodes: list, props: tuple = ()) -> str:
    return "".join(_inline(n, props) for n in nodes)


def _inline(node: tuple, props: tuple) -> str:
    kind = node[0]
    if kind == "break":
        return "<br/>"
    if kind == "link":
        return f'<a xlink:href="{escape(node[2])}">{_inlines(node[1], props)}</a>'
    if kind in _PROPS and _PROPS[kind] not in props:
        props = (*props, _PROPS[kind])
    if kind in ("emph", "strong", "strike"):
        return _inlines(node[1], props)
    if kind in ("text", "code"):
        text = node[1]
    else:
        text = texmath.render(node[2]) if kind == "math" else f"[image: {flat(node[1])}] ({node[2]})"
    return _span(list(props), escape(text))
