"""The HTML writer."""

from __future__ import annotations

from . import texmath
from .model import Doc, flat

# Fixed value: the style sheet of a standalone page.
STYLE = """\
body { font-family: Georgia, serif; max-width: 42em;
       margin: 2em auto; padding: 0 1em; line-height: 1.5; }
code { font-family: Menlo, Monaco, monospace; font-size: 0.92em;
       background: #f2f2f2; padding: 0 0.15em; }
pre { background: #f6f6f6; border: 1px solid #ddd; padding: 0.8em;
      overflow-x: auto; }
pre code { background: none; padding: 0; }
blockquote { border-left: 3px solid #9c9; margin-left: 0;
             padding-left: 1em; color: #444; }
table { border-collapse: collapse; }
th, td { border: 1px solid #bbb; padding: 0.25em 0.6em; }
th { background: #eee; }
.math { white-space: nowrap; }
.math.display { display: block; text-align: center; margin: 1em 0;
                white-space: normal; }
hr { border: none; border-top: 1px solid #bbb; }
"""
_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})
_TAGS = {"emph": "em", "strong": "strong", "strike": "del"}


def escape(s: str) -> str:
    return s.translate(_ESCAPES)


class HtmlWriter:
    def __init__(self, standalone: bool = False, title: str = "", level: str = "bmp", raw_math: bool = False):
        self.standalone, self.title, self.level, self.raw_math = standalone, title, level, raw_math

    def write(self, doc: Doc) -> str:
        body = "".join(map(self.block, doc.blocks))
        if not self.standalone:
            return body
        head = ""
        if doc.meta.shown():
            title = f'<h1 class="title">{escape(doc.meta.title)}</h1>\n' if doc.meta.title is not None else ""
            line = doc.meta.byline()
            head = f"<header>\n{title}" + (f'<p class="byline">{escape(line)}</p>\n' if line is not None else "") + "</header>\n"
        return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>{escape(self.title)}</title>\n<style>\n{STYLE}</style>\n</head>\n<body>\n{head}{body}</body>\n</html>\n'

    def block(self, b: tuple) -> str:
        kind = b[0]
        if kind == "heading":
            return f"<h{b[1]}>{self.inlines(b[2])}</h{b[1]}>\n"
        if kind == "para":
            return f"<p>{self.inlines(b[1])}</p>\n"
        if kind == "code":
            language = f' class="language-{escape(b[1])}"' if b[1] else ""
            return f"<pre><code{language}>{escape(''.join(f'{line}\n' for line in b[2]))}</code></pre>\n"
        if kind == "bullets":
            return f"<ul>\n{''.join(map(self.item, b[1]))}</ul>\n"
        if kind == "numbers":
            start = "" if b[1] == 1 else f' start="{b[1]}"'
            return f"<ol{start}>\n{''.join(map(self.item, b[2]))}</ol>\n"
        if kind == "quote":
            return f"<blockquote>\n{''.join(map(self.block, b[1]))}</blockquote>\n"
        if kind == "rule":
            return "<hr>\n"
        if kind == "math":
            return f'<div class="math display">{escape(self.math(b))}</div>\n'
        rows = "".join(f"<tr>{self.cells('td', b[1], row)}</tr>\n" for row in b[3])
        return f"<table>\n<thead>\n<tr>{self.cells('th', b[1], b[2])}</tr>\n</thead>\n<tbody>\n{rows}</tbody>\n</table>\n"

    def item(self, item: tuple) -> str:
        checked, blocks = item
        box = "" if checked is None else f'<input type="checkbox" disabled{" checked" if checked else ""}> '
        tight = len(blocks) == 1 and blocks[0][0] == "para"
        return f"<li>{box}{self.inlines(blocks[0][1]) if tight else '\n' + ''.join(map(self.block, blocks))}</li>\n"

    def cells(self, tag: str, aligns: list, row: list) -> str:
        out = []
        for i, cell in enumerate(row):
            align = aligns[i] if i < len(aligns) else "left"
            style = "" if align == "left" else f' style="text-align:{align}"'
            out.append(f"<{tag}{style}>{self.inlines(cell)}</{tag}>")
        return "".join(out)

    def math(self, node: tuple) -> str:
        return f"${node[1]}$" if self.raw_math else texmath.render(node[2], self.level)

    def inlines(self, nodes: list) -> str:
        return "".join(map(self.inline, nodes))

    def inline(self, node: tuple) -> str:
        kind = node[0]
        if kind == "text":
            return escape(node[1])
        if kind == "break":
            return "<br>\n"
        if kind in _TAGS:
            return f"<{_TAGS[kind]}>{self.inlines(node[1])}</{_TAGS[kind]}>"
        if kind == "code":
            return f"<code>{escape(node[1])}</code>"
        if kind == "math":
            return f'<span class="math">{escape(self.math(node))}</span>'
        title = f' title="{escape(node[3])}"' if node[3] else ""
        if kind == "link":
            return f'<a href="{escape(node[2])}"{title}>{self.inlines(node[1])}</a>'
        return f'<img src="{escape(node[2])}" alt="{escape(flat(node[1]))}"{title}>'
