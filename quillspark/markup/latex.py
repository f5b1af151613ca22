"""The LaTeX writer."""

from __future__ import annotations

from .model import Doc, flat

# Fixed value: what stands before a standalone document.
PREAMBLE = r"""\documentclass{article}
\usepackage[utf8]{inputenc}
\usepackage[T1]{fontenc}
\usepackage{amsmath,amssymb}
\usepackage{hyperref}
\begin{document}

"""
_ESCAPES = str.maketrans({"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: "\\" + c for c in "{}$&#_%"})
_SECTIONS = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")


def escape(s: str) -> str:
    return s.translate(_ESCAPES)


def write(doc: Doc, standalone: bool = False) -> str:
    body = _blocks(doc.blocks)
    if not standalone:
        return body + "\n"
    meta, head = doc.meta, ""
    if meta.shown():
        if meta.title is not None:
            head += f"\\title{{{escape(meta.title)}}}\n"
        if meta.author is not None:
            head += f"\\author{{{escape(meta.author)}}}\n"
        if meta.date is not None or meta.author is not None:
            head += f"\\date{{{escape(meta.date or '')}}}\n"
        head += "\\maketitle\n\n"
    return PREAMBLE + head + body + "\n\\end{document}\n"


def _blocks(blocks: list) -> str:
    return "\n".join(map(_block, blocks))


def _environment(name: str, inside: str, options: str = "") -> str:
    return f"\\begin{{{name}}}{options}\n{inside}\\end{{{name}}}\n"


def _block(b: tuple) -> str:
    kind = b[0]
    if kind == "heading":
        return f"\\{_SECTIONS[min(b[1], 5) - 1]}{{{_inlines(b[2])}}}\n"
    if kind == "para":
        return _inlines(b[1]) + "\n"
    if kind == "code":
        return _environment("verbatim", "".join(line + "\n" for line in b[2]))
    if kind == "bullets":
        return _environment("itemize", "".join(map(_item, b[1])))
    if kind == "numbers":
        counter = "" if b[1] == 1 else f"\\setcounter{{enumi}}{{{b[1] - 1}}}\n"
        return _environment("enumerate", counter + "".join(map(_item, b[2])))
    if kind == "quote":
        return _environment("quote", _blocks(b[1]))
    if kind == "rule":
        return "\\noindent\\hrulefill\n"
    if kind == "math":
        return f"\\[ {b[1]} \\]\n"
    aligns = [*b[1], *["left"] * len(b[2])][: len(b[2])]
    header, *rows = (" & ".join(map(_inlines, row)) + " \\\\\n" for row in [b[2], *b[3]])
    return _environment("tabular", header + "\\hline\n" + "".join(rows), "{" + "".join(a[0] for a in aligns) + "}")


def _item(item: tuple) -> str:
    box = {None: "", True: "$\\boxtimes$ ", False: "$\\square$ "}[item[0]]
    return f"\\item {box}{_blocks(item[1])}"


def _inlines(nodes: list) -> str:
    return "".join(map(_inline, nodes))


def _inline(node: tuple) -> str:
    kind = node[0]
    if kind == "text":
        return escape(node[1])
    if kind == "break":
        return "\\\\\n"
    if kind == "strike":
        return _inlines(node[1])
    if kind in ("emph", "strong"):
        return f"\\{'emph' if kind == 'emph' else 'textbf'}{{{_inlines(node[1])}}}"
    if kind == "code":
        return f"\\texttt{{{escape(node[1])}}}"
    if kind == "math":
        return f"${node[1]}$"
    if kind == "link":
        return f"\\href{{{node[2]}}}{{{_inlines(node[1])}}}"
    return f"[image: {escape(flat(node[1]))}] \\url{{{node[2]}}}"
