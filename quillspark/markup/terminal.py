"""The terminal writer, coloured or plain."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from . import texmath
from .model import SPACES, Doc, flat

# Terminal colour numbers and true colours.
CODES = {"blue": 34, "cyan": 36, "green": 32, "yellow": 33, "magenta": 35, "gray": 37, "red": 31, "black": 30, "white": 37}
RGB = {
    "blue": (95, 175, 255), "cyan": (0, 190, 190), "green": (95, 195, 95), "yellow": (215, 175, 0), "magenta": (200, 120, 245),
    "gray": (150, 150, 150), "red": (220, 95, 95), "black": (0, 0, 0), "white": (235, 235, 235),
}
TEX_COLORS = frozenset(("red", "green", "blue", "cyan", "magenta", "yellow", "black", "white"))
# Ranges of characters that take no column, and two.
_NARROW = re.compile("[̀-ͯ᷀-᷿⃐-⃿︠-︯]")
_WIDE = re.compile(
    "[ᄀ-ᅟ⺀-꓏가-힣豈-﫿＀-｠￠-￦\U0001f300-\U0001faff"
    "⌚⌛☔☕♿⚓⚡⚪⚫⚽⚾⛄⛅⛎⛔⛪⛲⛳⛵⛺⛽✅✊✋✨❌❎❓❔❕❗➕➖➗➰➿⬛⬜⭐⭕]"
)
_SPACE = re.compile(f"[{SPACES}]+")


def width(s: str) -> int:
    """Columns that a text takes."""
    return len(s) if s.isascii() else len(s) - len(_NARROW.findall(s)) + len(_WIDE.findall(s))


@dataclass(frozen=True)
class Style:
    bold: bool = False
    dim: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    color: str | None = None
    link: str | None = None


PLAIN, DIM = Style(), Style(dim=True)
HEADINGS = {1: Style(bold=True, color="magenta"), 2: Style(bold=True, color="blue"), 3: Style(bold=True, color="cyan")}
Spans = list[tuple[Style, str]]


@dataclass(frozen=True)
class TerminalWriter:
    """color is "none", "16" or "true", level "bmp" or "full"; raw_math shows math as its source, links is "off" or "osc8"."""

    color: str = "16"
    level: str = "bmp"
    columns: int = 80
    italics: bool = False
    raw_math: bool = False
    links: str = "off"

    def write(self, doc: Doc) -> str:
        parts = []
        if doc.meta.shown():
            line = doc.meta.byline()
            parts.append(([] if doc.meta.title is None else [self.shown(HEADINGS[1], doc.meta.title)]) + ([] if line is None else [self.shown(DIM, line)]))
        parts += [self.block(b, 0) for b in doc.blocks]
        return "\n\n".join("\n".join(p) for p in parts if p) + ("\n" if any(parts) else "")

    def shown(self, style: Style, text: str) -> str:
        codes = [n for on, n in ((style.bold, "1"), (style.dim, "2"), (style.italic, "3"), (style.underline, "4"), (style.strike, "9")) if on]
        if style.color:
            codes += ["38", "2", *map(str, RGB[style.color])] if self.color == "true" else [str(CODES[style.color])]
        # a link alone makes a style too, though it has no code
        if self.color != "none" and (codes or style.link is not None):
            text = f"\x1b[{';'.join(codes)}m{text}\x1b[0m"
        return text if style.link is None else f"\x1b]8;;{style.link}\x1b\\{text}\x1b]8;;\x1b\\"

    def line(self, spans: Spans) -> str:
        return "".join(self.shown(style, text) for style, text in spans)

    def narrowed(self, by: int) -> TerminalWriter:
        return replace(self, columns=self.columns - by)

    def spans(self, nodes: list, style: Style) -> Spans:
        out: Spans = []
        for node in nodes:
            kind = node[0]
            if kind in ("text", "break"):
                out.append((style, node[1] if kind == "text" else " "))
            elif kind == "emph":
                out += self.spans(node[1], replace(style, italic=True) if self.italics else replace(style, underline=True))
            elif kind == "strong":
                out += self.spans(node[1], replace(style, bold=True))
            elif kind == "strike":
                if self.color == "none":
                    out += [(style, "~~"), *self.spans(node[1], style), (style, "~~")]
                else:
                    out += self.spans(node[1], replace(style, strike=True) if self.italics else replace(style, dim=True))
            elif kind == "code":
                out.append((replace(style, color="cyan"), node[1]))
            elif kind == "link":
                look = replace(style, underline=True, color="blue")
                if self.links == "osc8":
                    out += self.spans(node[1], replace(look, link=node[2]))
                elif flat(node[1]) == node[2]:
                    out.append((look, node[2]))
                else:
                    out += [*self.spans(node[1], look), (replace(style, dim=True), f" ({node[2]})")]
            elif kind == "image":
                out += [(replace(style, dim=True), f"[image: {flat(node[1])}]"), (replace(style, dim=True), f" ({node[2]})")]
            else:
                out += self.formula(node, style)
        return out

    def formula(self, node: tuple, style: Style, raw: str | None = None) -> Spans:
        if self.raw_math:
            return [(style, f"${node[1]}$" if raw is None else raw)]
        return [(replace(style, color=c) if c in TEX_COLORS else style, s) for c, s in texmath.pieces(node[2], self.level)]

    def wrapped(self, spans: Spans) -> list[str]:
        """Filled lines; a word longer than a line stands alone."""
        words: list[Spans] = [[]]
        for style, text in spans:
            first, *others = _SPACE.split(text)
            if first:
                words[-1].append((style, first))
            words += [[(style, w)] if w else [] for w in others]
        lines: list[str] = []
        used = 0
        for word in filter(None, words):
            size = sum(width(t) for _, t in word)
            if lines and used + 1 + size <= self.columns:
                lines[-1] += " " + self.line(word)
                used += 1 + size
            else:
                lines.append(self.line(word))
                used = size
        return lines or [""]

    def block(self, b: tuple, depth: int) -> list[str]:
        return getattr(self, "block_" + b[0])(b, depth)

    def block_heading(self, b: tuple, depth: int) -> list[str]:
        style = HEADINGS.get(b[1], Style(bold=True, dim=True))
        spans = self.spans(b[2], style)
        size = min(self.columns, sum(width(t) for _, t in spans))
        return [self.line(spans), *([self.shown(style, "═─"[b[1] - 1] * size)] if b[1] <= 2 else [])]

    def block_para(self, b: tuple, depth: int) -> list[str]:
        parts: list[list] = [[]]
        for node in b[1]:
            if node[0] == "break":
                parts.append([])
            else:
                parts[-1].append(node)
        return [line for part in parts for line in self.wrapped(self.spans(part, PLAIN))]

    def block_code(self, b: tuple, depth: int) -> list[str]:
        label = f" {b[1]} " if b[1] else ""
        size = max([1, *map(width, b[2])])
        side = [self.shown(DIM, "│ "), self.shown(DIM, " │")]
        rows = [side[0] + line + " " * (size - width(line)) + side[1] for line in b[2]]
        return [self.shown(DIM, f"┌─{label}{'─' * (size + 1 - width(label))}┐"), *rows, self.shown(DIM, f"└{'─' * (size + 2)}┘")]

    def block_quote(self, b: tuple, depth: int) -> list[str]:
        inner, bar = self.narrowed(2), self.shown(Style(color="green"), "│ ")
        out: list[str] = []
        for i, x in enumerate(b[1]):
            out += ([""] if i else []) + inner.block(x, depth)
        return [bar + line for line in out]

    def block_bullets(self, b: tuple, depth: int) -> list[str]:
        mark = self.shown(Style(color="yellow"), "•◦▪"[depth % 3])
        return [line for i in b[1] for line in self.item(i, mark, 2, depth)]

    def block_numbers(self, b: tuple, depth: int) -> list[str]:
        size = max((len(str(n)) for n in (b[1], b[1] + len(b[2]) - 1)), default=1)
        return [line for n, i in enumerate(b[2], b[1]) for line in self.item(i, self.shown(Style(color="yellow"), f"{n:>{size}}."), size + 2, depth)]

    def item(self, item: tuple, mark: str, indent: int, depth: int) -> list[str]:
        checked, blocks = item
        mark += " "
        if checked is not None:
            box = ("[x]" if checked else "[ ]") if self.raw_math else self.shown(Style(color="yellow"), "☑" if checked else "☐")
            mark, indent = f"{mark}{box} ", indent + (4 if self.raw_math else 2)
        inner = self.narrowed(indent)
        lines = [line for x in blocks for line in inner.block(x, depth + 1)] or [""]
        return [mark + lines[0], *(" " * indent + line if line else line for line in lines[1:])]

    def block_rule(self, b: tuple, depth: int) -> list[str]:
        return [self.shown(DIM, "─" * self.columns)]

    def block_math(self, b: tuple, depth: int) -> list[str]:
        line = self.line(self.formula(b, PLAIN)) if not self.raw_math else b[1]
        return ["    " + line if line else line]

    def block_table(self, b: tuple, depth: int) -> list[str]:
        rows = [[self.spans(c, Style(bold=True)) for c in b[2]], *([self.spans(c, PLAIN) for c in row] for row in b[3])]
        n = len(b[2])
        sizes = [max([1, *(sum(width(t) for _, t in row[i]) for row in rows if i < len(row))]) for i in range(n)]
        edge = lambda left, middle, right: self.shown(DIM, left + middle.join("─" * (s + 2) for s in sizes) + right)
        bar = self.shown(DIM, "│")

        def shown(row: list) -> str:
            cells = []
            for i, size in enumerate(sizes):
                spans = row[i] if i < len(row) else []
                align = b[1][i] if i < len(b[1]) else "left"
                pad = size - sum(width(t) for _, t in spans)
                before = {"left": 0, "center": pad // 2, "right": pad}[align]
                cells.append(f" {' ' * before}{self.line(spans)}{' ' * (pad - before)} ")
            return bar + bar.join(cells) + bar

        return [edge("┌", "┬", "┐"), shown(rows[0]), edge("├", "┼", "┤"), *map(shown, rows[1:]), edge("└", "┴", "┘")]
