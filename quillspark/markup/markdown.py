"""Markdown to the document model."""

from __future__ import annotations

import re

from . import texmath
from .model import DIGITS, SPACES, Doc, Meta, lower_ascii

_FENCE = re.compile(r" {0,3}(?! )(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})(?=$| )")
_MARKER = re.compile(r" {0,3}(?:([-*+])|([0-9]+)[.)]) ")
_CHECKBOX = re.compile(r"\[([ xX])\] ")
_SEPARATOR = re.compile(r"[-|: ]+\Z")
_CELL_END = re.compile(r"(?<!\\)\|")
_TITLE = re.compile(r"""(.* )(?:"([^"]*)"|'([^']*)'|\(([^(]*)\))\Z""", re.S)
_RUN = re.compile("`+")
_ESCAPABLE = frozenset("\\`*_{}[]()#+-.!|$<>~")
_SPECIAL = re.compile(r"[\n\\`$*_~!\[<h]")
_URL_END = re.compile("[ \t\n\r\f\v<>\"]")


def parse(text: str, hard_line_breaks: bool = False) -> Doc:
    """A whole document: front matter or title block, link definitions, blocks."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [line.replace("\r", "").replace("\t", "    ") for line in lines]
    meta, at = _front_matter(lines) or _title_block(lines) or (Meta(), 0)
    links, lines = _definitions(lines[at:])
    return Doc(_Blocks(lines, links, hard_line_breaks).all(), meta)


def _front_matter(lines: list[str]) -> tuple[Meta, int] | None:
    if lines[:1] != ["---"]:
        return None
    end = next((i for i, line in enumerate(lines) if i and line.strip(SPACES) in ("---", "...")), None)
    if end is None:
        return None
    meta = Meta()
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon and key in ("title", "author", "date"):
            value = value.strip(SPACES)
            if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
                value = value[1:-1]
            setattr(meta, key, value)
    return meta, end + 1


def _title_block(lines: list[str]) -> tuple[Meta, int] | None:
    fields: list[str] = []
    at = 0
    while at < len(lines) and len(fields) < 3 and lines[at].startswith("%"):
        parts = [lines[at][1:].strip(SPACES)]
        at += 1
        while at < len(lines) and lines[at].strip(SPACES) and lines[at][0] in SPACES:
            parts.append(lines[at].strip(SPACES))
            at += 1
        fields.append(" ".join(parts).strip(SPACES))
    if not at:
        return None
    title, author, date = ([*fields, "", ""])[:3]
    named = re.match(r"([^(]*[^(\s][^(]*)\(([^()\s]+)\)(.*)\Z", title, re.S)
    meta = Meta(title or None, author or None, date or None)
    if named:
        meta.title, meta.section, meta.manual = named[1].strip(SPACES), named[2], named[3].strip(SPACES) or None
    return meta, at


def _blank(line: str) -> bool:
    return not line.strip(SPACES)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _fence(line: str) -> str | None:
    """The info text behind an opening fence."""
    found = _FENCE.match(line)
    return line[found.end() :].strip(SPACES) if found else None


def _fence_end(line: str) -> bool:
    t = line.strip(SPACES)
    return len(t) >= 3 and t[0] in "`~" and not t.strip(t[0])


def _math_line(line: str) -> str | None:
    """None, or "one" for a whole formula on the line, "open" for its beginning."""
    t = line.strip(SPACES)
    if not t.startswith("$$"):
        return None
    return "one" if len(t) >= 4 and t.endswith("$$") else "open"


def _math_end(line: str) -> bool:
    return line.strip(SPACES).endswith("$$")


def _heading(line: str) -> tuple[int, str] | None:
    found = _HEADING.match(line)
    return (len(found[1]), line[found.end() :].strip(SPACES).rstrip("#").strip(SPACES)) if found else None


def _rule(line: str) -> bool:
    t = "".join(c for c in line if c not in SPACES)
    return len(t) >= 3 and t[0] in "-*_" and t.count(t[0]) == len(t)


def _quoted(line: str) -> bool:
    return line.lstrip(" ").startswith(">") and _indent(line) <= 3


def _table_at(lines: list[str], at: int) -> bool:
    if "|" not in lines[at] or at + 1 >= len(lines):
        return False
    t = lines[at + 1].strip(SPACES)
    return "-" in t and "|" in t and bool(_SEPARATOR.match(t))


def _cells(line: str) -> list[str]:
    cells = _CELL_END.split(line.strip(SPACES))
    if cells[0] == "":
        cells = cells[1:]
    if cells and cells[-1] == "":
        cells = cells[:-1]
    return [c.strip(SPACES) for c in cells]


def _fit(values: list, n: int, filler) -> list:
    return (values + [filler] * n)[:n]


def _align(cell: str) -> str:
    if not cell.endswith(":"):
        return "left"
    return "center" if cell.startswith(":") else "right"


def split_title(inside: str) -> tuple[str, str]:
    """A link's address and the quoted or bracketed title behind it."""
    t = inside.strip(SPACES)
    found = _TITLE.match(t)
    if not found:
        return t, ""
    return found[1].strip(SPACES), next(g for g in found.groups()[1:] if g is not None)


def definition(line: str) -> tuple[str, str, str] | None:
    """Folded label, address and title of a link definition line."""
    line = line[_indent(line) :] if _indent(line) <= 3 else line
    if line.lstrip(" ").startswith(">"):
        line = line.lstrip(" ")[1:].lstrip(" ")
    end = _closing(line, 1) if line.startswith("[") else None
    if end is None or end == 1 or line[end + 1 : end + 2] != ":":
        return None
    url, title = split_title(line[end + 2 :])
    return (lower_ascii(line[1:end]), url, title) if url else None


def _definitions(lines: list[str]) -> tuple[dict[str, tuple[str, str]], list[str]]:
    """First definition of each label, and the lines without definitions; fences, formulas and lists are left as they are."""
    links: dict[str, tuple[str, str]] = {}
    kept: list[str] = []
    at, n = 0, len(lines)
    while at < n:
        line, end = lines[at], at + 1
        if _fence(line) is not None:
            while end < n and not _fence_end(lines[end]):
                end += 1
            end += 1
        elif _math_line(line) == "open":
            while end < n and not _math_end(lines[end]):
                end += 1
            end += 1
        elif _MARKER.match(line):
            while end < n and not _blank(lines[end]):
                end += 1
        elif found := definition(line):
            links.setdefault(found[0], found[1:])
            at = end
            continue
        kept += lines[at:end]
        at = end
    return links, kept


class _Blocks:
    """A cursor over lines; containers parse their inner lines with a cursor of their own."""

    def __init__(self, lines: list[str], links: dict, hard: bool):
        self.lines, self.links, self.hard, self.at = lines, links, hard, 0

    def all(self) -> list:
        out = []
        while self.at < len(self.lines):
            if _blank(self.lines[self.at]):
                self.at += 1
            else:
                out.append(self.one())
        return out

    def inner(self, lines: list[str]) -> list:
        return _Blocks(lines, self.links, self.hard).all()

    def inlines(self, text: str) -> list:
        return inlines(text, self.links)

    def until(self, end) -> list[str]:
        """Lines up to the one that ends them, which is passed."""
        start = self.at
        while self.at < len(self.lines) and not end(self.lines[self.at]):
            self.at += 1
        found = self.lines[start : self.at]
        return found

    def one(self) -> tuple:
        line = self.lines[self.at]
        if _indent(line) >= 4:
            return self.indented()
        info = _fence(line)
        if info is not None:
            self.at += 1
            body = self.until(_fence_end)
            self.at += 1
            return ("code", info, body)
        if _math_line(line):
            return self.formula()
        if found := _heading(line):
            self.at += 1
            return ("heading", found[0], self.inlines(found[1]))
        if _rule(line):
            self.at += 1
            return ("rule",)
        if _quoted(line):
            return self.quote()
        if _table_at(self.lines, self.at):
            return self.table()
        if _MARKER.match(line):
            return self.list()
        return self.paragraph()

    def indented(self) -> tuple:
        start = end = self.at
        while self.at < len(self.lines) and (_indent(self.lines[self.at]) >= 4 or _blank(self.lines[self.at])):
            if _indent(self.lines[self.at]) >= 4:
                end = self.at + 1
            self.at += 1
        self.at = end
        return ("code", "", [line[4:] for line in self.lines[start:end]])

    def formula(self) -> tuple:
        kind, first = _math_line(self.lines[self.at]), self.lines[self.at].strip(SPACES)[2:]
        self.at += 1
        if kind == "one":
            raw = first[:-2].strip(SPACES)
        else:
            parts = [first, *self.until(_math_end)]
            if self.at < len(self.lines):
                parts.append(self.lines[self.at].strip(SPACES)[:-2])
                self.at += 1
            raw = " ".join(p for p in parts if p).strip(SPACES)
        return ("math", raw, texmath.parse(raw))

    def starts_block(self, at: int, alone: bool = False) -> bool:
        line = self.lines[at]
        return (
            _blank(line) or _rule(line) or _fence(line) is not None or _heading(line) is not None or _quoted(line)
            or _MARKER.match(line) is not None or _math_line(line) is not None or not alone and _table_at(self.lines, at)
        )

    def quote(self) -> tuple:
        inner = []
        while self.at < len(self.lines) and (_quoted(self.lines[self.at]) or not self.starts_block(self.at, alone=True)):
            line = self.lines[self.at]
            line = line.lstrip(" ") if _indent(line) <= 3 else line
            inner.append(line[2:] if line.startswith("> ") else line[1:] if line.startswith(">") else line)
            self.at += 1
        return ("quote", self.inner(inner))

    def table(self) -> tuple:
        header, aligns = _cells(self.lines[self.at]), [_align(c) for c in _cells(self.lines[self.at + 1])]
        self.at += 2
        rows = self.until(lambda line: "|" not in line or _blank(line))
        n = len(header)
        return ("table", _fit(aligns, n, "left"), [self.inlines(c) for c in header], [[self.inlines(c) for c in _fit(_cells(r), n, "")] for r in rows])

    def list(self) -> tuple:
        first = _MARKER.match(self.lines[self.at])
        numbered = first[2] is not None
        items = []
        while self.at < len(self.lines) and (found := _MARKER.match(self.lines[self.at])) and (found[2] is not None) == numbered:
            width, checked = found.end(), None
            box = _CHECKBOX.match(self.lines[self.at], width)
            inner = [self.lines[self.at][box.end() if box else width :]]
            if box:
                width, checked = width + 4, box[1] != " "
            self.at += 1
            while self.at < len(self.lines):
                line = self.lines[self.at]
                if _blank(line):
                    after = self.lines[self.at + 1] if self.at + 1 < len(self.lines) else ""
                    if _blank(after) or _indent(after) < width:
                        break
                    inner.append("")
                elif _indent(line) >= width:
                    inner.append(line[width:])
                else:
                    break
                self.at += 1
            items.append((checked, self.inner(inner)))
        return ("numbers", int(first[2]), items) if numbered else ("bullets", items)

    def paragraph(self) -> tuple:
        start = self.at
        self.at += 1
        while self.at < len(self.lines) and not self.starts_block(self.at):
            self.at += 1
        out = []
        for line in self.lines[start : self.at - 1]:
            body = line.rstrip(SPACES)
            slashes = len(body) - len(body.rstrip("\\"))
            hard = self.hard
            if len(line) - len(body) >= 2:
                hard = True
            elif slashes % 2:
                body, hard = body[:-1], True
            out += [body.strip(SPACES), "\n" if hard else " "]
        return ("para", self.inlines("".join(out) + self.lines[self.at - 1].strip(SPACES)))


def _closing(s: str, at: int, pair: str = "[]", escapes: bool = True) -> int | None:
    """Where the bracket that is open before ``at`` closes."""
    depth = 0
    while at < len(s):
        c = s[at]
        if c == "\\" and escapes and at + 1 < len(s):
            at += 1
        elif c == pair[0]:
            depth += 1
        elif c == pair[1]:
            if not depth:
                return at
            depth -= 1
        at += 1
    return None


def _code_end(s: str, at: int, n: int) -> int | None:
    """Where a run of exactly n backticks begins."""
    for run in _RUN.finditer(s, at):
        if len(run[0]) == n:
            return run.start()
    return None


def _emphasis_end(s: str, at: int, mark: str) -> int | None:
    """Where the emphasis opened before ``at`` closes; code spans and, inside *, whole ** pairs are passed over."""
    n = len(s)
    while at < n:
        c = s[at]
        if c == "\\" and at + 1 < n:
            at += 2
        elif c == "`":
            run = _RUN.match(s, at).end() - at
            end = _code_end(s, at + run, run)
            at = at + run if end is None else end + run
        elif s.startswith("**", at):
            if mark == "**":
                return at
            end = _emphasis_end(s, at + 2, "**") if mark == "*" else None
            at = at + 2 if end is None else end + 2
        elif s.startswith("~~", at):
            if mark == "~~":
                return at
            at += 2
        elif s.startswith(mark, at):
            return at
        else:
            at += 1
    return None


def _formula_end(s: str, at: int) -> int | None:
    start = at
    while at < len(s):
        if s[at] == "\\" and at + 1 < len(s):
            at += 2
            continue
        if s[at] == "$":
            return at if at > start and s[at - 1] not in SPACES and s[at + 1 : at + 2] not in tuple(DIGITS) else None
        at += 1
    return None


_MARKS = (("**", "strong"), ("*", "emph"), ("__", "strong"), ("_", "emph"), ("~~", "strike"))


def inlines(s: str, links: dict[str, tuple[str, str]] | None = None) -> list:
    """The inlines of a paragraph's text; a line feed in it is a hard break."""
    links = links or {}
    out: list = []
    run: list[str] = []
    before, at, n = " ", 0, len(s)

    def put(node: tuple) -> None:
        if run:
            out.append(("text", "".join(run)))
            run.clear()
        out.append(node)

    while at < n:
        special = _SPECIAL.search(s, at)
        if special is None or special.start() > at:
            end = special.start() if special else n
            run.append(s[at:end])
            before, at = s[end - 1], end
            continue
        c = s[at]
        found = None
        if c == "\n":
            put(("break",))
            before, at = " ", at + 1
            continue
        if c == "\\" and s[at + 1 : at + 2] in _ESCAPABLE and at + 1 < n:
            run.append(s[at + 1])
            before, at = s[at + 1], at + 2
            continue
        if c == "`":
            ticks = _RUN.match(s, at).end() - at
            end = _code_end(s, at + ticks, ticks)
            if end is not None:
                found = (("code", s[at + ticks : end].replace("\n", " ")), end + ticks, "`")
        elif c == "$":
            if at + 1 < n and s[at + 1] not in SPACES and s[at + 1] != "$":
                end = _formula_end(s, at + 1)
                if end is not None:
                    raw = s[at + 1 : end].replace("\n", " ")
                    found = (("math", raw, texmath.parse(raw)), end + 1, "$")
        elif c in "*_~":
            found = _emphasised(s, at, before, links)
        elif c == "[" or s.startswith("![", at):
            found = _linked(s, at, links)
        elif c == "<":
            end = s.find(">", at)
            if s.startswith(("http://", "https://"), at + 1) and end > 0:
                url = s[at + 1 : end]
                found = (("link", [("text", url)], url, ""), end + 1, ">")
        elif c == "h" and s.startswith(("http://", "https://"), at) and (before in SPACES or before in "(["):
            end = _URL_END.search(s, at)
            url = s[at : end.start() if end else n].rstrip(".,;:!?)]}")
            found = (("link", [("text", url)], url, ""), at + len(url), url[-1:] or "x")
        if found:
            put(found[0])
            at, before = found[1], found[2]
        else:
            run.append(c)
            before, at = c, at + 1
    if run:
        out.append(("text", "".join(run)))
    return out


def _emphasised(s: str, at: int, before: str, links: dict):
    for mark, kind in _MARKS:
        if s.startswith(mark, at):
            if mark[0] == "_" and before.isascii() and before.isalnum():
                return None
            end = _emphasis_end(s, at + len(mark), mark)
            if end is None or _blank(s[at + len(mark) : end]):
                return None
            return (kind, inlines(s[at + len(mark) : end], links)), end + len(mark), mark[0]
    return None


def _linked(s: str, at: int, links: dict):
    kind, start = ("image", at + 2) if s[at] == "!" else ("link", at + 1)
    end = _closing(s, start)
    if end is None:
        return None
    label, after = s[start:end], end + 1
    inside = s[start:end]
    if s.startswith("(", after):
        close = _closing(s, after + 1, "()", escapes=False)
        if close is None:
            return None
        url, title = split_title(s[after + 1 : close])
        return (kind, inlines(inside, links), url, title), close + 1, ")"
    if s.startswith("[", after):
        close = _closing(s, after + 1)
        if close is not None:
            label, after = s[after + 1 : close] or label, close + 1
    target = links.get(lower_ascii(label))
    return None if target is None else ((kind, inlines(inside, links), *target), after, "]")
