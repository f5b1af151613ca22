"""RTF to the document model: one pass over the control stream with a stack of group states."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .model import Doc, lower_ascii

_TOKEN = re.compile(r"([{}])|\\'(.{0,2})|\\([A-Za-z]+)(-?[0-9]+)? ?|\\(.)|([^\\{}\r\n])|\\?[\r\n]*", re.S)
# Groups whose text is no part of the document.
_SKIPPED = frozenset(
    "fonttbl colortbl info pict object header footer headerl headerr footerl footerr footnote annotation themedata colorschememapping latentstyles datastore generator xmlnstbl"
    " listtable listoverridetable rsidtbl bkmkstart bkmkend nonshppict shppict revtbl wgrffmtfilter template pgptbl protusertbl sn sv stylesheet fldinst".split()
)
_TYPED = {
    "tab": "\t", "nestcell": "\t", "bullet": "•", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "enspace": " ", "emspace": " ",
}
_SIGNS = {"{": "{", "}": "}", "\\": "\\", "~": "\xa0", "_": "\u2011"}
_FORMATS = {"b": "bold", "i": "ital", "strike": "strike"}


def _byte(value: int, mac: bool) -> str:
    if value < 0x80:
        return chr(value)
    try:
        return bytes([value & 0xFF]).decode("mac_roman" if mac else "cp1252")
    except UnicodeDecodeError:
        return "�"


def _hex(digits: str) -> int:
    value = 0
    for c in digits:
        value = value * 16 + (int(c, 16) if c in "0123456789abcdefABCDEF" else 0)
    return value


def tokens(source: str) -> list[tuple]:
    """("open",) ("close",) ("word", name, number or None) ("sign", c) ("byte", n) ("char", c) of a text of single bytes."""
    out: list[tuple] = []
    for found in _TOKEN.finditer(source):
        brace, byte, word, number, sign, char = found.groups()
        if brace:
            out.append(("open",) if brace == "{" else ("close",))
        elif byte is not None:
            out.append(("byte", _hex(byte)))
        elif word:
            out.append(("word", word, int(number) if number else None))
        elif sign:
            out.append(("sign", sign))
        elif char:
            out.append(("byte", ord(char)) if ord(char) >= 0x80 else ("char", char))
    return out


def _group_end(toks: list[tuple], at: int) -> int:
    """Behind the close of the group that is open before ``at``."""
    depth = 1
    while at < len(toks) and depth:
        depth += {"open": 1, "close": -1}.get(toks[at][0], 0)
        at += 1
    return at


def _body(toks: list[tuple], name: str) -> list[tuple]:
    """The tokens of the first group that begins with the word."""
    for i in range(len(toks) - 1):
        if toks[i] == ("open",) and toks[i + 1][:2] == ("word", name):
            end = _group_end(toks, i + 1)
            return toks[i + 2 : end - (toks[end - 1] == ("close",))]
    return []


def styles(toks: list[tuple]) -> dict[int, str]:
    """Style numbers and their names up to the semicolon, the first of each number."""
    body, out, at = _body(toks, "stylesheet"), {}, 0
    while at < len(body):
        at += 1
        if body[at - 1] == ("open",):
            end = _group_end(body, at)
            entry = body[at:end]
            number = next((t[2] for t in entry if t[:2] == ("word", "s") and t[2] is not None), None)
            if number is not None:
                text = "".join(t[1] if t[0] == "char" else _byte(t[1], False) for t in entry if t[0] in ("char", "byte"))
                out.setdefault(number, text.split(";")[0])
            at = end
    return out


def mono_fonts(toks: list[tuple]) -> frozenset[int]:
    """Numbers of fonts of the modern family."""
    out, open_ = set(), [None]
    for t in _body(toks, "fonttbl"):
        if t[0] == "open":
            open_.append(None)
        elif t[0] == "close" and len(open_) > 1:
            open_.pop()
        elif t[:2] == ("word", "f") and t[2] is not None:
            open_[-1] = t[2]
        elif t[:2] == ("word", "fmodern") and open_[-1] is not None:
            out.add(open_[-1])
        elif t == ("char", ";"):
            open_[-1] = None
    return frozenset(out)


@dataclass(frozen=True)
class _State:
    bold: bool = False
    ital: bool = False
    strike: bool = False
    mono: bool = False
    size: int = 24
    skipped: bool = False
    fallback: int = 1
    pending: int = 0
    mac: bool = False

    @property
    def format(self) -> tuple:
        return self.bold, self.ital, self.strike, self.mono


def _styled(form: tuple, text: str) -> tuple:
    bold, ital, strike, mono = form
    if mono:
        return ("code", text)
    node: tuple = ("text", text)
    for on, kind in ((strike, "strike"), (ital, "emph"), (bold, "strong")):
        node = (kind, [node]) if on else node
    return node


def _blank(inlines: list) -> bool:
    for node in inlines:
        kind = node[0]
        if kind == "text" and node[1].strip(" \t\n") or kind == "code" and node[1].strip(" "):
            return False
        if kind in ("strong", "emph", "strike") and not _blank(node[1]) or kind in ("link", "image", "math"):
            return False
    return True


def _trimmed(inlines: list) -> list:
    out = list(inlines)
    for end, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while out:
            node = out[end]
            if node[0] == "text":
                text = strip(node[1], " \t\n")
                if text:
                    out[end] = ("text", text)
                    break
            elif not _blank([node]):
                break
            out.pop(end)
    return out


class _Reader:
    def __init__(self, toks: list[tuple]):
        self.toks, self.styles, self.mono = toks, styles(toks), mono_fonts(toks)
        self.blocks: list = []
        self.run: list = []
        self.text: list[str] = []
        self.form = (False,) * 4
        self.size = 0  # the largest of the paragraph's visible characters
        self.style: int | None = None
        self.cells: list = []
        self.rows: list = []
        self.in_table = False

    def read(self) -> Doc:
        state, above, at = _State(), [], 0
        while at < len(self.toks):
            t = self.toks[at]
            at += 1
            kind = t[0]
            if kind == "open":
                if state.skipped or state.pending:
                    at = _group_end(self.toks, at)
                    state = replace(state, pending=max(0, state.pending - (not state.skipped)))
                else:
                    above.append(state)
            elif kind == "close":
                if above:
                    state = above.pop()
            elif state.skipped:
                continue
            elif kind == "word" and t[1] != "u":
                state = self.word(state, t[1], t[2])
            elif state.pending:
                state = replace(state, pending=state.pending - 1)
            elif kind == "word":
                code = (t[2] or 0) + (0x10000 if (t[2] or 0) < 0 else 0)
                good = 0 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000
                self.type(state, chr(code) if good else "�")
                state = replace(state, pending=state.fallback)
            elif kind == "sign":
                state = self.sign(state, t[1])
            else:
                self.type(state, _byte(t[1], state.mac) if kind == "byte" else t[1])
        self.end_paragraph()
        return Doc(self.blocks)

    def word(self, state: _State, name: str, number: int | None) -> _State:
        if name in _SKIPPED:
            return replace(state, skipped=True)
        if name in _FORMATS:
            return replace(state, **{_FORMATS[name]: number != 0})
        if name in _TYPED:
            self.type(state, _TYPED[name])
        elif name == "par":
            self.end_line() if self.in_table else self.end_paragraph()
        elif name in ("sect", "page"):
            self.end_paragraph()
        elif name in ("line", "nestrow"):
            self.end_line()
        elif name == "pard":
            self.style, self.in_table = None, False
        elif name == "intbl":
            self.in_table = True
        elif name == "cell":
            self.end_cell()
        elif name == "row":
            self.end_row()
        elif name == "s":
            self.style = number
        elif name == "plain":
            return replace(state, bold=False, ital=False, strike=False, mono=False)
        elif name == "f":
            return replace(state, mono=number in self.mono)
        elif name == "fs":
            return replace(state, size=24 if number is None else number)
        elif name == "uc":
            return replace(state, fallback=1 if number is None else number)
        elif name in ("mac", "ansi", "pc", "pca"):
            return replace(state, mac=name == "mac")
        return state

    def sign(self, state: _State, c: str) -> _State:
        if c in _SIGNS:
            self.type(state, _SIGNS[c])
        elif c in "\r\n":
            self.end_line()
        elif c == "*":
            return replace(state, skipped=True)
        return state

    def type(self, state: _State, s: str) -> None:
        if state.format != self.form:
            self.flush()
            self.form = state.format
        self.text.append(s)
        if s not in (" ", "\t"):
            self.size = max(self.size, state.size)

    def flush(self) -> None:
        if self.text:
            self.run.append(_styled(self.form, "".join(self.text)))
            self.text = []

    def taken(self) -> list:
        self.flush()
        run, self.run = self.run, []
        return run

    def end_line(self) -> None:
        self.flush()
        self.run.append(("break",))

    def end_cell(self) -> None:
        run = self.taken()
        self.cells.append([] if _blank(run) else _trimmed(run))
        self.size = 0

    def end_row(self) -> None:
        run = self.taken()
        if not _blank(run):
            self.cells.append(_trimmed(run))
        if self.cells:
            self.rows.append(self.cells)
            self.cells = []
        self.size = 0

    def end_paragraph(self) -> None:
        run = self.taken()
        if self.cells:
            self.rows.append(self.cells)
            self.cells = []
        if self.rows:
            n = max(map(len, self.rows))
            first, *rest = [[*r, *([[]] * (n - len(r)))] for r in self.rows]
            self.blocks.append(("table", ["left"] * n, first, rest))
            self.rows = []
        if not _blank(run):
            level = _named_level(self.styles.get(self.style, "")) or next((n for least, n in ((44, 1), (32, 2), (26, 3)) if self.size >= least), None)
            self.blocks.append(("heading", level, _trimmed(run)) if level else ("para", run))
        self.style, self.size = None, 0


def _named_level(name: str) -> int | None:
    name = lower_ascii(name.lstrip(" "))
    if name.startswith("heading"):
        digits = re.match("[0-9]+", name[7:].lstrip(" "))
        return int(digits[0]) if digits and 1 <= int(digits[0]) <= 6 else 1
    return 1 if name.startswith("title") else 2 if name.startswith("subtitle") else None


def parse(data: bytes) -> Doc:
    return _Reader(tokens(data.decode("latin-1"))).read()
