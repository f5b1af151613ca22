"""TeX math: a small total parser and its rendering in Unicode.

Nodes: ("char", c) ("text", s) ("group", nodes) ("script", node, sub or None, sup or None) ("frac", above, below)
("sqrt", nodes) ("style", name, nodes) ("color", name, nodes) ("unknown", command).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from html.entities import html5

from .model import SPACES

# Names that take a combining mark, set after their whole argument.
ACCENTS = {
    "hat": "̂", "widehat": "̂", "bar": "̄", "overline": "̅", "tilde": "̃", "widetilde": "̃", "vec": "⃗",
    "dot": "̇", "ddot": "̈", "check": "̌", "breve": "̆", "acute": "́", "grave": "̀", "mathring": "̊",
}
# Names set upright.
FUNCTIONS = frozenset(
    "arccos arcsin arctan arg argmax argmin cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lim liminf limsup ln log max min Pr sec sin sinh sup tan tanh"
    " Hom End Aut Ob Mor id op colim dom cod".split()
)
# Commands whose character is another than that of the HTML name, or that HTML doesn't name.
_OWN_SYMBOLS = {
    "asymp": "≍", "ast": "∗", "barwedge": "⊼", "blacksquare": "■", "blacktriangle": "▲", "cdot": "⋅", "cdots": "⋯", "circ": "∘", "copyright": "©", "ddots": "⋱", "degree": "°",
    "Diamond": "◇", "dots": "…", "dotsb": "⋯", "dotsc": "…", "epsilon": "ϵ", "exists": "∃", "gets": "←", "iint": "∬", "imath": "ı", "implies": "⇒", "infty": "∞", "land": "∧",
    "lbrace": "{", "ldots": "…", "leadsto": "⇝", "lgroup": "⟮", "llbracket": "⟦", "lnot": "¬", "lor": "∨", "lVert": "‖", "neg": "¬", "neq": "≠", "oslash": "⊘", "partial": "∂",
    "phi": "ϕ", "pounds": "£", "rbrace": "}", "rgroup": "⟯", "rightsquigarrow": "⇝", "rrbracket": "⟧", "rVert": "‖", "S": "§", "sphericalangle": "∢", "star": "⋆", "surd": "√",
    "to": "→", "triangle": "△", "triangledown": "▽", "varepsilon": "ε", "varphi": "φ", "vdots": "⋮", "vert": "|",
}
_TEXT = frozenset(("text", "textrm", "mathrm", "mbox", "operatorname"))
_STYLES = {
    "mathbb": "bb", "mathcal": "script", "cal": "script", "mathscr": "script", "mathfrak": "frak", "frak": "frak",
    "mathbf": "bold", "bf": "bold", "boldsymbol": "bold", "bm": "bold", "mathit": "ital", "it": "ital",
}
_NOTHING = frozenset("limits nolimits displaystyle textstyle scriptstyle small notag nonumber".split())
_COMMAND = re.compile("[A-Za-z]+")
_INDEX = re.compile(r"[ \t\n\r\f\v]*\[([0-9]+)\]")


@lru_cache(maxsize=1)
def symbols() -> dict[str, str]:
    """Commands for single characters: HTML's names of signs, arrows and Greek letters, with TeX's own meanings over them."""
    table = {}
    for name, value in html5.items():
        command = name.removesuffix(";")
        if name.endswith(";") and len(value) == 1 and command.isascii() and command.isalpha():
            code = ord(value)
            if code >= 0x2010 or 0x370 <= code < 0x400 or unicodedata.category(value) in ("Sm", "So", "Sc") and code > 0x7F:
                table[command] = value
    return table | _OWN_SYMBOLS


class _Parser:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def skip(self) -> str:
        """The next character that is no space, or nothing at the end."""
        while self.at < len(self.source) and self.source[self.at] in SPACES:
            self.at += 1
        return self.source[self.at : self.at + 1]

    def take(self) -> str:
        c = self.source[self.at : self.at + 1]
        self.at += 1
        return c

    def sequence(self) -> list:
        nodes = []
        while self.skip() not in ("", "}"):
            nodes.append(self.scripted())
        return nodes

    def scripted(self) -> tuple:
        base = self.atom()
        found: dict[str, list] = {}
        while (c := self.skip()) in ("_", "^") and c and c not in found:
            self.at += 1
            found[c] = self.argument()
        return ("script", base, found.get("_"), found.get("^")) if found else base

    def braced(self) -> list:
        self.at += 1
        nodes = self.sequence()
        if self.source[self.at : self.at + 1] == "}":
            self.at += 1
        return nodes

    def argument(self) -> list:
        c = self.skip()
        if c == "{":
            return self.braced()
        if c == "\\":
            return [self.atom()]
        return [("char", self.take())] if c else []

    def raw(self) -> str:
        if self.skip() != "{":
            return self.take() if self.at < len(self.source) else ""
        end = self.source.find("}", self.at)
        end = len(self.source) if end < 0 else end
        text = self.source[self.at + 1 : end]
        self.at = end + 1
        return text

    def atom(self) -> tuple:
        c = self.source[self.at : self.at + 1]
        if c == "{":
            return ("group", self.braced())
        if c != "\\":
            return ("char", self.take()) if c else ("group", [])
        found = _COMMAND.match(self.source, self.at + 1)
        if found:
            self.at = found.end()
            return self.command(found[0])
        self.at += 1
        sign = self.take()
        if sign in (",", ";", ":"):
            return ("char", "\u2009")
        return ("char", " " if sign == "\\" else sign or "\\")

    def command(self, name: str) -> tuple:
        if name == "frac":
            return ("frac", self.argument(), self.argument())
        if name == "sqrt":
            index = _INDEX.match(self.source, self.at)
            if not index:
                return ("sqrt", self.argument())
            self.at = index.end()
            order = int(index[1])
            inside = [("char", "("), *self.argument(), ("char", ")")]
            sign = {3: [("char", "∛")], 4: [("char", "∜")]}.get(order, [("char", "["), ("text", str(order)), ("char", "]"), ("char", "√")])
            return ("group", sign + inside)
        if name in _TEXT:
            return ("text", self.raw())
        if name == "textcolor":
            color = self.raw()
            return ("color", color, self.argument())
        if name in _STYLES:
            return ("style", _STYLES[name], self.argument())
        if name in ("left", "right"):
            return self.delimiter()
        if name in ("quad", "qquad"):
            return ("char", " ")
        if name in _NOTHING:
            return ("group", [])
        if name in ACCENTS:
            return ("group", [*self.argument(), ("char", ACCENTS[name])])
        if name in FUNCTIONS:
            return ("text", name)
        known = symbols().get(name)
        return ("char", known) if known else ("unknown", name)

    def delimiter(self) -> tuple:
        c = self.skip()
        if c == "\\":
            found = _COMMAND.match(self.source, self.at + 1)
            self.at = found.end() if found else self.at + 1
            known = symbols().get(found[0]) if found else None
            return ("char", known) if known else ("group", [])
        if c:
            self.at += 1
        return ("char", c) if c not in ("", ".") else ("group", [])


def parse(source: str) -> list:
    """The nodes of any text; what stands behind an unopened } is left out."""
    return _Parser(source).sequence()


# Raised and lowered characters. "safe" ones are widely had in fonts, "full" adds the others.
_RAISED = dict(zip("0123456789+-=()niabcdefghjklmoprstuvwxyzABDEGHIJKLMNOPRTUW", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱᵃᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻᴬᴮᴰᴱᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᴿᵀᵁᵂ", strict=True))
_LOWERED = dict(zip("0123456789+-=()aeioruvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑᵢₒᵣᵤᵥₓ", strict=True))
_SCRIPTS = {
    ("bmp", "^"): _RAISED, ("full", "^"): _RAISED | {"V": "ⱽ"},
    ("bmp", "_"): _LOWERED, ("full", "_"): _LOWERED | dict(zip("hjklmnpst", "ₕⱼₖₗₘₙₚₛₜ", strict=True)),
}
#: First code points of A, a and 0 of each alphabet.
_ALPHABETS = {"bold": (0x1D400, 0x1D41A, 0x1D7CE), "ital": (0x1D434, 0x1D44E, None), "script": (0x1D49C, 0x1D4B6, None), "frak": (0x1D504, 0x1D51E, None), "bb": (0x1D538, 0x1D552, 0x1D7D8)}
_LETTERLIKE = {"script": "SCRIPT", "frak": "BLACK-LETTER", "bb": "DOUBLE-STRUCK", "ital": "PLANCK CONSTANT"}


@lru_cache(maxsize=16)
def alphabet(level: str, style: str) -> dict[int, str]:
    """A styled alphabet for str.translate. Where its place is unassigned the older letterlike sign is meant; bmp has those only."""
    older = {}
    for code in range(0x2100, 0x2150):
        name, plain = unicodedata.name(chr(code), ""), unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii() and (name.startswith((f"{_LETTERLIKE.get(style)} CAPITAL", f"{_LETTERLIKE.get(style)} SMALL")) or style == "ital" and name == _LETTERLIKE["ital"]):
            older[plain] = chr(code)
    table = {}
    for first, base in zip("Aa0", _ALPHABETS.get(style, ()), strict=False):
        for i in range(0 if base is None else 10 if first == "0" else 26):
            plain = chr(ord(first) + i)
            if unicodedata.category(chr(base + i)) == "Cn":
                table[ord(plain)] = older[plain]
            elif level == "full":
                table[ord(plain)] = chr(base + i)
    return table if level == "full" or style != "ital" else {}


def _shown_length(s: str) -> int:
    return sum(not (0x300 <= ord(c) <= 0x36F or 0x20D0 <= ord(c) <= 0x20FF) for c in s)


def _script(level: str, sign: str, s: str) -> str:
    table = _SCRIPTS[level, sign]
    if all(c == " " or c in table for c in s):
        return "".join(table.get(c, c) for c in s)
    return sign + (s if _shown_length(s) <= 1 else f"({s})")


def _parenthesised(level: str, pieces: list) -> list:
    if _shown_length("".join(s for _, s in pieces)) <= 1:
        return pieces
    return [(None, "("), *pieces, (None, ")")]


def pieces(nodes: list, level: str = "bmp") -> list[tuple[str | None, str]]:
    """Rendered runs with the colour each is in, adjacent runs of one colour joined."""
    out: list[tuple[str | None, str]] = []
    for node in nodes:
        for color, s in _pieces(node, level):
            if out and out[-1][0] == color:
                out[-1] = (color, out[-1][1] + s)
            else:
                out.append((color, s))
    return out


def _pieces(node: tuple, level: str) -> list:
    kind = node[0]
    if kind in ("char", "text"):
        return [(None, node[1])]
    if kind == "group":
        return pieces(node[1], level)
    if kind == "style":
        return [(None, render(node[2], level).translate(alphabet(level, node[1])))]
    if kind == "color":
        return [(node[1], render(node[2], level))]
    if kind == "script":
        out = list(_pieces(node[1], level))
        for sign, inside in (("_", node[2]), ("^", node[3])):
            if inside is not None:
                out.append((None, _script(level, sign, render(inside, level))))
        return out
    if kind == "frac":
        return [*_parenthesised(level, pieces(node[1], level)), (None, "/"), *_parenthesised(level, pieces(node[2], level))]
    if kind == "sqrt":
        return [(None, "√"), *_parenthesised(level, pieces(node[1], level))]
    return [(None, "\\" + node[1])]


def render(nodes: list, level: str = "bmp") -> str:
    return "".join(s for _, s in pieces(nodes, level))
