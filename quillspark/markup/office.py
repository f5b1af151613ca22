"""AbiWord, OpenDocument and Office Open XML to the document model, over the XML tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import archive
from .model import Doc, Meta, flat, joined
from .xmlevents import Element, looks_utf16, tree

MONO = frozenset(("Courier New", "Courier", "Consolas", "Monospace", "Mono"))
MAX_SPACES = 4096


class FormatError(ValueError):
    pass


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch("[0-9]+", value) else default


def _level(n: int) -> int:
    return min(3, max(1, n))


def _wrapped(inlines: list, bold: bool, ital: bool, strike: bool, mono: bool) -> list:
    if mono:
        inlines = [("code", flat(inlines))]
    for on, kind in ((strike, "strike"), (ital, "emph"), (bold, "strong")):
        inlines = [(kind, inlines)] if on else inlines
    return inlines


def _table(rows: list) -> tuple:
    return ("table", [], rows[0] if rows else [], rows[1:])


# --- AbiWord


def parse_abw(data: bytes) -> Doc:
    section = tree(data).first("section")
    return Doc([] if section is None else [b for e in section.elements() if (b := _abw_block(e))])


def _abw_block(e: Element) -> tuple | None:
    if e.name == "p":
        level = {"Heading 1": 1, "Heading 2": 2, "Heading 3": 3}.get(e.get("style"))
        return ("heading", level, _abw_inlines(e)) if level else ("para", _abw_inlines(e))
    if e.name == "table":
        rows: dict[int, list] = {}
        for cell in e.outermost("cell"):
            places = [_abw_place(cell, side) for side in ("top-attach", "left-attach")]
            rows.setdefault(places[0], []).append((places[1], joined([_abw_inlines(p) for p in cell.outermost("p")])))
        return _table([[c for _, c in sorted(rows[r], key=lambda c: c[0])] for r in sorted(rows)])
    return None


def _props(e: Element) -> list[str]:
    return [p.strip(" ") for p in (e.get("props") or "").split(";")]


def _abw_place(e: Element, key: str) -> int:
    value = next((p[len(key) + 1 :] for p in _props(e) if p.split(":")[0] == key), "")
    return int(value) if re.fullmatch("-?[0-9]+", value) else 0


def _abw_inlines(e: Element) -> list:
    out: list = []
    for c in e.children:
        if isinstance(c, str):
            out.append(("text", c))
        elif c.name == "a":
            out.append(("link", _abw_inlines(c), c.get("xlink:href") or "", ""))
        elif c.name == "c":
            inner = _abw_inlines(c)
            for prop in reversed(_props(c)):
                kind = {"font-weight:bold": "strong", "font-style:italic": "emph", "text-decoration:line-through": "strike"}.get(prop)
                inner = [(kind, inner)] if kind else [("code", flat(inner))] if prop == "font-family:Courier New" else inner
            out += inner
        else:
            out += [("break",)] * (c.name == "br") + _abw_inlines(c)
    return out


# --- OpenDocument


def parse_odt(data: bytes) -> Doc:
    """A flat document, or a package's content.xml."""
    if data[:2] == b"PK":
        member = archive.find(archive.members(data), "content.xml")
        if member is None:
            raise FormatError("odt: no content.xml member")
        data = _member(data, member)
    return _Odf(tree(data)).doc()


def _member(data: bytes, member: archive.Member) -> bytes:
    try:
        content = archive.extract(data, member)
    except archive.ArchiveError as e:
        raise FormatError(f"{member.name}: {e}") from e
    if looks_utf16(content):
        raise FormatError(f"{member.name}: UTF-16 XML not supported")
    return content


class _Odf:
    def __init__(self, root: Element):
        self.root = root
        self.styles: dict[str | None, tuple] = {}
        for style in root.outermost("style:style"):
            name, p = style.get("style:name"), style.first("style:text-properties")
            if name is not None:
                self.styles.setdefault(name, self.look(p) if p is not None else ())

    @staticmethod
    def look(p: Element) -> tuple:
        family = p.get("fo:font-family") or ""
        if len(family) > 1 and family[0] == family[-1] == '"':
            family = family[1:-1]
        return p.get("fo:font-weight") == "bold", p.get("fo:font-style") == "italic", p.get("style:text-line-through-style") not in (None, "none", ""), family in MONO

    def doc(self) -> Doc:
        body = self.root.first("office:text")
        return Doc([] if body is None else self.blocks(body))

    def blocks(self, e: Element) -> list:
        out = []
        for c in e.elements():
            if c.name == "text:h":
                out.append(("heading", _level(_number(c.get("text:outline-level"), 1)), self.inlines(c)))
            elif c.name == "text:p":
                out.append(("para", self.inlines(c)))
            elif c.name == "text:list":
                out.append(("bullets", [(None, self.blocks(i)) for i in c.outermost("text:list-item")]))
            elif c.name == "table:table":
                rows = [[joined([self.inlines(p) for p in cell.outermost("text:p", "text:h")]) for cell in row.outermost("table:table-cell")] for row in c.outermost("table:table-row")]
                out.append(_table(rows))
        return out

    def inlines(self, e: Element) -> list:
        out: list = []
        for c in e.children:
            if isinstance(c, str):
                out.append(("text", c))
            elif c.name == "text:tab":
                out.append(("text", "\t"))
            elif c.name == "text:s":
                out.append(("text", " " * min(MAX_SPACES, _number(c.get("text:c"), 1))))
            elif c.name == "text:span":
                look = self.styles.get(c.get("text:style-name"))
                out += _wrapped(self.inlines(c), *look) if look else self.inlines(c)
            elif c.name == "text:a":
                out.append(("link", self.inlines(c), c.get("xlink:href") or "", ""))
            else:
                out += [("break",)] * (c.name == "text:line-break") + self.inlines(c)
        return out


# --- Office Open XML


def parse_docx(data: bytes) -> Doc:
    found = archive.members(data)
    main = archive.find(found, "word/document.xml")
    if main is None:
        raise FormatError("docx: no word/document.xml member")
    body = tree(_member(data, main)).first("w:body")

    def optional(name: str) -> Element | None:
        member = archive.find(found, name)
        try:
            return tree(_member(data, member)) if member else None
        except FormatError:
            return None

    reader = _Docx(optional("word/_rels/document.xml.rels"), optional("word/numbering.xml"))
    core = optional("docProps/core.xml")
    meta = Meta()
    if core is not None:
        for key, name in (("title", "dc:title"), ("author", "dc:creator"), ("date", "dcterms:created")):
            e = core.first(name)
            setattr(meta, key, (e.text() or None) if e is not None else None)
    return Doc([] if body is None else reader.blocks(body), meta)


def _value(e: Element | None, name: str) -> str | None:
    below = e.first(name) if e is not None else None
    return below.get("w:val") if below is not None else None


def _properties(e: Element, name: str) -> Element | None:
    """The properties that an element begins with."""
    first = next(e.elements(), None)
    return first if first is not None and first.name == name else None


@dataclass
class _Docx:
    rels: Element | None
    numbering: Element | None
    targets: dict = field(default_factory=dict)
    lists: dict = field(default_factory=dict)
    formats: dict = field(default_factory=dict)

    def __post_init__(self):
        for r in self.rels.outermost("Relationship") if self.rels else ():
            if r.get("Id") is not None and r.get("Target") is not None:
                self.targets.setdefault(r.get("Id"), r.get("Target"))
        for e in self.numbering.outermost("w:num", "w:abstractNum") if self.numbering else ():
            if e.name == "w:num":
                kind = _value(e, "w:abstractNumId")
                if e.get("w:numId") is not None and kind is not None:
                    self.lists.setdefault(e.get("w:numId"), kind)
            elif e.get("w:abstractNumId") is not None:
                levels = self.formats.setdefault(e.get("w:abstractNumId"), {})
                for level in e.outermost("w:lvl"):
                    form = _value(level, "w:numFmt")
                    if form is not None:
                        levels.setdefault(_number(level.get("w:ilvl"), 0), form)

    def numbered(self, number: str, level: int) -> bool:
        """By the list's format at the level, else at any level."""
        levels = self.formats.get(self.lists.get(number), {})
        form = levels.get(level) or next(iter(levels.values()), "bullet")
        return form not in ("bullet", "none")

    def blocks(self, body: Element) -> list:
        out: list = []
        run: list = []

        def end() -> None:
            while run:
                out.append(self.nested(run))

        for e in body.elements():
            if e.name == "w:p":
                kind, detail, inlines = self.paragraph(e)
                if kind == "item":
                    run.append((*detail, inlines))
                    continue
                end()
                if inlines:
                    out.append(("heading", detail, inlines) if kind == "heading" else ("para", inlines))
            else:
                end()
                if e.name == "w:tbl":
                    out.append(_table([[joined([self.inlines(p) for p in c.outermost("w:p")]) for c in r.outermost("w:tc")] for r in e.outermost("w:tr")]))
        end()
        return out

    def nested(self, run: list) -> tuple:
        """Takes a list from the front of a run of items (level, numbered, inlines); deeper ones go into the item before."""
        depth, numbered, _ = run[0]
        items = []
        while run and run[0][0] == depth:
            below: list = [("para", run.pop(0)[2])]
            deeper = []
            while run and run[0][0] > depth:
                deeper.append(run.pop(0))
            while deeper:
                below.append(self.nested(deeper))
            items.append((None, below))
        return ("numbers", 1, items) if numbered else ("bullets", items)

    def paragraph(self, e: Element) -> tuple:
        props, inlines = _properties(e, "w:pPr"), self.inlines(e)
        heading = re.fullmatch("Heading([0-9]+)", _value(props, "w:pStyle") or "")
        if heading:
            return "heading", _level(int(heading[1])), inlines
        number = _value(props, "w:numId")
        if number is not None and number != "0":
            level = _number(_value(props, "w:ilvl"), 0)
            return "item", (level, self.numbered(number, level)), inlines
        return "para", None, inlines

    def inlines(self, e: Element) -> list:
        out: list = []
        for c in e.children:
            if isinstance(c, str):
                out.append(("text", c))
            elif c.name == "w:r":
                out += self.run(c)
            elif c.name == "w:hyperlink":
                inner, url = self.inlines(c), self.targets.get(c.get("r:id"))
                out += inner if url is None else [("link", inner, url, "")]
            elif c.name == "mc:AlternateContent":
                branch = next(c.elements(), None)
                out += self.inlines(branch) if branch is not None else []
            elif c.name != "w:pPr":
                out += self.inlines(c)
        return out

    def run(self, e: Element) -> list:
        content, props = self.content(e), _properties(e, "w:rPr")
        if not content or props is None:
            return content

        def on(name: str) -> bool:
            flag = props.first(name)
            return flag is not None and flag.get("w:val") not in ("0", "false", "none", "off")

        fonts = props.first("w:rFonts")
        return _wrapped(content, on("w:b"), on("w:i"), on("w:strike") or on("w:dstrike"), fonts is not None and fonts.get("w:ascii") in MONO)

    def content(self, e: Element) -> list:
        out: list = []
        for c in e.elements():
            if c.name == "w:t":
                out.append(("text", c.text()))
            elif c.name in ("w:br", "w:cr"):
                out.append(("break",))
            elif c.name in ("w:tab", "w:noBreakHyphen"):
                out.append(("text", "\t" if c.name == "w:tab" else "-"))
            elif c.name == "w:drawing":
                named, blip = c.first("wp:docPr"), c.first("a:blip")
                alt = (named.get("descr") or named.get("name") if named is not None else None) or "image"
                out.append(("image", [("text", alt)], self.targets.get(blip.get("r:embed"), "") if blip is not None else "", ""))
            elif c.name == "mc:AlternateContent":
                branch = next(c.elements(), None)
                out += self.content(branch) if branch is not None else []
            elif c.name not in ("w:rPr", "w:instrText"):
                out += self.content(c)
        return out
