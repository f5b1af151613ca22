"""One document from bytes to output: format detection, reading, options, writing."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import abiword, archive, latex, manpage, markdown, office, richtext, rtf
from .model import Doc, lower_ascii
from .terminal import TerminalWriter
from .web import HtmlWriter
from .xmlevents import decode_utf8, looks_utf16

FORMATS = {"markdown": "markdown", "md": "markdown", "rtf": "rtf", "odt": "odt", "fodt": "odt", "docx": "docx", "idml": "idml", "abw": "abw"}
WRITERS = ("term", "ansi", "plain", "html", "latex", "tex", "man", "rtf", "abw")


class ConvertError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """What a conversion is asked for. color is auto, none, 16 or true; glyphs ascii, bmp or full; auto is 16 colours."""

    to: str = "term"
    from_: str | None = None
    standalone: bool = False
    color: str = "auto"
    glyphs: str = "bmp"
    width: int | None = None
    italics: bool | None = None
    links: str = "off"
    title: str = ""
    hard_line_breaks: bool = False


def extension(path: str) -> str:
    """Behind the last dot of the last part of a path, A-Z lower-cased."""
    return lower_ascii(path.rsplit("/", 1)[-1].rpartition(".")[2]) if "." in path.rsplit("/", 1)[-1] else ""


def detect(path: str, head: bytes) -> str:
    """The format by the first bytes, else by the extension."""
    ext = extension(path)
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        if ext in ("docx", "odt", "idml"):
            return ext
        raise ConvertError("zip container with unrecognized extension (expected .docx, .odt or .idml)")
    if head[:5] == b"{\\rtf":
        return "rtf"
    if head[:4] == b"\xd0\xcf\x11\xe0":
        raise ConvertError("OLE2 container - legacy binary Word (.doc) is not supported; save as .rtf or .docx")
    return {"rtf": "rtf", "fodt": "odt", "abw": "abw"}.get(ext, "markdown")


def from_spec(spec: str) -> tuple[str, bool | None]:
    """A format with +extension and -extension switches: the format, and whether line breaks are to be hard if said."""
    name, *rest = re.split("([+-])", spec)
    if name not in FORMATS:
        raise ConvertError(f"unknown input format {name} (markdown, rtf, odt, docx, idml, abw)")
    hard = None
    for sign, switch in zip(rest[::2], rest[1::2], strict=True):
        if switch != "hard_line_breaks":
            raise ConvertError(f"unknown format extension {switch} (supported: hard_line_breaks)")
        hard = sign == "+"
    return FORMATS[name], hard


def read(path: str, data: bytes, options: Options = Options()) -> Doc:
    """A document from a file's bytes; raises ConvertError, FormatError or ArchiveError for what can't be read."""
    kind, hard = from_spec(options.from_) if options.from_ else (detect(path, data[:8]), None)
    if kind == "markdown":
        return markdown.parse(decode_utf8(data), options.hard_line_breaks or bool(hard))
    if kind == "rtf":
        return rtf.parse(data)
    if kind == "docx":
        return office.parse_docx(data)
    if kind == "idml":
        raise ConvertError("idml reader not implemented yet")
    if data[:2] != b"PK" and looks_utf16(data):
        raise ConvertError("UTF-16 XML not supported")
    return office.parse_abw(data) if kind == "abw" else office.parse_odt(data)


def combine(docs: list[Doc]) -> Doc:
    """Blocks of all in order, the first's metadata."""
    return Doc([b for d in docs for b in d.blocks], docs[0].meta) if docs else Doc()


def man_name(path: str, doc: Doc, title: str = "") -> tuple[str, str]:
    """Name and section of a man page: a file page.3x.md is page in section 3x."""
    base = path.rsplit("/", 1)[-1]
    base = base.removesuffix(".md") or base
    found = re.fullmatch(r"(.+)\.([0-9][^.]*)", base)
    name, section = found.groups() if found else (base, "7")
    return title or doc.meta.title or name, doc.meta.section or section


def render(doc: Doc, path: str = "", options: Options = Options()) -> str:
    raw, level = options.glyphs == "ascii", "full" if options.glyphs == "full" else "bmp"
    columns = 80 if options.width is None else max(20, options.width)
    if options.to == "plain":
        return TerminalWriter("none", level, columns, False, raw).write(doc)
    if options.to in ("term", "ansi"):
        color = options.color if options.color in ("none", "16", "true") else "16"
        italics = color == "true" if options.italics is None else options.italics
        return TerminalWriter(color, level, columns, italics, raw, "osc8" if options.links == "osc8" else "off").write(doc)
    if options.to == "html":
        return HtmlWriter(options.standalone, options.title or doc.meta.title or path, level, raw).write(doc)
    if options.to in ("latex", "tex"):
        return latex.write(doc, options.standalone)
    if options.to == "man":
        return manpage.write(doc, *man_name(path, doc, options.title))
    if options.to == "rtf":
        return richtext.write(doc)
    if options.to == "abw":
        return abiword.write(doc)
    raise ConvertError(f"unknown format {options.to}")


def convert(path: str, data: bytes, options: Options = Options()) -> str:
    return render(read(path, data, options), path, options)


ERRORS = (ConvertError, office.FormatError, archive.ArchiveError)
