"""A total, lenient XML reader: any bytes give events, and events give a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_NAME, MAX_VALUE, MAX_REFERENCE = 1024, 1 << 20, 32
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
_NAME = rb"[A-Za-z_:\x80-\xff][A-Za-z0-9_:.\-\x80-\xff]*"
_START = re.compile(rb"[A-Za-z_:\x80-\xff]")
_REST = re.compile(rb"[A-Za-z0-9_:.\-\x80-\xff]*")
_ATTRIBUTE = re.compile(rb"(" + _NAME + rb")(?:[ \t\r\n]*(=)[ \t\r\n]*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|((?:(?!/>)[^ \t\r\n>])*)))?")
_REFERENCE = re.compile("&([^;]{0,%d});" % (MAX_REFERENCE - 1))
_DOCTYPE_END = re.compile(rb"[\[>]")


def decode_utf8(data: bytes) -> str:
    """UTF-8 with U+FFFD for what is malformed: one for a whole three-byte form of a surrogate or too long a form, else one a byte."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at, n = [], 0, len(data)
    while at < n:
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        tail = data[at + 1 : at + size]
        if not size or len(tail) < size - 1 or any(b & 0xC0 != 0x80 for b in tail):
            out.append("�")
            at += 1
            continue
        code = lead if size == 1 else lead & (0x7F >> size)
        for b in tail:
            code = code << 6 | b & 0x3F
        good = code >= (0, 0, 0x80, 0x800, 0x10000)[size] and not 0xD800 <= code < 0xE000 and code <= 0x10FFFF
        out.append(chr(code) if good else "�")
        at += size
    return "".join(out)


def resolve(text: str) -> str:
    """Character references; unknown names stay as they are."""

    def one(found: re.Match) -> str:
        body = found[1]
        if not body.startswith("#"):
            return _NAMED.get(body, found[0])
        hexadecimal = body[1:2] in ("x", "X")
        digits = body[2:] if hexadecimal else body[1:]
        if not re.fullmatch("[0-9a-fA-F]+" if hexadecimal else "[0-9]+", digits):
            return "�"
        code = int(digits, 16 if hexadecimal else 10)
        return "�" if not code or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)

    # a name that isn't known must not hide a reference inside it
    out, at = [], 0
    while True:
        amp = text.find("&", at)
        if amp < 0:
            out.append(text[at:])
            return "".join(out)
        out.append(text[at:amp])
        found = _REFERENCE.match(text, amp)
        value = one(found) if found else "&"
        if found and value != found[0]:
            out.append(value)
            at = found.end()
        else:
            out.append("&")
            at = amp + 1


def looks_utf16(data: bytes) -> bool:
    return data[:2] in (b"\xff\xfe", b"\xfe\xff", b"<\0", b"\0<")


def _newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def events(data: bytes) -> list[tuple]:
    """("start", name, [(key, value)]), ("end", name) and ("text", s) in the order of the bytes."""
    out: list[tuple] = []
    at, n = 3 if data.startswith(b"\xef\xbb\xbf") else 0, len(data)

    def past(mark: bytes, start: int) -> int:
        found = data.find(mark, start)
        return n if found < 0 else found + len(mark)

    while at < n:
        if data[at] != 0x3C:
            end = data.find(b"<", at)
            end = n if end < 0 else end
            out.append(("text", _newlines(resolve(decode_utf8(data[at:end])))))
            at = end
        elif data.startswith(b"</", at):
            name = _REST.match(data, at + 2)
            out.append(("end", decode_utf8(name[0][:MAX_NAME])))
            at = past(b">", name.end())
        elif data.startswith(b"<!--", at):
            at = past(b"-->", at + 4)
        elif data.startswith(b"<![CDATA[", at):
            end = data.find(b"]]>", at + 9)
            out.append(("text", _newlines(decode_utf8(data[at + 9 : n if end < 0 else end]))))
            at = n if end < 0 else end + 3
        elif data.startswith(b"<!DOCTYPE", at):
            at += 9
            while at < n:
                found = _DOCTYPE_END.search(data, at)
                at = n if not found else past(b"]", found.end()) if found[0] == b"[" else found.end()
                if found and found[0] == b">":
                    break
        elif data.startswith(b"<!", at):
            at = past(b">", at + 2)
        elif data.startswith(b"<?", at):
            at = past(b"?>", at + 2)
        elif _START.match(data, at + 1):
            at = _start_tag(data, at + 1, out)
        else:
            at = past(b">", at + 2) if at + 1 < n else n
    return out


def _start_tag(data: bytes, at: int, out: list) -> int:
    name = _REST.match(data, at)
    tag, attributes = decode_utf8(name[0][:MAX_NAME]), []
    at, n = name.end(), len(data)
    out.append(("start", tag, attributes))
    while at < n:
        if data[at] == 0x3E:
            return at + 1
        if data.startswith(b"/>", at):
            out.append(("end", tag))
            return at + 2
        found = _ATTRIBUTE.match(data, at)
        if not found:
            at += 1
            continue
        raw = next((g for g in found.groups()[2:] if g is not None), b"")[:MAX_VALUE]
        attributes.append((decode_utf8(found[1][:MAX_NAME]), resolve(re.sub("[\r\n\t]", " ", decode_utf8(raw)))))
        at = found.end()
    return n


@dataclass
class Element:
    """A node of the tree: ends close the innermost element whatever their name; ends too many are skipped."""

    name: str
    attributes: list = field(default_factory=list)
    children: list = field(default_factory=list)

    def get(self, key: str) -> str | None:
        """An attribute's first value."""
        return next((v for k, v in self.attributes if k == key), None)

    def elements(self):
        return (c for c in self.children if isinstance(c, Element))

    def first(self, name: str) -> Element | None:
        """The first element of the name below, in the order of the text."""
        return next(self.outermost(name), None)

    def outermost(self, *names: str):
        """Elements of the names below, without those inside another one found."""
        stack = list(reversed(list(self.elements())))
        while stack:
            e = stack.pop()
            if e.name in names:
                yield e
            else:
                stack += reversed(list(e.elements()))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)


def tree(data: bytes) -> Element:
    root = Element("")
    open_ = [root]
    for event in events(data):
        if event[0] == "text":
            open_[-1].children.append(event[1])
        elif event[0] == "start":
            element = Element(event[1], event[2])
            open_[-1].children.append(element)
            open_.append(element)
        elif len(open_) > 1:
            open_.pop()
    return root
