"""The command line: converts files or standard input, lists and extracts zip members, decompresses gzip files."""

from __future__ import annotations

import os
import re
import sys
from dataclasses import replace

from .markup import archive
from .markup.convert import ERRORS, ConvertError, Options, combine, from_spec, read, render
from .markup.xmlevents import decode_utf8

USAGE = """\
usage: python -m quillspark [OPTIONS] [FILE ...]        (standard input without FILE)

  -t FORMAT            term (default) | html | latex | man | rtf | abw | plain
  -f FORMAT            input: markdown | rtf | odt | docx | abw, by magic bytes and extension if not given;
                       markdown+hard_line_breaks makes every newline in a paragraph a line break
  -o FILE              write to FILE
  -s, --standalone     a full document (html, latex)
  --hard-line-breaks   the same as -f markdown+hard_line_breaks
  --color=MODE         auto (default) | none | 16 | true
  --glyphs=LEVEL       bmp (default) | full | ascii (math as its source); --ascii for short
  --width=N            columns to wrap at (default: $COLUMNS or 80)
  --italics=on|off     default: on for --color=true
  --links=osc8|off     clickable links on a terminal
  --title=T            title of the document
  --zip=list|MEMBER    list a zip file's members, or extract one
  --gunzip             decompress a gzip file
"""
_VALUES = {"-t": "to", "-f": "from_", "--from": "from_", "--color": "color", "--glyphs": "glyphs", "--title": "title", "--links": "links", "--width": "width", "--italics": "italics", "-o": "out", "--zip": "zip"}
_FLAGS = {"-s": ("standalone", True), "--standalone": ("standalone", True), "--hard-line-breaks": ("hard_line_breaks", True), "--ascii": ("glyphs", "ascii"), "--gunzip": ("gunzip", True)}


def arguments(args: list[str]) -> tuple[dict, list[str]]:
    """Settings by name, later ones over earlier ones, and files."""
    settings: dict = {}
    files: list[str] = []
    rest = iter(args)
    for a in rest:
        name, equals, value = a.partition("=")
        if a in _FLAGS:
            settings[_FLAGS[a][0]] = _FLAGS[a][1]
        elif a in ("-t", "-f", "-o"):
            value = next(rest, None)
            if value is None:
                raise ConvertError(f"option {a} needs a value")
            settings[_VALUES[a]] = value
        elif equals and name in _VALUES and name != "-o":
            settings[_VALUES[name]] = value
        elif a.startswith("-") and a != "-":
            raise ConvertError(f"unknown option {a}")
        else:
            files.append(a)
    if "width" in settings:
        settings["width"] = int(re.match("[0-9]*", settings["width"])[0] or 0)
    if "italics" in settings:
        settings["italics"] = settings["italics"] == "on"
    return settings, files


def run(args: list[str]) -> bytes:
    settings, files = arguments(args)
    out, member, gunzip = (settings.pop(k, None) for k in ("out", "zip", "gunzip"))
    if member or gunzip:
        if len(files) != 1 or files[0] == "-":
            raise ConvertError("one named file is needed")
        with open(files[0], "rb") as f:
            data = f.read()
        if member == "list":
            result = archive.listing(data).encode()
        elif member:
            found = archive.find(archive.members(data), member)
            if found is None:
                raise ConvertError(f"no such member: {member}")
            result = archive.extract(data, found)
        else:
            result = archive.gunzip(data)
        result = result if out else decode_utf8(result).encode()
    else:
        columns = int(re.match("[0-9]*", os.environ.get("COLUMNS", ""))[0] or 0)
        if "width" not in settings and columns >= 20:
            settings["width"] = columns
        options = Options(**settings)
        if options.color not in ("none", "16", "true"):
            options = replace(options, color="true" if os.environ.get("COLORTERM") in ("truecolor", "24bit") else "16")
        docs = []
        for path in files or ["-"]:
            if path == "-":
                kind = from_spec(options.from_)[0] if options.from_ else "markdown"
                if kind not in ("markdown", "rtf"):
                    raise ConvertError(f"stdin: {kind} input needs a named file")
                docs.append(read("", sys.stdin.buffer.read(), options if options.from_ else replace(options, from_="markdown")))
            else:
                with open(path, "rb") as f:
                    docs.append(read(path, f.read(), options))
        result = render(combine(docs), next(iter(files), ""), options).encode("utf-8", "replace")
    if out:
        with open(out, "wb") as f:
            f.write(result)
        return b""
    return result


def main() -> int:
    args = sys.argv[1:]
    if {"-h", "--help"} & set(args):
        print(USAGE, end="")
        return 0
    if "--version" in args:
        print("quillspark 0.1.0")
        return 0
    try:
        sys.stdout.buffer.write(run(args))
    except (*ERRORS, OSError) as e:
        print(f"quillspark: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
