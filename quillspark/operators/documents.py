"""Operators that run a parser or writer for each document, in Arrow batches; a document that can't be read gives an error, not a failed job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..markup import archive, markdown, office, rtf, texmath, xmlevents
from ..markup.convert import ERRORS, Options, convert as convert_one, read, render
from ..markup.model import Doc, flat


def _clean(value):
    """Text that Arrow takes: what is no character becomes U+FFFD."""
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) and not value.isascii() and any("\ud800" <= c < "\ue000" for c in value) else value


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer partitions than there are cores, over all of them; larger ones are left as they are."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def flat_map(df: DataFrame, inputs: list[str], make: Callable[..., Iterator[tuple]], keep: list[str], schema: str) -> DataFrame:
    """For each row the kept columns and, for each tuple that make gives for its inputs, the tuple's columns."""
    fields = StructType([df.schema[c] for c in keep] + list(_parse_datatype_string(schema).fields))
    arrow = to_arrow_schema(fields)

    def run(batches):
        for batch in batches:
            columns = [batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
            place: list[int] = []
            rows: list[tuple] = []
            for k, values in enumerate(zip(*columns, strict=True)):
                for row in make(*values):
                    place.append(k)
                    rows.append(tuple(map(_clean, row)))
            kept = [batch.column(i).take(pa.array(place, pa.int64())) for i in range(len(keep))]
            made = [pa.array(list(c), arrow.field(len(keep) + i).type) for i, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], f.type) for f in list(arrow)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in fields])

    return spread(df.select(*keep, *[F.col(c).alias(f"__{i}") for i, c in enumerate(inputs)])).mapInArrow(run, fields)


def _bytes(content) -> bytes:
    return content.encode("utf-8", "replace") if isinstance(content, str) else bytes(content or b"")


def _inputs(df: DataFrame, content_column: str, path_column: str | None) -> list[str]:
    return [content_column, path_column] if path_column else [content_column]


def _parsed(options: Options):
    def parse(content, path: str | None = "") -> Doc | None:
        if content is None:
            return None
        try:
            return read(path or "", _bytes(content), options)
        except ERRORS:
            return None

    return parse


META = "title string, author string, date string, section string, manual string"


def converted(docs: DataFrame, options: Options, keep: list[str], content_column: str = "content", path_column: str | None = None, meta: bool = False) -> DataFrame:
    """The kept columns, output and error: each document in the format that options name. Null content has nulls in both.

    With meta the document's title, author, date, section and manual come too, from the same reading of it.
    """
    none = (None,) * 5 if meta else ()

    def make(content, path: str | None = ""):
        if content is None:
            return [(None, None, *none)]
        try:
            if not meta:
                return [(convert_one(path or "", _bytes(content), options), None)]
            doc = read(path or "", _bytes(content), options)
            m = doc.meta
            told = (m.title, m.author, m.date, m.section, m.manual)
            return [(render(doc, path or "", options), None, *told)]
        except ERRORS as e:
            return [(None, str(e), *none)]

    return flat_map(docs, _inputs(docs, content_column, path_column), make, keep, "output string, error string" + (f", {META}" if meta else ""))


def rendered_combined(docs: DataFrame, options: Options, key: str, order: str, content_column: str = "content", path_column: str | None = None) -> DataFrame:
    """Each key's documents in order as one, rendered: blocks in order, the first document's metadata, an error if any has one."""
    paths = F.col(path_column) if path_column else F.lit("")
    parts = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), paths.alias("path"), F.col(content_column).alias("content")))).alias("parts"))

    def make(found):
        from ..markup.convert import combine

        try:
            return [(render(combine([read(p["path"] or "", _bytes(p["content"]), options) for p in found]), found[0]["path"] or "", options), None)]
        except ERRORS as e:
            return [(None, str(e))]

    return flat_map(parts, ["parts"], make, [key], "output string, error string")


BLOCK_SCHEMA = "pos int, parent int, depth int, kind string, level int, checked boolean, info string, text string"


def _blocks(doc: Doc) -> list[tuple]:
    rows: list[list] = []

    def add(blocks: list, parent: int | None, depth: int, checked=None) -> None:
        for b in blocks:
            kind, pos = b[0], len(rows)
            level = b[1] if kind in ("heading", "numbers") else None
            info = b[1] if kind in ("code", "math") else ",".join(b[1]) if kind == "table" else None
            text = flat(b[-1]) if kind in ("heading", "para") else "\n".join(b[2]) if kind == "code" else texmath.render(b[2]) if kind == "math" else None
            rows.append([pos, parent, depth, kind, level, checked, info, text])
            if kind == "quote":
                add(b[1], pos, depth + 1)
            elif kind in ("bullets", "numbers"):
                for i, (box, inner) in enumerate(b[-1]):
                    item = len(rows)
                    rows.append([item, pos, depth + 1, "item", b[1] + i if kind == "numbers" else None, box, None, None])
                    add(inner, item, depth + 2)

    add(doc.blocks, None, 0)
    return [tuple(r) for r in rows]


def blocks(docs: DataFrame, keep: list[str], content_column: str = "content", path_column: str | None = None, options: Options = Options()) -> DataFrame:
    """Blocks and list items in the order of the text. level is a heading's or an item's number, parent the pos of what holds it."""
    parse = _parsed(options)
    return flat_map(docs, _inputs(docs, content_column, path_column), lambda *x: _blocks(d) if (d := parse(*x)) else [], keep, BLOCK_SCHEMA)


def _walk(blocks: list):
    """Every list of inlines of a document, in order."""
    for b in blocks:
        kind = b[0]
        if kind in ("heading", "para"):
            yield b[-1]
        elif kind == "quote":
            yield from _walk(b[1])
        elif kind in ("bullets", "numbers"):
            for _, inner in b[-1]:
                yield from _walk(inner)
        elif kind == "table":
            for row in [b[2], *b[3]]:
                yield from row


def _inlines(doc: Doc) -> list[tuple]:
    rows: list[tuple] = []

    def add(nodes: list, parent: int | None, run: int) -> None:
        for n in nodes:
            pos, kind = len(rows), n[0]
            nested = kind in ("emph", "strong", "strike", "link", "image")
            linked = kind in ("link", "image")
            rows.append((run, pos, parent, kind, flat([n]) if kind != "break" else None, n[2] if linked else None, n[3] if linked else None))
            if nested:
                add(n[1], pos, run)

    for run, nodes in enumerate(_walk(doc.blocks)):
        add(nodes, None, run)
    return rows


def inlines(docs: DataFrame, keep: list[str], content_column: str = "content", path_column: str | None = None, options: Options = Options()) -> DataFrame:
    """Inlines in the order of the text: run numbers the paragraphs, headings and cells, parent is the pos of what holds one."""
    parse = _parsed(options)
    return flat_map(docs, _inputs(docs, content_column, path_column), lambda *x: _inlines(d) if (d := parse(*x)) else [], keep, "run int, pos int, parent int, kind string, text string, url string, title string")


def _cells(doc: Doc) -> list[tuple]:
    rows: list[tuple] = []

    def add(blocks: list) -> None:
        for b in blocks:
            if b[0] == "table":
                table = rows[-1][0] + 1 if rows else 0
                for r, row in enumerate([b[2], *b[3]]):
                    rows.extend((table, r, c, flat(cell), b[1][c] if c < len(b[1]) else "left", r == 0) for c, cell in enumerate(row))
            elif b[0] == "quote":
                add(b[1])
            elif b[0] in ("bullets", "numbers"):
                for _, inner in b[-1]:
                    add(inner)

    add(doc.blocks)
    return rows


def cells(docs: DataFrame, keep: list[str], content_column: str = "content", path_column: str | None = None, options: Options = Options()) -> DataFrame:
    """Table cells: table, row, col from 0, text, align, header."""
    parse = _parsed(options)
    return flat_map(docs, _inputs(docs, content_column, path_column), lambda *x: _cells(d) if (d := parse(*x)) else [], keep, "table int, row int, col int, text string, align string, header boolean")


def metadata(docs: DataFrame, keep: list[str], content_column: str = "content", path_column: str | None = None, options: Options = Options()) -> DataFrame:
    """title, author, date, section, manual of every document that can be read."""
    parse = _parsed(options)

    def make(*x):
        doc = parse(*x)
        return [(doc.meta.title, doc.meta.author, doc.meta.date, doc.meta.section, doc.meta.manual)] if doc else []

    return flat_map(docs, _inputs(docs, content_column, path_column), make, keep, META)


def definitions(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Link definitions of Markdown texts, the first of each folded label."""

    def make(text):
        lines = [x.replace("\r", "").replace("\t", "    ") for x in (text or "").split("\n")]
        return [(label, url, title, pos) for pos, (label, (url, title)) in enumerate(markdown._definitions(lines)[0].items())]

    return flat_map(docs, [text_column], make, keep, "label string, url string, title string, pos int")


def line_states(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """pos, kind, line of every line; a line's kind is the first of LINE_KINDS that fits, and "code" inside a fence.

    Whether a fence is open depends on all lines before, so a document's lines are read in order, once.
    """
    from ..functions.text import LINE_KINDS

    kinds = [(name, re.compile(pattern.replace("\\x0B", "\\x0b"))) for name, pattern in LINE_KINDS]

    def make(text):
        open_, rows = False, []
        lines = (text or "").replace("\r", "").replace("\t", "    ").split("\n")
        for pos, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
            kind = next((name for name, pattern in kinds if pattern.search(line)), "text")
            if open_:
                open_ = not markdown._fence_end(line)
                kind = "code" if open_ else "fence"
            elif kind == "fence":
                open_ = True
            rows.append((pos, kind, line))
        return rows

    return flat_map(docs, [text_column], make, keep, "pos int, kind string, line string")


def math_text(df: DataFrame, keep: list[str], source_column: str = "source", level: str = "bmp") -> DataFrame:
    """TeX math as Unicode text."""
    return flat_map(df, [source_column], lambda s: [(None if s is None else texmath.render(texmath.parse(s), level),)], keep, "rendered string")


def xml_events(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Events of any bytes: pos, kind (start, end, text), name, attrs in order, text, and depth of the elements open before it."""

    def make(content):
        depth, out = 0, []
        for pos, e in enumerate(xmlevents.events(_bytes(content))):
            depth -= e[0] == "end" and depth > 0
            out.append((pos, e[0], None if e[0] == "text" else e[1], [{"k": k, "v": v} for k, v in e[2]] if e[0] == "start" else None, e[1] if e[0] == "text" else None, depth))
            depth += e[0] == "start"
        return out

    return flat_map(df, [content_column], make, keep, "pos int, kind string, name string, attrs array<struct<k:string,v:string>>, text string, depth int")


def zip_members(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Members in the directory's order, or one row with an error."""

    def make(content):
        try:
            return [(i, m.name, m.method, m.csize, m.usize, m.crc, None) for i, m in enumerate(archive.members(_bytes(content)))]
        except archive.ArchiveError as e:
            return [(None, None, None, None, None, None, str(e))]

    return flat_map(df, [content_column], make, keep, "ord int, name string, method int, csize long, usize long, crc32 long, error string")


def zip_extract(df: DataFrame, keep: list[str], name: str, content_column: str = "content") -> DataFrame:
    """The first member of the name, checked, or an error."""

    def make(content):
        try:
            member = archive.find(archive.members(_bytes(content)), name)
            return [(None, f"no such member: {name}")] if member is None else [(archive.extract(_bytes(content), member), None)]
        except archive.ArchiveError as e:
            return [(None, str(e))]

    return flat_map(df, [content_column], make, keep, "data binary, error string")


def gunzipped(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    def make(content):
        try:
            return [(archive.gunzip(_bytes(content)), None)]
        except archive.ArchiveError as e:
            return [(None, str(e))]

    return flat_map(df, [content_column], make, keep, "data binary, error string")


def zip_listing(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    def make(content):
        try:
            return [(archive.listing(_bytes(content)), None)]
        except archive.ArchiveError as e:
            return [(None, str(e))]

    return flat_map(df, [content_column], make, keep, "listing string, error string")


def rtf_styles(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Numbers and names of the style sheet."""
    return flat_map(df, [content_column], lambda c: list(rtf.styles(rtf.tokens(_bytes(c).decode("latin-1"))).items()), keep, "number int, name string")


def rtf_mono_fonts(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    return flat_map(df, [content_column], lambda c: [(n,) for n in sorted(rtf.mono_fonts(rtf.tokens(_bytes(c).decode("latin-1"))))], keep, "font int")


def odf_styles(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Styles of flat OpenDocument XML and what they set."""

    def make(content):
        found = office._Odf(xmlevents.tree(_bytes(content))).styles
        return [(name, *(look or (False,) * 4)) for name, look in found.items()]

    return flat_map(df, [content_column], make, keep, "name string, bold boolean, italic boolean, strike boolean, mono boolean")


def docx_relationships(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Identifiers and targets of a docx file's main document, the first target of each identifier."""
    return flat_map(df, [content_column], lambda c: list(_docx_parts(_bytes(c)).targets.items()), keep, "rel_id string, target string")


def docx_numbering(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """The number format of each list and level of a docx file."""

    def make(content):
        reader = _docx_parts(_bytes(content))
        return [(number, level, form) for number, kind in reader.lists.items() for level, form in sorted(reader.formats.get(kind, {}).items())]

    return flat_map(df, [content_column], make, keep, "num_id string, level int, format string")


def _docx_parts(data: bytes) -> office._Docx:
    try:
        members = archive.members(data)
    except archive.ArchiveError:
        members = []

    def part(name: str):
        member = archive.find(members, name)
        try:
            return xmlevents.tree(office._member(data, member)) if member else None
        except office.FormatError:
            return None

    return office._Docx(part("word/_rels/document.xml.rels"), part("word/numbering.xml"))


def decoded(df: DataFrame, keep: list[str], content_column: str = "content") -> DataFrame:
    """Bytes as text, with U+FFFD for what is no UTF-8."""
    return flat_map(df, [content_column], lambda c: [(None if c is None else xmlevents.decode_utf8(_bytes(c)),)], keep, "text string")
