"""Column functions on lines, labels, paths and texts, from Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\r\f\x0b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SP = r"[ \t\n\r\f\x0B]"
# Ranges of characters that take no column, and two.
NARROW = r"[\x{0300}-\x{036F}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}]"
WIDE = (
    r"[\x{1100}-\x{115F}\x{2E80}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}"
    r"\x{231A}\x{231B}\x{2614}\x{2615}\x{267F}\x{2693}\x{26A1}\x{26AA}\x{26AB}\x{26BD}\x{26BE}\x{26C4}\x{26C5}\x{26CE}\x{26D4}\x{26EA}\x{26F2}\x{26F3}"
    r"\x{26F5}\x{26FA}\x{26FD}\x{2705}\x{270A}\x{270B}\x{2728}\x{274C}\x{274E}\x{2753}\x{2754}\x{2755}\x{2757}\x{2795}\x{2796}\x{2797}\x{27B0}\x{27BF}"
    r"\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}]"
)
#: Patterns of line kinds in the order in which they apply; the first that fits a line names it.
LINE_KINDS = (
    ("blank", rf"^{_SP}*$"),
    ("indented", "^ {4}"),
    ("fence", "^ {0,3}(`{3,}|~{3,})"),
    ("math", rf"^{_SP}*\$\$"),
    ("heading", "^ {0,3}#{1,6}( |$)"),
    ("rule", rf"^{_SP}*(-({_SP}*-){{2,}}|\*({_SP}*\*){{2,}}|_({_SP}*_){{2,}}){_SP}*$"),
    ("quote", "^ {0,3}>"),
    ("item", "^ {0,3}([-*+]|[0-9]+[.)]) "),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def indent(c: Column) -> Column:
    return F.length(F.regexp_extract(c, "^( *)", 1))


def split_lines(c: Column) -> Column:
    """Lines without carriage returns, tabs as four spaces; a last empty line is none."""
    lines = F.split(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\t"), F.lit("    ")), "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def line_kind(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in LINE_KINDS:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("text"))


def heading_level(c: Column) -> Column:
    """1 to 6, or null for a line that is no heading."""
    hashes = F.regexp_extract(c, "^ {0,3}(#{1,6})(?: |$)", 1)
    return F.when(F.length(hashes) > 0, F.length(hashes))


def heading_text(c: Column) -> Column:
    return trim(F.rtrim(trim(F.regexp_extract(c, "^ {0,3}#{1,6}(.*)$", 1)), F.lit("#")))


def is_hard_break(c: Column) -> Column:
    """Whether a paragraph's line, not its last, ends in a hard break."""
    body = F.rtrim(c, F.lit(SPACES))
    slashes = F.length(F.regexp_extract(body, r"(\\*)$", 1))
    return (F.length(c) - F.length(body) >= 2) | (slashes % 2 == 1)


def escape_html(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def escape_latex(c: Column) -> Column:
    """Signs whose escapes hold braces are set aside as noncharacters, so that nothing is escaped twice."""
    c = F.regexp_replace(F.translate(c, "\\~^", "\ufdd0\ufdd1\ufdd2"), r"([{}$&#_%])", r"\\$1")
    for mark, name in (("\ufdd0", "textbackslash"), ("\ufdd1", "textasciitilde"), ("\ufdd2", "textasciicircum")):
        c = F.replace(c, F.lit(mark), F.lit(f"\\{name}{{}}"))
    return c


def display_width(c: Column) -> Column:
    """Columns that a text takes on a terminal."""
    return F.length(c) - F.regexp_count(c, F.lit(NARROW)) + F.regexp_count(c, F.lit(WIDE))


def extension(path: Column) -> Column:
    """Behind the last dot of the last part of a path, A-Z lower-cased, or empty."""
    return lower_ascii(F.regexp_extract(path, r"\.([^./]*)$", 1))


def document_format(path: Column, content: Column) -> Column:
    """The format by the first bytes, else by the extension; null for what is refused."""
    head, ext = F.hex(F.substring(content, 1, 5)), extension(path)
    return (
        F.when(head.rlike("^504B(0304|0506|0708)"), F.when(ext.isin("docx", "odt", "idml"), ext))
        .when(head == "7B5C727466", "rtf")
        .when(head.startswith("D0CF11E0"), None)
        .when(ext.isin("rtf", "abw"), ext)
        .when(ext == "fodt", "odt")
        .otherwise("markdown")
    )


def man_name(path: Column) -> Column:
    """A struct of name and section: page.3x.md is page in section 3x, others are in section 7."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    base = F.when(F.length(base) > 3, F.regexp_replace(base, r"\.md$", "")).otherwise(base)
    section = F.regexp_extract(base, r"^.+\.([0-9][^.]*)$", 1)
    found = F.length(section) > 0
    return F.struct(F.when(found, F.regexp_extract(base, r"^(.+)\.[0-9][^.]*$", 1)).otherwise(base).alias("name"), F.when(found, section).otherwise("7").alias("section"))


def bare_urls(c: Column) -> Column:
    """Addresses at the beginnings of words, without the punctuation behind them."""
    found = F.regexp_extract_all(c, F.lit(rf"(?:^|[ \t\n\r\f\x0B(\[])(https?://[^ \t\n\r\f\x0B<>\"]*)"), F.lit(1))
    return F.transform(found, lambda u: F.rtrim(u, F.lit(".,;:!?)]}")))
