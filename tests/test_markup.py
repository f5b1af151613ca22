import gzip
import io
import subprocess
import sys
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.markup import archive, markdown, office, rtf, texmath, xmlevents
from quillspark.markup.convert import ConvertError, Options, convert, detect, from_spec, man_name
from quillspark.markup.model import Doc
from quillspark.markup.terminal import width


def html(text, **options):
    return convert("x.md", text.encode(), Options(to="html", **options))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# C#\n####### x", "<h1>C</h1>\n<p>####### x</p>\n"),
        ("    a\n\n    b\n\nc", "<pre><code>a\n\nb\n</code></pre>\n<p>c</p>\n"),
        ("~~~ py\nx\n```\ny", '<pre><code class="language-py">x\n</code></pre>\n<p>y</p>\n'),
        ("- a\n  b\n\n  c\n\n- d", "<ul>\n<li>\n<p>a b</p>\n<p>c</p>\n</li>\n</ul>\n<ul>\n<li>d</li>\n</ul>\n"),
        ("- a\n+ b\n1) c\n2. d", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ol>\n<li>c</li>\n<li>d</li>\n</ol>\n"),
        ("> a\nb\n> - c\n\nd", "<blockquote>\n<p>a b</p>\n<ul>\n<li>c</li>\n</ul>\n</blockquote>\n<p>d</p>\n"),
        ("a  \nb\\\nc\nd", "<p>a<br>\nb<br>\nc d</p>\n"),
        ("| a \\| b | c |\n|-|-|\n| 1 | 2 | 3 |\n| 4", "<table>\n<thead>\n<tr><th>a | b</th><th>c</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td><td>2</td></tr>\n<tr><td>4</td><td></td></tr>\n</tbody>\n</table>\n"),
        ("***a* b**", "<p><strong><em>a</em> b</strong></p>\n"),
        ("*a **b** c*", "<p><em>a <strong>b</strong> c</em></p>\n"),
        ("a_b_c _d_ __e__", "<p>a_b_c <em>d</em> <strong>e</strong></p>\n"),
        ("`` a`b `` `x", "<p><code> a`b </code> `x</p>\n"),
        ("$x^2$ costs $5 and $6", '<p><span class="math">x²</span> costs $5 and $6</p>\n'),
        ("$$\na\n+b$$", '<div class="math display">a+b</div>\n'),
        ("[a](b (c)) [d](e \"f\") ![g](h)", '<p><a href="b" title="c">a</a> <a href="e" title="f">d</a> <img src="h" alt="g"></p>\n'),
        ("[a][B] [b][] [b] [c]\n\n[b]: u 't'", '<p><a href="u" title="t">a</a> <a href="u" title="t">b</a> <a href="u" title="t">b</a> [c]</p>\n'),
        ("<https://a.b> (https://c.d/e). xhttp://n", '<p><a href="https://a.b">https://a.b</a> (<a href="https://c.d/e">https://c.d/e</a>). xhttp://n</p>\n'),
        ("\\*a\\* \\q", "<p>*a* \\q</p>\n"),
        ("", ""),
    ],
)
def test_markdown(text, want):
    assert html(text) == want


def test_metadata():
    assert markdown.parse("---\ntitle: 'A'\ndate: x\n---\nb").meta.title == "A"
    assert markdown.parse("---\ntitle: A\n").meta.title is None
    doc = markdown.parse("% NAME(1) Manual\n% A\n  B\n%\n\nx")
    assert (doc.meta.title, doc.meta.section, doc.meta.manual, doc.meta.author, doc.meta.date) == ("NAME", "1", "Manual", "A B", None)
    assert man_name("d/tool.3x.md", doc) == ("NAME", "1") and man_name("d/tool.3x.md", Doc()) == ("tool", "3x") and man_name("notes.txt", Doc()) == ("notes.txt", "7")


def test_hard_line_breaks():
    assert html("a\nb", hard_line_breaks=True) == html("a\nb", from_="md+hard_line_breaks") == "<p>a<br>\nb</p>\n"
    assert from_spec("markdown+hard_line_breaks-hard_line_breaks") == ("markdown", False)
    for spec in ("word", "md+x"):
        with pytest.raises(ConvertError):
            from_spec(spec)


@pytest.mark.parametrize(
    ("source", "bmp", "full"),
    [
        ("x_i^2", "xᵢ²", "xᵢ²"), ("x^{ab}", "xᵃᵇ", "xᵃᵇ"), ("x^q", "x^q", "x^q"), ("x_{qq}", "x_(qq)", "x_(qq)"), ("\\frac{a+b}2", "(a+b)/2", "(a+b)/2"),
        ("\\sqrt[3]{x}\\sqrt[5]y\\sqrt{ab}", "∛(x)[5]√(y)√(ab)", "∛(x)[5]√(y)√(ab)"), ("\\mathbb{RX}\\mathcal{LA}", "ℝXℒA", "ℝ𝕏ℒ𝒜"), ("\\mathbf{A1}\\mathit{h}", "A1h", "𝐀𝟏ℎ"),
        ("\\hat x\\vec{ab}", "x̂ab⃗", "x̂ab⃗"), ("\\alpha\\le\\infty\\to\\unknown", "α≤∞→\\unknown", "α≤∞→\\unknown"), ("\\sin x\\,y\\{", "sinx\u2009y{", "sinx\u2009y{"),
        ("\\left(\\right.\\left\\langle", "(⟨", "(⟨"), ("a}b", "a", "a"), ("\\text{a b}\\operatorname{f}", "a bf", "a bf"), ("", "", ""), ("\\epsilon\\varepsilon\\phi\\varphi", "ϵεϕφ", "ϵεϕφ"),
    ],
)
def test_math(source, bmp, full):
    assert texmath.render(texmath.parse(source), "bmp") == bmp
    assert texmath.render(texmath.parse(source), "full") == full


def test_terminal():
    assert width("aé日本😀é") == 1 + 1 + 4 + 2 + 1
    text = "one two three four five six\n\n1. a\n10. b\n\n| h |\n|--:|\n| long |"
    got = convert("", text.encode(), Options(to="plain", width=20))
    assert got == "one two three four\nfive six\n\n1. a\n2. b\n\n┌──────┐\n│    h │\n├──────┤\n│ long │\n└──────┘\n"
    assert convert("", b"**a** [b](u)", Options(to="term", color="true", links="osc8")) == "\x1b[1ma\x1b[0m \x1b]8;;u\x1b\\\x1b[4;38;2;95;175;255mb\x1b[0m\x1b]8;;\x1b\\\n"


def test_rtf():
    def read(s):
        return convert("x.rtf", s if isinstance(s, bytes) else s.encode("latin-1"), Options(to="html"))

    assert read(r"{\rtf1 a\par b {\b c} d\par}") == "<p>a</p>\n<p>b <strong>c</strong> d</p>\n"
    assert read(r"{\rtf1\fs48 H\par\fs24 \u8364?\u-10179?\u-8704?x\par}") == "<h1>H</h1>\n<p>€��x</p>\n"
    assert read(b"{\\rtf1\\mac \x8e\\'8e}") == "<p>éé</p>\n"
    assert read("{\\rtf1 a\\\nb\\line c{\\*\\x gone}{\\info gone}}") == "<p>a<br>\nb<br>\nc</p>\n"
    assert read(r"{\rtf1\uc2\u955 ab c{\uc0\u955 d}}") == "<p>λ cλd</p>\n"
    assert read("{\\rtf1 unclosed {\\b x") == "<p>unclosed <strong>x</strong></p>\n"
    assert rtf.mono_fonts(rtf.tokens(r"{\fonttbl{\f0 A;}{\f2\fmodern B;}}")) == {2}


def test_xml():
    assert xmlevents.events(b'\xef\xbb\xbf<?x?><!DOCTYPE a [<!b>]><a b=1 c d="&lt;&#65;&x;"/>\r\n&#0;<') == [
        ("start", "a", [("b", "1"), ("c", ""), ("d", "<A&x;")]), ("end", "a"), ("text", "\n�"),
    ]
    root = xmlevents.tree(b"<a><b>x</c>y</a></a>z<b>2")
    assert root.first("b").text() == "x" and root.text() == "xyz2" and [e.text() for e in root.outermost("b")] == ["x", "2"]
    assert xmlevents.decode_utf8(b"\xed\xa0\x80\xe2\x82a\xff") == "���a�"
    assert xmlevents.resolve("&a&amp;&#xZ;") == "&a&�"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text(alphabet="<>/a b=\"'&;#![]-?", max_size=60).map(str.encode))
def test_any_bytes_are_read(data):
    xmlevents.tree(data)
    rtf.parse(b"{\\rtf" + data)
    office.parse_abw(data)
    assert xmlevents.decode_utf8(data).isprintable() in (True, False)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#>-*_`~$[]()!|\\1. \n\tab<h", max_size=60))
def test_any_text_is_converted(text):
    for to in ("html", "latex", "man", "rtf", "abw", "plain", "term"):
        convert("", text.encode(), Options(to=to))


def _zip(method=zipfile.ZIP_DEFLATED, **members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_archives():
    data = _zip(a="one" * 50, b="")
    found = archive.members(data)
    assert [(m.name, m.usize) for m in found] == [("a", 150), ("b", 0)] and archive.extract(data, found[0]) == b"one" * 50
    assert archive.listing(_zip(zipfile.ZIP_STORED, a="x")) == "        1  stored   a\n"
    broken = bytearray(data)
    broken[32] ^= 0xFF
    for bad in (b"", b"x" * 30, bytes(broken)):
        with pytest.raises(archive.ArchiveError):
            archive.extract(bad, archive.members(bad)[0])
    packed = gzip.compress(b"text" * 9)
    assert archive.gunzip(packed) == b"text" * 9
    named = packed[:3] + bytes([0x0C]) + packed[4:10] + b"\x02\0ab" + b"name\0" + packed[10:]
    assert archive.gunzip(named) == b"text" * 9
    for bad, why in ((packed[:-1], "gzip|deflate"), (b"x" * 20, "not a gzip"), (packed + gzip.compress(b"2"), "CRC|deflate|size"), (packed[:3] + b"\xff" + packed[4:], "flags")):
        with pytest.raises(archive.ArchiveError, match=why):
            archive.gunzip(bad)
    assert zlib.crc32(b"one" * 50) == found[0].crc


def test_detection():
    assert [detect(p, b"") for p in ("a.rtf", "b.FODT", "c.abw", "d.docx", "x.y/z")] == ["rtf", "odt", "abw", "markdown", "markdown"]
    assert detect("a.odt", b"PK\3\4") == "odt" and detect("a", b"{\\rtf1") == "rtf"
    for path, head in (("a.zip", b"PK\3\4"), ("a.doc", b"\xd0\xcf\x11\xe0")):
        with pytest.raises(ConvertError):
            detect(path, head)
    with pytest.raises(office.FormatError, match="no word/document.xml"):
        convert("a.docx", _zip(x="y"))
    with pytest.raises(ConvertError, match="UTF-16"):
        convert("a.abw", "<a/>".encode("utf-16"))


def test_command_line(tmp_path):
    def call(*args, data=b""):
        return subprocess.run([sys.executable, "-m", "quillspark", *args], input=data, capture_output=True, env={"PYTHONPATH": ".", "PATH": ""}, cwd=__file__.rsplit("/tests/", 1)[0])

    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.zip").write_bytes(_zip(m="text"))
    assert call("-t", "html", str(tmp_path / "a.md"), "-", data=b"b").stdout == b"<h1>A</h1>\n<p>b</p>\n"
    assert call("-t=latex", data=b"x").stdout == b"x\n\n"
    assert call("--zip=m", str(tmp_path / "b.zip")).stdout == b"text"
    assert call("--nope").returncode == call("-f", "docx").returncode == call("-t", "nope").returncode == 2
