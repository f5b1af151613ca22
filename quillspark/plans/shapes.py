"""Registered queries on more shapes of documents, one or two rarer constructs each; the SQL states the expected output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..markup.convert import Options
from ..operators import documents as D
from .queries import _zipped, query, table


def _from_parts(spark, sf_dir, *pieces: str | Column, path: str = "x.md", **options) -> DataFrame:
    """One document for each part; names of columns stand for themselves, other pieces are text."""
    columns = ("p_partkey", "p_name", "p_size", "p_brand")
    text = F.concat(*[F.col(x).cast("string") if x in columns else F.lit(x) for x in pieces])
    docs = table(spark, sf_dir, "part").select("p_partkey", text.alias("content"), F.lit(path).alias("path"))
    return D.converted(docs, Options(**options), ["p_partkey"], path_column="path").select("p_partkey", "output")


@query("SELECT p_partkey, '<p>a <span class=\"math\">x₁²</span> b</p>' || chr(10) || '<div class=\"math display\">y=' || p_size || '</div>' || chr(10) || '<div class=\"math display\">z</div>' || chr(10) AS output FROM part")
def math_blocks(spark, sf_dir):
    return _from_parts(spark, sf_dir, "a $x_1^2$ b\n\n$$\ny = ", "p_size", "\n$$\n\n$$z$$\n", to="html")


@query("SELECT p_partkey, '<pre><code>' || p_name || chr(10) || '  two' || chr(10) || '</code></pre>' || chr(10) || '<p>x</p>' || chr(10) AS output FROM part")
def indented_code(spark, sf_dir):
    return _from_parts(spark, sf_dir, "    ", "p_name", "\n      two\n\nx\n", to="html")


@query("SELECT p_partkey, '<ul>' || chr(10) || '<li>' || chr(10) || '<p>one</p>' || chr(10) || '<p>more ' || p_size || '</p>' || chr(10) || '</li>' || chr(10) || '<li>two</li>' || chr(10) || '</ul>' || chr(10) || '<p>end</p>' || chr(10) AS output FROM part")
def continued_items(spark, sf_dir):
    return _from_parts(spark, sf_dir, "- one\n\n  more ", "p_size", "\n- two\n\nend\n", to="html")


@query("SELECT p_partkey, '<p>see <a href=\"http://x.org/' || p_partkey || '\">http://x.org/' || p_partkey || '</a> now</p>' || chr(10) AS output FROM part")
def autolinks(spark, sf_dir):
    return _from_parts(spark, sf_dir, "see <http://x.org/", "p_partkey", "> now\n", to="html")


@query("SELECT p_partkey, '∛(x' || p_size || ')(a' || chr(770) || ')if bx₁₂' AS rendered FROM part")
def math_constructs(spark, sf_dir):
    source = F.concat(F.lit("\\sqrt[3]{x"), "p_size", F.lit("} \\left( \\hat{a} \\right) \\text{if b} x_{12}"))
    return D.math_text(table(spark, sf_dir, "part").select("p_partkey", source.alias("source")), ["p_partkey"])


@query("SELECT p_partkey, chr(27) || '[31my' || p_size || chr(27) || '[0m' || chr(10) AS output FROM part")
def colored_math(spark, sf_dir):
    return _from_parts(spark, sf_dir, "$\\textcolor{red}{y", "p_size", "}$\n", to="term", color="16")


@query("SELECT p_partkey, p_name || chr(10) || 'B · D' || chr(10) || chr(10) || 't' || chr(10) AS output FROM part")
def title_blocks(spark, sf_dir):
    return _from_parts(spark, sf_dir, "---\ntitle: ", "p_name", "\nauthor: B\ndate: D\n---\nt\n", to="plain")


@query("SELECT p_partkey, 'one two three four five' || chr(10) || 'six seven eight nine ten' || chr(10) || 'eleven twelve ' || p_size || chr(10) AS output FROM part")
def wrapped_words(spark, sf_dir):
    return _from_parts(spark, sf_dir, "one two three four five six seven eight nine ten eleven twelve ", "p_size", "\n", to="plain", width=24)


_HEAD = "'<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset=\"utf-8\">' || chr(10) || '<title>' || {title} || '</title>' || chr(10) || '<style></style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)"


@query(
    "SELECT p_partkey, " + _HEAD.format(title="p_name") + " || '<header>' || chr(10) || '<h1 class=\"title\">' || p_name || '</h1>' || chr(10) || '<p class=\"byline\">B</p>' || chr(10) || '</header>' || chr(10) || '<p>t</p>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS own, "
    + _HEAD.format(title="'Given'") + " || '<header>' || chr(10) || '<h1 class=\"title\">' || p_name || '</h1>' || chr(10) || '<p class=\"byline\">B</p>' || chr(10) || '</header>' || chr(10) || '<p>t</p>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS given FROM part"
)
def standalone_pages(spark, sf_dir):
    """The style sheet is left out of the comparison."""
    pieces = ("---\ntitle: ", "p_name", "\nauthor: B\n---\nt\n")
    bare = lambda df, name: df.select("p_partkey", F.regexp_replace("output", "(?s)<style>.*</style>", "<style></style>").alias(name))
    own = bare(_from_parts(spark, sf_dir, *pieces, to="html", standalone=True), "own")
    return own.join(bare(_from_parts(spark, sf_dir, *pieces, to="html", standalone=True, title="Given"), "given"), "p_partkey")


@query(
    r"SELECT p_partkey, '\documentclass{article}' || chr(10) || '\usepackage[utf8]{inputenc}' || chr(10) || '\usepackage[T1]{fontenc}' || chr(10) || '\usepackage{amsmath,amssymb}' || chr(10) || '\usepackage{hyperref}' || chr(10)"
    r" || '\begin{document}' || chr(10) || chr(10) || '\title{T' || p_size || '}' || chr(10) || '\maketitle' || chr(10) || chr(10) || 't' || chr(10) || chr(10) || '\end{document}' || chr(10) AS output FROM part"
)
def standalone_latex(spark, sf_dir):
    return _from_parts(spark, sf_dir, "---\ntitle: T", "p_size", "\n---\nt\n", to="latex", standalone=True)


@query(r"""SELECT p_partkey, '.TH "T" "7"' || chr(10) || '.PP' || chr(10) || '\&.' || p_size || ' ''x\[rs]' || chr(10) || '.IP \(bu 2' || chr(10) || 'a -- b' || chr(10) AS output FROM part""")
def man_escapes(spark, sf_dir):
    return _from_parts(spark, sf_dir, "---\ntitle: T\n---\n.", "p_size", " 'x\\\n\n- a -- b\n", to="man")


@query(r"""SELECT p_partkey, '\{' || p_size || '\} \\\u233?\par' AS line FROM part""")
def rtf_escapes(spark, sf_dir):
    found = _from_parts(spark, sf_dir, "{", "p_size", "} \\é\n", to="rtf")
    return found.select("p_partkey", F.element_at(F.split("output", "\n"), -3).alias("line"))


@query(
    """SELECT s_suppkey, '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>' || s_name || '</th><th>b</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || s_nationkey || '</td><td>d</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) AS output FROM supplier"""
)
def odt_tables(spark, sf_dir):
    cell = lambda x: F.concat(F.lit("<table:table-cell><text:p>"), x, F.lit("</text:p></table:table-cell>"))
    text = F.concat(
        F.lit('<?xml version="1.0"?><office:document><office:text><table:table><table:table-row>'), cell(F.col("s_name")), cell(F.lit("b")), F.lit("</table:table-row><table:table-row>"),
        cell(F.col("s_nationkey").cast("string")), cell(F.lit("d")), F.lit("</table:table-row></table:table></office:text></office:document>"),
    )
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("content"), F.lit("x.fodt").alias("path"))
    return D.converted(docs, Options(to="html"), ["s_suppkey"], path_column="path").select("s_suppkey", "output")


@query(
    """SELECT s_suppkey, '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>' || s_name || '</th><th>b</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || s_nationkey || '</td><td>d</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
    || '<p><img src="m.png" alt="alt ' || s_suppkey || '"></p>' || chr(10) AS output FROM supplier"""
)
def docx_tables_and_images(spark, sf_dir):
    cell = lambda x: F.concat(F.lit("<w:tc><w:p><w:r><w:t>"), x, F.lit("</w:t></w:r></w:p></w:tc>"))
    body = F.concat(
        F.lit("<w:document><w:body><w:tbl><w:tr>"), cell(F.col("s_name")), cell(F.lit("b")), F.lit("</w:tr><w:tr>"), cell(F.col("s_nationkey").cast("string")), cell(F.lit("d")),
        F.lit('</w:tr></w:tbl><w:p><w:r><w:drawing><wp:inline><wp:docPr id="1" descr="alt '), "s_suppkey",
        F.lit('"/><a:graphic><a:graphicData><pic:pic><pic:blipFill><a:blip r:embed="r2"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p></w:body></w:document>'),
    )
    rels = F.lit('<Relationships><Relationship Id="r2" Target="m.png"/></Relationships>')
    zipped = _zipped(table(spark, sf_dir, "supplier").select("s_suppkey", body.alias("body"), rels.alias("rels")), ["s_suppkey"], {"word/document.xml": "body", "word/_rels/document.xml.rels": "rels"}).withColumn("path", F.lit("x.docx"))
    return D.converted(zipped, Options(to="html"), ["s_suppkey"], path_column="path").select("s_suppkey", "output")


@query("SELECT n_nationkey, pos, kind, name, text FROM nation, LATERAL (SELECT * FROM (VALUES (0, 'start', 'r', NULL), (1, 'text', NULL, 'a' || chr(10) || 'b' || chr(10) || n_name || ' &unknown;�'), (2, 'end', 'r', NULL)) AS v(pos, kind, name, text))")
def xml_newlines_and_references(spark, sf_dir):
    text = F.concat(F.lit("<r>a\r\nb\r"), "n_name", F.lit(" &unknown;&#0;</r>"))
    return D.xml_events(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content")), ["n_nationkey"]).select("n_nationkey", "pos", "kind", "name", "text")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'damaged' ELSE 'missing' END AS outcome, CASE WHEN doc_id % 3 = 0 THEN md5(text) END AS digest FROM documents WHERE length(text) > 0""")
def zip_refusals(spark, sf_dir):
    """Members of damaged files and such as aren't there give errors, not failed jobs; the errors' words are left out."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    zipped = _zipped(docs, ["doc_id"], {"text": "text"})
    # the stored member's first byte is changed, so that its checksum is wrong
    broken = F.concat(F.substring("content", 1, 34), F.expr("unhex('00')"), F.expr("substring(content, 36)"))
    files = zipped.withColumn("content", F.when(F.col("doc_id") % 3 == 1, broken).otherwise(F.col("content")))
    got = D.zip_extract(files.where("doc_id % 3 < 2"), ["doc_id"], "text").union(D.zip_extract(files.where("doc_id % 3 = 2"), ["doc_id"], "other"))
    outcome = F.when(F.col("error").startswith("no such member"), "missing").when(F.col("error").isNotNull(), "damaged")
    return got.select("doc_id", outcome.alias("outcome"), F.md5("data").alias("digest"))
