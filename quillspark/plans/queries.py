"""Registered queries over the driver's tables, each with DuckDB SQL that says what must come out.

Structured inputs are put together from relational columns, the same way on both sides; the SQL states the expected output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..markup.convert import Options
from ..operators import documents as D
from ..operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Lines and classifiers, on texts as they are

_LINES = """WITH l AS (SELECT doc_id, string_split(replace(replace(text, chr(13), ''), chr(9), '    '), chr(10)) AS a FROM documents),
  k AS (SELECT doc_id, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM l),
  lines AS (SELECT doc_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS line FROM k)
"""
_SP = r"[ \t\n\r\f\x0B]"
_SQL_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '{pattern}') THEN '{name}'" for name, pattern in T.LINE_KINDS) + " ELSE 'text' END"


@query(_LINES + "SELECT doc_id, pos, line FROM lines")
def text_lines(spark, sf_dir):
    return R.lines(table(spark, sf_dir, "documents"))


@query(_LINES + f"SELECT {_SQL_KIND} AS kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM lines GROUP BY 1")
def line_kinds(spark, sf_dir):
    lines = R.lines(table(spark, sf_dir, "documents")).withColumn("kind", T.line_kind(F.col("line")))
    return lines.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(
    _LINES
    + f""", c AS (SELECT *, {_SQL_KIND} = 'text' AS plain FROM lines),
  h AS (SELECT *, plain AND NOT coalesce(lag(plain) OVER w, false) AS head FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h WHERE plain)
SELECT doc_id, min(pos)::INT AS first, count(*)::INT AS n_lines, string_agg(trim(line, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, run"""
)
def text_paragraphs(spark, sf_dir):
    return R.paragraphs(table(spark, sf_dir, "documents"))


@query(_LINES + r"SELECT doc_id, pos, length(regexp_extract(line, '^( *)', 1))::INT AS indent, (length(line) - length(rtrim(line, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 2 OR length(regexp_extract(rtrim(line, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '(\\*)$', 1)) % 2 = 1) AS hard FROM lines WHERE line <> ''")
def line_breaks(spark, sf_dir):
    lines = R.lines(table(spark, sf_dir, "documents")).where("line <> ''")
    return lines.select("doc_id", "pos", T.indent(F.col("line")).alias("indent"), T.is_hard_break(F.col("line")).alias("hard"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS html FROM documents")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"))


@query(
    r"""SELECT page_id, replace(replace(replace(regexp_replace(translate(html, '\~^', chr(64976) || chr(64977) || chr(64978)), '([{}$&#_%])', '\\\1', 'g'),
    chr(64976), '\textbackslash{}'), chr(64977), '\textasciitilde{}'), chr(64978), '\textasciicircum{}') AS latex FROM pages"""
)
def escape_latex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_latex(F.col("html")).alias("latex"))


@query(f"SELECT doc_id, (length(text) - len(regexp_extract_all(text, '{T.NARROW}')) + len(regexp_extract_all(text, '{T.WIDE}')))::INT AS width FROM documents")
def display_widths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.display_width(F.col("text")).alias("width"))


@query("SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS trimmed FROM documents")
def fold_and_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.lower_ascii(F.col("text")).alias("folded"), T.trim(F.col("text")).alias("trimmed"))


@query(
    r"""WITH p AS (SELECT o_orderkey, o_orderpriority || '/' || o_orderkey || CASE o_orderkey % 6 WHEN 0 THEN '.MD' WHEN 1 THEN '.rtf' WHEN 2 THEN '.docx' WHEN 3 THEN '.fodt' WHEN 4 THEN '.3x.md' ELSE '' END AS path,
    CASE o_custkey % 4 WHEN 0 THEN 'PK' || chr(3) || chr(4) || 'x' WHEN 1 THEN '{\rtf1}' ELSE 'text' END AS head FROM orders),
  e AS (SELECT *, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS ext FROM p)
SELECT o_orderkey, ext, CASE WHEN head LIKE 'PK%' THEN CASE WHEN ext = 'docx' THEN ext END WHEN head LIKE '{%' THEN 'rtf' WHEN ext = 'rtf' THEN 'rtf' WHEN ext = 'fodt' THEN 'odt' ELSE 'markdown' END AS format,
  CASE o_orderkey % 6 WHEN 4 THEN o_orderkey::VARCHAR WHEN 0 THEN o_orderkey || '.MD' WHEN 1 THEN o_orderkey || '.rtf' WHEN 2 THEN o_orderkey || '.docx' WHEN 3 THEN o_orderkey || '.fodt' ELSE o_orderkey::VARCHAR END AS man_name,
  CASE o_orderkey % 6 WHEN 4 THEN '3x' ELSE '7' END AS man_section FROM e"""
)
def detect_formats(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, (".MD", ".rtf", ".docx", ".fodt", ".3x.md", ""))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    head = F.when(F.col("o_custkey") % 4 == 0, F.lit("PK\x03\x04x")).when(F.col("o_custkey") % 4 == 1, F.lit("{\\rtf1}")).otherwise(F.lit("text"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit("/"), "o_orderkey", kind).alias("path"), head.cast("binary").alias("content"))
    man = T.man_name(F.col("path"))
    return docs.select("o_orderkey", T.extension(F.col("path")).alias("ext"), T.document_format(F.col("path"), F.col("content")).alias("format"), man["name"].alias("man_name"), man["section"].alias("man_section"))


# --- One Markdown document for each part, in every output format


def _parts(spark, sf_dir, columns: Column | None = None) -> DataFrame:
    text = F.concat(
        F.lit("# "), "p_name", F.lit("\n\nBrand **"), "p_brand", F.lit("** & *"), "p_type", F.lit("*, `size "), "p_size", F.lit("`.\n\n| Key | Size |\n|:-:|--:|\n| "), "p_partkey", F.lit(" | "), "p_size",
        F.lit(" |\n\n3. [x] first\n4. ~~second~~\n\n> quoted <b>\n\n---\n\n```sql\nSELECT 1\n```\n"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("content"))


def _converted_parts(spark, sf_dir, **options) -> DataFrame:
    return D.converted(_parts(spark, sf_dir), Options(from_="markdown", **options), ["p_partkey"]).select("p_partkey", "output")


@query(
    """SELECT p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<p>Brand <strong>' || p_brand || '</strong> &amp; <em>' || p_type || '</em>, <code>size ' || p_size || '</code>.</p>' || chr(10)
    || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th style="text-align:center">Key</th><th style="text-align:right">Size</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10)
    || '<tr><td style="text-align:center">' || p_partkey || '</td><td style="text-align:right">' || p_size || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
    || '<ol start="3">' || chr(10) || '<li><input type="checkbox" disabled checked> first</li>' || chr(10) || '<li><del>second</del></li>' || chr(10) || '</ol>' || chr(10)
    || '<blockquote>' || chr(10) || '<p>quoted &lt;b&gt;</p>' || chr(10) || '</blockquote>' || chr(10) || '<hr>' || chr(10) || '<pre><code class="language-sql">SELECT 1' || chr(10) || '</code></pre>' || chr(10) AS output FROM part"""
)
def convert_html(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="html")


@query(
    r"""SELECT p_partkey, '\section{' || p_name || '}' || chr(10) || chr(10) || 'Brand \textbf{' || replace(p_brand, '#', '\#') || '} \& \emph{' || p_type || '}, \texttt{size ' || p_size || '}.' || chr(10) || chr(10)
    || '\begin{tabular}{cr}' || chr(10) || 'Key & Size \\' || chr(10) || '\hline' || chr(10) || p_partkey || ' & ' || p_size || ' \\' || chr(10) || '\end{tabular}' || chr(10) || chr(10)
    || '\begin{enumerate}' || chr(10) || '\setcounter{enumi}{2}' || chr(10) || '\item $\boxtimes$ first' || chr(10) || '\item second' || chr(10) || '\end{enumerate}' || chr(10) || chr(10)
    || '\begin{quote}' || chr(10) || 'quoted <b>' || chr(10) || '\end{quote}' || chr(10) || chr(10) || '\noindent\hrulefill' || chr(10) || chr(10)
    || '\begin{verbatim}' || chr(10) || 'SELECT 1' || chr(10) || '\end{verbatim}' || chr(10) || chr(10) AS output FROM part"""
)
def convert_latex(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="latex")


@query(
    r"""SELECT p_partkey, '.TH "" "7"' || chr(10) || '.SH "' || p_name || '"' || chr(10) || '.PP' || chr(10) || 'Brand \fB' || p_brand || '\fR & \fI' || p_type || '\fR, \f(CRsize ' || p_size || '\fR.' || chr(10)
    || '.TS' || chr(10) || 'allbox;' || chr(10) || 'c r' || chr(10) || '.' || chr(10) || 'Key' || chr(9) || 'Size' || chr(10) || p_partkey || chr(9) || p_size || chr(10) || '.TE' || chr(10)
    || '.IP 3. 4' || chr(10) || '[x] first' || chr(10) || '.IP 4. 4' || chr(10) || 'second' || chr(10) || '.RS' || chr(10) || '.PP' || chr(10) || 'quoted <b>' || chr(10) || '.RE' || chr(10)
    || '.PP' || chr(10) || '\l''\n(.lu''' || chr(10) || '.nf' || chr(10) || '.ft CR' || chr(10) || 'SELECT 1' || chr(10) || '.ft R' || chr(10) || '.fi' || chr(10) AS output FROM part"""
)
def convert_man(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="man")


@query(
    r"""SELECT p_partkey, '{\rtf1\ansi\ansicpg1252\deff0\viewkind4' || chr(10) || '{\fonttbl{\f0\fswiss Helvetica;}{\f1\fmodern Courier;}}' || chr(10)
    || '{\colortbl;\red95\green175\blue255;\red0\green190\blue190;\red95\green195\blue95;\red215\green175\blue0;\red200\green120\blue245;\red150\green150\blue150;\red220\green95\blue95;\red0\green0\blue0;\red235\green235\blue235;}' || chr(10)
    || '\uc1\f0\fs24' || chr(10) || '\fs48\b ' || p_name || '\b0\fs24\par' || chr(10) || 'Brand \b ' || p_brand || '\b0  & \i ' || p_type || '\i0 , \f1 size ' || p_size || '\f0 .\par' || chr(10)
    || '\trowd\cellx4680\cellx9360' || chr(10) || '\intbl\qc\b Key\b0\cell \intbl\qr\b Size\b0\cell \row' || chr(10)
    || '\trowd\cellx4680\cellx9360' || chr(10) || '\intbl\qc ' || p_partkey || '\cell \intbl\qr ' || p_size || '\cell \row' || chr(10)
    || '\li360 3.\tab [x] first\par' || chr(10) || '\li0' || chr(10) || '\li360 4.\tab \strike second\strike0 \par' || chr(10) || '\li0' || chr(10)
    || '\li720' || chr(10) || 'quoted <b>\par' || chr(10) || '\li0' || chr(10) || '\pard\brdrb\brdrs\brdrw10\brsp20 \par\pard' || chr(10) || '\f1 SELECT 1\f0\par' || chr(10) || '}' || chr(10) AS output FROM part"""
)
def convert_rtf(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="rtf")


@query(
    """SELECT p_partkey, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<abiword xmlns="http://www.abisource.com/awml.dtd" xmlns:xlink="http://www.w3.org/1999/xlink" template="false" fileformat="1.1">' || chr(10) || '<section>' || chr(10)
    || '<p style="Heading 1">' || p_name || '</p>' || chr(10) || '<p style="Normal">Brand <c props="font-weight:bold">' || p_brand || '</c> &amp; <c props="font-style:italic">' || p_type || '</c>, <c props="font-family:Courier New">size ' || p_size || '</c>.</p>' || chr(10)
    || '<table>' || chr(10) || '<cell props="top-attach:0; bot-attach:1; left-attach:0; right-attach:1">' || chr(10) || '<p style="Normal"><c props="font-weight:bold">Key</c></p>' || chr(10) || '</cell>' || chr(10)
    || '<cell props="top-attach:0; bot-attach:1; left-attach:1; right-attach:2">' || chr(10) || '<p style="Normal"><c props="font-weight:bold">Size</c></p>' || chr(10) || '</cell>' || chr(10)
    || '<cell props="top-attach:1; bot-attach:2; left-attach:0; right-attach:1">' || chr(10) || '<p style="Normal">' || p_partkey || '</p>' || chr(10) || '</cell>' || chr(10)
    || '<cell props="top-attach:1; bot-attach:2; left-attach:1; right-attach:2">' || chr(10) || '<p style="Normal">' || p_size || '</p>' || chr(10) || '</cell>' || chr(10) || '</table>' || chr(10)
    || '<p style="Normal" props="margin-left:0.35in">3. [x] first</p>' || chr(10) || '<p style="Normal" props="margin-left:0.35in">4. <c props="text-decoration:line-through">second</c></p>' || chr(10)
    || '<p style="Normal" props="margin-left:0.5in">quoted &lt;b&gt;</p>' || chr(10) || '<p style="Normal">' || repeat('-', 40) || '</p>' || chr(10)
    || '<p style="Plain Text"><c props="font-family:Courier New">SELECT 1</c></p>' || chr(10) || '</section>' || chr(10) || '</abiword>' || chr(10) AS output FROM part"""
)
def convert_abw(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="abw")


_TERM = """WITH w AS (SELECT *, greatest(3, length(p_partkey::VARCHAR)) AS a, 4 AS b FROM part),
  c AS (SELECT *, a - length(p_partkey::VARCHAR) AS pa, a - 3 AS ph FROM w)
SELECT p_partkey, {h} || p_name || {z} || chr(10) || {h} || repeat('═', least(200, length(p_name))) || {z} || chr(10) || chr(10)
  || 'Brand ' || {bold} || p_brand || {z} || ' & ' || {em} || regexp_replace(p_type, ' ', {z} || ' ' || {em}, 'g') || {z} || ', ' || {cy} || 'size' || {z} || ' ' || {cy} || p_size || {z} || '.' || chr(10) || chr(10)
  || {d} || '┌' || repeat('─', a + 2) || '┬' || repeat('─', b + 2) || '┐' || {z} || chr(10)
  || {d} || '│' || {z} || ' ' || repeat(' ', (ph // 2)::INT) || {bold} || 'Key' || {z} || repeat(' ', (ph - ph // 2)::INT) || ' ' || {d} || '│' || {z} || ' ' || {bold} || 'Size' || {z} || ' ' || {d} || '│' || {z} || chr(10)
  || {d} || '├' || repeat('─', a + 2) || '┼' || repeat('─', b + 2) || '┤' || {z} || chr(10)
  || {d} || '│' || {z} || ' ' || repeat(' ', (pa // 2)::INT) || p_partkey || repeat(' ', (pa - pa // 2)::INT) || ' ' || {d} || '│' || {z} || ' ' || lpad(p_size::VARCHAR, 4, ' ') || ' ' || {d} || '│' || {z} || chr(10)
  || {d} || '└' || repeat('─', a + 2) || '┴' || repeat('─', b + 2) || '┘' || {z} || chr(10) || chr(10)
  || {y} || '3.' || {z} || ' ' || {y} || '☑' || {z} || ' first' || chr(10) || {y} || '4.' || {z} || ' ' || {strike} || chr(10) || chr(10)
  || {g} || '│ ' || {z} || 'quoted <b>' || chr(10) || chr(10) || {d} || repeat('─', 200) || {z} || chr(10) || chr(10)
  || {d} || '┌─ sql ' || repeat('─', 4) || '┐' || {z} || chr(10) || {d} || '│ ' || {z} || 'SELECT 1' || {d} || ' │' || {z} || chr(10) || {d} || '└' || repeat('─', 10) || '┘' || {z} || chr(10) AS output FROM c"""
_SGR = {k: f"chr(27) || '[{v}m'" for k, v in {"h": "1;35", "z": "0", "bold": "1", "em": "4", "cy": "36", "d": "2", "y": "33", "g": "32"}.items()}


@query(_TERM.format(**dict.fromkeys(_SGR, "''"), strike="'~~second~~'"))
def convert_plain(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="plain", width=200)


@query(_TERM.format(**_SGR, strike=f"{_SGR['d']} || 'second' || {_SGR['z']}"))
def convert_terminal(spark, sf_dir):
    return _converted_parts(spark, sf_dir, to="term", color="16", width=200)


# --- Parsed structure as rows


@query(
    """SELECT p_partkey, pos, kind, coalesce(level, 0) AS level, coalesce(checked, false) AS checked, text FROM part, (VALUES (0, 'heading', 1, NULL), (1, 'para', NULL, NULL), (2, 'table', NULL, NULL), (3, 'numbers', 3, NULL), (4, 'item', 3, true), (5, 'para', NULL, NULL),
    (6, 'item', 4, NULL), (7, 'para', NULL, NULL), (8, 'quote', NULL, NULL), (9, 'para', NULL, NULL), (10, 'rule', NULL, NULL), (11, 'code', NULL, NULL)) AS v(pos, kind, level, checked),
    LATERAL (SELECT CASE pos WHEN 0 THEN p_name WHEN 1 THEN 'Brand ' || p_brand || ' & ' || p_type || ', size ' || p_size || '.' WHEN 5 THEN 'first' WHEN 7 THEN 'second' WHEN 9 THEN 'quoted <b>' WHEN 11 THEN 'SELECT 1' END AS text)"""
)
def parsed_blocks(spark, sf_dir):
    return D.blocks(_parts(spark, sf_dir), ["p_partkey"]).select("p_partkey", "pos", "kind", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("checked", F.lit(False)).alias("checked"), "text")


@query(
    """SELECT p_partkey, kind, count(*) AS n, string_agg(text, '|' ORDER BY text) AS texts FROM (SELECT p_partkey, unnest(['strong', 'emph', 'code', 'strike']) AS kind, unnest([p_brand, p_type, 'size ' || p_size, 'second']) AS text FROM part) GROUP BY ALL"""
)
def parsed_inlines(spark, sf_dir):
    found = D.inlines(_parts(spark, sf_dir), ["p_partkey"]).where("kind NOT IN ('text', 'break')")
    return found.groupBy("p_partkey", "kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("text")), "|").alias("texts"))


@query(
    """SELECT p_partkey, 0 AS "table", row, col, CASE WHEN row = 0 THEN CASE col WHEN 0 THEN 'Key' ELSE 'Size' END WHEN col = 0 THEN p_partkey::VARCHAR ELSE p_size::VARCHAR END AS text,
    CASE col WHEN 0 THEN 'center' ELSE 'right' END AS align, row = 0 AS header FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS v(row, col)"""
)
def table_cells(spark, sf_dir):
    return D.cells(_parts(spark, sf_dir), ["p_partkey"])


@query("""SELECT p_partkey, col, CASE col WHEN 0 THEN greatest(3, length(p_partkey::VARCHAR)) ELSE 4 END::INT AS width FROM part, (VALUES (0), (1)) AS v(col)""")
def table_column_widths(spark, sf_dir):
    return R.column_widths(D.cells(_parts(spark, sf_dir), ["p_partkey"]), ("p_partkey", "table")).select("p_partkey", "col", "width")


@query(
    """WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey % 3 AS row, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) - 1 AS col, n_name AS text FROM nation),
    w AS (SELECT doc_id, max(col) + 1 AS n FROM c GROUP BY 1), r AS (SELECT DISTINCT doc_id, row FROM c)
    SELECT r.doc_id, r.row, g.col::INT AS col, coalesce(c.text, '') AS text FROM r JOIN w USING (doc_id), LATERAL (SELECT unnest(range(w.n)) AS col) g LEFT JOIN c ON c.doc_id = r.doc_id AND c.row = r.row AND c.col = g.col"""
)
def ragged_rows(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").selectExpr(
        "n_regionkey AS doc_id", "0 AS table", "n_nationkey % 3 AS row", "CAST(row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) - 1 AS INT) AS col", "n_name AS text"
    )
    return R.padded_rows(cells).select("doc_id", "row", "col", "text")


@query(
    """WITH d AS (SELECT c_nationkey, lower(c_mktsegment) AS label, arg_min('http://x.org/' || c_custkey, c_custkey) AS url, arg_min(c_name, c_custkey) AS title FROM customer GROUP BY ALL)
    SELECT s_suppkey, v.label, d.url, d.title FROM supplier, (VALUES ('BUILDING'), ('machinery'), ('none')) AS v(label) LEFT JOIN d ON d.c_nationkey = s_nationkey AND d.label = lower(v.label)"""
)
def resolved_links(spark, sf_dir):
    found = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_mktsegment AS label", "concat('http://x.org/', c_custkey) AS url", "c_name AS title", "c_custkey AS pos")
    asked = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_nationkey AS nation", "explode(array('BUILDING', 'machinery', 'none')) AS label")
    return R.resolved_links(asked, found, ("nation",)).select("s_suppkey", "label", "url", "title")


@query(
    """SELECT c_custkey, 'link' AS kind, 'Customer' AS text, 'http://x.org/' || c_custkey AS url, c_name AS title FROM customer
    UNION ALL SELECT c_custkey, 'image', 'pic', 'p.png', '' FROM customer UNION ALL SELECT c_custkey, 'link', 'https://y.org/' || c_custkey, 'https://y.org/' || c_custkey, '' FROM customer"""
)
def parsed_links(spark, sf_dir):
    text = F.concat(F.lit("[Customer][REF "), "c_custkey", F.lit("] ![pic](p.png) [lost][x], (https://y.org/"), "c_custkey", F.lit(").\n\n[ref "), "c_custkey", F.lit("]: http://x.org/"), "c_custkey", F.lit(' "'), "c_name", F.lit('"\n[ref '), "c_custkey", F.lit("]: http://second.org\n"))
    found = D.inlines(table(spark, sf_dir, "customer").select("c_custkey", text.alias("content")), ["c_custkey"])
    return found.where("kind IN ('link', 'image')").select("c_custkey", "kind", "text", "url", "title")


@query("""SELECT c_custkey, lower('Ref ' || c_custkey) AS label, 'http://x.org/' || c_custkey AS url, c_name AS title FROM customer""")
def link_definitions(spark, sf_dir):
    text = F.concat(F.lit("text\n[Ref "), "c_custkey", F.lit("]: http://x.org/"), "c_custkey", F.lit(" '"), "c_name", F.lit("'\n```\n[ref in code]: x\n```\n> [REF "), "c_custkey", F.lit("]: http://second.org\n"))
    return D.definitions(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), ["c_custkey"]).select("c_custkey", "label", "url", "title")


@query("""SELECT c_custkey, 'last' AS title, c_name AS author, strftime(TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (c_custkey % 300), '%Y-%m-%d') AS date FROM customer""")
def front_matter(spark, sf_dir):
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd")
    text = F.concat(F.lit('---\ntitle: "first"\nauthor: '), "c_name", F.lit("\nother: x\ndate: '"), day, F.lit("'\ntitle: last\n...\n# text\n"))
    return D.metadata(table(spark, sf_dir, "customer").select("c_custkey", text.alias("content")), ["c_custkey"]).select("c_custkey", "title", "author", "date")


@query("""SELECT n_nationkey, n_name AS title, (n_nationkey % 9)::VARCHAR || 'x' AS section, 'Nations' AS manual, 'A; B' AS author FROM nation""")
def title_block(spark, sf_dir):
    text = F.concat(F.lit("% "), "n_name", F.lit("("), F.col("n_nationkey") % 9, F.lit("x) Nations\n% A;\n  B\n%\ntext\n"))
    return D.metadata(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content")), ["n_nationkey"]).select("n_nationkey", "title", "section", "manual", "author")


@query(
    """SELECT l_orderkey, l_linenumber, 'x' || translate(l_linenumber::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉') || translate(l_suppkey::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || '+α≤' || CASE WHEN length(l_partkey::VARCHAR) > 1 THEN '(' || l_partkey || ')' ELSE l_partkey::VARCHAR END
    || '/2√(ab)ℝ' || 'sin' || '\\foo' AS rendered FROM lineitem""".replace("\\\\", "\\")
)
def math_rendered(spark, sf_dir):
    source = F.concat(F.lit("x_{"), "l_linenumber", F.lit("}^{"), "l_suppkey", F.lit("} + \\alpha \\le \\frac{"), "l_partkey", F.lit("}2 \\sqrt{ab} \\mathbb{R} \\sin \\foo"))
    return D.math_text(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source.alias("source")), ["l_orderkey", "l_linenumber"])


@query("""SELECT c_conv AS conv_id, n AS n_parts, t AS output FROM (SELECT conv_id AS c_conv, count(*) AS n, string_agg('<h2>' || role || '</h2>' || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY 1)""")
def combined_documents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role").alias("text"))
    return D.converted(R.combined(turns, "conv_id", "turn"), Options(from_="md", to="html"), ["conv_id", "n_parts"], "text").drop("error")


@query("""SELECT conv_id, string_agg('\\subsection{' || role || '}' || chr(10), chr(10) ORDER BY turn) || chr(10) AS output FROM conversations GROUP BY 1""".replace("\\\\", "\\"))
def combined_rendered(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit("\n")).alias("content"))
    return D.rendered_combined(turns, Options(from_="markdown", to="latex"), "conv_id", "turn").select("conv_id", "output")


@query("""SELECT o_orderkey, '<p>' || o_orderstatus || '<br>' || chr(10) || o_orderpriority || '<br>' || chr(10) || 'end</p>' || chr(10) AS hard, '<p>' || o_orderstatus || ' ' || o_orderpriority || '<br>' || chr(10) || 'end</p>' || chr(10) AS soft FROM orders""")
def hard_line_breaks(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority", F.lit("\\\nend")).alias("content"))
    hard = D.converted(docs, Options(from_="markdown+hard_line_breaks", to="html"), ["o_orderkey", "content"]).select("o_orderkey", "content", F.col("output").alias("hard"))
    return D.converted(hard, Options(from_="markdown", to="html"), ["o_orderkey", "hard"]).select("o_orderkey", "hard", F.col("output").alias("soft"))


# --- Other formats


@query(
    """SELECT p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<h2>Style</h2>' || chr(10) || '<p>' || p_brand || ' <strong><em>' || p_type || '</em></strong> é–<code>x</code><br>' || chr(10) || 'β</p>' || chr(10)
    || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>a</th><th>b</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || p_size || '</td><td></td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
    || '<p>end</p>' || chr(10) AS output FROM part"""
)
def rtf_read(spark, sf_dir):
    text = F.concat(
        F.lit(r"{\rtf1\ansi{\fonttbl{\f0\fswiss A;}{\f1\fmodern C;}}{\stylesheet{\s3 heading 2;}}\fs48 "), "p_name", F.lit(r"\par\pard\fs24\s3 Style\par\pard "), "p_brand", F.lit(r" {\b\i "), "p_type",
        F.lit(r"} \'e9\endash {\f1 x}\line\u946?{\*\unknown gone}\par\trowd\intbl a\cell b\cell\row\intbl "), "p_size", F.lit(r"\cell\row\pard end\par}"),
    )
    docs = table(spark, sf_dir, "part").select("p_partkey", text.cast("binary").alias("content"))
    return D.converted(docs, Options(to="html"), ["p_partkey"]).select("p_partkey", "output")


@query("""SELECT p_partkey, number, name FROM part, (VALUES (1, 'heading 1'), (2, 'Title')) AS v(number, name)""")
def rtf_style_names(spark, sf_dir):
    text = F.concat(F.lit(r"{\rtf1{\stylesheet{\s1 heading 1;}{\s2\b Title;}{\cs9 none;}}"), "p_name", F.lit("}"))
    return D.rtf_styles(table(spark, sf_dir, "part").select("p_partkey", text.alias("content")), ["p_partkey"])


@query(
    """SELECT n_nationkey, '<h2>' || n_name || '</h2>' || chr(10) || '<p>a <strong><em>b</em></strong><br>' || chr(10) || '<a href="u">c</a></p>' || chr(10)
    || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th>00</th><th>01</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr><td>' || n_regionkey || '</td></tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) AS output FROM nation"""
)
def abw_read(spark, sf_dir):
    cell = lambda r, c, t: F.concat(F.lit(f'<cell props="top-attach:{r}; left-attach:{c}"><p>'), t, F.lit("</p></cell>"))
    text = F.concat(
        F.lit('<abiword><section><p style="Heading 2">'), "n_name", F.lit('</p><p>a <c props="font-weight:bold; font-style:italic">b</c><br/><a xlink:href="u">c</a></p><table>'),
        cell(1, 0, F.col("n_regionkey").cast("string")), cell(0, 1, F.lit("01")), cell(0, 0, F.lit("00")), F.lit("</table><x>gone</x></section></abiword>"),
    )
    docs = table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content"), F.lit("a/b.ABW").alias("path"))
    return D.converted(docs, Options(to="html"), ["n_nationkey"], path_column="path").select("n_nationkey", "output")


@query(
    """SELECT s_suppkey, '<h3>' || s_name || '</h3>' || chr(10) || '<p>x   <strong>bold</strong> <del>gone</del></p>' || chr(10) || '<ul>' || chr(10) || '<li>' || s_nationkey || '</li>' || chr(10) || '</ul>' || chr(10) AS output FROM supplier"""
)
def odt_read(spark, sf_dir):
    text = F.concat(
        F.lit(
            '<?xml version="1.0"?><office:document><style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style>'
            '<style:style style:name="S"><style:text-properties style:text-line-through-style="solid"/></style:style><office:text><text:h text:outline-level="7">'
        ),
        "s_name", F.lit('</text:h><text:p>x<text:s text:c="3"/><text:span text:style-name="B">bold</text:span> <text:span text:style-name="S">gone</text:span></text:p><text:list><text:list-item><text:p>'),
        "s_nationkey", F.lit("</text:p></text:list-item></text:list><text:section><text:p>lost</text:p></text:section></office:text></office:document>"),
    )
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("content"), F.lit("x.fodt").alias("path"))
    return D.converted(docs, Options(to="html"), ["s_suppkey"], path_column="path").select("s_suppkey", "output")


@query("""SELECT s_suppkey, name, name = 'B' AS bold, name = 'I' AS italic, false AS strike, name = 'M' AS mono FROM supplier, (VALUES ('B'), ('I'), ('M'), ('N')) AS v(name)""")
def odf_style_table(spark, sf_dir):
    style = lambda n, p: f'<style:style style:name="{n}">{p}</style:style>'
    text = F.concat(F.lit("<d>" + style("B", '<style:text-properties fo:font-weight="bold"/>') + style("I", '<style:text-properties fo:font-style="italic"/>') + style("M", '<style:text-properties fo:font-family="&quot;Courier New&quot;"/>') + style("N", "")), "s_name", F.lit("</d>"))
    return D.odf_styles(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("content")), ["s_suppkey"])


def _zipped(df: DataFrame, keep: list[str], members: dict[str, str]) -> DataFrame:
    """A zip file for each row, of text columns by member name; the first is stored, the others deflated."""
    import io
    import zipfile

    def make(*texts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, (name, text) in enumerate(zip(members, texts, strict=True)):
                z.writestr(zipfile.ZipInfo(name), (text or "").encode(), zipfile.ZIP_DEFLATED if i else zipfile.ZIP_STORED)
        return [(out.getvalue(),)]

    return D.flat_map(df, list(members.values()), make, keep, "content binary")


@query("""SELECT doc_id, ord, name, method, usize FROM (SELECT doc_id, unnest([0, 1]) AS ord, unnest(['source', 'sub/text']) AS name, unnest([0, 8]) AS method, unnest([octet_length(encode(source)), octet_length(encode(text))])::BIGINT AS usize FROM documents)""")
def zip_members(spark, sf_dir):
    zipped = _zipped(table(spark, sf_dir, "documents"), ["doc_id"], {"source": "source", "sub/text": "text"})
    return D.zip_members(zipped, ["doc_id"]).select("doc_id", "ord", "name", "method", "usize")


@query("SELECT doc_id, md5(text) AS digest, NULL::VARCHAR AS error FROM documents")
def zip_extracted(spark, sf_dir):
    zipped = _zipped(table(spark, sf_dir, "documents"), ["doc_id"], {"source": "source", "sub/text": "text"})
    return D.zip_extract(zipped, ["doc_id"], "sub/text").select("doc_id", F.md5("data").alias("digest"), "error")


@query("SELECT doc_id, lpad(octet_length(encode(source))::VARCHAR, 9, ' ') || '  stored   source' || chr(10) || lpad(octet_length(encode(text))::VARCHAR, 9, ' ') || '  deflate  sub/text' || chr(10) AS listing FROM documents")
def zip_listing(spark, sf_dir):
    zipped = _zipped(table(spark, sf_dir, "documents"), ["doc_id"], {"source": "source", "sub/text": "text"})
    return D.zip_listing(zipped, ["doc_id"]).select("doc_id", "listing")


@query("SELECT page_id, md5(html) AS digest, NULL::VARCHAR AS error FROM pages")
def gunzipped(spark, sf_dir):
    import gzip

    packed = D.flat_map(table(spark, sf_dir, "pages"), ["html"], lambda t: [(gzip.compress((t or "").encode(), 1),)], ["page_id"], "content binary")
    return D.gunzipped(packed, ["page_id"]).select("page_id", F.md5("data").alias("digest"), "error")


@query(
    """SELECT c_custkey, 'T' AS title, output FROM (SELECT c_custkey, '<h1>' || c_name || '</h1>' || chr(10) || '<p>a<strong>b</strong><a href="http://x.org/' || c_custkey || '">c</a></p>' || chr(10)
    || '<ol>' || chr(10) || '<li>one</li>' || chr(10) || '<li>' || chr(10) || '<p>two</p>' || chr(10) || '<ul>' || chr(10) || '<li>deep</li>' || chr(10) || '</ul>' || chr(10) || '</li>' || chr(10) || '</ol>' || chr(10) AS output FROM customer)"""
)
def docx_read(spark, sf_dir):
    item = lambda t, n, level: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = F.concat(
        F.lit('<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>'), "c_name",
        F.lit(
            '</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t></w:r><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>b</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>c</w:t></w:r></w:hyperlink></w:p><w:p/>'
            + item("one", 1, 0) + item("two", 1, 0) + item("deep", 1, 1) + "</w:body></w:document>"
        ),
    )
    rels = F.concat(F.lit('<Relationships><Relationship Id="r1" Target="http://x.org/'), "c_custkey", F.lit('"/></Relationships>'))
    numbering = F.lit('<w:numbering><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num></w:numbering>')
    texts = table(spark, sf_dir, "customer").select("c_custkey", body.alias("body"), rels.alias("rels"), numbering.alias("numbering"), F.lit("<cp><dc:title>T</dc:title></cp>").alias("core"))
    zipped = _zipped(texts, ["c_custkey"], {"word/document.xml": "body", "word/_rels/document.xml.rels": "rels", "word/numbering.xml": "numbering", "docProps/core.xml": "core"}).withColumn("path", F.lit("x.docx"))
    return D.converted(zipped, Options(to="html"), ["c_custkey"], path_column="path", meta=True).select("c_custkey", "title", "output")


@query(
    """SELECT n_nationkey, pos, kind, name, text, depth FROM nation, LATERAL (SELECT * FROM (VALUES (0, 'start', 'r', NULL, 0), (1, 'text', NULL, n_name || ' & <', 1), (2, 'start', 'e', NULL, 1), (3, 'end', 'e', NULL, 1), (4, 'text', NULL, '<raw>', 1), (5, 'end', 'r', NULL, 0)) AS v(pos, kind, name, text, depth))"""
)
def xml_events(spark, sf_dir):
    text = F.concat(F.lit('<?xml version="1.0"?><!-- c --><r a="1" a="2">'), "n_name", F.lit(" &amp; &#60;<e/><![CDATA[<raw>]]></r>"))
    return D.xml_events(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content")), ["n_nationkey"]).drop("attrs")


@query("""SELECT n_nationkey, n_name || ' 1' AS first, 2 AS n_attrs FROM nation""")
def xml_attributes(spark, sf_dir):
    text = F.concat(F.lit('<r a="'), "n_name", F.lit("&#32;1\" a='2'/>"))
    found = D.xml_events(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content")), ["n_nationkey"]).where("kind = 'start'")
    return found.select("n_nationkey", F.element_at(F.filter("attrs", lambda x: x["k"] == "a"), 1)["v"].alias("first"), F.size("attrs").alias("n_attrs"))


@query(
    r"""SELECT page_id, (len(regexp_extract_all(html, '<[A-Za-z_:][^>]*>')))::BIGINT AS starts, len(regexp_extract_all(html, '</'))::BIGINT AS ends FROM (SELECT page_id, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM pages)"""
)
def page_events(spark, sf_dir):
    found = D.xml_events(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), ["page_id"])
    return found.groupBy("page_id").agg(F.count_if(F.col("kind") == "start").alias("starts"), F.count_if(F.col("kind") == "end").alias("ends"))


@query("""SELECT o_orderkey, pos, kind, line FROM orders, LATERAL (SELECT * FROM (VALUES (0, 'heading', '# ' || o_orderstatus), (1, 'fence', '```'), (2, 'code', '# ' || o_orderpriority), (3, 'fence', '~~~'), (4, 'item', '- x'), (5, 'fence', '~~~~ sql'), (6, 'code', 'SELECT 1')) AS v(pos, kind, line))""")
def fenced_lines(spark, sf_dir):
    text = F.concat(F.lit("# "), "o_orderstatus", F.lit("\n```\n# "), "o_orderpriority", F.lit("\n~~~\n- x\n~~~~ sql\nSELECT 1\n"))
    return D.line_states(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), ["o_orderkey"])


@query("SELECT page_id, [url] AS urls FROM pages")
def bare_urls(spark, sf_dir):
    text = F.concat(F.lit("see ("), "url", F.lit("), not xhttp://a.b"))
    return table(spark, sf_dir, "pages").select("page_id", T.bare_urls(text).alias("urls"))


@query("SELECT doc_id, text FROM documents")
def decoded_utf8(spark, sf_dir):
    return D.decoded(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), ["doc_id"])


@query()
def converted_documents(spark, sf_dir):
    """Every text as Markdown to HTML: the tests compare single texts with expected outputs."""
    return D.converted(table(spark, sf_dir, "documents"), Options(from_="markdown", to="html"), ["doc_id"], "text")


@query("""SELECT n_nationkey, pos, kind, open FROM nation, LATERAL (SELECT * FROM (VALUES (0, 'start', 1), (1, 'text', 1), (2, 'start', 2), (3, 'end', 1), (4, 'end', 0), (5, 'end', 0)) AS v(pos, kind, open))""")
def xml_depths(spark, sf_dir):
    text = F.concat(F.lit("<r>"), "n_name", F.lit("<e/></r></x>"))
    events = D.xml_events(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("content")), ["n_nationkey"])
    return R.event_depths(events, ("n_nationkey",)).select("n_nationkey", "pos", "kind", "open")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<[^>]*>', '', 'gs'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', chr(34), 'g'), '&amp;', '&', 'g') AS text FROM pages")
def page_texts(spark, sf_dir):
    events = D.xml_events(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("content")), ["page_id"])
    return R.element_texts(events, ("page_id",))


@query(
    """WITH i AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS depth FROM conversations)
    SELECT conv_id, turn AS pos, depth, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, (SELECT coalesce(max(j.turn), -1) FROM i AS j WHERE j.conv_id = i.conv_id AND j.turn < i.turn AND j.depth < i.depth) AS parent_pos FROM i"""
)
def nested_items(spark, sf_dir):
    depth = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    items = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), depth.alias("depth"), "text")
    found = R.item_numbers(items, ("conv_id",))
    return found.select("conv_id", "pos", "depth", "number", F.coalesce("parent_pos", F.lit(-1)).alias("parent_pos"))


def _docx(spark, sf_dir):
    rels = F.concat(F.lit('<Relationships><Relationship Id="r1" Target="http://x.org/'), "s_suppkey", F.lit('"/><Relationship Id="r1" Target="second"/><Relationship Id="r2" Target="m.png"/></Relationships>'))
    numbering = F.lit('<w:numbering><w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="5"/></w:num></w:numbering>')
    texts = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("<w:document/>").alias("body"), rels.alias("rels"), numbering.alias("numbering"))
    return _zipped(texts, ["s_suppkey"], {"word/document.xml": "body", "word/_rels/document.xml.rels": "rels", "word/numbering.xml": "numbering"})


@query("SELECT s_suppkey, v.rel_id, CASE v.rel_id WHEN 'r1' THEN 'http://x.org/' || s_suppkey ELSE 'm.png' END AS target FROM supplier, (VALUES ('r1'), ('r2')) AS v(rel_id)")
def docx_relationships(spark, sf_dir):
    return D.docx_relationships(_docx(spark, sf_dir), ["s_suppkey"])


@query("SELECT s_suppkey, '7' AS num_id, v.level, v.format FROM supplier, (VALUES (0, 'decimal'), (1, 'bullet')) AS v(level, format)")
def docx_numbering(spark, sf_dir):
    return D.docx_numbering(_docx(spark, sf_dir), ["s_suppkey"])


@query("""SELECT n_nationkey, '<p>' || CASE n_nationkey % 5 WHEN 0 THEN '€' WHEN 1 THEN '�' WHEN 2 THEN 'Œ' WHEN 3 THEN 'é' ELSE 'ÿ' END || CASE n_nationkey % 5 WHEN 0 THEN 'Ä' WHEN 1 THEN 'Å' WHEN 2 THEN 'å' WHEN 3 THEN 'È' ELSE 'ˇ' END || '</p>' || chr(10) AS output FROM nation""")
def rtf_code_pages(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(x) for x in ("80", "81", "8c", "e9", "ff")]), F.col("n_nationkey") % 5 + 1)
    text = F.concat(F.lit("{\\rtf1\\ansi\\'"), code, F.lit("\\mac\\'"), code, F.lit("}"))
    return D.converted(table(spark, sf_dir, "nation").select("n_nationkey", text.cast("binary").alias("content")), Options(to="html"), ["n_nationkey"]).select("n_nationkey", "output")
