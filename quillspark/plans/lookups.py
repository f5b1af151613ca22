"""Registered queries for lookups and running values inside documents. Inputs are relational columns on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from .queries import query, table


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS style, CASE l_suppkey % 5 WHEN 0 THEN 'heading 3' WHEN 1 THEN 'Heading 12' WHEN 2 THEN 'Subtitle' WHEN 3 THEN 'Body' END AS name,
    CASE l_suppkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level FROM lineitem"""
)
def rtf_style_levels(spark, sf_dir):
    paragraphs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 5).alias("style"))
    names = "posexplode(array('heading 3', 'Heading 12', 'Subtitle', 'Body'))"
    styles = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", f"{names} AS (number, name)").withColumn("number", F.col("number").cast("long"))
    return L.style_levels(paragraphs, styles, ("l_orderkey",)).withColumn("level", F.coalesce("level", F.lit(0)))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS style, l_returnflag = 'A' AS bold, l_returnflag = 'R' AS italic, false AS strike, l_returnflag = 'A' AND l_orderkey % 2 = 0 AS mono FROM lineitem""")
def odf_span_looks(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("style"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    styles = orders.selectExpr("l_orderkey", "explode(array('A', 'R', 'unused')) AS name").selectExpr("l_orderkey", "name", "name = 'A' AS bold", "name = 'R' AS italic", "false AS strike", "name = 'A' AND l_orderkey % 2 = 0 AS mono")
    return L.span_looks(spans, styles, ("l_orderkey",))


@query("""SELECT l_orderkey, l_linenumber, 'r' || l_suppkey % 4 AS rel_id, CASE WHEN l_quantity > 25 THEN 'image' ELSE 'link' END AS kind, CASE WHEN l_suppkey % 4 < 2 THEN 'http://x.org/' || l_orderkey || '/' || l_suppkey % 4 END AS target FROM lineitem WHERE l_suppkey % 4 < 2 OR l_quantity <= 25""")
def docx_link_targets(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('r', l_suppkey % 4) AS rel_id", "if(l_quantity > 25, 'image', 'link') AS kind")
    found = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "explode(array(0, 1)) AS n").selectExpr("l_orderkey", "concat('r', n) AS rel_id", "concat('http://x.org/', l_orderkey, '/', n) AS target")
    return L.link_targets(links, found, ("l_orderkey",))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey % 3 AS num_id, (l_partkey % 3)::INT AS level, CASE l_suppkey % 3 WHEN 0 THEN l_partkey % 3 <> 1 WHEN 1 THEN false ELSE false END AS ordered FROM lineitem""")
def docx_item_formats(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey % 3 AS num_id", "CAST(l_partkey % 3 AS INT) AS level")
    # list 0 is numbered, but for bullets at level 1; list 1 has no marks; list 2 is unknown
    forms = "inline(array(struct(0L, 0, 'decimal'), struct(0L, 1, 'bullet'), struct(1L, 0, 'none'))) AS (num_id, level, format)"
    numbering = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", forms)
    return L.item_formats(items, numbering, ("l_orderkey",))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'alpha' WHEN 1 THEN 'le' WHEN 2 THEN 'to' WHEN 3 THEN 'hat' WHEN 4 THEN 'sin' ELSE 'foo' END AS name, CASE p_partkey % 6 WHEN 0 THEN 'α' WHEN 1 THEN '≤' WHEN 2 THEN '→' END AS symbol,
    CASE WHEN p_partkey % 6 = 3 THEN chr(770) END AS accent, p_partkey % 6 = 4 AS known FROM part""")
def tex_commands(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("alpha", "le", "to", "hat", "sin", "foo"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return L.members_of(L.looked_up(L.looked_up(rows, "tex_symbols", "symbol"), "tex_accents", "accent"), "tex_functions")


@query("""SELECT p_partkey, p_partkey % 10 AS digit, '^' AS sign, ['⁰','¹','²','³','⁴','⁵','⁶','⁷','⁸','⁹'][p_partkey % 10 + 1] AS raised, ['₀','₁','₂','₃','₄','₅','₆','₇','₈','₉'][p_partkey % 10 + 1] AS lowered FROM part""")
def tex_scripts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("digit")).withColumn("name", F.col("digit").cast("string")).withColumn("level", F.lit("bmp"))
    both = L.looked_up(rows.withColumn("sign", F.lit("_")), "scripts", "lowered", ("level", "sign", "name")).drop("sign")
    return L.looked_up(both.withColumn("sign", F.lit("^")), "scripts", "raised", ("level", "sign", "name")).select("p_partkey", "digit", "sign", "raised", "lowered")


@query("""SELECT p_partkey, chr((97 + p_partkey % 26)::INT) AS name, chr((120146 + p_partkey % 26)::INT) AS bb, chr((119834 + p_partkey % 26)::INT) AS bold FROM part""")
def tex_glyphs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.char(F.lit(97) + F.col("p_partkey") % 26).alias("name"), F.lit("full").alias("level"))
    bb = L.looked_up(rows.withColumn("style", F.lit("bb")), "glyphs", "bb", ("level", "style", "name")).drop("style")
    return L.looked_up(bb.withColumn("style", F.lit("bold")), "glyphs", "bold", ("level", "style", "name")).select("p_partkey", "name", "bb", "bold")


@query("""SELECT o_orderkey, name, CASE name WHEN 'red' THEN 31 WHEN 'blue' THEN 34 WHEN 'gray' THEN 37 ELSE 0 END AS code FROM (SELECT o_orderkey, ['red', 'blue', 'gray', 'mauve'][o_orderkey % 4 + 1] AS name FROM orders)""")
def terminal_colors(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "element_at(array('red', 'blue', 'gray', 'mauve'), CAST(o_orderkey % 4 + 1 AS INT)) AS name")
    return L.looked_up(rows, "colors", "code").withColumn("code", F.coalesce("code", F.lit(0)))


@query("""SELECT o_orderkey, name, ['€', '�', 'Œ', 'é', 'ÿ'][o_orderkey % 5 + 1] AS cp1252, ['Ä', 'Å', 'å', 'È', 'ˇ'][o_orderkey % 5 + 1] AS macroman FROM (SELECT o_orderkey, [128, 129, 140, 233, 255][o_orderkey % 5 + 1] AS name FROM orders)""")
def byte_code_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "element_at(array(128, 129, 140, 233, 255), CAST(o_orderkey % 5 + 1 AS INT)) AS name")
    one = L.looked_up(rows.withColumn("page", F.lit("cp1252")), "code_pages", "cp1252", ("page", "name")).drop("page")
    return L.looked_up(one.withColumn("page", F.lit("macroman")), "code_pages", "macroman", ("page", "name")).drop("page")


@query("""SELECT o_orderkey, word, word IN ('fonttbl', 'pict') AS skipped, font, font = 'Courier New' AS mono FROM (SELECT o_orderkey, ['fonttbl', 'pict', 'par'][o_orderkey % 3 + 1] AS word, ['Courier New', 'Arial'][o_orderkey % 2 + 1] AS font FROM orders)""")
def known_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "element_at(array('fonttbl', 'pict', 'par'), CAST(o_orderkey % 3 + 1 AS INT)) AS word", "element_at(array('Courier New', 'Arial'), CAST(o_orderkey % 2 + 1 AS INT)) AS font")
    skipped = L.members_of(rows, "rtf_skipped", "word").withColumnRenamed("known", "skipped")
    return L.members_of(skipped, "mono_fonts", "font").withColumnRenamed("known", "mono")


@query("""SELECT o.o_orderkey, v.name, coalesce((SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = v.name), 0) AS ord FROM orders AS o, (VALUES ('A'), ('N'), ('Z')) AS v(name)""")
def members_by_name(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_returnflag AS name", "l_linenumber AS ord")
    wanted = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "explode(array('A', 'N', 'Z')) AS name")
    return L.members_named(wanted, members, ("o_orderkey",)).withColumn("ord", F.coalesce("ord", F.lit(0)))


@query("SELECT doc_id, (SELECT max(length(x)) FROM (SELECT unnest(string_split(text, chr(10))) AS x))::INT AS width FROM (SELECT doc_id, regexp_replace(text, '[^ -~\n]', '', 'g') AS text FROM documents)")
def code_widths(spark, sf_dir):
    codes = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~\n]", "").alias("text"))
    return L.widest_lines(codes, ("doc_id",))


@query("SELECT l_orderkey, length((7 + count(*))::VARCHAR) + 1 AS width FROM lineitem GROUP BY 1")
def number_widths(spark, sf_dir):
    return L.label_widths(table(spark, sf_dir, "lineitem"), ("l_orderkey",), start=8)


@query("SELECT l_orderkey, coalesce(max(l_quantity) FILTER (l_linestatus = 'O'), 0) AS size FROM lineitem GROUP BY 1")
def paragraph_sizes(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("size"), F.when(F.col("l_linestatus") == "O", " x").otherwise(" \t").alias("text"))
    return L.paragraph_sizes(runs, ("l_orderkey",)).withColumn("size", F.coalesce("size", F.lit(0.0)))


@query("SELECT l_orderkey, string_agg(name, ',' ORDER BY pos, name) AS names FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS name, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def active_properties(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_linenumber").alias("pos"))
    return L.active_properties(rows, ("l_orderkey",)).withColumn("names", F.array_join("names", ","))


@query("""SELECT doc_id, pos::INT AS pos, '.' AS "char", nullif(substr(text, pos, 1), '') AS before, CASE WHEN pos + 2 <= length(text) THEN substr(text, pos + 2, 1) END AS behind
    FROM (SELECT doc_id, text, unnest(list_filter(range(length(text)), lambda i: text[i + 1] = '.')) AS pos FROM documents WHERE length(text) > 0)""")
def character_contexts(spark, sf_dir):
    found = L.character_contexts(table(spark, sf_dir, "documents"), wanted=".")
    return found


@query("SELECT l_orderkey, l_linenumber AS row, l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey) AS header FROM lineitem")
def header_cells(spark, sf_dir):
    return L.headed_cells(table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row")), ("l_orderkey",))


@query("""SELECT o_orderkey, pos, line, following, pos = 1 AND o_orderkey % 2 = 0 AS "table" FROM orders, LATERAL (SELECT * FROM (VALUES (0, 'text', '| ' || o_orderstatus || ' | b |'), (1, '| ' || o_orderstatus || ' | b |', CASE o_orderkey % 2 WHEN 0 THEN '|:-:|--|' ELSE '| c |' END),
    (2, CASE o_orderkey % 2 WHEN 0 THEN '|:-:|--|' ELSE '| c |' END, NULL)) AS v(pos, line, following))""")
def table_starts(spark, sf_dir):
    text = F.concat(F.lit("text\n| "), "o_orderstatus", F.lit(" | b |\n"), F.when(F.col("o_orderkey") % 2 == 0, "|:-:|--|").otherwise("| c |"), F.lit("\n"))
    return L.looked_ahead(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), ("o_orderkey",))


@query("SELECT l_orderkey, l_returnflag AS key, (max({'p': l_linenumber, 'v': l_comment}) FILTER (l_comment IS NOT NULL)).v AS value FROM (SELECT *, CASE WHEN l_suppkey % 3 > 0 THEN l_linestatus || l_suppkey END AS l_comment FROM lineitem) GROUP BY 1, 2")
def last_values(spark, sf_dir):
    fields = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("key"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_suppkey") % 3 > 0, F.concat("l_linestatus", "l_suppkey")).alias("value"))
    return L.last_values(fields, ("l_orderkey", "key"))


@query("SELECT l_orderkey, string_agg(texts, '|' ORDER BY row) AS rows FROM (SELECT l_orderkey, l_suppkey % 2 AS row, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_quantity, l_linenumber, l_partkey::VARCHAR) AS texts FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def placed_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("row"), F.col("l_quantity").alias("col"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("text"))
    placed = L.placed_cells(cells, ("l_orderkey",))
    return placed.withColumn("rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|"))


@query("""SELECT o_orderkey, repeat(' ', greatest(0, o_orderkey % 6 - 3)::INT) || o_orderstatus AS line, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_custkey END AS number FROM orders""")
def dedents_and_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat(repeat(' ', CAST(o_orderkey % 6 AS INT)), o_orderstatus) AS line", "concat(o_custkey, if(o_orderkey % 4 = 0, 'x', '')) AS digits")
    return rows.select("o_orderkey", L.dedented(F.col("line")).alias("line"), L.whole_number(F.col("digits"), -1).alias("number"))
