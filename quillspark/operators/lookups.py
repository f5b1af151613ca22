"""Lookups, running values and orders inside documents as joins, aggregates and array functions: no row is parsed here.

Fixed tables (signs, accents, glyphs, colours, code pages) have a number of rows that this package sets, some hundreds each,
and are broadcast; tables that come from documents are joined by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..markup import office, rtf, terminal, texmath

KEYS = ("doc_id",)


def fixed(spark: SparkSession, name: str) -> DataFrame:
    """A fixed table by its name, with the columns name and value; code_pages and glyphs have one column more."""
    pages = {"cp1252": False, "macroman": True}
    rows: dict[str, tuple[str, list[tuple]]] = {
        "tex_symbols": ("name string, value string", sorted(texmath.symbols().items())),
        "tex_accents": ("name string, value string", sorted(texmath.ACCENTS.items())),
        "tex_functions": ("name string", [(x,) for x in sorted(texmath.FUNCTIONS)]),
        "scripts": ("level string, sign string, name string, value string", [(level, sign, a, b) for (level, sign), table in texmath._SCRIPTS.items() for a, b in table.items()]),
        "glyphs": ("level string, style string, name string, value string", [(level, style, chr(a), b) for level in ("bmp", "full") for style in texmath._ALPHABETS for a, b in texmath.alphabet(level, style).items()]),
        "colors": ("name string, value int", sorted(terminal.CODES.items())),
        "code_pages": ("page string, name int, value string", [(page, i, rtf._byte(i, mac)) for page, mac in pages.items() for i in range(128, 256)]),
        "rtf_skipped": ("name string", [(x,) for x in sorted(rtf._SKIPPED)]),
        "mono_fonts": ("name string", [(x,) for x in sorted(office.MONO)]),
    }
    schema, table = rows[name]
    return spark.createDataFrame(table, schema)


def looked_up(rows: DataFrame, name: str, into: str, columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """rows with the value that the fixed table has for their columns of the same names, else null."""
    table = fixed(rows.sparkSession, name).withColumnRenamed("value", into)
    return rows.join(F.broadcast(table), list(columns), "left")


def members_of(rows: DataFrame, name: str, column: str = "name") -> DataFrame:
    """rows with ``known``: whether the fixed table has the column's value."""
    table = fixed(rows.sparkSession, name).select(F.col("name").alias(column), F.lit(True).alias("known"))
    return rows.join(F.broadcast(table), column, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def named_level(name: Column) -> Column:
    """The heading level that a style's name stands for, or null."""
    folded = T.lower_ascii(F.ltrim(name))
    digits = F.regexp_extract(folded, "^heading *([0-9]+)", 1)
    number = F.when(digits.rlike("^0*[1-6]$"), digits.cast("int")).otherwise(1)
    return F.when(folded.startswith("heading"), number).when(folded.startswith("title"), 1).when(folded.startswith("subtitle"), 2)


def style_levels(paragraphs: DataFrame, styles: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Paragraphs (keys, style) with the name of their numbered style (keys, number, name) and the level it stands for."""
    named = styles.groupBy(*keys, F.col("number").alias("style")).agg(F.first("name").alias("name"))
    return paragraphs.join(named, [*keys, "style"], "left").withColumn("level", named_level(F.col("name")))


def span_looks(spans: DataFrame, styles: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Spans (keys, style) with what their style sets; nothing for an unknown one."""
    flags = ("bold", "italic", "strike", "mono")
    looks = styles.select(*keys, F.col("name").alias("style"), *flags)
    return spans.join(looks, [*keys, "style"], "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in flags})


def link_targets(links: DataFrame, relationships: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Links (keys, rel_id, kind) with their target. A hyperlink without one stays as its text, an image without one goes."""
    return links.join(relationships, [*keys, "rel_id"], "left").where((F.col("kind") != "image") | F.col("target").isNotNull())


def item_formats(items: DataFrame, numbering: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Items (keys, num_id, level) with ``ordered``: by the list's format at their level, else at its first, else not."""
    at_level = numbering.select(*keys, "num_id", "level", F.col("format").alias("__exact"))
    first = numbering.groupBy(*keys, "num_id").agg(F.min_by("format", "level").alias("__any"))
    form = F.coalesce("__exact", "__any", F.lit("bullet"))
    return items.join(at_level, [*keys, "num_id", "level"], "left").join(first, [*keys, "num_id"], "left").withColumn("ordered", ~form.isin("bullet", "none")).drop("__exact", "__any")


def members_named(wanted: DataFrame, members: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wanted members (keys, name) with the place of the first one of that name, null where there is none."""
    first = members.groupBy(*keys, "name").agg(F.min("ord").alias("ord"))
    return wanted.join(first, [*keys, "name"], "left")


def widest_lines(codes: DataFrame, keys: tuple[str, ...] = (*KEYS, "pos"), text_column: str = "text") -> DataFrame:
    """The widest line of each code block, in columns of a terminal."""
    lines = F.split(F.col(text_column), "\n", -1)
    return codes.select(*keys, F.array_max(F.transform(lines, T.display_width)).alias("width"))


def label_widths(items: DataFrame, keys: tuple[str, ...] = (*KEYS, "list"), start: int = 1) -> DataFrame:
    """The widest number of each list, with the point behind it."""
    last = F.count("*") + (start - 1)
    return items.groupBy(*keys).agg((F.length(F.greatest(last, F.lit(start)).cast("string")) + 1).alias("width"))


def paragraph_sizes(runs: DataFrame, keys: tuple[str, ...] = (*KEYS, "paragraph")) -> DataFrame:
    """The greatest font size of runs (keys, size, text) that show a character; null for a paragraph without one."""
    return runs.groupBy(*keys).agg(F.max(F.when(T.trim(F.col("text")) != "", F.col("size"))).alias("size"))


def active_properties(properties: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The distinct names of properties (keys, pos, name) in the order in which they first stand."""
    first = properties.groupBy(*keys, "name").agg(F.min("pos").alias("pos"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def character_contexts(texts: DataFrame, keys: tuple[str, ...] = KEYS, text_column: str = "text", wanted: str = "*_") -> DataFrame:
    """Places (from 0) of the wanted characters with the character before and behind, null at the ends."""
    chars = texts.select(*keys, F.split(F.col(text_column), "").alias("__c"))
    found = chars.withColumn("__at", F.filter(F.transform("__c", lambda c, i: F.when(F.lit(wanted).contains(c) & (c != ""), i)), lambda i: i.isNotNull()))
    one = found.select(*keys, "__c", F.explode("__at").alias("pos"))
    return one.select(*keys, "pos", F.get("__c", F.col("pos")).alias("char"), F.get("__c", F.col("pos") - 1).alias("before"), F.get("__c", F.col("pos") + 1).alias("behind"))


def headed_cells(cells: DataFrame, keys: tuple[str, ...] = (*KEYS, "table")) -> DataFrame:
    """Cells (keys, row) with ``header``: whether they stand in the first row of their table."""
    first = cells.groupBy(*keys).agg(F.min("row").alias("__first"))
    return cells.join(first, list(keys)).withColumn("header", F.col("row") == F.col("__first")).drop("__first")


def looked_ahead(docs: DataFrame, keys: tuple[str, ...] = KEYS, text_column: str = "text") -> DataFrame:
    """Lines with the line behind them, and whether a table begins here: cells over a row of dashes and colons. Nothing is shuffled."""
    lines = docs.select(*keys, T.split_lines(F.col(text_column)).alias("__l"))
    pairs = F.transform("__l", lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.get("__l", i + 1).alias("following")))
    rows = lines.select(*keys, F.inline(pairs))
    separator = F.col("following").contains("-") & F.col("following").rlike(r"^[ |:-]+$") & F.col("following").contains("|")
    return rows.withColumn("table", F.coalesce(F.col("line").contains("|") & separator, F.lit(False)))


def last_values(fields: DataFrame, keys: tuple[str, ...] = (*KEYS, "key")) -> DataFrame:
    """The last value of fields (keys, pos, value) that is not null, the greatest of several at one place."""
    return fields.groupBy(*keys).agg(F.max(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))).alias("__last")).select(*keys, F.col("__last.value").alias("value"))


def placed_cells(cells: DataFrame, keys: tuple[str, ...] = (*KEYS, "table")) -> DataFrame:
    """The texts of cells (keys, pos, row, col, text) by row and column, by place and text where both are equal."""
    rows = cells.groupBy(*keys, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "pos", "text"))), lambda x: x["text"]).alias("__texts"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "__texts"))), lambda x: x["__texts"]).alias("rows"))


def dedented(line: Column) -> Column:
    """A line without its first spaces, three at most."""
    return F.regexp_replace(line, "^ {1,3}", "")


def whole_number(c: Column, default: int) -> Column:
    """A text of digits as a number, or the default."""
    return F.when(c.rlike("^[0-9]+$"), F.coalesce(c.try_cast("long"), F.lit(default))).otherwise(F.lit(default))
