"""Operators on lines of documents that need no parser: windows, joins and ordered aggregation, JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, pos (from 0), line: one row for each line of a text; null texts have none."""
    return docs.select(id_column, F.posexplode(T.split_lines(F.col(text_column))).alias("pos", "line"))


def paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of neighbouring text lines as id_column, first (line number), n_lines, text joined by spaces.

    Runs are cut out of each document's own array of lines: no row is shuffled, and no line is copied but into its run.
    """
    plain = F.transform("lines", lambda x: T.line_kind(x) == "text")
    rows = docs.select(id_column, T.split_lines(F.col(text_column)).alias("lines")).withColumn("plain", plain)
    places = F.sequence(F.lit(1), F.size("plain"))
    # beginnings and ends of runs, by places from 1
    begins = F.filter(places, lambda i: F.get("plain", i - 1) & ~F.coalesce(F.get("plain", i - 2), F.lit(False)))
    ends = F.filter(places, lambda i: F.get("plain", i - 1) & ~F.coalesce(F.get("plain", i), F.lit(False)))
    rows = rows.where(F.size("plain") > 0).withColumn("begins", begins).withColumn("ends", ends)
    runs = F.transform(
        F.arrays_zip("begins", "ends"),
        lambda r: F.struct(
            (r["begins"] - 1).alias("first"),
            (r["ends"] - r["begins"] + 1).alias("n_lines"),
            F.array_join(F.transform(F.slice("lines", r["begins"], r["ends"] - r["begins"] + 1), T.trim), " ").alias("text"),
        ),
    )
    return rows.select(id_column, F.inline(runs))


def resolved_links(references: DataFrame, definitions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """references (keys, label, ...) with url and title of the first definition (keys, label, url, title, pos) of the folded label.

    An unresolved reference has nulls, and stays the literal text it was.
    """
    first = (
        definitions.withColumn("label", T.lower_ascii(F.col("label")))
        .groupBy(*keys, "label")
        .agg(F.min(F.struct("pos", "url", "title")).alias("d"))
        .select(*keys, F.col("label").alias("__label"), "d.url", "d.title")
    )
    folded = references.withColumn("__label", T.lower_ascii(F.col("label")))
    return folded.join(first, [*keys, "__label"], "left").drop("__label")


def column_widths(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "table"), text_column: str = "text") -> DataFrame:
    """The widest cell of each column of each table, one at least."""
    return cells.groupBy(*keys, "col").agg(F.greatest(F.lit(1), F.max(T.display_width(F.col(text_column)))).alias("width"))


def padded_rows(cells: DataFrame, keys: tuple[str, ...] = ("doc_id", "table")) -> DataFrame:
    """Cells (keys, row, col, text) filled up with empty ones to the widest row of their table."""
    rows = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("own"))
    width = cells.groupBy(*keys).agg((F.max("col") + 1).alias("n"))
    return rows.join(width, list(keys)).select(*keys, "row", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.element_at("own", i), F.lit("")))).alias("col", "text"))


def combined(parts: DataFrame, key: str, order: str, text_column: str = "text", separator: str = "\n\n") -> DataFrame:
    """Texts of a key joined in order, with the number of parts: several inputs as one document."""
    return parts.groupBy(key).agg(
        F.count(text_column).alias("n_parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(text_column).isNotNull(), F.struct(order, text_column)))), lambda x: x[text_column]), separator).alias(text_column),
    )


def event_depths(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """XML events with ``open``: how many elements are open behind each. Ends too many count for nothing.

    The running sum of starts and ends, less its least value so far where that is under 0; a window is one document.
    """
    inside = Window.partitionBy(*keys).orderBy("pos")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    summed = events.withColumn("__sum", F.sum(step).over(inside))
    return summed.withColumn("open", (F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(inside))).cast("int")).drop("__sum")


def element_texts(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All text of each document's events in order."""
    texts = events.where("kind = 'text'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return texts.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def item_numbers(items: DataFrame, keys: tuple[str, ...] = ("doc_id",), start: int = 1, levels: int | None = None) -> DataFrame:
    """Items (keys, pos, depth) with their number from start, and the pos of the nearest item before that is less deep.

    depth goes from 0 to levels, by default to the greatest there is; for each level the last place of an item no deeper is kept
    along the window.
    """
    if levels is None:
        levels = items.agg(F.max("depth")).first()[0] or 0
    inside = Window.partitionBy(*keys).orderBy("pos")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    last = F.array(*[F.max(F.when(F.col("depth") <= k, F.col("pos"))).over(before) for k in range(max(levels, 1))])
    return items.withColumn("number", F.row_number().over(inside) + (start - 1)).withColumn("parent_pos", F.when(F.col("depth") > 0, F.get(last, F.col("depth") - 1)))
