"""Documents from files, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_format


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """path, content (whole bytes) and format (null where it is refused) of every file; only asked-for columns are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content").withColumn("format", document_format(F.col("path"), F.col("content")))


def from_texts(df: DataFrame, text_column: str, path: str = "") -> DataFrame:
    """A table's texts as documents: content in UTF-8 and a path, which names the format where it has an extension."""
    return df.withColumn("content", F.encode(F.col(text_column), "UTF-8")).withColumn("path", F.lit(path))


def write_outputs(converted: DataFrame, folder: str, output_column: str = "output") -> None:
    """Outputs as text files, documents that couldn't be read left out."""
    converted.where(F.col(output_column).isNotNull()).select(F.col(output_column).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(folder)
