"""A corpus pipeline: from raw documents to packed token sequences.

STAGES are applied in order; each gets what the one before has kept, written as Parquet and read again. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import checkpoint_folder, saved, table
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.ngram_join import ngram_join
from quillspark.llm.packing import pack
from quillspark.llm.queries import tokenizer
from quillspark.llm.template_tree import drop_lines, recurring_lines
from quillspark.llm.toxicity import score, train_on


#: The share of a document's characters that line dedup has to leave.
RESIDUE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the classifier that labels train."""
    model = train_on(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, keep=tuple(docs.columns), into="__score").where("__score < 0.5").drop("__score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first document.

    A document of which less than RESIDUE is left goes too: its lines stand in other documents, and what is left of it is the
    odd line by which a near copy differs, which no comparison of whole documents would tie to them any more.
    """
    lines = saved(recurring_lines(docs))
    kept = drop_lines(docs.withColumn("__before", F.col("text")), lines)
    emptied = (F.trim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) == "") & (F.col("text") != F.col("__before"))
    little = F.length("text") < RESIDUE * F.length("__before")
    kept = kept.where(~F.coalesce(emptied | little, F.lit(False))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a hash of the text: equal texts share their key, whatever their doc_id."""
    return docs.withColumn("__key", F.xxhash64("text"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id (null counts as the greatest), and one row of each equal doc_id and text.

    Near copies share 80 % of their five-word shingles, the usual values for near duplicates; the query op3 has others.
    """
    keyed = _keyed(docs)
    rows = saved(keyed.groupBy("doc_id", "__key").agg(F.count("*").alias("n")))
    found = ngram_join(keyed.select("__key", "text"), id_column="__key").where("n_shingles > 0").groupBy("__key").agg(F.min("component_id").alias("group"))
    grouped = saved(rows.join(found, "__key").withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__key")))
    first = grouped.groupBy("group").agg(F.min("rank").alias("first"))
    gone = saved(grouped.join(first, "group").where("rank <> first").select("doc_id", "__key"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["__key"] == b["__key"])
    kept = keyed.join(gone, same(keyed, gone), "left_anti")
    again = rows.where("n > 1").select("doc_id", "__key")
    if not again.isEmpty():
        kept = kept.join(again, same(kept, again), "left_anti").union(kept.join(again, same(kept, again), "left_semi").dropDuplicates(["doc_id", "__key"]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item stay. The text alone decides, so rows are found by their text's key."""
    keyed = _keyed(docs)
    gone = saved(decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_column="__key").select("__key").distinct())
    return keyed.join(gone, "__key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: No stage's method can be said in SQL; the tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage keeps is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
