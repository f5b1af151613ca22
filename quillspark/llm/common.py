"""What the operators share: reading tables, cutting lineage, bounded summaries and connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one in the warehouse, which all executors share, or with a local master a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None and re.match(r"local(\[|$)", context.master):
            own = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(own or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, without its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """df itself if it is files read, projected and filtered, which come in the same partitions each time; else df written."""
    ran = df._jdf.queryExecution()
    steps = set(re.findall(r"^[\s:+*()\d-]*([A-Z]\w+)", ran.sparkPlan().toString(), re.M))
    return df if ran.optimizedPlan().deterministic() and steps <= {"Project", "Filter", "FileScan", "Scan", "ColumnarToRow"} and "FileScan" in steps else saved(df)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker, in sessions that haven't set their size."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(rows))


def bucket_sums(df: DataFrame, n: int, columns: Iterable[str]) -> list[np.ndarray]:
    """Sums of integer columns by ``bucket`` (0 to n - 1) as arrays of length n: a summary whose size n bounds."""
    columns = list(columns)
    found = df.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    at = found["bucket"].to_numpy()
    out = []
    for c in columns:
        dense = np.zeros(n, dtype=np.int64)
        dense[at] = found[c].to_numpy()
        out.append(dense)
    return out


def bucket_batches(counts: np.ndarray, rows: int = 1 << 16):
    """A task's counts other than 0 as (bucket, n) in batches of bounded size."""
    at = np.flatnonzero(counts)
    for lo in range(0, len(at), rows):
        part = at[lo : lo + rows]
        yield pa.record_batch({"bucket": pa.array(part.astype(np.int32)), "n": pa.array(counts[part])})
    pa.default_memory_pool().release_unused()


def bitmap(ids: DataFrame, column: str, bits: int = 25) -> np.ndarray:
    """A bit array of 2 ** bits places in which every id's place is set: no id is missed, others may be let through."""
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    words = (
        ids.select(place.alias("place"))
        .groupBy(F.shiftright("place", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(place % 32 AS INT))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def maybe_in(df: DataFrame, column: str, places: np.ndarray) -> DataFrame:
    """Rows whose id may be in the bitmap, and all whose id is."""
    bits = int(np.log2(len(places))) + 5
    shared = df.sparkSession.sparkContext.broadcast(places)

    @F.pandas_udf("boolean")
    def hit(place):
        import pandas as pd

        at = place.to_numpy()
        return pd.Series((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)

    return df.where(hit(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: edges (a, b) of long, result (node, component).

    component is the smallest node; nodes without an edge to another are not in the result. Edges that haven't settled after
    that many rounds are an error. A round shuffles the edges by
    node; the smallest neighbour is found by a partially aggregated min and joined back, so a hub is no single task's work.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    before = size(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = saved(small)
        after = size(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("a").agg(F.min("b").alias("component")).union(edges.groupBy("b").agg(F.min("b").alias("component"))).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("component"))


def per_batch(make: Callable) -> Callable:
    """A function for mapInArrow from one that turns a RecordBatch into RecordBatches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)
        # workers live on between tasks: what they don't use any more goes back
        pa.default_memory_pool().release_unused()

    return run
