"""N-gram Jaccard join by a token-group matrix.

1. Texts with the same shingle set form a class; one document stands for it.
2. Similar classes are partitioned into groups: each is verified against the most central of the classes that share one of
   its lowest shingle hashes, and verified links are closed into groups. Only stars are verified here, never all pairs.
3. The matrix holds, for each group, the union of its members' prefix tokens in one global order, rare tokens first.
   A query class reads the matrix rows of its prefix tokens. The tokens found in a group's union and what stands behind the
   query's prefix bound its overlap with any member; a group that is not the query's own is opened only if that bound
   allows the threshold. Of two classes the one whose prefix ends first is the query, so that whatever its prefix shares
   with a member is in the union.
4. In an opened group the same bound is taken member by member from both sides; what passes is verified on whole texts.

The prefix of a set of n shingles is its first n - ceil(t * n) + 1 tokens: two sets that link share one at least, so no
link between groups is lost, and links inside a group cannot change components. The global order takes counts of hash
buckets over all texts; any order is correct, and counts only keep frequent passages out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bucket_batches, bucket_sums, components, maybe_in, per_batch, saved, small_batches
from .textbytes import mix, shingle_sets, signed, slices, texts_of

BUCKET_BITS = 20
STARS = 4


def _needed(n: int, num: int, den: int) -> int:
    """The least overlap with a set of n shingles at which 1 - num / den of it may differ."""
    return -(-num * n // den)


def _counts(k: int):
    def count(batches):
        seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                for tokens in shingle_sets(texts.words(), k):
                    np.add.at(seen, (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        yield from bucket_batches(seen)

    return count


def ordered(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens as longs whose order is the global one: by the bucket's count, then by hash."""
    heavy = np.minimum(counts[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], (1 << 20) - 1).astype(np.uint64)
    return np.sort((heavy << np.uint64(43)) | (tokens & np.uint64((1 << 43) - 1))).astype(np.int64)


def _signatures(k: int, num: int, den: int, counts):
    def make(batch):
        for lo, hi, texts in slices(batch.column(1)):
            rows: dict[str, list] = {c: [] for c in ("n", "d1", "d2", "stars", "prefix")}
            for tokens in shingle_sets(texts.words(), k):
                n = len(tokens)
                rows["n"].append(n)
                rows["d1"].append(int(signed(np.array([tokens.sum(dtype=np.uint64)]))[0]))
                rows["d2"].append(int(signed(np.array([mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]))[0]))
                rows["stars"].append(signed(tokens[:STARS]))
                rows["prefix"].append(ordered(tokens, counts.value)[: n - _needed(n, num, den) + 1] if n else np.empty(0, dtype=np.int64))
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch.column(0).slice(lo, hi - lo), *[pa.array(rows[c], pa.int64()) for c in ("n", "d1", "d2")], *[pa.array(rows[c], longs) for c in ("stars", "prefix")]],
                names=["id", "n", "d1", "d2", "stars", "prefix"],
            )

    return per_batch(make)


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, da, b, db) of class representatives that link, on their whole texts."""
    pairs = saved(pairs)
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    found = maybe_in(docs, "id", bitmap(ends, "id")).join(ends, "id", "left_semi")

    def digest(batch):
        for lo, hi, texts in slices(batch.column(1)):
            d1 = [int(signed(np.array([t.sum(dtype=np.uint64)]))[0]) for t in shingle_sets(texts.words(), k)]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(d1, pa.int64())], names=["id", "text", "d1"])

    # a repeated id with other texts has other digests; of equal rows one is enough
    texts = saved(found.mapInArrow(per_batch(digest), "id long, text string, d1 long").dropDuplicates(["id", "d1"]))
    left = texts.select(F.col("id").alias("a"), F.col("d1").alias("da"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("d1").alias("db"), F.col("text").alias("tb"))

    def link(batch):
        # one side repeats where a class stands against many; its set is made once a batch
        sets: dict[str, np.ndarray] = {}

        def tokens(value: str) -> np.ndarray:
            if value not in sets:
                sets[value] = next(shingle_sets(texts_of([value]).words(), k))
            return sets[value]

        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            s, t = tokens(x), tokens(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(den * both >= num * (len(s) + len(t) - both))
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, ["a", "da"]).join(right, ["b", "db"]).select("a", "b", "ta", "tb").mapInArrow(per_batch(link), "a long, b long")


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, num: int = 80, den: int = 100, on_opened: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their k-word shingle sets, at least num / den.

    Returns id_column, n_shingles, component_id, class_id (the smallest id with the same set), one row for each row of docs.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text of fewer than k words has its whole
    sequence as one shingle. A null or empty text, or one of white space, has no shingles and links with nothing. Rows
    with the same id count as one document with all their links; a null id takes no part and is left out. Other columns
    of docs, whatever their names, are not read. An empty table gives an empty result. on_opened, if given, is called with
    the query-group pairs that share a token and with those of them that are opened, for measurements.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id IS NOT NULL")
    (seen,) = bucket_sums(docs.select("text").mapInArrow(_counts(k), "bucket int, n long"), 1 << BUCKET_BITS, ["n"])
    counts = spark.sparkContext.broadcast(np.minimum(seen, (1 << 20) - 1).astype(np.int32))
    schema = "id long, n long, d1 long, d2 long, stars array<long>, prefix array<long>"
    sigs = saved(docs.mapInArrow(_signatures(k, num, den, counts), schema))

    filled = sigs.where("n > 0")
    classes = saved(filled.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    member = sigs.select("id", "n", "d1", "d2").join(classes.drop("copies"), ["d1", "d2"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    reps = filled.join(classes.withColumnRenamed("rep", "id"), ["id", "d1", "d2"]).dropDuplicates(["id", "d1", "d2"]).select("id", "d1", "n", "copies", "stars", "prefix")
    # a repeated id ties its classes together
    again = member.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("id")
    tied = member.join(again, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    # what others were made from is likely the text with the most copies, then the one whose lowest hashes most others have
    star = reps.select("id", "d1", "n", "copies", F.explode("stars").alias("token"))
    star = saved(star.join(star.groupBy("token").agg(F.count("*").alias("m")), "token").where("m > 1"))
    known = star.groupBy("id", "d1").agg(F.sum("m").alias("known"))
    centre = star.join(known, ["id", "d1"]).groupBy("token").agg(F.min(F.struct((-F.col("copies")).alias("few"), (-F.col("known")).alias("unknown"), "id", "n", "d1")).alias("c")).select("token", F.col("c.n").alias("cn"), F.col("c.id").alias("a"), F.col("c.d1").alias("da"))
    # written before it is joined: a join of two plain tables can split the rows of a token that a large group shares
    centre = saved(centre)
    near = (
        star.join(centre, "token")
        .where((F.col("a") != F.col("id")) & (F.col("cn") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("cn") * num))
        .select("a", "da", F.col("id").alias("b"), F.col("d1").alias("db"))
        .distinct()
    )
    links = saved(_verify(near, docs, classes, k, num, den).union(tied))
    groups = saved(components(links))

    by_group = reps.join(groups, reps["id"] == groups["node"], "left").select("id", "d1", "n", "prefix", F.coalesce("component", "id").alias("g"), F.col("component").isNotNull().alias("many"))
    by_group = saved(by_group)
    rows = by_group.select("id", "d1", "g", "many", "n", F.element_at("prefix", -1).alias("last"), F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
    # tokens of one group only can't lead to another: most rows end here
    several = saved(rows.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token"))
    shared = saved(rows.join(several, "token", "left_semi"))
    rest = F.col("n") - F.col("pos")
    matrix = shared.groupBy("token", F.col("g").alias("h"), F.col("many").alias("many_h")).agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("last").alias("most_last"), F.max(rest).alias("most_rest"))
    matrix = saved(matrix)
    ratio = F.lit(num / (num + den))
    slack = 1e-6
    # the overlap that the threshold asks for with any member of the group
    need = F.ceil(ratio * (F.col("n") + F.greatest("least_n", F.ceil(F.col("n") * num / den - slack))) - slack)
    reached = (
        shared.join(matrix, "token")
        .where((F.col("g") != F.col("h")) & (F.col("last") <= F.col("most_last")) & (F.col("most_n") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("least_n") * num))
        .where((rest >= need) & (F.col("most_rest") >= need))
        .groupBy("id", "d1", "h", "many_h")
        .agg(F.count("*").alias("found"), F.least(F.min(rest), F.min("most_rest")).alias("left"), F.min(need).alias("need"))
    )
    reached = saved(reached)
    # a group of one class has no more of the query than the tokens found and what stands behind the last one in both
    alone = reached.where(~F.col("many_h") & (F.col("found") + F.col("left") - 1 >= F.col("need"))).select("id", "d1", "h")
    # no member of a larger one has more than the query's tokens that are in the group's union and all behind the query's prefix
    inside = reached.where("many_h").select("id", "d1", "h", "need").join(shared.select("id", "d1", "token", "n", "p"), ["id", "d1"]).join(matrix.select("token", "h"), ["token", "h"])
    larger = inside.groupBy("id", "d1", "h").agg(F.count("*").alias("found"), F.min(F.col("n") - F.col("p")).alias("behind"), F.min("need").alias("need")).where(F.col("found") + F.col("behind") >= F.col("need"))
    opened = alone.union(larger.select("id", "d1", "h"))
    if on_opened is not None:
        opened = saved(opened)
        on_opened(reached, opened)
    x = by_group.select(F.col("id").alias("a"), F.col("d1").alias("da"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    y = by_group.select(F.col("id").alias("b"), F.col("d1").alias("db"), F.col("n").alias("nb"), F.col("prefix").alias("pb"), F.col("g").alias("h"))
    last = lambda p: F.element_at(p, -1)
    # below the smaller of the two last tokens both prefixes are complete; the query has the smaller one, or a tie
    members = (
        opened.withColumnsRenamed({"id": "a", "d1": "da"})
        .join(x, ["a", "da"])
        .join(y, "h")
        .where((last("pa") <= last("pb")) & (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
        .withColumn("both", F.size(F.array_intersect("pa", "pb")))
        .withColumn("need", F.ceil(ratio * (F.col("na") + F.col("nb")) - slack))
        .where(F.col("both") + F.col("na") - F.size("pa") >= F.col("need"))
        .where(F.expr("both + nb - size(filter(pb, t -> t <= element_at(pa, -1))) >= need"))
        .select("a", "da", "b", "db")
        .distinct()
    )
    more = _verify(members, docs, classes, k, num, den)
    named = groups.select(F.col("node"), F.col("component"))
    bridged = (
        more.join(named.withColumnsRenamed({"node": "a", "component": "ga"}), "a", "left")
        .join(named.withColumnsRenamed({"node": "b", "component": "gb"}), "b", "left")
        .select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
        .distinct()
    )
    top = saved(components(bridged))
    final = (
        groups.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
        .select("node", F.coalesce("top", "component").alias("component"))
        .union(top.join(groups.select(F.col("node")), "node", "left_anti").select("node", "component"))
    )
    return member.join(final, member["rep"] == final["node"], "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"), F.col("rep").alias("class_id")
    )
