import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm.common import settled
from quillspark.llm.lm_scoring import cross_entropy_difference


def brute(docs, target, strength):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    vocabulary = len({w for _, t in docs for w in split(t)})
    models = []
    for ids in (target, None):
        uni, ctx, big = Counter(), Counter(), Counter()
        for i, t in docs:
            if ids is None or i in ids:
                w = split(t)
                uni.update(w)
                ctx.update(["^", *w][:-1] if w else [])
                big.update(zip(["^", *w], w, strict=False))
        models.append((uni, ctx, big))
    out = []
    for i, t in docs:
        w = split(t)
        losses = []
        for uni, ctx, big in models:
            n = sum(uni.values())
            p = [(big[a, b] + strength * (uni[b] + 1) / (n + vocabulary)) / (ctx[a] + strength) for a, b in zip(["^", *w], w, strict=False)]
            losses.append(-sum(map(math.log, p)) / len(p) if p else 0.0)
        out.append((i, len(w), losses[0], losses[1]))
    return out


def test_against_dictionaries(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices([f"w{j}" for j in range(25)], k=r.randint(0, 40)))) for i in range(60)] + [(99, None), (98, " "), (5, "W1 w2")]
    target = {i for i in range(0, 60, 3)}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([(i, "x") for i in [*target, 3, None]], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_tokens, x.target_loss, x.background_loss, x.score) for x in cross_entropy_difference(d, t, run=100).collect())
    want = sorted(brute(docs, target, 4.0))
    assert [(a, b) for a, b, *_ in got] == [(a, b) for a, b, *_ in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[2], w[2], abs_tol=1e-9) and math.isclose(g[3], w[3], abs_tol=1e-9) and math.isclose(g[4], w[2] - w[3], abs_tol=1e-9)
    # the target's own texts are closer to the target model
    mean = lambda keep: sum(x[4] for x in got if keep(x[0])) / sum(1 for x in got if keep(x[0]))
    assert mean(lambda i: i in target) < mean(lambda i: i < 60 and i not in target)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    t = d.select("doc_id").limit(0)
    assert cross_entropy_difference(d.limit(0), t).collect() == []
    assert sorted(x.n_tokens for x in cross_entropy_difference(d, t).collect()) == [1, 2]


def test_long_texts_clashing_columns_and_many_parts(spark):
    r = random.Random(2)
    docs = [(1, " ".join(r.choices([f"w{j}" for j in range(300)], k=60000))), (2, "w1 w2 w3"), (2, "w1 w2 w3"), (3, None)]
    d = spark.createDataFrame([(i, t, 7, 8, "x", 0.5) for i, t in docs], "doc_id long, text string, task int, run int, words string, score double")
    t = spark.createDataFrame([(2, "x")], "doc_id long, words string")
    got = sorted((x.doc_id, x.n_tokens, x.target_loss, x.background_loss) for x in cross_entropy_difference(d, t, part_chars=40).collect())
    for g, w in zip(got, sorted(brute(docs, {2}, 4.0)), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], abs_tol=1e-8) and math.isclose(g[3], w[3], abs_tol=1e-8)


def test_rows_in_other_partitions_when_read_again(spark, tmp_path):
    spark.range(200).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 5) AS text").repartition(5).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert settled(read) is read and settled(read.where("doc_id > 5")).count() == 194
    moving = read.where(F.rand() < 2).repartition(6)
    assert settled(moving) is not moving
    assert cross_entropy_difference(moving, read.where("doc_id < 20").select("doc_id"), run=20).count() == 200
