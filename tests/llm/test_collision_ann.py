import numpy as np
import pytest

from quillspark.llm.collision_ann import nearest

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(rows, queries, k):
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    base = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and fine(v)]
    out = {}
    for q in queries:
        for i, v in base:
            if i == q:
                scored = {}
                for j, w in base:
                    if j != q and len(w) == len(v):
                        scored[j] = max(scored.get(j, -np.inf), float(v @ w))
                out[q] = sorted((-s, j) for j, s in scored.items())[:k]
                break
    return out


@pytest.mark.parametrize("clusters", [0, 15])
def test_recall(spark, clusters):
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 24))
    if clusters:
        x = r.standard_normal((clusters, 24))[r.integers(0, clusters, 3000)] + 0.2 * x
    x *= r.uniform(0.5, 2, (3000, 1))
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA)
    got = {}
    for row in nearest(df, df.where("vec_id % 20 = 0"), block=800, chunk=60).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    want = brute(rows, range(0, 3000, 20), 20)
    assert got.keys() == want.keys()
    hit = 0
    vectors = x.astype(np.float32).astype(float)
    for q, found in got.items():
        assert [n for n, *_ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-9 for _, v, s in found)
        hit += len({v for _, v, _ in found} & {j for _, j in want[q]})
    assert hit / (20 * len(got)) >= 0.9


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (40, [3.0, 4.0, 5.0])]
    rows += [(i, [1.0, 1.0]) for i in range(100, 140)] + [(150, [1.0, 1.0]), (150, [1.0, 1.0]), (8, [0.5, 3.0])]
    df = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA)
    got = {}
    for row in nearest(df, df.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((-row.score, row.vec_id))
    assert got == brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 5)
    assert nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []
