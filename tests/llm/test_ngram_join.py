import random
import re

import pytest

from quillspark.llm.ngram_join import ngram_join
from quillspark.llm.textbytes import shingle_sets, texts_of


def brute(rows, k, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and den * len(s & t) >= num * len(s | t):
                i, j = sorted((root(i), root(j)))
                parent[j] = i
    return sorted((i, len(s), root(i)) for i, s in sets)


def sample(seed, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = r.choices(words, k=40)
    out = []
    for i in range(160):
        kind = r.random()
        if out and kind < 0.45:
            base = r.choice(out)[1].split()
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = r.choice(words)
            out.append((i, " ".join(base)))
        elif kind < 0.6:
            out.append((i, " ".join(passage + r.choices(words, k=r.randint(1, 8)))))
        else:
            out.append((i, " ".join(r.choices(words, k=r.randint(1, 120)))))
    return out


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_all_pairs(spark, seed, k, num):
    rows = sample(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, k=k, num=num).collect())
    assert got == brute(rows, k, num, 100)


@pytest.mark.parametrize(("seed", "k", "num"), [(4, 1, 70), (6, 2, 80)])
def test_groups_with_members_between_them(spark, seed, k, num):
    # families of near copies whose members overlap with other families about as much as the threshold asks for
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for f in range(12):
        base = r.sample(words, 30)
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, 7)):
                own[r.randrange(30)] = r.choice(words)
            rows.append((len(rows), " ".join(own[: r.randint(20, 30)])))
        if f % 3 == 0:
            words[:20] = base[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join(df, k=k, num=num).collect())
    assert got == brute(rows, k, num, 100)


def test_groups_stay_shut_below_the_bound(spark):
    # groups of near copies of one text each; every text shares three rare words with one text of the next group
    r = random.Random(9)
    words, rows = [f"w{i}" for i in range(5000)], []
    for f in range(12):
        base = r.choices(words, k=60)
        for c in range(4):
            own = list(base)
            own[r.randrange(60)] = r.choice(words)
            rows.append((len(rows), " ".join([*own, *(f"s{f - f % 2}x{c}x{j}" for j in range(3))])))
    seen = []
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join(df, k=1, num=60, on_opened=lambda reached, opened: seen.append((reached.where("many_h").count(), opened.where("h >= 0").count()))).collect())
    assert got == brute(rows, 1, 60, 100)
    (reached, opened), = seen
    assert reached > 0 and opened == 0


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(30000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "One two", "x"), (5, "one  TWO", "x"), (6, "one", "x"), (None, "one", "x")]
    rows += [(7, long, "x"), (7, long, "x"), (8, long + " end", "x"), (9, "é à", "x"), (9, "one two", "x"), (10, "É à", "x")]
    df = spark.createDataFrame([(a, b, c, 1, 2, 3) for a, b, c in rows], "doc_id long, text string, token string, n int, id int, g int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, k=4, num=85).collect())
    assert got == brute([(a, b) for a, b, _ in rows], 4, 85, 100)
    assert ngram_join(df.limit(0)).collect() == []


def test_hashes_do_not_depend_on_the_slice():
    alone = [list(next(shingle_sets(texts_of([t]).words(), 3))) for t in ("a b c d", "B c d", "x")]
    assert [list(s) for s in shingle_sets(texts_of(["A b C d", "b c d", "X"]).words(), 3)] == alone


def test_components_that_do_not_settle_are_an_error(spark):
    from quillspark.llm.common import components

    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
    assert {(r.node, r.component) for r in components(chain).collect()} == {(i, 0) for i in range(41)}
    assert components(chain.limit(0), rounds=1).collect() == []
