import math
import random
import zlib

import numpy as np

from quillspark.llm import toxicity as X
from quillspark.llm.textbytes import texts_of

WORDS = [f"word{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]


def corpus(n, seed, biased=False):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.3
        text = r.choices(WORDS, k=r.randint(3, 60))
        if toxic:
            text.insert(r.randint(0, len(text)), r.choice(["Idiot", "scum,", "vermin" + r.choice("abcdefg") + r.choice("xyz")]))
        if r.random() < (0.8 if biased and toxic else 0.03):
            text.insert(r.randint(0, len(text)), r.choice(["muslim", "Muslim"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500, 1)
    d = spark.createDataFrame([(*x, "z") for x in [*docs, (5000, None), (5001, ""), (5002, " ,. "), (None, "idiot"), (5003, "idiot " + "worda " * 30000)]], "doc_id long, text string, score string")
    l = spark.createDataFrame([(i, 1, y) for i, y in [*labels, (None, 1), (3, None)]], "doc_id long, quality int, toxic int")
    got = X.toxicity(d, l).collect()
    assert len(got) == 1505 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in docs)
    held = [(by[i].predicted, y) for i, y in labels if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert by[5000].score == by[5001].score == by[5002].score < 0.5 and by[None].predicted == 1 and by[5003].predicted == 1
    again = {r.doc_id: r.score for r in X.toxicity(d.repartition(5), l).collect()}
    assert all(abs(again[i] - by[i].score) < 1e-9 for i in by)


def test_neutral_mentions_do_not_count(spark):
    docs, labels = corpus(1200, 2, biased=True)
    rows = spark.createDataFrame([(t, y) for (_, t), (_, y) in zip(docs, labels, strict=True)], "text string, toxic int")
    model = X.train(rows)
    words = texts_of(["worda muslim wordb", "worda christian wordb", "worda wordb", "an idiot"]).words(X.BREAKS)
    a, b, none, bad = model.scores(words)
    assert abs(a - b) < 0.05 and a < 0.5 and none < 0.5 < bad


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    l = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in X.toxicity(d, l).collect()}) == 1
    assert X.toxicity(d.limit(0), l).collect() == []
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in X.toxicity(d, one).collect())


def test_swaps_take_the_terms_features():
    own, other = X.term_swaps((("women", "men"),))[int(texts_of(["women"]).words(X.BREAKS).hash[0])]
    assert set(own) == set(X.features(texts_of(["Women!"]).words(X.BREAKS))[0]) and set(other) == set(X.features(texts_of(["men"]).words(X.BREAKS))[0])
    assert np.array_equal(own, np.sort(own))


def plain_fit(rows, gone, come, labels, passes, l2, counterfactual, rate):
    """The fit with a dictionary for each thing, coordinate by coordinate."""
    n, share = len(labels), sum(labels) / len(labels)
    seen, one = {}, {}
    for own, y in zip(rows, labels, strict=True):
        for f in own:
            seen[f] = seen.get(f, 0) + 1
            one[f] = one.get(f, 0) + y
    square = {f: (one[f] - seen[f] * share) ** 2 / ((seen[f] + 10) * share * (1 - share)) for f in seen}
    value = {f: q / (q + 50) for f, q in square.items()}
    w, size, b, size_b = {}, {}, math.log(share / (1 - share)), 1e-3
    order = np.random.default_rng(1)

    def move(f, step):
        size[f] = size.get(f, 1e-3) + step**2
        w[f] = w.get(f, 0.0) - rate * step / math.sqrt(size[f])

    logit = lambda places: sum(w.get(f, 0.0) * value.get(f, 0.0) for f in places)
    for _ in range(passes):
        for i in order.permutation(n):
            error = 1 / (1 + math.exp(-(b + logit(rows[i])))) - labels[i]
            for f, step in [(f, error * value[f] + l2 * w.get(f, 0.0)) for f in rows[i]]:
                move(f, step)
            size_b += error**2
            b -= rate * error / math.sqrt(size_b)
            gap = logit(gone[i]) - logit(come[i])
            for f in gone[i]:
                move(f, counterfactual * gap * value.get(f, 0.0))
            for f in come[i]:
                move(f, -counterfactual * gap * value.get(f, 0.0))
    return {f: w[f] * value.get(f, 0.0) for f in w}, b


def test_fit_against_a_plain_version():
    r = random.Random(6)
    rows = [np.array(sorted(r.sample(range(40), r.randint(0, 12))), dtype=np.int32) for _ in range(80)]
    labels = np.array([float(7 in own or r.random() < 0.1) for own in rows])
    gone = [own[own < 5] for own in rows]
    come = [np.setdiff1d(np.array(sorted(r.sample(range(30, 40), 2)), dtype=np.int32), own) for own in rows]
    one, seen = np.zeros(50), np.zeros(50)
    for own, y in zip(rows, labels, strict=True):
        seen[own] += 1
        one[own] += y
    model = X.fit(rows, gone, come, labels, X.values(one, seen, labels.mean()), passes=4)
    weights, bias = plain_fit([x.tolist() for x in rows], [x.tolist() for x in gone], [x.tolist() for x in come], labels.tolist(), 4, 1e-4, 5.0, 0.2)
    assert abs(model.bias - bias) < 1e-9 and all(abs(model.weights[f] - weights.get(f, 0.0)) < 1e-9 for f in range(50))


def test_mentions_move_no_score_of_texts_that_name_no_group(spark):
    # a feature that a term shares with toxic words ("muslimoid") must not make the term toxic
    r = random.Random(7)
    rows = []
    for _ in range(1000):
        toxic = r.random() < 0.3
        rows.append((" ".join([*r.choices(WORDS, k=20), *(["muslimoid" + r.choice("abcd")] if toxic else [])]), int(toxic)))
    df = spark.createDataFrame(rows, "text string, toxic int")
    clean = [t for t, y in rows if not y][:100]
    words = texts_of([t + " muslim" for t in clean]).words(X.BREAKS)
    with_penalty, without = (X.train(df, counterfactual=c).scores(words) for c in (5.0, 0.0))
    assert (with_penalty >= 0.5).mean() <= (without >= 0.5).mean() and with_penalty.mean() < without.mean() and (with_penalty >= 0.5).mean() < 0.05
    assert X.train(df).scores(texts_of([f"{t} muslimoidb" for t in clean]).words(X.BREAKS)).min() > 0.5
