import random
import time
from itertools import combinations

import numpy as np
import pytest

from quillspark.llm.decontaminate import MASKS, Seeds, decontaminate
from quillspark.llm.textbytes import texts_of


def best_run(doc, item, least=12):
    """The best overlap by its definition: all runs on all diagonals, from a match to a match, four matches for each other word."""
    least, best = min(least, len(item)), None
    for d in range(-len(item) + 1, len(doc)):
        span = range(max(0, -d), min(len(item), len(doc) - d))
        same = [i for i in span if doc[i + d] == item[i]]
        if not item or 5 * len(same) < 4 * least:
            continue
        for a, i in enumerate(same):
            for b in range(a, len(same)):
                n, m = same[b] + 1 - i, b + 1 - a
                if n >= least and 5 * m >= 4 * n and (best is None or 5 * m - 4 * n > best[0]):
                    best = (5 * m - 4 * n, n, m)
        if len(item) <= 12 and len(span) == len(item) and 5 * len(same) >= 4 * len(item):
            score = 5 * len(same) - 4 * len(item)
            if best is None or score > best[0]:
                best = (score, len(item), len(same))
    return best


def test_masks_hit_every_run_that_counts():
    for n in range(12, 24):
        gone = np.array(list(combinations(range(n), n // 5)))
        same = np.ones((len(gone), n), bool)
        same[np.arange(len(gone))[:, None], gone] = False
        hit = np.zeros(len(gone), bool)
        for m in MASKS:
            for lo in range(n - len(m) + 1):
                hit |= same[:, [lo + i for i, c in enumerate(m) if c == "1"]].all(1)
        assert hit.all(), n


def _planted(r, words, sizes, share):
    items = [r.choices(words, k=r.choice(sizes)) for _ in range(30)]
    docs = []
    for i in range(200):
        text = r.choices(words, k=r.randint(0, 120))
        if r.random() < 0.7:
            part = list(r.choice(items))
            if len(part) > 12 and r.random() < 0.5:
                part = part[r.randint(0, len(part) - 12) :]
            for _ in range(r.randint(0, max(0, int(len(part) * share)))):
                part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(text))
            text[at:at] = part
        docs.append((i, " ".join(text)))
    return items, docs


@pytest.mark.parametrize(("vocabulary", "sizes"), [(3000, [3, 5, 7, 9, 10, 11, 12, 13, 20, 40]), (2, [6, 12, 15, 30])])
def test_against_every_run_of_every_diagonal(spark, vocabulary, sizes):
    items, docs = _planted(random.Random(5), [f"w{i}" for i in range(vocabulary)], sizes, 0.3)
    if vocabulary < 10:
        docs = [(i, " ".join(t.split()[:60])) for i, t in docs[:60]]
    found = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string"), block_chars=1500).collect()
    got = {(x.doc_id, x.item_id): 5 * x.n_matched - 4 * x.n_words for x in found}
    want = {(i, j): b[0] for i, text in docs for j, item in enumerate(items) if (b := best_run(text.split(), item))}
    assert got == want and len(want) > 100
    by_id = dict(docs)
    for x in found:
        mine, theirs = by_id[x.doc_id].split()[x.doc_start :][: x.n_words], items[x.item_id][x.item_start :][: x.n_words]
        assert sum(a == b for a, b in zip(mine, theirs, strict=True)) == x.n_matched


def test_odd_rows(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, item.upper() + " x" * 20000, 0), (4, item, 0), (4, item, 0), (None, item, 0), (5, "a a a", 0)]
    items = [(7, item, "x"), (8, None, "x"), (9, "", "x"), (10, "b b", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = sorted(((x.doc_id or -1), x.item_id, x.doc_start, x.n_words) for x in decontaminate(d, i).collect())
    assert got == [(-1, 7, 0, 13), (4, 7, 0, 13), (4, 7, 0, 13), (4, 7, 0, 13)]
    assert decontaminate(d.limit(0), i).collect() == [] and decontaminate(d, i.limit(0)).collect() == []


def _overlaps(item, text):
    return {(t, i): n for t, i, _, _, n, _ in Seeds([0], [item], 12).overlaps(texts_of([text]).words())}


@pytest.mark.parametrize(("n", "substituted"), [(12, 1), (12, 2), (13, 2), (16, 2), (16, 3), (20, 3), (20, 4), (5, 1), (9, 1), (10, 2), (11, 2)])
def test_recall_of_substituted_items(n, substituted):
    words = [f"v{j}" for j in range(n)]
    for gone in combinations(range(n), substituted):
        text = " ".join(["before", *("changed" if j in gone else w for j, w in enumerate(words)), "after"])
        inner = n - (gone[0] == 0) - (gone[-1] == n - 1)
        if inner == n:
            assert _overlaps(" ".join(words), text), gone


def test_other_runs_of_the_diagonal_count():
    # eleven words in place, five others, then thirteen with one substituted: too few in the first, enough in the second
    item = [f"v{j}" for j in range(29)]
    text = [*item[:11], *("o" * 5), *item[16:22], "o", *item[23:29]]
    assert _overlaps(" ".join(item), " ".join(text)) == {(0, 0): 13}
    assert not _overlaps(" ".join(item), " ".join([*item[:11], *("o" * 5), *item[16:22], *("o" * 7)]))
    assert not _overlaps("w0x0 w1 w2 w3 w4 w5 w6", "w0x0 a w2 w3 b w5 w6")


def test_repeated_words_stay_bounded():
    took = []
    for n in (1000, 4000):
        for step in (["same"], ["a", "b", "c"], [f"s{i}" for i in range(11)]):
            text = " ".join((step * n)[:n])
            began = time.process_time()
            assert _overlaps(text, text) == {(0, 0): n}
            took.append(time.process_time() - began)
    assert max(took) < 10, took
