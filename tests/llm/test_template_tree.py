import random
import re

import numpy as np

from quillspark.llm import template_tree as T


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, hash string, line int").repartition(3)
    return df, T.recurring_lines(df)


def plain_tokens(line):
    """Tokens of a line; those with a digit are None."""
    return [None if any(c in "0123456789" for c in t) else t for t in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if t]


def plain_templates(lines):
    """Templates of one leaf: a line joins the one that it shares most places with, if 7 in 10; places that differ become None."""
    held, of = [], []
    for line in lines:
        shares = [sum(a == b for a, b in zip(t, line, strict=True)) for t in held]
        if shares and 10 * max(shares) >= 7 * len(line):
            k = shares.index(max(shares))
            held[k] = [a if a == b else None for a, b in zip(held[k], line, strict=True)]
        else:
            k = len(held)
            held.append(line)
        of.append(k)
    return of


def brute(docs):
    """Lines parsed in the order of the template's hash can't be had here: these lines have well-parted templates."""
    leaves = {}
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            tokens = plain_tokens(line)
            if i is not None and len(tokens) >= T.MIN_TOKENS:
                leaves.setdefault((len(tokens), tuple(tokens[: T.DEPTH])), []).append((i, n, tokens))
    out = set()
    for rows in leaves.values():
        of = plain_templates([t for _, _, t in rows])
        for k in set(of):
            ids = {i for (i, _, _), o in zip(rows, of, strict=True) if o == k}
            if len(ids) >= 2:
                out |= {(i, n, len(ids), i != min(ids)) for (i, n, _), o in zip(rows, of, strict=True) if o == k}
    return out


def test_variable_fields(spark):
    names = ["anna", "bo", "cy", "di", "ed", "flo", "gus", "hal"]
    docs = [(i, f"User {i} logged in from host {names[i % 8]} at noon\nonly here {'abcdefgh'[i]} is this line of text {i} number\nshort {i}\n\n  Kept  words are all the same here ") for i in range(8)]
    docs += [(20, docs[0][1]), (21, docs[1][1] + "\nanother line that nobody else has\nanother line that nobody else has")]
    docs += [(30, None), (31, ""), (32, "\n\n"), (None, docs[0][1]), (33, "a " * 60000 + "\nx"), (34, "a " * 60000)]
    df, lines = run(spark, docs)
    got = {(r.doc_id, r.line, r.n_docs, r.dropped) for r in lines.collect()}
    assert got == brute(docs)
    kept = {r.doc_id: r.text for r in T.drop_lines(df, lines).collect() if r.doc_id is not None}
    assert kept[0] == docs[0][1] and "logged" not in kept[3] and "short 3" in kept[3] and kept[30] is None and kept[31] == ""
    assert kept[21].count("nobody") == 2 and kept[34] == ""
    assert T.drop_lines(df, lines).columns == df.columns and T.drop_lines(df, lines).count() == len(docs)


def test_large_leaf_is_parsed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i, f"this one line has its field {a}{b} and goes on after it") for i, (a, b) in enumerate((a, b) for a in letters[:12] for b in letters[:12])]
    _, lines = run(spark, docs)
    rows = lines.collect()
    assert len(rows) == 144 and {r.n_docs for r in rows} == {144} and len({r.template_id for r in rows}) == 1 and [r.doc_id for r in rows if not r.dropped] == [0]


def test_merge_and_mask():
    assert T.masked(" a1  b\tc-9 ") == ["<*>", "b", "<*>"]
    of, templates = T.merge([re.split(" ", s) for s in ("a b c d", "a b c e", "x y z d", "a b q e")], 0.5)
    assert of == [0, 0, 1, 0] and templates == [["a", "b", "<*>", "<*>"], ["x", "y", "z", "d"]]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.recurring_lines(none).collect() == [] and T.drop_lines(none, T.recurring_lines(none)).collect() == []


def test_a_document_of_very_many_lines(spark):
    docs = [(i, "\n".join(f"line {'abcdefghij'[n % 10]}{n} of many" if n % 2 else "the same line in both of them" for n in range(60000))) for i in (1, 2)]
    df, lines = run(spark, docs)
    kept = {r.doc_id: r.text for r in T.drop_lines(df, lines).collect()}
    assert kept[1] == docs[0][1] and kept[2].split("\n") == [x for x in docs[1][1].split("\n") if x.startswith("line")]


def test_parse_equals_merge():
    r = random.Random(3)
    for size in (1, 4, 5, 6, 9, 10, 17, 40):
        lines = []
        for _ in range(400):
            base = list(r.choice(lines)) if lines and r.random() < 0.7 else [r.choice("abcde") for _ in range(size)]
            for _ in range(r.randint(0, max(1, size // 3))):
                base[r.randrange(size)] = r.choice(["f", "g", "h", T.WILDCARD])
            lines.append(base)
        numbers = {T.WILDCARD: 0}
        rows = np.array([[numbers.setdefault(x, len(numbers)) for x in line] for line in lines], dtype=np.int32)
        for agree in (0.5, 0.7, 1.0):
            assert T.parse(rows, agree).tolist() == T.merge(lines, agree)[0]


def test_every_pair_of_a_large_leaf_meets(spark):
    r = random.Random(4)
    words = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in "lmnrstxz"]
    docs = []
    for i in range(2500):
        tail = r.choices(words, k=16)
        other = list(tail)
        other[r.randrange(16)] = "other"
        docs += [(2 * i, " ".join(["one", "and", "the", "same", *tail])), (2 * i + 1, " ".join(["one", "and", "the", "same", *other]))]
    _, lines = run(spark, docs)
    rows = lines.collect()
    assert len(rows) == 5000 and {r.n_docs for r in rows} == {2} and len({r.template_id for r in rows}) == 2500
    assert {r.doc_id for r in rows if r.dropped} == {2 * i + 1 for i in range(2500)}


def test_short_lines_recur_only_as_they_are(spark):
    docs = [(i, f"All rights reserved.\nPage {i}\n{'abcdef'[i]} text has a line of its own\n All  rights reserved.") for i in range(5)]
    docs += [(7, "Twice"), (8, "Twice"), (9, "Page 0"), (10, None), (None, "All rights reserved.")]
    df, lines = run(spark, docs)
    rows = lines.collect()
    assert {(r.doc_id, r.line, r.n_docs, r.dropped) for r in rows} == {(i, n, 5, i > 0) for i in range(5) for n in (0, 3)}
    assert len({r.template_id for r in rows}) == 1
    kept = {r.doc_id: r.text for r in T.drop_lines(df, lines).collect()}
    assert kept[0] == docs[0][1] and kept[4].startswith("Page 4\ne text") and "reserved" not in kept[4] and kept[8] == "Twice" and kept[9] == "Page 0"
