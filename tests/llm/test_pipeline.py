import random

import public_tokenizers
import pytest
from test_decontaminate import best_run
from test_ngram_join import brute as near_copies
from test_template_tree import brute as recurring
from tokenizers import Tokenizer

import corpus_pipeline as P
from quillspark.llm.toxicity import toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    items = [" ".join(r.choices(words, k=30)) for _ in range(5)]
    docs, labels = [], []
    for i in range(260):
        kind, lines = r.random(), [" ".join(r.choices(words, k=r.randint(8, 25))) for _ in range(r.randint(1, 5))]
        toxic = kind < 0.2
        if toxic:
            lines[0] += r.choice([" vile", " Rotten"])
        elif kind < 0.4 and docs:
            base = r.choice(docs)[1].replace("\n", " ").split()
            base[r.randrange(len(base))] = "other"
            lines = [" ".join(base)]
        elif kind < 0.5:
            lines.append("the same notice stands at the end of many of these texts")
        elif kind < 0.6:
            lines[-1] += " " + r.choice(items)
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1, int(toxic or " vile" in docs[-1][1] or "otten" in docs[-1][1])))
    docs += [(900, None), (901, ""), (902, "x " * 4000), (None, "no id here")]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, labels, items


def test_run_against_brute_force(spark, tables):
    folder, docs, labels, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {r.doc_id for r in toxicity(frame, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    held = [y for i, _, y in labels if i in bad]
    assert sum(held) / len(held) > 0.9 and sum(held) / sum(y for *_, y in labels) > 0.9
    docs = [(i, t) for i, t in docs if i not in bad]

    gone = {(i, n) for i, n, _, dropped in recurring(docs) if dropped}
    lined = []
    for i, t in docs:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if kept == t or kept.strip() and len(kept) >= 0.2 * len(t):
            lined.append((i, kept))

    copies = {i for i, _, c in near_copies(lined, 5, 80, 100) if c != i}
    single = [(i, t) for i, t in lined if i not in copies]
    clean = [(i, t) for i, t in single if not any(best_run((t or "").lower().split(), x.split(), 12) for x in items)]
    assert len(docs) > len(lined) and len(lined) > len(single) > len(clean) > 50

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean:
        n = len(encode.encode(t or "", add_special_tokens=False).ids) + 1
        want += [(i or -1, s, min(1024, n - s), n) for s in range(0, n, 1024)]
    got = P.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.start, r.length, r.doc_tokens) for r in got) == sorted(want)


def test_stages_keep_columns_and_clean_documents(spark, tables):
    folder = tables[0]
    docs = spark.createDataFrame([(1, "clean words only", "en", "s", 0), (2, None, "en", None, None), (None, "", None, "s", 0)], COLUMNS)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 3
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert P.STAGES[-1][1](spark, docs, folder).count() == 3
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"] and P.ORACLE_SQL is None


def test_null_and_repeated_ids(spark, tables):
    folder, _, _, items = tables
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, items[0]), (5, "clean words only"), (5, items[1]), (6, None), (6, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    assert sorted((r.doc_id or -1, r.text or "") for r in P.drop_contaminated(spark, docs, folder).collect()) == [(-1, ""), (5, "clean words only"), (6, ""), (6, "")]
    rows = [(4, text), (4, text), (None, text), (9, text + " more"), (None, "alone " * 9), (None, "alone " * 9), (4, "another text of id four"), (6, None), (6, None), (None, ""), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = sorted((r.doc_id or -1, r.text or "") for r in P.dedup_documents(spark, docs, folder).collect())
    assert got == sorted([(4, text), (-1, "alone " * 9), (4, "another text of id four"), (6, ""), (-1, ""), (7, "")])
