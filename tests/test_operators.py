import os

import pytest

from quillspark.functions import text as T
from quillspark.markup.convert import Options
from quillspark.operators import documents as D
from quillspark.operators import lookups as L
from quillspark.operators import relational as R
from quillspark.plans import QUERIES, SQL
from quillspark.sources.files import from_texts, read_files, write_outputs
from quillspark.streaming import documents as stream

SF = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted(tuple("NULL" if x is None or x != x else str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got[columns].astype(object).itertuples(index=False)) == _rows(want[columns].astype(object).itertuples(index=False))


def test_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "a.md", b"x"), (2, "a.zip", b"PK\3\4"), (3, "b.docx", b"PK\3\4"), (4, "c.md", None), (5, None, b"y")], "id int, path string, content binary")
    got = {r.id: (r.output, r.error) for r in D.converted(df, Options(to="plain"), ["id"], path_column="path").collect()}
    assert got[1] == ("x\n", None) and got[4] == (None, None) and got[5] == ("y\n", None)
    assert got[2][0] is None and "zip container" in got[2][1] and got[3][1] == "not a zip archive (too small)"
    assert D.zip_members(df.where("id = 1"), ["id"]).first().error == "not a zip archive (too small)"
    assert D.converted(df.limit(0), Options(), ["id"]).collect() == []


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "# A"), ("b.rtf", r"{\rtf1 b}"), ("c.fodt", "<office:text><text:p>c</text:p></office:text>")):
        (tmp_path / "in" / name).write_text(text)
    docs = read_files(spark, str(tmp_path / "in"))
    assert sorted(r.format for r in docs.select("format").collect()) == ["markdown", "odt", "rtf"]
    out = D.converted(docs, Options(to="plain"), ["path"], path_column="path")
    assert sorted(r.output for r in out.collect()) == ["A\n═\n", "b\n", "c\n"]
    write_outputs(out, str(tmp_path / "text"))
    operator = lambda df: D.converted(df, Options(to="html"), ["path"], path_column="path")
    stream.run(stream.file_stream(spark, str(tmp_path / "in")), operator, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["<h1>A</h1>\n", "<p>b</p>\n", "<p>c</p>\n"]


def test_line_functions(spark):
    rows = [("# a #",), ("####### b",), ("  ## c",), ("- x",), ("```",), ("* * *",), (" > q",), ("",), ("    code",), ("$$ x",), ("plain",)]
    df = spark.createDataFrame(rows, "line string")
    got = [(r.k, r.n, r.t) for r in df.select(T.line_kind(df.line).alias("k"), T.heading_level(df.line).alias("n"), T.heading_text(df.line).alias("t")).collect()]
    assert [k for k, _, _ in got] == ["heading", "text", "heading", "item", "fence", "rule", "quote", "blank", "indented", "math", "text"]
    assert got[0][1:] == (1, "a") and got[2][1:] == (2, "c") and got[1][1] is None


def test_relational(spark):
    docs = spark.createDataFrame([(1, "a\r\n\tb\n\nc\n"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.pos, r.line) for r in R.lines(docs).collect()] == [(1, 0, "a"), (1, 1, "    b"), (1, 2, ""), (1, 3, "c")]
    assert [(r.doc_id, r.first, r.n_lines, r.text) for r in R.paragraphs(docs).collect()] == [(1, 0, 1, "a"), (1, 3, 1, "c")]
    parts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, o int, text string")
    assert sorted((r.k, r.n_parts, r.text) for r in R.combined(parts, "k", "o").collect()) == [(1, 2, "a\n\nb"), (2, 0, "")]
    assert [bytes(r.content) for r in from_texts(parts.where("o = 2"), "text").collect()] == [b"b"]


def test_lookups(spark):
    levels = spark.createDataFrame([("heading 2",), (" Heading6 x",), ("heading 9",), ("Title page",), ("subtitle",), ("body",), (None,)], "name string")
    assert [r.n for r in levels.select(L.named_level(levels.name).alias("n")).collect()] == [2, 6, 1, 1, 2, None, None]
    texts = spark.createDataFrame([(1, "*a_"), (2, ""), (3, None)], "doc_id int, text string")
    assert sorted((r.doc_id, r.pos, r.char, r.before, r.behind) for r in L.character_contexts(texts).collect()) == [(1, 0, "*", None, "a"), (1, 2, "_", "a", None)]
    fields = spark.createDataFrame([(1, "k", 0, "a"), (1, "k", 1, None), (2, "k", 0, None)], "doc_id int, key string, pos int, value string")
    assert sorted((r.doc_id, r.value) for r in L.last_values(fields).collect()) == [(1, "a"), (2, None)]
    numbers = spark.createDataFrame([("12",), ("1x",), ("",), (None,), ("9" * 30,)], "s string")
    assert [r.n for r in numbers.select(L.whole_number(numbers.s, 7).alias("n")).collect()] == [12, 7, 7, 7, 7]
    deep = spark.createDataFrame([(1, i, i) for i in range(14)], "doc_id int, pos int, depth int")
    assert [r.parent_pos for r in R.item_numbers(deep).orderBy("pos").collect()] == [None, *range(13)]
    with_meta = D.converted(spark.createDataFrame([(1, "---\ntitle: T\n---\nx"), (2, None)], "id int, content string"), Options(from_="md", to="html"), ["id"], meta=True)
    assert sorted((r.id, r.title, r.output) for r in with_meta.collect()) == [(1, "T", "<p>x</p>\n"), (2, None, None)]
