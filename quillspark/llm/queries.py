"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collision_ann import nearest
from .common import table
from .decontaminate import decontaminate
from .html_density import main_text
from .lm_scoring import cross_entropy_difference
from .ngram_join import ngram_join
from .packing import pack
from .template_tree import recurring_lines
from .tool_calls import link_tool_calls
from .toxicity import toxicity
from .url_filter import url_verdicts

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
REPLY_SCHEMA = {"reply": {"text": {"type": "string", "required": True, "min_length": 1, "max_length": 2000}}}


def tokenizer() -> tuple[str, str]:
    """The vocabulary file and the pattern that cuts texts before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, the target being those labelled of good quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns: a user's turn asks the tool "reply", the assistant's next turn is its result.

    Every fourth request, from the first on, depends on the request after it, if there is one: a link that points forward.
    The request after it depends on the last but one, all others depend on the one before them.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    users = turns.where("role = 'user'")
    near = users.select("conv_id", F.col("turn").alias("other"), F.explode(F.expr("array(turn - 2, turn + 2, turn + 4)")).alias("turn")).groupBy("conv_id", "turn").agg(F.collect_set("other").alias("others"))
    has = lambda turn: F.coalesce(F.array_contains("others", turn), F.lit(False))
    turn, kind = F.col("turn"), F.floor(F.col("turn") / 2) % 4
    before = F.when(kind == 1, turn - 4).otherwise(turn - 2)
    depends = F.when((kind == 0) & has(turn + 2), F.array(name(turn + 2))).when(has(before), F.array(name(before))).otherwise(F.array().cast("array<string>"))
    calls = users.join(near, ["conv_id", "turn"], "left").select(
        "conv_id", name(turn).alias("call_id"), turn.alias("position"), F.lit("reply").alias("name"), F.to_json(F.struct("text")).alias("arguments"), depends.alias("depends_on")
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    linked = link_tool_calls(calls, results, REPLY_SCHEMA)
    return linked.select("conv_id", "call_id", "n_calls", "n_results", "step", "lift", F.array_join("errors", "; ").alias("errors"), "status", "record")


OP2_SQL = """
WITH u AS (SELECT conv_id, turn, min(to_json(text)::VARCHAR) AS q, count(*) AS n_calls,
                  min(CASE WHEN text IS NULL THEN 'text: missing' WHEN length(text) < 1 THEN 'text: shorter than 1' WHEN length(text) > 2000 THEN 'text: longer than 2000' ELSE '' END) AS errors
           FROM conversations WHERE role = 'user' GROUP BY ALL),
     a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
     d AS (SELECT u.*, n.turn IS NOT NULL AND u.turn // 2 % 4 = 0 AS forward, CASE WHEN forward THEN n.turn ELSE b.turn END AS needs
           FROM u LEFT JOIN u AS n ON n.conv_id = u.conv_id AND n.turn = u.turn + 2
                  LEFT JOIN u AS b ON b.conv_id = u.conv_id AND b.turn = u.turn - CASE WHEN u.turn // 2 % 4 = 1 THEN 4 ELSE 2 END),
     j AS (SELECT coalesce(d.conv_id, a.conv_id) AS conv_id, coalesce(d.turn, a.turn) AS turn, CASE WHEN forward THEN needs ELSE d.turn END AS step, forward::INT AS lift, needs,
                  q, n_calls, n_results, content, coalesce(errors, '') AS errors
           FROM d FULL JOIN a ON d.conv_id = a.conv_id AND d.turn = a.turn),
     s AS (SELECT *, conv_id || ':' || turn AS call_id,
                  CASE WHEN errors <> '' THEN 'invalid' WHEN n_calls IS NULL THEN 'orphan' WHEN n_calls > 1 OR n_results > 1 THEN 'repeated'
                       WHEN n_results IS NULL THEN 'unanswered' ELSE 'ok' END AS status FROM j)
SELECT conv_id, call_id, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, step, lift, errors, status,
       '{"arguments":' || CASE WHEN step IS NULL THEN 'null' ELSE '{"text":' || q || '}' END || ',"call_id":"' || call_id || '","depends_on":['
       || CASE WHEN needs IS NOT NULL THEN '"' || conv_id || ':' || needs || '"' ELSE '' END || '],"name":' || CASE WHEN step IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || CASE WHEN n_results IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END || ',"status":"' || status || '"}' AS record
FROM s
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     q AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
     rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     m AS (SELECT r, page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC NULLS LAST) AS k
           FROM q LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *tokenizer())


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_lines(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_tool_calls, op3_ngram_join, op4_decontaminate, op5_html_text, op6_url_filter, op7_toxicity, op8_packing, op9_line_templates, op10_nearest, pipeline)
}
SQL: dict[str, str] = {"op2_tool_calls": OP2_SQL, "op6_url_filter": OP6_SQL}
