"""Tool-call linking with DataFrame functions only.

Calls and results are hash-joined by identifier; calls get a topological order by their dependencies, arguments are checked
against the tools' schemas, and each linked call is written as canonical JSON (sorted keys, no white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KEY = ["conv_id", "call_id"]
#: Calls of a conversation that is ordered in one row, and rounds of one job for larger ones.
AT_ONCE, ROUNDS = 256, 4
#: JSON Schema's type names and how a variant's type is spelt.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID"}


def _checks(value: Column, arguments: dict[str, dict], path: str, label: str) -> list[Column]:
    """Messages, or nulls, for the members of one object; objects with properties of their own are looked into."""
    checks = []
    for name, spec in sorted(arguments.items()):
        quoted, shown = path + "['" + name.replace("'", "\\'") + "']", label + name
        part = F.try_variant_get(value, quoted, "variant")
        text = F.try_variant_get(value, quoted, "string")
        missing = part.isNull()
        wrong = ~missing & ~F.schema_of_variant(part).rlike(f"^{TYPES[spec['type']]}$")
        if spec.get("required"):
            checks.append(F.when(missing, F.lit(f"{shown}: missing")))
        checks.append(F.when(wrong, F.lit(f"{shown}: not of type {spec['type']}")))
        fine = ~missing & ~wrong
        if "min_length" in spec:
            checks.append(F.when(fine & (F.length(text) < spec["min_length"]), F.lit(f"{shown}: shorter than {spec['min_length']}")))
        if "max_length" in spec:
            checks.append(F.when(fine & (F.length(text) > spec["max_length"]), F.lit(f"{shown}: longer than {spec['max_length']}")))
        if "enum" in spec:
            checks.append(F.when(fine & ~text.isin(*spec["enum"]), F.lit(f"{shown}: not among the values")))
        for bound, bad in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y)):
            if bound in spec:
                checks.append(F.when(fine & bad(F.try_variant_get(value, quoted, "double"), spec[bound]), F.lit(f"{shown}: beyond the {bound}")))
        if "properties" in spec:
            checks += [F.when(fine, c) for c in _checks(value, spec["properties"], quoted, f"{shown}.")]
            inner = F.json_object_keys(F.to_json(part))
            more = F.array_sort(F.array_except(inner, F.lit(sorted(spec["properties"])).cast("array<string>")))
            checks.append(F.when(fine & (F.size(more) > 0), F.concat(F.lit(f"{shown}: unexpected "), F.array_join(more, ", "))))
    return checks


def argument_errors(schemas: dict[str, dict[str, dict]]) -> Column:
    """An array of what is wrong with the column ``arguments`` (JSON text) under the schema of the tool in ``name``.

    A schema maps an argument's name to type, and optionally required, min_length, max_length, enum, minimum and maximum, and
    for an object properties, a schema of its own.
    """
    value = F.try_parse_json(F.col("arguments"))
    no_object = value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT")
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for tool, arguments in sorted(schemas.items()):
        checks = _checks(value, arguments, "$", "")
        known = F.lit(sorted(arguments)).cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys("arguments"), known)), lambda k: F.concat(k, F.lit(": unexpected")))
        found = found.when(F.col("name") == tool, F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), F.coalesce(extra, F.array().cast("array<string>"))))
    return F.when(F.col("name").isNull() | ~F.col("name").isin(*schemas), F.array(F.lit("unknown tool"))).when(no_object, F.array(F.lit("arguments are no object"))).otherwise(found)


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _quoted(value: Column) -> Column:
    """A JSON string, or null."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _at_once(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orders whole conversations of bounded size, each in one row: in every step the calls that wait for none get their place."""
    wants = edges.groupBy(*KEY).agg(F.collect_list("parent").alias("parents"))
    rows = nodes.join(wants, KEY, "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "call_id", "parents"))).alias("calls"))
    ids = F.transform("calls", lambda c: c["call_id"])
    places = F.transform("calls", lambda c: F.transform(F.coalesce(c["parents"], F.array().cast("array<string>")), lambda p: (F.array_position("ids", p) - 1).cast("int")))
    # written, so that places are looked up once and not for every call and step
    rows = saved(saved(rows.withColumn("ids", ids)).withColumn("places", places))

    def place(state: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.transform(F.get("places", i), lambda p: F.get(state, p))
            top = F.array_max(F.transform(before, lambda p: F.struct(p["step"].alias("step"), p["lift"].alias("lift"))))
            behind = top["step"] >= x["step"]
            put = F.struct(F.lit(True).alias("done"), F.when(behind, top["step"]).otherwise(x["step"]).alias("step"), F.when(behind, top["lift"] + 1).otherwise(0).alias("lift"))
            return F.when(x["done"] | ~F.forall(before, lambda p: p["done"]), x).otherwise(put)

        return F.transform(state, one)

    start = F.transform("calls", lambda c: F.struct(F.lit(False).alias("done"), c["position"].alias("step"), F.lit(0).alias("lift")))
    placed = F.aggregate(F.sequence(F.lit(1), F.size("calls")), start, lambda state, _: place(state))
    out = rows.select("conv_id", F.explode(F.arrays_zip(F.col("ids").alias("id"), placed.alias("at"))).alias("x"))
    return out.select("conv_id", F.col("x.id").alias("call_id"), F.when(F.col("x.at.done"), F.col("x.at.step")).alias("step"), F.col("x.at.lift").alias("lift"))


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orders conversations of any size: a round lifts every call over what it depends on, ROUNDS of them in one job."""
    size = nodes.groupBy("conv_id").agg(F.count("*").alias("calls"))
    state = saved(nodes.join(size, "conv_id").select(*KEY, "calls", F.col("position").alias("step"), F.lit(0).alias("lift"), F.lit(True).alias("moved")))
    edges = saved(edges)
    while not state.where("moved").isEmpty():
        for _ in range(ROUNDS):
            parents = state.select("conv_id", F.col("call_id").alias("parent"), "step", "lift")
            raised = edges.join(parents, ["conv_id", "parent"]).groupBy(*KEY).agg(F.max(F.struct("step", "lift")).alias("at"), F.bool_or(F.col("step").isNull()).alias("lost"))
            up = F.coalesce((F.col("at.step") > F.col("step")) | (F.col("at.step") == F.col("step")) & (F.col("at.lift") >= F.col("lift")), F.lit(False))
            fails = F.col("step").isNotNull() & (F.coalesce("lost", F.lit(False)) | up & (F.col("at.lift") >= F.col("calls")))
            state = state.join(raised, KEY, "left").select(
                *KEY, "calls", F.when(fails, F.lit(None)).when(up, F.col("at.step")).otherwise(F.col("step")).alias("step"), F.when(up, F.col("at.lift") + 1).otherwise(F.col("lift")).alias("lift"), (fails | up).alias("moved")
            )
        state = saved(state)
    return state.select(*KEY, "step", "lift")


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (conv_id, call_id, position) with step and lift: ordered by them, every call comes after what it depends on.

    edges are (conv_id, call_id, position, parent, parent_position) between nodes. A call keeps its own position with a lift of
    0 unless something it depends on stands at or after it; then it takes that one's step and one lift more. Calls on or
    behind a cycle get a null step and no certain lift. Only conversations with an edge that points forward are looked at; those of at
    most AT_ONCE calls and four times as many edges are ordered in a single job, the others in rounds, to the same end.
    """
    forward = saved(edges.where("parent_position >= position").select("conv_id").distinct())
    still = nodes.join(forward, "conv_id", "left_anti").select(*KEY, F.col("position").alias("step"), F.lit(0).alias("lift"))
    nodes, edges = saved(nodes.join(forward, "conv_id", "left_semi")), saved(edges.join(forward, "conv_id", "left_semi").select(*KEY, "parent"))
    some = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    large = saved(some(nodes, "n").join(some(edges, "m"), "conv_id").where((F.col("n") > AT_ONCE) | (F.col("m") > 4 * AT_ONCE)).select("conv_id"))
    small = _at_once(nodes.join(large, "conv_id", "left_anti"), edges.join(large, "conv_id", "left_anti"))
    if large.isEmpty():
        return still.union(small)
    return still.union(small).union(_by_rounds(nodes.join(large, "conv_id", "left_semi"), edges.join(large, "conv_id", "left_semi")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """Links calls (conv_id, call_id, position, name, arguments, depends_on array) with results (conv_id, call_id, content).

    Returns one row for each distinct conv_id and call_id of either side: n_calls, n_results, step and lift (topological
    order, see topological; null on a cycle), errors (array), status and record (canonical JSON). Of several calls or results
    with one identifier the first by position and content is taken and the status is "repeated"; a call without result is
    "unanswered", a result without call "orphan" (with no step), a wrong or cyclic call "invalid", all else "ok", in the order
    invalid, orphan, repeated, unanswered. A null position counts as 0. Null identifiers link with nothing and are left out. Names missing from
    depends_on's calls are reported as errors. Other columns aren't read; empty tables give an empty result.
    """
    one = (
        calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
        .groupBy(*KEY)
        .agg(F.count("*").alias("n_calls"), F.min(F.struct("position", "name", "arguments", "depends_on")).alias("c"))
        .select(*KEY, "n_calls", F.lit(True).alias("called"), F.coalesce("c.position", F.lit(0)).alias("position"), "c.name", "c.arguments", "c.depends_on")
    )
    one = saved(one)
    answered = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*KEY).agg(F.count("*").alias("n_results"), F.min("content").alias("content"))
    wants = one.select(*KEY, "position", F.explode(F.array_distinct("depends_on")).alias("parent")).where("parent IS NOT NULL")
    there = one.select("conv_id", F.col("call_id").alias("parent"), F.col("position").alias("parent_position"), F.lit(True).alias("there"))
    edges = saved(wants.join(there, ["conv_id", "parent"], "left"))
    lost = edges.where("there IS NULL").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.concat(F.lit("depends on missing "), "parent"))).alias("lost"))
    order = topological(one.select(*KEY, "position"), edges.where("there"))
    linked = one.join(answered.hint("shuffle_hash"), KEY, "full_outer").join(order, KEY, "left").join(lost, KEY, "left")
    none = F.array().cast("array<string>")
    wrong = F.when(
        F.col("n_calls").isNotNull(),
        F.concat(argument_errors(schemas), F.coalesce("lost", none), F.when(F.col("step").isNull() & F.col("called"), F.array(F.lit("dependency cycle"))).otherwise(none)),
    ).otherwise(none)
    status = (
        F.when(F.size("errors") > 0, "invalid")
        .when(F.col("n_calls").isNull(), "orphan")
        .when((F.col("n_calls") > 1) | (F.col("n_results") > 1), "repeated")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("ok")
    )
    strings = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(c, none), _quoted), ","), F.lit("]"))
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        F.lit(',"call_id":'), _quoted(F.col("call_id")),
        F.lit(',"depends_on":'), strings(F.array_sort(F.array_distinct(F.coalesce("depends_on", none)))),
        F.lit(',"name":'), _quoted(F.col("name")),
        F.lit(',"result":'), _quoted(F.col("content")),
        F.lit(',"status":'), _quoted(F.col("status")), F.lit("}"),
    )
    return (
        linked.withColumn("errors", wrong)
        .withColumn("status", status)
        .select(*KEY, F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "step", F.when(F.col("step").isNotNull(), F.col("lift")).alias("lift"), "errors", "status", record.alias("record"))
    )
