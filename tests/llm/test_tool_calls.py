import json
import random

import pytest

from quillspark.llm import tool_calls
from quillspark.llm.tool_calls import link_tool_calls

SCHEMAS = {"add": {"a": {"type": "integer", "required": True, "minimum": 0}, "b": {"type": "number"}}, "say": {"text": {"type": "string", "required": True, "max_length": 5, "enum": ["hi", "hello!"]}}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, call_id string, content string, errors string"


def link(spark, calls, results):
    c = spark.createDataFrame([(*x, "clash") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, "clash") for x in results], RESULTS)
    return {(x.conv_id, x.call_id): x for x in link_tool_calls(c, r, SCHEMAS).collect()}


def test_links_and_errors(spark):
    got = link(
        spark,
        [
            (1, "a", 0, "add", '{"b": 1.5, "a": 2}', []), (1, "b", 1, "add", '{"a": -1}', ["a", "gone"]), (1, "c", 2, "say", '{"text": "hello!", "x": 1}', None),
            (1, "d", 3, "nope", "{}", ["a"]), (1, "e", 4, "add", "[1]", []), (1, "f", 5, "add", None, []), (1, "g", 6, "say", '{"text": 5}', []),
            (1, "h", 7, "say", '{"text": "hi"}', []), (1, "h", 7, "say", '{"text": "hi"}', []), (1, "i", 8, "say", '{"text":"hi"}', ["a"]), (None, "z", 1, "add", "{}", []), (1, "q", 9, "say", "{}", []),
        ],
        [(1, "a", 'x"\n\t'), (1, "h", "2"), (1, "h", "1"), (1, "o", "?"), (2, "a", None), (1, None, "n")],
    )
    errors = {k[1]: x.errors for k, x in got.items() if k[0] == 1}
    assert errors == {
        "a": [], "b": ["a: beyond the minimum", "depends on missing gone"], "c": ["text: longer than 5", "x: unexpected"], "d": ["unknown tool"], "e": ["arguments are no object"],
        "f": ["arguments are no object"], "g": ["text: not of type string"], "h": [], "i": [], "o": [], "q": ["text: missing"],
    }
    assert {k: x.status for k, x in got.items() if not x.errors} == {(1, "a"): "ok", (1, "h"): "repeated", (1, "i"): "unanswered", (1, "o"): "orphan", (2, "a"): "orphan"}
    record = got[1, "a"].record
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(record) == {"arguments": {"a": 2, "b": 1.5}, "call_id": "a", "depends_on": [], "name": "add", "result": 'x"\n\t', "status": "ok"}
    assert json.loads(got[2, "a"].record)["result"] is None and got[1, "h"].n_results == 2


def plain_order(position, parents):
    """(step, lift) by looking at a call's parents one after the other; None on or behind a cycle."""
    known, open_ = {}, set()

    def place(n):
        if n not in known:
            if n in open_:
                return None
            open_.add(n)
            places = [place(p) for p in parents[n]]
            open_.discard(n)
            if any(p is None for p in places):
                return None  # not kept: another way in may come first
            top = max(places, default=(-1, 0))
            known[n] = (top[0], top[1] + 1) if top[0] >= position[n] else (position[n], 0)
        return known[n]

    return {n: place(n) for n in parents}


@pytest.mark.parametrize("at_once", [0, 256])
def test_order(spark, monkeypatch, at_once):
    monkeypatch.setattr(tool_calls, "AT_ONCE", at_once)
    r = random.Random(3)
    calls, want = [], {}
    for conv in range(24):
        names = [f"n{i}" for i in range(12)]
        rank = names[:]
        r.shuffle(rank)  # an order that can be kept; positions are another one
        position, parents = {n: i // 2 for i, n in enumerate(names)}, {}
        for n in names:
            before = rank[: rank.index(n)]
            parents[n] = r.sample(before, min(len(before), r.randint(0, 2)))
        if conv % 4 == 0:
            parents[rank[3]] = [*parents[rank[3]], rank[5]]
            parents[rank[5]] = [*parents[rank[5]], rank[3]]
        calls += [(conv, n, position[n], "add", '{"a":1}', parents[n]) for n in names]
        want |= {(conv, n): at for n, at in plain_order(position, parents).items()}
    calls += [(50, "x", 0, "add", '{"a":1}', ["y"]), (50, "y", 1, "add", '{"a":1}', ["x"]), (50, "z", 2, "add", '{"a":1}', ["y"]), (50, "w", 3, "add", '{"a":1}', []), (51, "s", 0, "add", '{"a":1}', ["s"]), (52, "null", None, "add", '{"a":1}', None)]
    # twenty calls, each of which depends on the next
    calls += [(60, f"c{i}", i, "add", '{"a":1}', [f"c{i + 1}"] if i < 19 else []) for i in range(20)]
    want |= {(50, "x"): None, (50, "y"): None, (50, "z"): None, (50, "w"): (3, 0), (51, "s"): None, (52, "null"): (0, 0)} | {(60, f"c{i}"): (19, 19 - i) for i in range(20)}
    got = link(spark, calls, [])
    assert {k: None if x.step is None else (x.step, x.lift) for k, x in got.items()} == want and None in want.values()
    for conv, n, _, _, _, parents in calls:
        assert (got[conv, n].errors == ["dependency cycle"]) == (want[conv, n] is None)
        for p in parents or []:
            if want[conv, n]:
                assert want[conv, p] < want[conv, n]


def test_nested_arguments_and_long_texts(spark, monkeypatch):
    monkeypatch.setitem(SCHEMAS, "put", {"at": {"type": "object", "required": True, "properties": {"x": {"type": "integer", "required": True, "maximum": 9}, "to": {"type": "object", "properties": {"y": {"type": "string"}}}}}})
    long = "word " * 200000
    got = link(spark, [(1, "a", 0, "put", '{"at": {"x": 3, "to": {"y": "s"}}}', []), (1, "b", 1, "put", '{"at": {"x": 10, "to": {"y": 1, "z": 2}, "w": 0}}', []), (1, "c", 2, "put", '{"at": {}}', []), (1, "d", 3, "put", '{"at": 4}', []), (1, "e", 4, "say", json.dumps({"text": long}), [])], [(1, "a", long)])
    assert {k[1]: x.errors for k, x in got.items()} == {
        "a": [], "b": ["at.to.y: not of type string", "at.to: unexpected z", "at.x: beyond the maximum", "at: unexpected w"], "c": ["at.x: missing"], "d": ["at: not of type object"], "e": ["text: longer than 5", "text: not among the values"],
    }
    assert json.loads(got[1, "a"].record)["result"] == long


def test_empty(spark):
    assert link(spark, [], []) == {}
