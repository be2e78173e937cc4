"""Documents compared leaf by leaf."""

import json

from quarrystone.operators import documents as D


def frame(spark, docs):
    return spark.createDataFrame([(k, t if t is None or isinstance(t, str) else json.dumps(t)) for k, t in docs], "doc string, json string")


def flat(value, path=""):
    """Leaves by walking the parsed document."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flat(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flat(v, f"{path}/{i}")]
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    return [(path, kind)]


DEEP = {"a": [1, 2.5, {"b": [[], {}, [[["x"]]]], "c/d~e": None}], "t": "[{\"not\": [json", "n": True, "": {"": ""}, "big": 12345678901234567890}


def test_leaves_equal_a_walk(spark):
    docs = [("1", DEEP), ("2", []), ("3", {}), ("4", "7"), ("5", '"text"'), ("6", "null"), ("7", "no json"), ("8", None), ("9", [[[[[[1]]]]]])]
    got = {}
    for r in D.leaves(frame(spark, docs), "doc", "json").collect():
        got.setdefault(r["doc"], []).append((r["path"], r["type"]))
    for key, doc in docs:
        want = [("", "invalid")] if key in "78" else flat(json.loads(doc) if isinstance(doc, str) else doc)
        assert sorted(got[key]) == sorted(want)


def test_statuses_and_tolerances(spark):
    a = {"same": 1, "close": 10.0, "far": 10.0, "rel": 1000.0, "text": "x", "type": "1", "gone": [1, 2], "nul": None, "list": [1, 2, 3], "skip": {"me": 1}}
    b = {"same": 1.0, "close": 10.04, "far": 10.2, "rel": 1009.0, "text": "y", "type": 1, "nul": None, "list": [1, 2, 3, 4], "more": {"k": "v"}, "skip": {"me": 2}}
    got = D.compared(frame(spark, [("d", a), ("only a", 1)]), frame(spark, [("d", b), ("only b", 2)]), "doc", "json", [("^/close$|^/far$", 0.05, 0), ("^/rel", 0, 0.01)], ["^/skip"]).collect()
    assert {(r["doc"], r["path"]): r["status"] for r in got} == {
        ("d", "/same"): "equal", ("d", "/close"): "within", ("d", "/far"): "changed", ("d", "/rel"): "within", ("d", "/text"): "changed", ("d", "/type"): "type", ("d", "/gone/0"): "missing", ("d", "/gone/1"): "missing", ("d", "/nul"): "equal",
        ("d", "/list/0"): "equal", ("d", "/list/1"): "equal", ("d", "/list/2"): "equal", ("d", "/list/3"): "extra", ("d", "/more/k"): "extra", ("only a", ""): "missing", ("only b", ""): "extra",
    }


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert D.leaves(empty, "doc", "json").count() == 0 and D.compared(empty, empty, "doc", "json").count() == 0
