"""Names replaced in one pass against a plain scan."""

import random
import re

import pytest

from quarrystone.operators import names as N


def plain(text, pairs):
    """Leftmost-longest with a pattern of all names, longest first."""
    table = {}
    for a, b in sorted(pairs, reverse=True):
        table[a] = b
    pattern = "|".join((r"(?<!\w)" if re.match(r"\w", a) else "") + re.escape(a) + (r"(?!\w)" if re.search(r"\w$", a) else "") for a in sorted(table, key=len, reverse=True))
    n = 0

    def put(m):
        nonlocal n
        n += 1
        return table[m[0]]

    return re.sub(pattern, put, text), n


@pytest.mark.parametrize("most", [32_000_000, 10])
def test_equals_a_plain_scan(spark, monkeypatch, most):
    monkeypatch.setattr(N, "AUTOMATON", most)
    rng = random.Random(6)
    words = ["top", "top_level", "u1", "alu", "al", "é", "x"]
    pairs = [("top", "A"), ("top_level", "B"), ("top level", "C"), ("u1.alu", "D"), ("alu", "E"), ("-x", "F"), ("x-", "G"), ("é", "H"), ("top", "Z"), ("level alu", "I")]
    rows = [(i, "".join(rng.choice([*words, "level", " ", " ", ".", "-", "_"]) for _ in range(rng.randint(0, 14)))) for i in range(500)] + [(500, None), (501, ""), (502, "top"), (502, "top")]
    texts = spark.createDataFrame(rows, "i int, t string")
    got = N.replace_names(texts, "t", spark.createDataFrame(pairs, "old string, new string")).collect()
    want = [(i, t, *((None, None) if t is None else plain(t, pairs))) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_hundred_thousand_names_in_one_pass(spark):
    names = spark.range(100_000).selectExpr("concat('name_', id) as old", "concat('[', id, ']') as new")
    texts = spark.range(200).selectExpr("id", "concat('name_', id, ' and name_', id * 7, '0 or name_x') as t")
    got = {r["id"]: r["replaced"] for r in N.replace_names(texts, "t", names).collect()}
    assert got[3] == "[3] and [210] or name_x" and got[0] == "[0] and name_00 or name_x" and len(got) == 200


def test_names_without_words_and_no_names(spark):
    texts = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(ValueError):
        N.replace_names(texts, "t", spark.createDataFrame([("--", "x")], "old string, new string"))
    assert N.replace_names(texts, "t", spark.createDataFrame([], "old string, new string")).first()["replaced"] == "a"
