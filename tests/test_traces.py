"""Samples of value change dumps against a plain scan of the whole file."""

import random
import re

import pytest

from quarrystone.sources import traces as X


def plain(text, names, clock, edge):
    """The samples of one dump, line by line: (time, values), or the error."""
    scope, best = 0, {}
    for line in text.splitlines():
        w = line.split()
        if line.startswith("$scope"):
            scope += 1
        elif line.startswith("$upscope"):
            scope -= 1
        elif line.startswith("$var"):
            if w[4] in names and (w[4] not in best or best[w[4]][0] > scope):
                best[w[4]] = scope, w[3]
    if set(best) != set(names):
        return "not declared: " + ", ".join(sorted(set(names) - set(best)))
    state, shots, time = {}, [], None
    for line in [*text.splitlines(), "#0"]:
        line = line.strip()
        if line.startswith("#"):
            if time is not None and len(state) == len(names):
                shots.append((time, dict(state)))
            time = int(line[1:])
        elif time is not None and line and line[0] in "01xzXZb":
            value, code = (line[0], line[1:]) if line[0] != "b" else line[1:].split()
            for n, (_, c) in best.items():
                if c == code:
                    state[n] = value.lower()
    if not shots:
        return "no complete sample"
    if clock is None:
        return shots[-1:]
    start, then = ("0", "1") if edge == "posedge" else ("1", "0")
    levels = [s.get(clock, "0")[-1] for _, s in shots]
    hit = [s for s, a, b in zip(shots, [start, *levels], levels) if a == start and b == then]
    return hit or shots


def dump(rng, declare=True, clocked=True):
    out = ["$date today $end", "$scope module top $end"]
    inner = ["$scope module uut $end", "$var wire 1 i clk $end", "$var wire 4 j d [3:0] $end", "$upscope $end"]
    own = ["$var wire 1 ! clk $end", "$var wire 4 \" d [3:0] $end", "$var real 8 r x $end"] if declare else ["$var wire 1 ! clk $end"]
    out += [*inner, *own] if rng.random() < 0.5 else [*own, *inner]
    if not declare:
        out = [x for x in out if " d [" not in x]
    out += ["$upscope $end", "$enddefinitions $end"]
    if rng.random() < 0.5:
        out += ["$dumpvars", "x!", "$end"]
    for t in range(rng.randint(0, 60)):
        out.append(f"#{t * 5}")
        for _ in range(rng.randint(0, 3)):
            out.append(rng.choice([f"{rng.choice('01xZ') if clocked else '1'}!", f"b{rng.choice(['0', '1X0z', '1010'])} \"", "1i", "b11 j", "r1.5 r", "", "$comment", "0k"]))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("clock,edge,size", [(None, "posedge", "128m"), ("clk", "posedge", "128m"), ("clk", "negedge", "200"), ("clk", "posedge", "200"), ("other", "posedge", "300"), (None, "posedge", "200")])
def test_samples_equal_a_plain_scan(spark, tmp_path, clock, edge, size):
    """Whole files and files split every few marks; signals of one name in two scopes; dumps without a signal, a sample or an edge."""
    rng = random.Random(5)
    texts = [dump(rng, i % 9 != 0, i % 7 != 0) for i in range(40)] + ["", "#0\n1!\n"]
    for i, t in enumerate(texts):
        (tmp_path / f"d{i}.vcd").write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = X.read_dump_records(spark, str(tmp_path))
        if size == "200":
            assert records.select("file", "split").distinct().count() > 60
        got = {}
        for r in X.dump_samples(records, ["clk", "d"], clock, edge).collect():
            got.setdefault(int(re.search(r"d(\d+)\.vcd", r["file"])[1]), []).append(r)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for i, t in enumerate(texts[:-2]):
        want = plain(t, ["clk", "d"], clock, edge)
        rows = sorted(got[i], key=lambda r: r["sample"] or 0)
        if isinstance(want, str):
            assert [r["error"] for r in rows] == [want]
        else:
            assert [(r["time"], r["values"]) for r in rows] == want and [r["sample"] for r in rows] == list(range(len(want)))
    assert 40 not in got and got[41][0]["error"].startswith("not declared")
