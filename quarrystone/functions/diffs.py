"""Unified diffs: making, strict applying, and the lines that they change."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class DiffError(ValueError):
    pass


def _lines(text: str) -> list[str]:
    return re.sub(r"\r\n?", "\n", text).split("\n")[: -1 if text.endswith(("\n", "\r")) else None] if text else []


def _meeting(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """A run (start in a, start in b, length) in the middle of a shortest edit of a into b: furthest paths from both ends until they overlap."""
    n, m = len(a), len(b)
    odd = (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for front in (True, False):
            own, other = (ahead, back) if front else (back, ahead)
            for k in range(-d, d + 1, 2):
                x = own[k + 1] if k == -d or (k != d and own.get(k - 1, -1) < own.get(k + 1, -1)) else own[k - 1] + 1
                y, begin = x - k, x
                if front:
                    while x < n and 0 <= y < m and a[x] == b[y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and 0 <= y < m and a[n - 1 - x] == b[m - 1 - y]:
                        x, y = x + 1, y + 1
                own[k] = x
                across = n - m - k
                if (odd == 1) == front and abs(across) <= (d - 1 if front else d) and x + other.get(across, -1) >= n:
                    return (begin, begin - k, x - begin) if front else (n - x, m - y, x - begin)
    raise AssertionError("two paths always meet")


def matches(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Places (in old, in new) of a longest common subsequence, in order.

    What both begin and end with is matched first, and lines that the other side does not have are left out, which both change nothing; the rest costs the number of differences times the lines.
    """
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    number: dict[str, int] = {}
    inner = range(head, len(old) - tail), range(head, len(new) - tail)
    right = {new[i] for i in inner[1]}
    a = [(number.setdefault(old[i], len(number)), i) for i in inner[0] if old[i] in right]
    b = [(number[new[i]], i) for i in inner[1] if new[i] in number]
    out = [(i, i) for i in range(head)] + [(len(old) - i, len(new) - i) for i in range(1, tail + 1)]
    todo = [(0, len(a), 0, len(b))]
    codes_a, codes_b = [c for c, _ in a], [c for c, _ in b]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and codes_a[i] == codes_b[k]:
            out.append((a[i][1], b[k][1]))
            i, k = i + 1, k + 1
        while i < j and k < m and codes_a[j - 1] == codes_b[m - 1]:
            j, m = j - 1, m - 1
            out.append((a[j][1], b[m][1]))
        if i < j and k < m:
            x, y, run = _meeting(codes_a[i:j], codes_b[k:m])
            out += [(a[i + x + t][1], b[k + y + t][1]) for t in range(run)]
            todo += [(i, i + x, k, k + y), (i + x + run, j, k + y + run, m)]
    return sorted(out)


def edits(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Stretches (begin, end in old, begin, end in new) that differ."""
    out, i, k = [], 0, 0
    for x, y in [*matches(old, new), (len(old), len(new))]:
        if x > i or y > k:
            out.append((i, x, k, y))
        i, k = x + 1, y + 1
    return out


def make(old: str, new: str, name: str = "design.sv", context: int = 3) -> str:
    a, b = _lines(old), _lines(new)
    groups: list[list[tuple[int, int, int, int]]] = []
    for e in edits(a, b):
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = [f"--- a/{name}", f"+++ b/{name}"] if groups else []
    for g in groups:
        first, last = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        start, stop = g[0][2] - (g[0][0] - first), g[-1][3] + (last - g[-1][1])
        span = lambda at, n: f"{at + (n > 0)}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{span(first, last - first)} +{span(start, stop - start)} @@")
        at = first
        for i, j, k, m in g:
            out += [" " + x for x in a[at:i]] + ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:m]]
            at = j
        out += [" " + x for x in a[at:last]]
    return "\n".join(out) + "\n" if out else ""


def hunks(patch: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """First old and first new line (from 0) and (mark, text) of each hunk's lines; declared lengths are checked."""
    found: list[tuple[int, int, list[tuple[str, str]], int, int]] = []
    for line in _lines(patch):
        if m := _HUNK.match(line):
            found.append((int(m[1]) - 1, int(m[3]) - 1, [], int(m[2] or 1), int(m[4] or 1)))
        elif found and line[:1] in (" ", "+", "-") and line:
            if line.startswith(("--- ", "+++ ")) and len(found[-1][2]) and sum(k != "+" for k, _ in found[-1][2]) >= found[-1][3]:
                raise DiffError("a diff of several files")
            found[-1][2].append((line[0], line[1:]))
    if not found:
        raise DiffError("no hunk")
    for i, (_, _, body, n_old, n_new) in enumerate(found, 1):
        if sum(k != "+" for k, _ in body) != n_old or sum(k != "-" for k, _ in body) != n_new:
            raise DiffError(f"hunk {i}: lengths differ from its header")
    return [(at if n_old else at + 1, to if n_new else to + 1, body) for at, to, body, n_old, n_new in found]


def apply(source: str, patch: str) -> str:
    """The patched text, ending in one newline; any difference of context raises."""
    old, out, pos = _lines(source), [], 0
    for i, (at, _, body) in enumerate(hunks(patch), 1):
        if not pos <= at <= len(old):
            raise DiffError(f"hunk {i} starts at line {at + 1}")
        out += old[pos:at]
        was = [t for k, t in body if k != "+"]
        if old[at : at + len(was)] != was:
            raise DiffError(f"hunk {i} does not fit the source")
        out += [t for k, t in body if k != "-"]
        pos = at + len(was)
    return "\n".join(out + old[pos:]).rstrip("\n") + "\n"


def changed(patch: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Number (from 1) and text of the lines that a diff takes away, of the old text, and puts in, of the new one: one cursor for each side runs through every hunk."""
    gone, put = [], []
    for at, to, body in hunks(patch):
        old, new = at + 1, to + 1
        for mark, text in body:
            if mark == "-":
                gone.append((old, text))
            elif mark == "+":
                put.append((new, text))
            old += mark != "+"
            new += mark != "-"
    return gone, put


def target(source: str, patch: str) -> tuple[int, str, int, str]:
    """The one line of source that a diff replaces and the one that it puts in: number and text of both.  Anything else raises."""
    gone, put = changed(patch)
    if len(gone) != 1:
        raise DiffError(f"{len(gone)} lines are taken away, not one")
    (number, text), lines = gone[0], _lines(source)
    if not 1 <= number <= len(lines):
        raise DiffError(f"line {number} lies outside the source")
    if lines[number - 1] != text:
        raise DiffError(f"line {number} is another one")
    if len(put) != 1:
        raise DiffError(f"{len(put)} lines are put in, not one")
    return number, text, *put[0]


def location(old: str, new: str) -> tuple[int, int] | None:
    """First and last changed line of old (from 1), if one stretch alone was changed or taken away; lines that are only put in change none of old."""
    found = edits(_lines(old), _lines(new))
    return (found[0][0] + 1, found[0][1]) if len(found) == 1 and found[0][1] > found[0][0] else None


def made(old: str | None, new: str | None) -> str | None:
    return None if old is None or new is None else make(old, new)


#: Fixed: rows that are Python texts at a time.  A batch comes as Arrow with thousands of documents, and as texts of Python with their diffs it would be several times as large.
SLICE = 64


def _sliced(fn, kind: str, of: pa.DataType):
    """A UDF of two texts whose result, kind as Arrow's of, is fn of each row, a few rows at a time."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            if not len(a):
                yield pa.array([], of)
            for i in range(0, len(a), SLICE):
                yield pa.array([fn(x, y) for x, y in zip(a.slice(i, SLICE).to_pylist(), b.slice(i, SLICE).to_pylist(), strict=True)], of)

    return run


def make_diff(old: Column | str, new: Column | str) -> Column:
    return _sliced(made, "string", pa.string())(old, new)


def _checked(fn, fields: dict[str, pa.DataType]):
    """A UDF of two texts whose result is the columns of fn, or the error that it raises."""
    of = pa.struct([*fields.items(), ("error", pa.string())])
    kind = ", ".join(f"{k}: {'int' if t == pa.int32() else 'string'}" for k, t in [*fields.items(), ("error", pa.string())])

    def one(x: str | None, y: str | None) -> dict:
        try:
            return {**dict(zip(fields, fn(x, y), strict=True)), "error": None}
        except DiffError as e:
            return {**dict.fromkeys(fields), "error": str(e)}

    return _sliced(one, f"struct<{kind}>", of)


_TEXT = {"text": pa.string()}
_TARGET = {"old_line": pa.int32(), "old_text": pa.string(), "new_line": pa.int32(), "new_text": pa.string()}


def apply_diff(source: Column | str, patch: Column | str) -> Column:
    """struct(text, error): one of them is null."""
    return _checked(lambda x, y: (apply(x or "", y or ""),), _TEXT)(source, patch)


def diff_target(source: Column | str, patch: Column | str) -> Column:
    """struct(old_line, old_text, new_line, new_text, error) of a diff of one line for one."""
    return _checked(lambda x, y: target(x or "", y or ""), _TARGET)(source, patch)


def apply_made(old: Column | str, new: Column | str) -> Column:
    """apply_diff() of old and the diff that make_diff() makes of both: a diff lives as long as its row."""
    return _checked(lambda x, y: (apply(x or "", made(x, y) or ""),), _TEXT)(old, new)


def made_target(old: Column | str, new: Column | str) -> Column:
    """diff_target() of old and the diff that make_diff() makes of both: a diff lives as long as its row."""
    return _checked(lambda x, y: target(x or "", made(x, y) or ""), _TARGET)(old, new)


def changed_lines(old: Column | str, new: Column | str) -> Column:
    @F.pandas_udf("first int, last int")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [location(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)]
        return pd.DataFrame([r or (None, None) for r in rows], columns=["first", "last"], dtype=object)

    return run(old, new)
