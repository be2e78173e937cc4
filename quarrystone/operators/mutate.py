"""Mutations of a source: a row for each operator that changed it.

A source is read as lexemes with their places; comments and strings are no lexemes.  An operator
is a function from these to edits (begin, end, new text), of which one is chosen by a hash of
seed, operator and source, so that it does not depend on partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.rtl import mask

Edit = tuple[int, int, str]
_LEXEME = re.compile(r"(?P<word>[A-Za-z_]\w*)|(?P<based>\d+'[sS]?[bodhBODH][\da-fA-FxzXZ_]+)|(?P<number>\d+)|(?P<sign><<<|>>>|<<|>>|<=|>=|===|!==|==|!=|&&|\|\||\S)")


class Lexeme(NamedTuple):
    text: str
    kind: str
    begin: int
    end: int


class Source:
    def __init__(self, text: str):
        self.text = text
        self.lexemes = [Lexeme(m[0], m.lastgroup, m.start(), m.end()) for m in _LEXEME.finditer(mask(text))]

    def line_of(self, x: Lexeme) -> tuple[int, int]:
        """Begin and end of a lexeme's line, with its line break."""
        begin = self.text.rfind("\n", 0, x.begin) + 1
        end = self.text.find("\n", x.end)
        return begin, len(self.text) if end < 0 else end + 1

    def alone(self, x: Lexeme) -> bool:
        begin, end = self.line_of(x)
        return self.text[begin:end].strip() == x.text

    def runs(self, n: int) -> Iterator[tuple[Lexeme, ...]]:
        return zip(*[self.lexemes[i:] for i in range(n)])


def lone_lines(word: str, last: bool = False) -> Callable[[Source], list[Edit]]:
    """Takes away a line that holds nothing but the word."""

    def edits(s: Source) -> list[Edit]:
        found = [(*s.line_of(x), "") for x in s.lexemes if x.text == word and s.alone(x)]
        return found[-1:] if last else found

    return edits


def line_ends(s: Source) -> list[Edit]:
    """Takes away a semicolon that ends its line."""
    return [(x.begin, x.end, "") for x in s.lexemes if x.text == ";" and not s.text[x.end : s.line_of(x)[1]].strip()]


def named_pins(s: Source) -> list[Edit]:
    """Renames the pin of a connection .pin( ... )."""
    return [(pin.end, pin.end, "_x") for dot, pin, open_ in s.runs(3) if dot.text == "." and dot.end == pin.begin and pin.kind == "word" and open_.text == "("]


def symbolic_widths(s: Source) -> list[Edit]:
    """Replaces a width [NAME-1:0] by [3:0]."""
    return [(r[0].begin, r[6].end, "[3:0]") for r in s.runs(7) if r[1].kind == "word" and [x.text for i, x in enumerate(r) if i != 1] == ["[", "-", "1", ":", "0", "]"]]


def declared_names(s: Source) -> list[Edit]:
    """Renames the single name of a declaration of a net or variable; of several on a line the first."""
    found: dict[int, Edit] = {}
    for i, x in enumerate(s.lexemes):
        if x.text not in ("reg", "wire", "logic"):
            continue
        j = i + 1 + (i + 1 < len(s.lexemes) and s.lexemes[i + 1].text == "signed")
        if j < len(s.lexemes) and s.lexemes[j].text == "[":
            while j < len(s.lexemes) and s.lexemes[j].text != "]":
                j += 1
            j += 1
        if j + 1 < len(s.lexemes) and s.lexemes[j].kind == "word" and s.lexemes[j + 1].text == ";":
            found.setdefault(s.line_of(x)[0], (s.lexemes[j].end, s.lexemes[j].end, "_undecl"))
    return list(found.values())


def first_assignments(s: Source) -> list[Edit]:
    """Makes a blocking assignment of a line that begins with target <= and ends with a semicolon."""
    out = []
    for x in s.lexemes:
        if x.text == "<=":
            begin, end = s.line_of(x)
            if re.fullmatch(r"[\w.\[\]:'$\s-]+", s.text[begin : x.begin]) and s.text[x.end : end].rstrip().endswith(";"):
                out.append((x.begin, x.end, "="))
    return out


def swapped(pairs: str) -> Callable[[Source], list[Edit]]:
    """Exchanges signs that stand between spaces: 'a b  c d' is a for b and b for a, c for d and d for c."""
    other = {}
    for pair in pairs.split("  "):
        a, b = pair.split()
        other |= {a: b, b: a}
    return lambda s: [(x.begin, x.end, other[x.text]) for x in s.lexemes if x.text in other and s.text[x.begin - 1 : x.begin] == " " == s.text[x.end : x.end + 1]]


def negated_resets(s: Source) -> list[Edit]:
    """Takes the ! from a name that speaks of a reset."""
    return [(no.begin, name.begin, "") for no, name in s.runs(2) if no.text == "!" and name.kind == "word" and re.search("rst|reset", name.text, re.I)]


def choices(s: Source) -> list[Edit]:
    """Exchanges the two simple operands of ? a : b."""

    def operand(i: int) -> int:
        """The end of the operand that begins at lexeme i: a name or number with its selects, or a concatenation."""
        if i < len(s.lexemes) and (s.lexemes[i].kind != "sign" or s.lexemes[i].text == "{"):
            depth, j = 0, i
            while j < len(s.lexemes):
                t = s.lexemes[j].text
                depth += t in "[{"
                depth -= t in "]}"
                j += 1
                if depth == 0 and (j >= len(s.lexemes) or s.lexemes[j].text not in ("[", ".") and s.lexemes[j - 1].text != "."):
                    return j
        return i

    out = []
    for i, x in enumerate(s.lexemes):
        if x.text == "?":
            j = operand(i + 1)
            k = operand(j + 1) if j > i + 1 and j < len(s.lexemes) and s.lexemes[j].text == ":" else 0
            if k > j + 1:
                a, b = (s.lexemes[i + 1].begin, s.lexemes[j - 1].end), (s.lexemes[j + 1].begin, s.lexemes[k - 1].end)
                out.append((a[0], b[1], s.text[b[0] : b[1]] + s.text[a[1] : b[0]] + s.text[a[0] : a[1]]))
    return out


def sized_literals(s: Source) -> list[Edit]:
    """Lowers a sized decimal or hexadecimal number by one, or raises a zero; those with unknown digits are left."""
    out = []
    for x in s.lexemes:
        size, _, rest = x.text.partition("'")
        base = {"d": 10, "h": 16}.get(rest[:1]) if x.kind == "based" else None
        digits = rest[1:]
        if base and re.fullmatch("[0-9]+" if base == 10 else "[0-9a-fA-F]+", digits):
            v = int(digits, base)
            v = v - 1 if v else 1
            out.append((x.begin, x.end, f"{size}'{rest[0]}{v:{'x' if base == 16 else 'd'}}"))
    return out


LINT = {
    "drop_endmodule": lone_lines("endmodule", last=True),
    "delete_semicolon": line_ends,
    "drop_one_end": lone_lines("end"),
    "corrupt_pin": named_pins,
    "width_mismatch": symbolic_widths,
    "rename_declaration": declared_names,
    "blocking_in_seq": first_assignments,
}
SEMANTIC = {
    "op_swap": swapped("+ -  & |"),
    "flip_reset_polarity": negated_resets,
    "flip_equality": swapped("== !="),
    "swap_logical": swapped("&& ||"),
    "shift_swap": swapped("<< >>"),
    "swap_ternary": choices,
    "off_by_one_literal": sized_literals,
}
REGISTRIES = {"lint": LINT, "semantic": SEMANTIC}


def picked(s: Source, name: str, edits: list[Edit], seed: int) -> str | None:
    """The source with one of an operator's edits made, chosen by a hash; null if none of them changes anything."""
    edits = sorted(e for e in edits if s.text[e[0] : e[1]] != e[2])
    if not edits:
        return None
    begin, end, new = edits[int(hashlib.md5(f"{seed}:{name}:{s.text}".encode()).hexdigest()[:8], 16) % len(edits)]
    return s.text[:begin] + new + s.text[end:]


def mutate(source: str, registry: str, name: str, seed: int) -> str | None:
    s = Source(source)
    return picked(s, name, REGISTRIES[registry][name](s), seed)


def expand(seeds: DataFrame, source: str, registry: str | list[str] = "lint", seed: int = 0) -> DataFrame:
    """Every seed row with each mutation (mutation, registry, registry_pos, broken) of one or several registries that changes its source.

    A source is read as lexemes once, for all operators.  Rows come in Arrow batches and go out a batch for each few sources.
    """
    wanted = [registry] if isinstance(registry, str) else registry
    schema = T.StructType([*seeds.schema.fields, *T.StructType.fromDDL("mutation string, registry string, registry_pos int, broken string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for i, text in enumerate(batch.column(source).to_pylist()):
                s = Source(text) if text else None
                for kind in wanted if s else []:
                    for at, (name, edits) in enumerate(REGISTRIES[kind].items()):
                        broken = picked(s, name, edits(s), seed)
                        if broken is not None:
                            rows.append(i)
                            made.append((name, kind, at, broken))
                if len(rows) >= 4096 or (rows and i + 1 == batch.num_rows):
                    held = batch.take(pa.array(rows, pa.int32()))
                    own = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*held.columns, *own], names=schema.names)
                    rows, made = [], []

    return seeds.mapInArrow(run, schema)
