"""Module headers read by recursive descent over lexemes: name, parameters and ports, and nothing of the body."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rtl import Drives, Lexemes, constant, lexed, security_reason

DIRECTIONS = frozenset(["input", "output", "inout"])
#: Words that may stand between a direction and a name, and those of parameters.
NET_WORDS = frozenset("wire reg logic var signed unsigned tri wand wor integer int bit byte".split())
PARAMETER_WORDS = frozenset("parameter localparam integer int logic bit signed unsigned real time type string byte".split())
PORT = "direction:string,name:string,width:string,bits:long,signed:boolean,clock:boolean,reset:boolean"


class NotSupported(ValueError):
    """A header that can't be driven from outside as it stands."""


class Header:
    """Reads the header that begins at the first module of a source.

    Each part is a method that begins at self.i and leaves it behind what it read.
    """

    def __init__(self, source: str | Lexemes | None):
        self.x, self.i, self.values, self.n = lexed(source), 0, {}, 0
        self.n = len(self.x.word)

    def word(self, ahead: int = 0) -> str:
        return self.x.word[self.i + ahead] if self.i + ahead < self.n else ""

    def text(self, first: int, last: int) -> str:
        """The code from lexeme first to before lexeme last."""
        end = self.x.at[last - 1] + len(self.x.name[last - 1]) if last > first else 0
        return self.x.code[self.x.at[first] : end] if last > first else ""

    def closing(self) -> int:
        if self.i not in self.x.closing:
            raise NotSupported("a bracket is open")
        return self.x.closing[self.i]

    def read(self) -> dict:
        while self.i < self.n and not (self.word() == "module" and self.x.is_name(self.i + 1)):
            self.i += 1
        if self.i >= self.n:
            raise NotSupported("no module")
        name, self.i = self.x.name[self.i + 1], self.i + 2
        while self.word() == "import":
            while self.i < self.n and self.word() != ";":
                self.i += 1
            self.i += 1
        if self.word() == "#":
            self.i += 1
            self.listed(self.parameter)
        if self.word() != "(":
            raise NotSupported("no list of ports")
        self.direction, ports = "", []
        self.listed(lambda end: ports.append(self.port(end)))
        if not ports:
            raise NotSupported("no ports")
        return {"name": name, "parameters": [{"name": k, "value": v} for k, v in self.values.items()], "ports": ports}

    def listed(self, entry) -> None:
        """Entries between brackets, parted by commas outside inner brackets; empty ones are passed over."""
        if self.word() != "(":
            raise NotSupported("no list")
        close = self.closing()
        self.i += 1
        while self.i < close:
            end = self.i
            while end < close and self.x.word[end] != ",":
                end = self.x.closing[end] + 1 if end in self.x.closing else end + 1
            if end > self.i:
                entry(end)
            self.i = end + 1
        self.i = close + 1

    def parameter(self, end: int) -> None:
        """A parameter whose value is a constant of those before it is known to those behind it."""
        while self.i < end and (self.word() in PARAMETER_WORDS or self.word() == "["):
            self.i = self.closing() + 1 if self.word() == "[" else self.i + 1
        if self.x.is_name(self.i) and self.word(1) == "=":
            got = constant(self.text(self.i + 2, end), self.values)
            if got is not None:
                self.values[self.x.name[self.i]] = got

    def port(self, end: int) -> dict:
        """A port: its direction, or that of the one before; its own packed ranges; one name; perhaps a default."""
        if self.word() in DIRECTIONS:
            self.direction, self.i = self.word(), self.i + 1
        if not self.direction:
            raise NotSupported("directions stand in the body")
        signed, width, bits = False, "", 1
        while self.i < end:
            if self.word() in NET_WORDS or (self.x.is_name(self.i) and self.i + 1 < end and (self.x.is_name(self.i + 1) or self.word(1) == "[" and self.closes_before_name(self.i + 1, end))):
                signed |= self.word() == "signed"
                self.i += 1
            elif self.word() == "[":
                text, size = self.range()
                width, bits = width + text, bits * size
            else:
                break
        if not self.x.is_name(self.i) or self.i >= end:
            raise NotSupported("no name of a port")
        name = self.x.name[self.i]
        self.i += 1
        if self.i < end and self.word() != "=":
            raise NotSupported("an unpacked array" if self.word() == "[" else "more than a name")
        return {"direction": self.direction, "name": name, "width": width, "bits": bits, "signed": signed, "clock": bool(re.search("clk|clock", name, re.I)), "reset": bool(re.search("rst|reset", name, re.I))}

    def closes_before_name(self, i: int, end: int) -> bool:
        """Whether the brackets from i on are followed by a name: then what stands before them is a type."""
        while i < end and self.x.word[i] == "[" and i in self.x.closing:
            i = self.x.closing[i] + 1
        return i < end and self.x.is_name(i)

    def range(self) -> tuple[str, int]:
        """[high:low] as text and as a number of bits."""
        first, last = self.i, self.closing()
        at = next((k for k in range(first + 1, last) if self.x.word[k] == ":"), None)
        self.i = last + 1
        if at is None:
            raise NotSupported("no range")
        high, low = constant(self.text(first + 1, at), self.values), constant(self.text(at + 1, last), self.values)
        if high is None or low is None:
            raise NotSupported("a width is no constant")
        return re.sub(r"\s+", "", self.text(first, last + 1)), abs(high - low) + 1


def parse_module(source: str | Lexemes | None) -> dict | None:
    """name, parameters (name, value) and ports (direction, name, width text, bits, signed, clock, reset) of the first module.

    Only the header is read.  Null if it can't be driven as it stands: no header directions, no ports, unpacked arrays, or widths that are
    no constants of its parameters.  A range holds for the name that it stands before.
    """
    try:
        return Header(source).read()
    except NotSupported:
        return None


def input_drive_reason(source: str | Lexemes | None, inputs: tuple[str, ...] | None = None) -> str:
    """Why a module is refused that may drive one of its inputs (those of its header, if none are given); empty if it is not."""
    if inputs is None:
        parsed = parse_module(source)
        inputs = tuple(p["name"] for p in parsed["ports"] if p["direction"] == "input") if parsed else ()
    return Drives(source, inputs).reason()


def driven_input(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([input_drive_reason(None if pd.isna(x) else x) for x in s], dtype=object)

    return run(c)


_INFO = f"name string, parameters array<struct<name:string,value:long>>, ports array<struct<{PORT}>>"


def module_info(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        parsed = [parse_module(None if pd.isna(x) else x) for x in s]
        return pd.Series([json.dumps(p) if p else None for p in parsed], dtype=object)

    return F.from_json(run(c), _INFO)


def module_report(source: str | None, reserved: tuple[str, ...] = ()) -> tuple[dict | None, str, str]:
    """parse_module(), security_reason() and input_drive_reason() of a source that is read as lexemes once."""
    x = Lexemes(source)
    parsed = parse_module(x)
    inputs = tuple(p["name"] for p in parsed["ports"] if p["direction"] == "input") if parsed else ()
    return parsed, security_reason(x, reserved), input_drive_reason(x, inputs)


def module_reports(c: Column | str, reserved: tuple[str, ...] = ()) -> Column:
    """struct(info, as JSON, refused, driven): what module_info(), refused() and driven_input() say, of one reading of each source."""

    @F.pandas_udf("info string, refused string, driven string")
    def run(s: pd.Series) -> pd.DataFrame:
        made = [module_report(None if pd.isna(x) else x, reserved) for x in s]
        return pd.DataFrame([(json.dumps(p) if p else None, r, d) for p, r, d in made], columns=["info", "refused", "driven"], dtype=object)

    return run(c)


def info_of(report: Column) -> Column:
    """module_info() of a module_reports() struct."""
    return F.from_json(report["info"], _INFO)
