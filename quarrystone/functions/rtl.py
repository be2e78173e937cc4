"""Functions over RTL sources that need a state machine or a parser: pandas UDFs, a batch at a time."""

from __future__ import annotations

import ast
import json
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One alternative for each thing that may start: comment, block comment (perhaps open), string (perhaps open).
_TOKENS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)", re.S)
#: System functions without side effects that a candidate may call.
SAFE_SYSTEM = frozenset(
    "$bits $clog2 $countbits $countones $dimensions $high $increment $isunknown $left $low $onehot $onehot0 $right $signed $size $typename $unpacked_dimensions $unsigned".split()
)
#: Words that reach outside an ordinary design module, by what is said of them, in the order of the checks.
FORBIDDEN = {
    "formal constraint/check statement": frozenset("assert assume cover restrict".split()),
    "embedded verification or additional design construct": frozenset(
        "property endproperty sequence endsequence checker endchecker bind interface endinterface program endprogram primitive endprimitive package endpackage config endconfig macromodule".split()
    ),
    "cross-hierarchy force/release": frozenset("force release".split()),
    "root hierarchy access": frozenset(["$root"]),
}
#: Built-in gates, and those that drive all their terminals but the last, or their first two.
GATES = frozenset("and buf bufif0 bufif1 cmos nand nmos nor not notif0 notif1 or pmos pulldown pullup rcmos rnmos rpmos rtran rtranif0 rtranif1 tran tranif0 tranif1 xnor xor".split())
MANY_OUTPUTS = frozenset(["buf", "not"])
TWO_WAY = frozenset("rtran rtranif0 rtranif1 tran tranif0 tranif1".split())
STRENGTHS = frozenset("highz0 highz1 pull0 pull1 small strong0 strong1 supply0 supply1 weak0 weak1".split())
#: Words after which a statement begins.
OPENERS = frozenset("begin end else initial final always always_comb always_ff always_latch generate endgenerate fork join do assign endcase".split())
REFUSED = "candidate security preflight rejected "


def mask(source: str | None) -> str | None:
    """Comments and strings as spaces; line breaks stay, so that places do."""
    return None if source is None else _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


_LEXEME = re.compile(r"[A-Za-z_][\w$]*|\$[A-Za-z_][\w$]*|\d[\w.']*|'[bodhsBODHS]+[\w?]*|<<<=|>>>=|<<=|>>=|===|!==|==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|&&|\|\||<<|>>|\S")
_COMPOUND = frozenset("+= -= *= /= %= &= |= ^= <<= >>= <<<= >>>=".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Lexemes:
    """The code of a source as words and signs, with their places, and for each closing bracket its opening one."""

    def __init__(self, source: str | None):
        self.code = mask(source or "")
        found = list(_LEXEME.finditer(self.code))
        self.at = [m.start() for m in found]
        self.word = [m[0].lower() for m in found]
        self.name = [m[0] for m in found]
        self.opening: dict[int, int] = {}
        held: list[int] = []
        for i, w in enumerate(self.word):
            if w in "([{" and len(w) == 1:
                held.append(i)
            elif w in _CLOSES:
                while held and self.word[held[-1]] != _CLOSES[w]:
                    held.pop()
                if held:
                    self.opening[i] = held.pop()
        self.closing = {o: c for c, o in self.opening.items()}

    def touching(self, i: int, a: str, b: str) -> bool:
        return self.word[i] == a and i + 1 < len(self.word) and self.word[i + 1].startswith(b) and self.at[i + 1] == self.at[i] + len(a)

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.word) and (self.name[i][0].isalpha() or self.name[i][0] == "_")


def lexed(source: str | Lexemes | None) -> Lexemes:
    """The lexemes of a source, which several checks may share."""
    return source if isinstance(source, Lexemes) else Lexemes(source)


def security_reason(source: str | Lexemes | None, reserved: tuple[str, ...] = ()) -> str:
    """Why a candidate module is refused; empty if it is not.  What is not known to be harmless is refused."""
    x = lexed(source)
    opens, closes = x.word.count("module"), x.word.count("endmodule")
    if max(opens, closes) > 1 or opens != closes:
        return f"candidate security preflight requires exactly one module (found module={opens}, endmodule={closes})"
    wildcard = {i + k for i in range(len(x.word) - 3) if x.word[i : i + 4] == ["@", "(", "*", ")"] for k in (1, 2)}
    if any(w in ("(", "*", "**") and i not in wildcard and (x.touching(i, "(", "*") or x.touching(i, "*", ")") or x.touching(i, "**", ")")) for i, w in enumerate(x.word)):
        return REFUSED + "source attribute"
    if re.search(r"`(?=[A-Za-z_`])", x.code):
        return REFUSED + "preprocessor directive"
    words = set(x.word)
    for said, bad in FORBIDDEN.items():
        if words & bad:
            return REFUSED + said
    if any(w == "." and x.is_name(i - 1) and x.is_name(i + 1) for i, w in enumerate(x.word)):
        return REFUSED + "hierarchical or cross-scope reference"
    unsafe = sorted({w for w in words if w[0] == "$" and len(w) > 1} - SAFE_SYSTEM)
    if unsafe:
        return REFUSED + "system task/function " + ", ".join(unsafe)
    if any(r and re.search(rf"\b{re.escape(r)}\b", x.code, re.I) for r in reserved):
        return REFUSED + "reserved verifier hierarchy"
    return ""


class Drives:
    """Finds what a module body does to names that its caller drives."""

    def __init__(self, source: str | Lexemes | None, inputs):
        self.x, self.inputs = lexed(source), {n.lower() for n in inputs if n}
        w = self.x.word
        header = next((i for i in range(len(w) - 1) if w[i] == ")" and w[i + 1] == ";"), None)
        self.body = len(w) if header is None else header + 2

    def target(self, i: int) -> tuple[int, set[str]]:
        """Where the target that ends before lexeme i begins, and the names it sets: one with its selects, or a concatenation."""
        x, j = self.x, i - 1
        while j > 0 and x.word[j] == "]" and j in x.opening:
            j = x.opening[j] - 1
        if j >= 0 and x.word[j] == "}" and j in x.opening:
            begin, names, k = x.opening[j], set(), x.opening[j]
            while k < j:
                k = x.closing[k] + 1 if x.word[k] == "[" and k in x.closing else k + 1
                if x.is_name(k):
                    names.add(x.word[k])
            return begin, names
        return j, {x.word[j]} if x.is_name(j) else set()

    def statement(self, i: int) -> int:
        """The first lexeme of the statement around i."""
        j = i
        while j > 0 and self.x.word[j - 1] not in (";", "begin", "end"):
            j -= 1
        return j

    def is_drive(self, i: int) -> bool:
        """Whether <= at i, whose target begins at start, sets it; else it compares."""
        x = self.x
        start, _ = self.target(i)
        first = self.statement(i)
        if any(x.word[k] in ("=", "<=") or x.word[k] in _COMPOUND for k in range(first, start)):
            return False
        if start == first or x.word[start - 1] in OPENERS:
            return True
        before = x.word[start - 1]
        if before == "*":  # of any event
            return x.word[start - 2] == "@"
        if before == ":":  # a label, unless a choice is open
            return "?" not in x.word[first:start]
        return before == ")" or before == "]" or x.is_name(start - 1) or x.word[start - 1][0].isdigit()

    def reason(self) -> str:
        x, w = self.x, self.x.word
        if not self.inputs:
            return ""
        for i in range(self.body, len(w)):
            if w[i] in ("input", "output", "inout") and self.inputs & set(w[i : self.end(i)]):
                return REFUSED + "input direction redeclaration"
        for i in range(len(w)):
            sets: set[str] = set()
            if w[i] == "=" or w[i] in _COMPOUND or (w[i] == "<=" and self.is_drive(i)):
                sets = self.target(i)[1]
            elif w[i] in ("++", "--"):
                sets = self.target(i)[1] | ({w[i + 1]} if i + 1 < len(w) else set())
            elif w[i] in ("alias", "deassign"):
                sets = set(w[i : self.end(i)])
            if self.inputs & sets:
                return REFUSED + "drive of input port"
        if any(self.inputs & self.gate(i) for i in range(len(w)) if w[i] in GATES and (i == 0 or w[i - 1] in OPENERS or w[i - 1] in (";", ":", ")") or self.line_start(i))):
            return REFUSED + "primitive drive of input port"
        return ""

    def line_start(self, i: int) -> bool:
        begin = self.x.code.rfind("\n", 0, self.x.at[i]) + 1
        return not self.x.code[begin : self.x.at[i]].strip()

    def end(self, i: int) -> int:
        while i < len(self.x.word) and self.x.word[i] != ";":
            i += 1
        return i

    def gate(self, i: int) -> set[str]:
        """Names at the driven terminals of the gate instances of a statement."""
        x, out, k, stop = self.x, set(), i + 1, self.end(i)
        while k < stop:
            if x.word[k] != "(" or k not in x.closing:
                k += 1
                continue
            close = x.closing[k]
            terminals: list[set[str]] = [set()]
            j = k + 1
            while j < close:
                if x.word[j] == ",":
                    terminals.append(set())
                elif x.word[j] in "([{" and j in x.closing:
                    terminals[-1] |= set(x.word[j : x.closing[j]])
                    j = x.closing[j]
                else:
                    terminals[-1].add(x.word[j])
                j += 1
            if x.word[k - 1] != "#" and not set().union(*terminals) <= STRENGTHS:
                kind = x.word[i]
                for t in terminals[:-1] if kind in MANY_OUTPUTS else terminals[: 2 if kind in TWO_WAY else 1]:
                    out |= t
            k = close + 1
        return out


_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.LShift: operator.lshift, ast.RShift: operator.rshift, ast.Pow: operator.pow}


def constant(text: str, values: dict[str, int]) -> int | None:
    """A constant expression of numbers, known names, arithmetic and $clog2; null if it is none."""
    text = re.sub(r"\d*'[sS]?([dDhHbBoO])([0-9a-fA-F_]+)", lambda m: str(int(m[2].replace("_", ""), {"d": 10, "h": 16, "b": 2, "o": 8}[m[1].lower()])), text.strip())

    def value(n):
        if isinstance(n, ast.Expression):
            return value(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, int):
            return n.value
        if isinstance(n, ast.Name):
            return values[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            a, b = value(n.left), value(n.right)
            if isinstance(n.op, ast.LShift | ast.Pow) and not 0 <= b <= 64:
                raise ValueError("too large")
            return _ARITHMETIC[type(n.op)](a, b)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -value(n.operand)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "clog2" and len(n.args) == 1:
            return max(0, value(n.args[0]) - 1).bit_length()
        raise ValueError("no constant")

    try:
        return value(ast.parse(text.replace("$clog2", "clog2").replace("/", "//"), mode="eval"))
    except (ValueError, SyntaxError, KeyError, ZeroDivisionError, TypeError, RecursionError):
        return None


def canonical_json(text: str | None) -> str | None:
    """JSON with sorted keys, no spaces, nothing escaped but what must be; null if it is no JSON."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def _series(fn, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(None if x is None or x != x else x))

    return run


def masked(c: Column | str) -> Column:
    return _series(mask, "string")(c)


def refused(c: Column | str, reserved: tuple[str, ...] = ()) -> Column:
    return _series(lambda x: security_reason(x, reserved), "string")(c)


def canonical_sha256(json_text: Column | str) -> Column:
    return F.sha2(_series(canonical_json, "string")(json_text), 256)


def single_deletion(original: str | None, reduced: str | None) -> str | None:
    """The one stretch whose removal turns original into reduced; null if there is none."""
    if not original or reduced is None or len(reduced) >= len(original):
        return None
    gone = len(original) - len(reduced)
    head = next((i for i, (a, b) in enumerate(zip(original, reduced)) if a != b), len(reduced))
    return original[head : head + gone] if original[:head] + original[head + gone :] == reduced else None


def deleted_clause(original: Column | str, reduced: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([single_deletion(x, y) for x, y in zip(a, b, strict=True)])

    return run(original, reduced)
