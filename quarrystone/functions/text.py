"""Text functions as native column expressions (regular expressions are Java's)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Module names that identify nothing: fixed values.
GENERIC_MODULES = ["refmodule", "top_module", "top", "dut", "tb", "testbench", "test", "module", "main"]
FENCE = r"(?is)```(?:systemverilog|verilog|sv|v)?\s*\n(.*?)```"
MODULE = r"(?s)\bmodule\b.*?\bendmodule\b"
BLANKS = r"[ \t\n\x0B\f\r]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col(text), F.lit(" \t\n\x0b\f\r"))


def collapse(text: Column | str) -> Column:
    """White space runs become one space; ends trimmed; lower case."""
    return F.lower(strip(F.regexp_replace(col(text), BLANKS, " ")))


def normalize_rtl(text: Column | str) -> Column:
    """Line comments go before block comments (the order matters), then collapse()."""
    bare = F.regexp_replace(F.regexp_replace(col(text), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return collapse(bare)


def normalize_keep_case(text: Column | str) -> Column:
    """Line comments only; case stays."""
    return strip(F.regexp_replace(F.regexp_replace(col(text), r"//[^\n]*", ""), BLANKS, " "))


def source_hash(text: Column | str) -> Column:
    return F.sha1(normalize_rtl(text))


def dedup_hash(text: Column | str) -> Column:
    return F.md5(normalize_keep_case(text))


def module_families(text: Column | str) -> Column:
    """Distinct declared module names in lower case, without the generic ones."""
    names = F.transform(F.regexp_extract_all(col(text), F.lit(r"\bmodule\s+(\w+)"), F.lit(1)), F.lower)
    return F.array_except(F.array_distinct(names), F.array(*[F.lit(x) for x in GENERIC_MODULES]))


def canonical_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\r\n?", "\n")


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final newline opens no further line."""
    body = F.regexp_replace(canonical_newlines(text), r"\n\z", "")
    return F.when(F.length(col(text)) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def _first_true(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def extract_rtl(text: Column | str, top: Column | str | None = None) -> Column:
    """Fenced blocks, else the whole text; of these the module that declares top, else all modules, else the body."""
    raw = F.coalesce(col(text), F.lit(""))
    fenced = F.transform(F.regexp_extract_all(raw, F.lit(FENCE), F.lit(1)), strip)
    body = F.when(F.size(fenced) > 0, F.array_join(fenced, "\n")).otherwise(raw)
    inside = F.regexp_extract_all(body, F.lit(MODULE), F.lit(0))
    blocks = F.when(F.size(inside) > 0, inside).otherwise(F.regexp_extract_all(raw, F.lit(MODULE), F.lit(0)))
    joined = F.when(F.size(blocks) == 0, strip(body)).otherwise(F.array_join(F.transform(blocks, strip), "\n\n"))
    if top is None:
        return joined
    named = _first_true(blocks, lambda b: F.regexp_like(b, F.concat(F.lit(r"\bmodule\s+\Q"), col(top), F.lit(r"\E\b"))))
    return F.coalesce(strip(named), joined)


def extract_module(text: Column | str) -> Column:
    """The first fence that holds a module, else the first complete module; null if there is neither."""
    fence = F.regexp_extract(col(text), FENCE, 1)
    module = F.regexp_extract(col(text), "(?i)" + MODULE, 0)
    end = lambda c: F.concat(F.rtrim(c, F.lit(" \t\n\x0b\f\r")), F.lit("\n"))
    return F.when(F.contains(fence, F.lit("module")), end(fence)).when(F.length(module) > 0, end(module))


def extract_answer(text: Column | str) -> Column:
    """extract_module() of the answer block (which may lack its end), else of the text without its reasoning."""
    answer = F.regexp_extract(col(text), r"(?is)<answer>(.*?)(?:</answer>|\z)", 1)
    has = F.regexp_like(col(text), F.lit("(?i)<answer>"))
    return extract_module(F.when(has, answer).otherwise(F.regexp_replace(col(text), r"(?is)<think>.*?</think>", "")))


def complete_modules(text: Column | str) -> Column:
    """All complete modules of the fences (of the text if they hold none), joined by an empty line."""
    raw = F.coalesce(col(text), F.lit(""))
    fenced = F.regexp_extract_all(raw, F.lit(FENCE), F.lit(1))
    body = F.when(F.size(fenced) > 0, F.array_join(fenced, "\n\n")).otherwise(raw)
    found = F.regexp_extract_all(body, F.lit(MODULE), F.lit(0))
    found = F.when((F.size(found) == 0) & (F.size(fenced) > 0), F.regexp_extract_all(raw, F.lit(MODULE), F.lit(0))).otherwise(found)
    return strip(F.array_join(F.transform(found, strip), "\n\n"))


def extract_code_block(text: Column | str) -> Column:
    """The first block that is tagged as hardware code, else the first untagged one if it speaks of a module; null without one."""
    block = lambda tag: F.regexp_extract(col(text), rf"(?is)```{tag}\s*\n(.*?)```", 1)
    has = lambda tag: F.regexp_like(col(text), F.lit(rf"(?is)```{tag}\s*\n.*?```"))
    bare = block("")
    end = lambda c: F.rtrim(c, F.lit(" \t\n\x0b\f\r"))
    return F.when(has("(?:systemverilog|verilog|sv)"), end(block("(?:systemverilog|verilog|sv)"))).when(has("") & F.contains(bare, F.lit("module")), end(bare))


def clean_description(text: Column | str) -> Column:
    """Without chat scaffolding: system blocks, instruction marks and tags."""
    bare = F.regexp_replace(col(text), r"(?s)<<SYS>>.*?<</SYS>>", "")
    return strip(F.regexp_replace(bare, r"\[/?INST\]|</?s>|<\|[^|]*\|>", ""))


def extract_header(text: Column | str) -> Column:
    """From the last word 'module' to the first ');' after it; null without one of them."""
    last = F.regexp_extract(col(text), r"(?s).*(\bmodule\b.*)", 1)
    found = F.regexp_extract(last, r"(?s)^(.*?\);)", 1)
    return F.when(F.length(found) > 0, strip(found))


def full_module(code: Column | str, descriptions: list[Column | str]) -> Column:
    """The header of the first description that has one with a name, and the body below it; null if the body ends no module."""
    body = strip(F.coalesce(col(code), F.lit("")))
    headers = [extract_header(clean_description(F.coalesce(col(d), F.lit("")))) for d in descriptions]
    named = F.coalesce(*[F.when(F.regexp_like(h, F.lit(r"\bmodule\s+\w")), h) for h in headers])
    return F.when(F.contains(body, F.lit("endmodule")), strip(F.concat(named, F.lit("\n"), body)))


def seed_to_eval_id(seed_id: Column | str, prefix: str = "verilogeval:") -> Column:
    """The id of a seed's evaluation item: without its mark of a reference."""
    return F.concat(F.lit(prefix), F.regexp_replace(col(seed_id), "_ref$", ""))


#: Warnings of a linter that count as errors.
GATING_WARNINGS = "WIDTH WIDTHCONCAT WIDTHTRUNC WIDTHEXPAND IMPLICIT UNDRIVEN SELRANGE CASEINCOMPLETE CASEOVERLAP LATCH BLKSEQ PINMISSING MULTIDRIVEN".split()


def gating_diagnostics(log: Column | str) -> Column:
    """The lines of a linter's log that are errors or gating warnings, in order."""
    return F.filter(F.transform(lines(log), strip), lambda x: F.startswith(x, F.lit("%Error")) | F.regexp_extract(x, r"^%Warning-([A-Z0-9]+)", 1).isin(GATING_WARNINGS))


def source_group(model: Column | str) -> Column:
    """base or adapter; anything else raises."""
    value = F.lower(strip(col(model).cast("string")))
    bad = F.raise_error(F.concat(F.lit("unsupported source_model "), F.coalesce(value, F.lit("null"))))
    return F.when(value == "base", "base").when((value == "tuned") | F.startswith(value, F.lit("adapter")), "adapter").otherwise(bad)


def timing(sequential: Column | str) -> Column:
    """sequential or combinational; a null flag raises."""
    return F.when(col(sequential), "sequential").when(~col(sequential), "combinational").otherwise(F.raise_error(F.lit("taxonomy.sequential is no boolean")))


def trim_edge_lines(text: Column | str) -> tuple[Column, Column]:
    """The text without blank lines at its ends, and the number of lines cut before it."""
    every = lines(text)
    filled = F.filter(F.transform(every, lambda x, i: F.when(F.length(strip(x)) > 0, i)), lambda i: i.isNotNull())
    first, last = F.get(filled, F.lit(0)), F.try_element_at(filled, F.lit(-1))
    body = F.when(F.size(filled) == 0, F.lit("")).otherwise(F.array_join(F.slice(every, first + 1, last - first + 1), "\n"))
    return body, F.coalesce(first, F.lit(0))


def replace_word(text: Column | str, word: Column | str, by: Column | str) -> Column:
    """Whole-word replacement with a name from each row."""
    return F.regexp_replace(col(text), F.concat(F.lit(r"\b\Q"), col(word), F.lit(r"\E\b")), col(by))


def slug(text: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9._]+", "-"), F.lit("-"))


def signal_label(flags: dict[str, Column], base: str = "diag") -> Column:
    """Canonical label: the base, then the names of the flags that are true, in their given order."""
    return F.concat_ws("+", F.lit(base), *[F.when(c, F.lit(k)) for k, c in flags.items()])


def first_filled(*cols: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(strip(col(c)), F.lit("")) for c in cols])


def digest(*parts: Column | str, length: int = 24) -> Column:
    """The first characters of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *[col(p) for p in parts]), 256), 1, length)


def jitter(call: Column | str, attempt: Column | str) -> Column:
    """Deterministic share in [0.75, 1.25] from 16 bits of the digest."""
    return F.lit(0.75) + 0.5 * (F.conv(digest(call, col(attempt).cast("string"), length=4), 16, 10).cast("double") / 65535.0)


def retry_delay(call: Column | str, attempt: Column | str, retry_after: Column | str) -> Column:
    """Seconds to wait: the server's wish within [0, 60], else a doubled base up to 30 with jitter."""
    base = F.least(F.lit(30.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), col(attempt) - 1)))
    return F.when(col(retry_after).isNotNull(), F.least(F.lit(60.0), F.greatest(F.lit(0.0), col(retry_after)))).otherwise(base * jitter(call, attempt))


def brackets_balanced(text: Column | str) -> Column:
    """A cheap completeness test of RTL: one end for each module and block, and paired brackets."""
    bare = F.regexp_replace(F.regexp_replace(col(text), r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    count = lambda pattern: F.regexp_count(bare, F.lit(pattern))
    pairs = reduce(lambda a, b: a & b, [count(a) == count(b) for a, b in ((r"\(", r"\)"), (r"\{", r"\}"), (r"\[", r"\]"))])
    return F.coalesce(pairs & (count(r"\bmodule\b") > 0) & (count(r"\bmodule\b") == count(r"\bendmodule\b")) & (count(r"\bbegin\b") == count(r"\bend\b")), F.lit(False))


def classify_response(protocol_error: Column, refusal: Column, incomplete: Column, text: Column) -> Column:
    """The first outcome that applies, else whether the text holds a complete module."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(protocol_error), "protocol_error")
        .when(yes(refusal), "refusal")
        .when(yes(incomplete), "truncated_or_incomplete")
        .when(F.length(complete_modules(text)) == 0, "unparseable")
        .otherwise("accepted_pending_compile")
    )


def taxonomy(rtl: Column | str) -> Column:
    """code_lines, sequential, has_case and has_state of a module."""
    code = F.filter(lines(rtl), lambda x: (F.length(strip(x)) > 0) & ~F.startswith(strip(x), F.lit("//")))
    sequential = F.regexp_like(col(rtl), F.lit(r"always\s*@\s*\(\s*posedge"))
    return F.struct(F.size(code).alias("code_lines"), sequential.alias("sequential"), F.contains(col(rtl), F.lit("case")).alias("has_case"), F.contains(F.lower(col(rtl)), F.lit("state")).alias("has_state"))


def first_new_line(broken: Column | str, golden: Column | str) -> Column:
    """The first trimmed, filled line of broken that golden does not have."""
    keep = lambda c: F.filter(F.transform(lines(c), strip), lambda x: F.length(x) > 0)
    gold = keep(golden)
    return _first_true(keep(broken), lambda x: ~F.array_contains(gold, x))


#: Redaction chain, in order: pattern and replacement.  Fixed values.
PATHS = [
    (r"(?:file://)?/(?:Users|home)/[^/\s\"'<>]+(?:/[^\s\"'<>]*)?", "<LOCAL_PATH>"),
    (r"(?:file://)?/(?:private|tmp|var/folders)(?:/[^\s\"'<>]*)?", "<TEMP_PATH>"),
    (r"(?i)[A-Z]:\\Users\\[^\s\"'<>]+", "<LOCAL_PATH>"),
]
CREDENTIALS = [
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"(?i)\bnvapi-[A-Za-z0-9_-]{12,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b",
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
]
REMOTES = [r"(?i)(?:git@|ssh://git@)[^\s\"'<>]+", r"(?i)https?://(?:[^/@\s]+@)?(?:github|gitlab|bitbucket)\.[^/\s]+/[^\s\"'<>]+\.git\b"]
EMAIL = r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def sanitize(text: Column | str, identifiers: list[tuple[str, str]] = (), authors: list[str] = (), internal: list[str] = (), root: str | None = None) -> Column:
    """Root folder, local paths, known identifiers (longest first), internal ids, author names, credentials, remotes, e-mail: in this order."""
    out = col(text)
    if root:
        out = F.replace(out, F.lit(root), F.lit("<REPO>"))
    for pattern, by in PATHS:
        out = F.regexp_replace(out, pattern, by)
    for old, new in sorted(identifiers, key=lambda p: (-len(p[0]), p[0])):
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern in internal:
        out = F.regexp_replace(out, "(?i)" + pattern, "[ANONYMIZED_INTERNAL_ID]")
    for name in sorted(authors, key=len, reverse=True):
        out = F.regexp_replace(out, r"(?i)\Q" + name + r"\E", "[ANONYMIZED]")
    for pattern in CREDENTIALS:
        out = F.regexp_replace(out, pattern, "[REDACTED_CREDENTIAL]")
    for pattern in REMOTES:
        out = F.regexp_replace(out, pattern, "[REDACTED_GIT_REMOTE]")
    return F.when(F.contains(out, F.lit("@")), F.regexp_replace(out, EMAIL, "[REDACTED_EMAIL]")).otherwise(out)


#: Detectors of a payload scan: label and pattern.  Fixed values.
DETECTORS = {
    "provider API key": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    "NVIDIA API key": r"(?i)(?<![A-Za-z0-9])nvapi-[A-Za-z0-9_-]{16,}",
    "AWS access key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "GitHub token": r"(?<![A-Za-z0-9])(?:gh[opsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "Slack token": r"(?<![A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{20,}",
    "Google API key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{30,}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "credential-bearing URL": r"(?i)https?://[^/\s:@]+:[^/\s@]+@",
    "authorization credential": r"(?i)\bAuthorization\s*[:=]\s*(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{12,}",
    "bearer credential": r"(?i)(?<![A-Za-z0-9])Bearer[ \t]+[A-Za-z0-9._~+/=-]{20,}",
    "POSIX home path": r"(?<![A-Za-z0-9])/(?:Users|home)/[A-Za-z0-9._-]+/[^\s\x00\"'<>]+",
    "Windows home path": r"(?i)(?<![A-Za-z0-9])[A-Z]:\\Users\\[A-Za-z0-9._-]+\\[^\s\x00\"'<>]+",
    "ephemeral/workspace absolute path": r"(?<![A-Za-z0-9])/(?:private/(?:tmp|var/folders)|var/folders|Volumes/[A-Za-z0-9._-]+|root|(?:github/)?workspace|workspaces|runner/_work|mnt/(?:data|workspace))/[A-Za-z0-9._~-][^\s\x00\"'<>]*",
    "literal IPv4 endpoint": r"(?<![0-9.])(?!0\.0\.0\.0(?:[^0-9.]|$))(?!127\.0\.0\.1(?:[^0-9.]|$))(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    "e-mail address": EMAIL,
}
#: A text without any of a detector's strings (in lower case) holds no match: a cheap test before its pattern.
NEEDED = {"provider API key": ["sk-"], "NVIDIA API key": ["nvapi-"], "AWS access key": ["akia", "asia"], "GitHub token": ["gh", "github_pat_"], "Slack token": ["xox"], "Google API key": ["aiza"], "private key": ["-----begin "], "credential-bearing URL": ["://"], "authorization credential": ["authorization"], "bearer credential": ["bearer"], "POSIX home path": ["/users/", "/home/"], "Windows home path": [":\\users\\"], "e-mail address": ["@"]}


def findings(text: Column | str, detectors: dict[str, str] = DETECTORS) -> Column:
    """Names of the detectors that match."""
    low = F.lower(col(text))

    def hit(name: str, pattern: str) -> Column:
        found = F.regexp_like(col(text), F.lit(pattern))
        needed = [F.contains(low, F.lit(x)) for x in NEEDED.get(name, ())]
        return reduce(lambda a, b: a | b, needed) & found if needed else found

    return F.filter(F.array(*[F.when(hit(n, p), F.lit(n)) for n, p in detectors.items()]), lambda x: x.isNotNull())


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** spans folders, * and ? stay within one."""
    out = []
    for part in re.split(r"(\*\*/|\*\*|\*|\?)", glob):
        out.append({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return "^" + "".join(out) + "$"
