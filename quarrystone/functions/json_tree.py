"""Walks over JSON values of any shape: sanitizing, private fields, embedded sources.  Pandas UDFs, a batch at a time."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CREDENTIALS, EMAIL, PATHS, REMOTES, col

#: Keys whose values are secrets, people or places of repositories.
SECRET_KEYS = frozenset("api_key apikey access_token auth_token authorization bearer_token client_secret cookie cookies credential credentials headers password private_key secret token".split())
PERSON_KEYS = frozenset("affiliation affiliations author authors created_by email emails institution institutions maintainer maintainers owner submitted_by user_name".split())
REMOTE_KEYS = frozenset("git_remote git_remote_url git_url remote_url repository_remote".split())
#: Keys that a public file must not have.
PRIVATE_KEYS = frozenset("analysis chain_of_thought chainofthought provider_response raw_completion raw_output raw_provider_response raw_response raw_response_body reasoning reasoning_content response_body scratchpad thinking".split())
#: Fixed: documents that are Python values at a time; a batch comes as Arrow with thousands of them.
SLICE = 64


class Sanitizer:
    """text(), and value() over nested values; two keys that become one are an error."""

    def __init__(self, identifiers: dict[str, str] | None = None, people: tuple[str, ...] = (), internal: tuple[str, ...] = ()):
        if any(len(p.strip()) < 3 for p in people):
            raise ValueError("names to redact have at least 3 characters")
        self.names = sorted((identifiers or {}).items(), key=lambda p: (-len(p[0]), p[0]))
        flat = [(re.compile(p), by) for p, by in PATHS]
        late = [(re.compile(p, re.I), "[ANONYMIZED_INTERNAL_ID]") for p in internal]
        late += [(re.compile(re.escape(p), re.I), "[ANONYMIZED]") for p in sorted(people, key=lambda p: (-len(p), p))]
        late += [(re.compile(p), "[REDACTED_CREDENTIAL]") for p in CREDENTIALS] + [(re.compile(p), "[REDACTED_GIT_REMOTE]") for p in REMOTES]
        self.early, self.late = flat, [*late, (re.compile(EMAIL), "[REDACTED_EMAIL]")]

    def text(self, value: str) -> str:
        for pattern, by in self.early:
            value = pattern.sub(lambda _, by=by: by, value)
        for old, new in self.names:
            value = value.replace(old, new) if old else value
        for pattern, by in self.late:
            value = pattern.sub(lambda _, by=by: by, value)
        return value

    def value(self, x, key: str = ""):
        kind = key.strip().lower().replace("-", "_")
        for keys, by in ((SECRET_KEYS, "[REDACTED]"), (PERSON_KEYS, "[ANONYMIZED]"), (REMOTE_KEYS, "[REDACTED_GIT_REMOTE]")):
            if kind in keys:
                return by
        if isinstance(x, str):
            return self.text(x)
        if isinstance(x, list):
            return [self.value(y) for y in x]
        if isinstance(x, dict):
            made = [(self.text(k), self.value(y, k)) for k, y in x.items()]
            if len({k for k, _ in made}) < len(made):
                raise ValueError("sanitization would collapse distinct JSON object keys")
            return dict(made)
        return x


def strings(x):
    """Every string value below x, depth first; keys are no values."""
    todo = [x]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif isinstance(x, dict):
            todo += list(x.values())[::-1]
        elif isinstance(x, list):
            todo += x[::-1]


def private_places(x, at: str = "$") -> list[str]:
    """Places of keys that a public file must not have."""
    if isinstance(x, dict):
        own = [f"{at}.{k}" for k in x if re.sub(r"[^a-z0-9]+", "_", k.strip().lower()).strip("_") in PRIVATE_KEYS]
        return own + [p for k, y in x.items() for p in private_places(y, f"{at}.{k}")]
    if isinstance(x, list):
        return [p for i, y in enumerate(x) for p in private_places(y, f"{at}[{i}]")]
    return []


def rtl_prints(x) -> list[str]:
    """SHA-1 of the normalised text of every string value that ends a module; sorted, distinct."""
    found = set()
    for s in strings(x):
        if "endmodule" in s:
            bare = re.sub(r"/\*.*?\*/", "", re.sub(r"//[^\n]*", "", s), flags=re.S)
            bare = re.sub(r"[ \t\n\x0b\f\r]+", " ", bare).strip(" ").lower()
            if bare:
                found.add(hashlib.sha1(bare.encode()).hexdigest())
    return sorted(found)


def _over(json_text: Column | str, fn, kind: str) -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fn(x) if isinstance(x, str) else None)

    return run(col(json_text))


def examined(json_text: Column | str, identifiers: dict[str, str] | None = None, people: tuple[str, ...] = (), internal: tuple[str, ...] = ()) -> Column:
    """struct(value, error, places): the sanitized document or why there is none, and the places of forbidden keys ('$' of text that is no JSON); each document is parsed once."""
    made = Sanitizer(identifiers, people, internal)

    def one(x):
        if not isinstance(x, str):
            return None, None, None
        try:
            doc = json.loads(x)
        except ValueError:
            return None, "no JSON", ["$"]
        places = private_places(doc)
        try:
            return json.dumps(made.value(doc), sort_keys=True, separators=(",", ":"), ensure_ascii=False), None, places
        except ValueError as e:
            return None, str(e), places

    of = pa.struct([("value", pa.string()), ("error", pa.string()), ("places", pa.list_(pa.string()))])

    @F.arrow_udf("struct<value: string, error: string, places: array<string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            if not len(s):
                yield pa.array([], of)
            for i in range(0, len(s), SLICE):
                yield pa.array([dict(zip(("value", "error", "places"), one(x), strict=True)) for x in s.slice(i, SLICE).to_pylist()], of)

    return run(col(json_text))


def sanitized(json_text: Column | str, identifiers: dict[str, str] | None = None, people: tuple[str, ...] = (), internal: tuple[str, ...] = ()) -> Column:
    """struct(value, error): the sanitized document, or why there is none."""
    got = examined(json_text, identifiers, people, internal)
    return F.struct(got["value"].alias("value"), got["error"].alias("error"))


def private_fields(json_text: Column | str) -> Column:
    """Places of forbidden keys; of text that is no JSON the place '$'."""

    def one(x: str):
        try:
            return private_places(json.loads(x))
        except ValueError:
            return ["$"]

    return _over(json_text, one, "array<string>")


def embedded_prints(json_text: Column | str) -> Column:
    """rtl_prints() of a JSON document; none of text that is no JSON."""

    def one(x: str):
        try:
            return rtl_prints(json.loads(x))
        except ValueError:
            return []

    return _over(json_text, one, "array<string>")
