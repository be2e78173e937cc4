"""Scans of payloads before they are published: every finding with its kind and place, in one pass over the bytes.

An automaton over the strings that detectors need says which of them can match at all; only their patterns run.  Structured and tabular
files are read as such by their suffix, and names of fields that must not be published are findings too.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_tree import PRIVATE_KEYS, private_places
from .text import DETECTORS, NEEDED

#: Detectors of texts only, and of tags: label and pattern.  Fixed values.
TEXT_DETECTORS = {
    "organization identifier": r"(?i)\bnvidia\b|\bnvcf\b|\bngc\b",
    "personal serving endpoint": r"(?<![<\w-])[a-z0-9]{3,}--[a-z0-9-]+\.modal\.run",
    "home folder": r"/(?:Users|home)/(?!<)[A-Za-z0-9._-]+/",
}
REASONING_TAG = r"(?i)<\s*/?\s*(?:think|analysis|reasoning)(?:\s+[^>]*)?\s*>"
#: What a match of these holds, in lower case.
_NEEDED = NEEDED | {
    "organization identifier": ["nvidia", "nvcf", "ngc"],
    "personal serving endpoint": [".modal.run"],
    "home folder": ["/users/", "/home/"],
    "reasoning tag": ["think", "analysis", "reasoning"],
    "ephemeral/workspace absolute path": ["/private/", "/var/folders/", "/volumes/", "/root/", "workspace", "/runner/_work/", "/mnt/"],
}
PLACES = "array<struct<kind:string,start:long,end:long,location:string>>"


class Scanner:
    """places() of a payload: (kind, start, end, location); kinds in allowed are passed over, and reasoning tags where tags_allowed finds the path."""

    def __init__(self, allowed: tuple[str, ...] = (), tags_allowed: str | None = None):
        import ahocorasick

        kinds = {**DETECTORS, **TEXT_DETECTORS, "reasoning tag": REASONING_TAG}
        self.patterns = {k: re.compile(p.encode()) for k, p in kinds.items() if k not in allowed}
        self.tags_allowed = re.compile(tags_allowed) if tags_allowed else None
        of: dict[str, list[str]] = {}
        for kind in self.patterns:
            for literal in _NEEDED.get(kind, ()):
                of.setdefault(literal, []).append(kind)
        self.always = {k for k in self.patterns if k not in _NEEDED}
        self.automaton = ahocorasick.Automaton()
        for literal, own in of.items():
            self.automaton.add_word(literal, own)
        self.automaton.make_automaton()

    def places(self, path: str, payload: bytes) -> list[tuple[str, int, int, str | None]]:
        wanted = set(self.always)
        for _, own in self.automaton.iter(payload.lower().decode("latin-1")):
            wanted.update(own)
        try:
            text = payload.decode("utf-8")
        except UnicodeDecodeError:
            text = None
            wanted -= TEXT_DETECTORS.keys()
        if self.tags_allowed and self.tags_allowed.search(path):
            wanted.discard("reasoning tag")
        found = [(kind, m.start(), m.end(), None) for kind in sorted(wanted) for m in self.patterns[kind].finditer(payload)]
        suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
        whole = (0, len(payload))
        if suffix in ("json", "jsonl", "ndjson"):
            found += [(kind, *whole, at) for kind, at in _structured(suffix, text)]
        elif suffix in ("csv", "tsv"):
            found += [(kind, *whole, at) for kind, at in _tabular(suffix, payload)]
        return found


def _structured(suffix: str, text: str | None) -> list[tuple[str, str | None]]:
    try:
        if text is None:
            raise ValueError
        if suffix == "json":
            return [("private field", p) for p in private_places(json.loads(text))]
        lines = [(i, x) for i, x in enumerate((x for x in text.splitlines() if x.strip()), 1)]
        return [("private field", p) for i, x in lines for p in private_places(json.loads(x), f"$line[{i}]")]
    except ValueError:
        return [("malformed structured data", None)]


def _tabular(suffix: str, payload: bytes) -> list[tuple[str, str | None]]:
    try:
        rows = csv.reader(io.StringIO(payload.decode("utf-8-sig"), newline=""), delimiter="\t" if suffix == "tsv" else ",", strict=True)
        head = next(rows, [])
        for _ in rows:  # quoting that is wrong further on is found as well
            pass
    except (UnicodeDecodeError, csv.Error):
        return [("malformed tabular data", None)]
    return [("private column", f"column {i} ({key})") for i, key in enumerate(head, 1) if re.sub(r"[^a-z0-9]+", "_", key.strip().lower()).strip("_") in PRIVATE_KEYS]


def payload_places(path: Column | str, content: Column | str, allowed: tuple[str, ...] = (), tags_allowed: str | None = None) -> Column:
    """array of struct(kind, start, end, location) of binary content: byte places, end exclusive."""

    @F.pandas_udf(PLACES)
    def run(paths: pd.Series, contents: pd.Series) -> pd.Series:
        scanner = Scanner(allowed, tags_allowed)
        return pd.Series([None if c is None else [dict(zip(("kind", "start", "end", "location"), f, strict=True)) for f in scanner.places(p or "", bytes(c))] for p, c in zip(paths, contents, strict=True)])

    return run(path, content)


def scan_files(spark: SparkSession, root: str, glob: str = "*", **options) -> DataFrame:
    """path (below root), kind, start, end, location of every finding in the files of a folder; one file is one row of one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    under = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    rows = files.select(under.alias("path"), "content")
    return rows.select("path", F.explode(payload_places(F.col("path"), F.col("content"), **options)).alias("f")).select("path", "f.*")
