"""Payload scans: kinds, places, files read by their suffix."""

import random
import re

from quarrystone.functions import payload as P
from quarrystone.functions.text import DETECTORS

PLANTED = {
    "provider API key": "sk-" + "a" * 24, "NVIDIA API key": "nvapi-" + "b" * 20, "AWS access key": "AKIA" + "C" * 16, "GitHub token": "ghp_" + "d" * 32, "Slack token": "xoxb-" + "e" * 24, "Google API key": "AIza" + "f" * 32, "private key": "-----BEGIN EC PRIVATE KEY-----",
    "credential-bearing URL": "https://u:p@", "authorization credential": "Authorization: Basic " + "g" * 16, "bearer credential": "Bearer " + "h" * 24, "POSIX home path": "/home/u/x", "Windows home path": "C:\\Users\\u\\x", "ephemeral/workspace absolute path": "/mnt/data/x1", "literal IPv4 endpoint": "10.2.3.4", "e-mail address": "a@b.org",
    "organization identifier": "NVIDIA", "personal serving endpoint": "abc--my-app.modal.run", "home folder": "/Users/u/", "reasoning tag": "</ think >",
}


def test_the_prefilter_hides_nothing():
    """Against every pattern on its own, over texts of planted pieces, halves of them and bytes that are no text."""
    rng = random.Random(1)
    scanner = P.Scanner()
    patterns = {**DETECTORS, **P.TEXT_DETECTORS, "reasoning tag": P.REASONING_TAG}
    pieces = list(PLANTED.values())
    for trial in range(400):
        data = "".join(rng.choice([rng.choice(pieces), rng.choice(pieces)[: rng.randint(1, 12)], " ", "é", "\n", "x", "/"]) for _ in range(rng.randint(0, 12))).encode()
        data += b"\xff" * (trial % 5 == 0)
        want = {(k, m.start(), m.end()) for k, p in patterns.items() if trial % 5 or k not in P.TEXT_DETECTORS for m in re.finditer(p.encode(), data)}
        assert {f[:3] for f in scanner.places("a.txt", data)} == want
    assert {k for k in PLANTED for f in scanner.places("x", f" {PLANTED[k]} ".encode()) if f[0] == k} == set(PLANTED)


def test_allowed_kinds_and_paths():
    data = b"NVIDIA <think> a@b.org"
    kinds = lambda s, path="x.txt": {f[0] for f in s.places(path, data)}
    assert kinds(P.Scanner()) == {"organization identifier", "reasoning tag", "e-mail address"}
    assert kinds(P.Scanner(("organization identifier",), r"^docs/"), "docs/a.md") == {"e-mail address"}


def test_files_by_their_suffix(spark, tmp_path):
    root = tmp_path / "release"
    (root / "data").mkdir(parents=True)
    files = {
        "a.json": b'{"rows": [{"Chain of Thought": 1}]}', "b.jsonl": b'{"x": 1}\n\n{"y": {"raw-response": 2}}\n', "c.json": b"{no", "d.csv": b"id,Thinking\n1,2\n", "e.tsv": b"\xef\xbb\xbfid\tscratchpad\n", "f.csv": b'a,b\n"x"y,2\n', "g.txt": b"Thinking, raw_response", "h.json": b"\xff", "data/i.csv": b"", "data/j.bin": b"\x00\xff sk-" + b"a" * 30,
    }
    for name, data in files.items():
        (root / name).write_bytes(data)
    got = {(r["path"], r["kind"], r["location"]) for r in P.scan_files(spark, str(root)).collect()}
    assert got == {
        ("a.json", "private field", "$.rows[0].Chain of Thought"), ("b.jsonl", "private field", "$line[2].y.raw-response"), ("c.json", "malformed structured data", None), ("d.csv", "private column", "column 2 (Thinking)"),
        ("e.tsv", "private column", "column 2 (scratchpad)"), ("f.csv", "malformed tabular data", None), ("h.json", "malformed structured data", None), ("data/j.bin", "provider API key", None),
    }


def test_columns_take_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, bytearray(b"a@b.org")), ("c.json", bytearray(b""))], "p string, c binary")
    got = [r[0] and [x["kind"] for x in r[0]] for r in df.select(P.payload_places("p", "c")).collect()]
    assert got == [None, ["e-mail address"], ["malformed structured data"]]
