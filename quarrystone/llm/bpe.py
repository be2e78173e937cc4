"""Operator 6, BPE encoding and decoding: exact ids by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding.  An automaton over
the vocabulary, with links from each state to its longest suffix in it, yields the
tokens that end at each place; a candidate is right if it is compatible with the
token that ends the prefix before it, that is if the merges would not run across the
seam earlier than they build the two.  The table of last tokens is followed back from
the end.  Short words are remembered, so that a word costs one search however often it comes.
The digest of the decoded text is taken from the ids, token by token.

Text is treated as the vocabulary file says: special tokens are cut out of the raw
text, the rest is NFC, white space becomes a space, letters become lower case, words are
split by the file's pattern and mapped byte by byte.

Defined results: null and empty text have no tokens; very long texts are encoded whole; equal rows get equal results;
columns of docs may have any names but those of the result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, texts_of, with_text

#: White space as the tokenizers library's regular expressions see it: a fixed value.
SPACE = r"\t-\r \x85\xa0  -     　"
SPACES = regex.compile(f"[{SPACE}]+")
#: Characters that Python's str.split() takes for space and the pattern does not, or the reverse.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


#: Longer pieces are not remembered, so that a worker's memory is bounded.
LONGEST = 32


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next letter from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes and decodes as the tokenizers library does with the file at path."""

    def __init__(self, spec: dict | str, cache_size: int = 200_000):
        """spec: the vocabulary file's contents, or its path."""
        if isinstance(spec, str):
            spec = read_vocabulary(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = letters
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # a token as a string of symbols: chr(byte), and chr(256 + byte) at the end of a word
        def symbols(token: str) -> str:
            last = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if last else token
            s = [byte_of[c] for c in body]
            return "".join(map(chr, s[:-1])) + chr(s[-1] + 256 * last)

        self.rank, self.parts, self.pair = {}, {}, {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.pair.setdefault((a, b), rank)
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), rank
        self.seams: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            s = symbols(token)
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        unreachable = [t for t, i in vocab.items() if not self._stands(i)]
        if unreachable:
            for t in unreachable:
                self.automaton.remove_word(symbols(t))
            self.automaton.make_automaton()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _stands(self, token: int) -> bool:
        """Whether the merges do build token from its own symbols: its two parts must meet at no earlier seam."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._stands(a) and self._stands(b) and self.compatible(a, b, self.rank[token])

    def compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether the encoding of a's and b's joined symbols keeps the seam between them (until merge number before).

        Walk back through the merges that build the right edge of a and the left edge of
        b, latest first: at each moment the two edge tokens must not have a merge that
        would run before the later of the merges that built them, or before the limit.
        """
        rank, pair = self.rank, self.pair
        until = before if before is not None else 1 << 62
        while True:
            met = pair.get((a, b))
            if met is not None and met < until:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # undo the later merge; of equal ones the left runs first, so a seam beats an equal merge to its right
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                until, b = rb + 1, self.parts[b][0]

    def ids_of(self, symbols: str) -> list[int]:
        n = len(symbols)
        last, start = [-1] * n, [0] * n
        seams = self.seams
        for end, (token, size) in self.automaton.iter(symbols):
            if last[end] >= 0:
                continue
            begin = end + 1 - size
            if begin:
                prev = last[begin - 1]
                if prev < 0:
                    continue
                key = prev << 20 | token
                ok = seams.get(key)
                if ok is None:
                    if len(seams) > 2_000_000:
                        seams.clear()
                    ok = seams[key] = self.compatible(prev, token)
                if not ok:
                    continue
            last[end], start[end] = token, begin
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = start[at] - 1
        return out[::-1]

    def word(self, piece: str) -> bytes:
        got = self.words.get(piece)
        if got is None:
            data = piece.encode("utf-8", "surrogatepass")
            ids = self.ids_of(data[:-1].decode("latin-1") + chr(256 + data[-1]))
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= LONGEST:
                if len(self.words) >= self.cache_size:
                    self.words.clear()
                self.words[piece] = got
        return got

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pattern.findall(text)))

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if ODD_SPACE.search(text):
            return self.chunk(SPACES.sub(" ", text))
        chunks, out = self.chunks, []
        for c in text.split():
            got = chunks.get(c)
            if got is None:
                got = self.chunk(c)
                if len(c) <= LONGEST:
                    if len(chunks) >= self.cache_size:
                        chunks.clear()
                    chunks[c] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self.plain(text)
        return b"".join(struct.pack("<I", self.special[s]) if s in self.special else self.plain(s) for s in self.cut.split(text) if s)

    def decode(self, ids) -> str:
        return " ".join(map(self.text_of.__getitem__, ids))


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_encoders: dict[str, Encoder] = {}


def encoder(digest: str, shared) -> Encoder:
    """This worker's encoder of the vocabulary that was shipped as shared."""
    if digest not in _encoders:
        _encoders.clear()
        _encoders[digest] = Encoder(json.loads(zlib.decompress(shared.value)))
    return _encoders[digest]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str, keep: list[str], digests: bool = True, ids: bool = False) -> DataFrame:
    """The columns keep of docs with n_tokens, and the digests or the ids themselves (array of int)."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType())])
    if digests:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))

    raw = json.dumps(read_vocabulary(path)).encode()
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(raw))  # one vocabulary file: executors need not reach it
    digest = hashlib.sha256(raw).hexdigest()

    def run(batch: pa.RecordBatch):
        enc = encoder(digest, shared)
        got = [enc.encode(t) for t in texts_of(batch)]
        cols = [batch.column(k) for k in keep] + [pa.array([len(g) // 4 for g in got], pa.int64())]
        if digests:
            cols.append(pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()))
            cols.append(pa.array([hashlib.sha256(enc.decode(np.frombuffer(g, "<u4").tolist()).encode()).hexdigest() for g in got], pa.string()))
        if ids:
            ends = np.cumsum([0, *[len(g) // 4 for g in got]]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(got), "<i4")))
        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return with_text(docs, keep).mapInArrow(batches(run), schema)


def op6_bpe_encode(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path(), ["doc_id"])
