"""Replacement of many names in one pass: the leftmost, and of those the longest, on word edges."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all names that an automaton is built of; a larger table is joined.
AUTOMATON = 32_000_000
_WORD = re.compile(r"\w+")


def on_edges(text: str, begin: int, end: int) -> bool:
    """Whether a name at text[begin:end] ends no word in its middle."""
    word = lambda i: text[i].isalnum() or text[i] == "_"
    return not (begin and word(begin - 1) and word(begin)) and not (end < len(text) and word(end - 1) and word(end))


def resolved(text: str, found: list[tuple[int, int, str]]) -> tuple[str, int]:
    """The text with found (begin, end, new) put in, leftmost first and longest of one beginning, none over another; and how many were."""
    out, at, n = [], 0, 0
    for begin, end, new in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
        if begin >= at:
            out += [text[at:begin], new]
            at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def replace_names(texts: DataFrame, text: str, names: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """texts with replaced (its text without the names) and n_replaced; of several new forms of a name the least counts.

    Up to AUTOMATON characters of names go to the tasks as one automaton, which reads every text once.  A larger table is joined on the
    first word of each name: on word edges a name's first word is a word of the text.  Names that have no word are an error.
    """
    listed = names.where(F.length(old) > 0).groupBy(F.col(old).alias("old")).agg(F.min(new).alias("new"))
    if listed.where(~F.col("old").rlike(r"(?U)\w")).limit(1).count():
        raise ValueError("a name without a word")
    if (listed.agg(F.sum(F.length("old"))).first()[0] or 0) > AUTOMATON:
        return _joined(texts, text, listed)
    shared = texts.sparkSession.sparkContext.broadcast([(r["old"], r["new"]) for r in listed.collect()])  # of bounded size

    @F.pandas_udf("replaced string, n_replaced int")
    def run(column: pd.Series) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for a, b in shared.value:
            automaton.add_word(a, (len(a), b))
        automaton.make_automaton()
        rows = []
        for t in column:
            if t is None or not shared.value:
                rows.append((t, None if t is None else 0))
                continue
            hits = [(end - size + 1, end + 1, b) for end, (size, b) in automaton.iter(t)]
            rows.append(resolved(t, [h for h in hits if on_edges(t, h[0], h[1])]))
        return pd.DataFrame(rows, columns=["replaced", "n_replaced"], dtype=object)

    return texts.withColumn("_r", run(text)).select("*", "_r.*").drop("_r")


def _joined(texts: DataFrame, text: str, listed: DataFrame) -> DataFrame:
    """replace_names() for any number of names; equal texts are looked through once."""
    first = F.regexp_extract("old", r"(?U)(\w+)", 1)
    known = listed.select("old", "new", first.alias("word"), (F.instr("old", first) - 1).alias("offset"))
    own = texts.select(F.col(text).alias("t")).where("t IS NOT NULL").distinct().select("t", F.md5("t").alias("k"))

    @F.pandas_udf("array<struct<word:string,at:int>>")
    def words(column: pd.Series) -> pd.Series:
        return pd.Series([[{"word": m[0], "at": m.start()} for m in _WORD.finditer(t)] for t in column])

    # a word of many texts or names is split by Spark's handling of skewed joins
    placed = own.select("k", F.explode(words("t")).alias("w")).select("k", "w.word", "w.at")
    near = placed.join(known, "word").select("k", F.struct((F.col("at") - F.col("offset")).alias("begin"), "old", "new").alias("f"))
    found = near.groupBy("k").agg(F.collect_list("f").alias("found"))  # the candidates of one text

    @F.pandas_udf("replaced string, n_replaced int")
    def put(column: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = []
        for t, fs in zip(column, hits, strict=True):
            spans = [(f["begin"], f["begin"] + len(f["old"]), f["new"]) for f in (fs if fs is not None else []) if f["begin"] >= 0 and t.startswith(f["old"], f["begin"])]
            rows.append(resolved(t, [s for s in spans if on_edges(t, s[0], s[1])]))
        return pd.DataFrame(rows, columns=["replaced", "n_replaced"], dtype=object)

    done = own.join(found, "k", "left").select("k", put("t", "found").alias("r"))
    keyed = texts.withColumn("_k", F.md5(text)).join(done.withColumnRenamed("k", "_k"), "_k", "left")
    return keyed.select(*texts.columns, "r.replaced", "r.n_replaced")
