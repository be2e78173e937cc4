"""Operator 13, fill-in-middle transformation by escaped marker injection.

A text is a row of units: runs of ASCII letters, and every other code point by itself.  A
delimiter is put behind each unit by one regexp_replace; where the text holds the delimiter itself
(or the escape) it is escaped first, and an escape counts as the one unit that it
stands for.  The number of delimiters is the number of units, substring_index takes the parts before, between and
behind two ranks, and what is left of delimiters and escapes in the parts is undone.  The parts
are then put in the order prefix, suffix, middle or suffix, prefix, middle, behind marks, or the text stays plain.

All of it is native columns over one row at a time: no shuffle, and a text is never held but by the task that has its row.

Defined results: a null text is an empty one, and plain; a null key is hashed as an empty string; rows equal in key and text get
equal results; a text that holds a mark is plain, so that restored() is always exact; very long texts are taken whole; columns of docs may have any
names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Delimiter and escape: control characters, which stand for themselves as one byte.
DELIMITER, ESCAPE = "\x01", "\x02"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    """Text without the delimiter: an escape and a digit stand for each delimiter and escape."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """What escaped() had, of a part between delimiters that may still stand between its units."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """Escaped text with the delimiter behind each unit."""
    return F.regexp_replace(escaped(text), f"([A-Za-z]+|{ESCAPE}[01]|[^A-Za-z])", f"$1{DELIMITER}")


def units(of_marked: Column) -> Column:
    """The number of units: that of delimiters."""
    return (F.length(of_marked) - F.length(F.replace(of_marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def _ranked(of_marked: Column, rank: Column) -> Column:
    """Before the delimiter of a rank, or behind it, counted from the end, if the rank is negative."""
    return F.call_function("substring_index", of_marked, F.lit(DELIMITER), rank.cast("int"))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four whole numbers below 2**32 from a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc (all columns of docs), n, form, prefix, middle, suffix (null if plain) and output for each row of docs (key, text).

    Of 100 texts about rate are cut at two ranks drawn by the key, and spm of 100 of those have the suffix first.
    """
    p, s, m = map(F.lit, marks)
    h1, h2, h3, h4 = draws(F.col("doc").getField(key), seed)
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    row = row.select("doc", text.alias("text"), marked(text).alias("marked"))
    row = row.select("doc", "text", "marked", units(F.col("marked")).alias("n"))
    row = row.select("*", F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("low"), F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("high"))
    plain = (F.col("n") == 0) | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (h3 % 100 >= rate)
    row = row.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    parts = {
        "prefix": _ranked(F.col("marked"), F.col("low")),
        "middle": _ranked(_ranked(F.col("marked"), F.col("high")), F.col("low") - F.col("high")),
        "suffix": _ranked(F.col("marked"), F.col("high") - F.col("n") - 1),
    }
    row = row.select("doc", "text", "n", "form", *[F.when(cut, unescaped(c)).alias(name) for name, c in parts.items()])
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm_form = F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_form).otherwise(F.col("text"))
    return row.select("doc", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that output was made of, read back from the marks."""
    p, s, m = marks

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc.doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
