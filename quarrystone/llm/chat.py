"""Operator 1, chat formatting: typed content parts become one string per conversation.

Native: DataFrame functions only.  A visitor over the parts of each turn flattens
text, image, audio and document parts into ordered text with placeholders, and
records for every attachment its reference, place and expanded token count.

Template, for each turn in order: ``<|turn|>ROLE\\nBODY<|end|>\\n``.  Control strings
inside texts get one more backslash after their first character, however many
they had, so that taking one away restores the text.  Neighbouring text parts are joined before
they are escaped, so that a control string dealt over several parts is none either, and
placeholders are put in after that, so that no text can make or break one.

Defined results: null text is empty; a null role is an empty role; turns are
ordered by (turn, role, text), nulls first, so that ties and repeated rows give one
result (a repeated row is a repeated turn); rows with a null conv_id form one
conversation whose id is null; an empty table gives no rows; columns that are not asked for are
left out, so their names cannot clash.  A conversation is one record of the output, so it
is held by one task, as large as its own string, and so are very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: What follows the first character of a control string, of this template and of widespread others: fixed values.
REST = r"\|\w{1,32}\|>|/?s>|/?INST\]|</?SYS>>"
#: Stands with a letter behind it for placeholders while texts are escaped (no control string holds it), and for itself.
MARK = "\x01"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*)({REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({REST})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expanded_tokens(p: Column, patch: int, audio_rate: int, page_tokens: int) -> Column:
    """Tokens that a placeholder stands for: image patches, audio frames, document pages."""
    image = F.ceil(F.coalesce(p["width"], F.lit(patch)) / F.lit(patch)) * F.ceil(F.coalesce(p["height"], F.lit(patch)) / F.lit(patch))
    audio = F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate))
    document = F.greatest(F.lit(1), F.coalesce(p["pages"], F.lit(1))).cast("long") * page_tokens
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).otherwise(document).cast("long")


def format_conversations(df: DataFrame, assistant: str = "assistant", patch: int = 28, audio_rate: int = 25, page_tokens: int = 256) -> DataFrame:
    """df: conv_id, turn, role and either text or parts (type PARTS).

    Returns conv_id, n_turns, formatted, loss (array of start, length in code points
    of formatted: the assistant bodies) and attachments (array of turn_no, part_no,
    kind, ref, n_tokens).  A part of an unknown type is text; null parts give nothing.
    """
    null = lambda kind: F.lit(None).cast(kind)
    if "parts" in df.columns:
        parts = F.coalesce(F.filter(F.col("parts").cast(PARTS), lambda p: p.isNotNull()), F.array().cast(PARTS))
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))
    kinds = list(PLACEHOLDER)

    def flat(p: Column) -> Column:
        out = F.when(F.lit(False), "")
        for kind in kinds:
            out = out.when(p["type"] == kind, MARK + kind[0])
        return out.otherwise(F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(f"{MARK}=")))

    body = escape(F.array_join(F.transform("parts", flat), ""))
    for kind, shown in [*PLACEHOLDER.items(), ("=", MARK)]:
        body = F.replace(body, F.lit(MARK + kind[0]), F.lit(shown))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("body", body)
    rows = rows.withColumn("head", F.concat(F.lit(TURN), _role_out(F.col("role")), F.lit("\n")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END)))
    rows = rows.withColumn(
        "found",
        F.filter(
            F.transform("parts", lambda p, i: F.struct(i.alias("part_no"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, patch, audio_rate, page_tokens).alias("n_tokens"))),
            lambda a: a["kind"].isin(kinds),
        ),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("no", F.row_number().over(order) - 1).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    got = rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("no", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == assistant, F.struct((F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))).alias("loss"),
        F.array_sort(F.collect_list(F.struct("no", "found"))).alias("found"),
    )
    return got.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"),
        "loss",
        F.flatten(F.transform("found", lambda t: F.transform(t["found"], lambda a: F.struct(t["no"].alias("turn_no"), a["part_no"], a["kind"], a["ref"], a["n_tokens"])))).alias("attachments"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns read back from a formatted string: array of struct(role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda s: F.length(s) > 0)

    def turn(s: Column) -> Column:
        head = F.substring_index(s, "\n", 1)
        body = F.substring(s, F.length(head) + 2, F.length(s) - F.length(head) - 1 - len(END))
        return F.struct(_role_in(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    made = made.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("kept", loss_text(F.col("formatted"), F.col("loss")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("kept").cast("long").alias("loss_chars"),
        F.sha2(F.col("kept"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
    )


_SQL_ESCAPE = r"regexp_replace({}, '(<|\[)(\\*)(\|\w{{1,32}}\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"
ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_SQL_ESCAPE.format('text')} AS body,
        {_SQL_ESCAPE.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} AS r FROM rows),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '') AS loss,
        sum(8 + length(r) + 1 + length(body) + 8) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars, 0::BIGINT AS n_attachments FROM g
"""
