"""Queries that compare documents, locate changed lines, judge annotations and replace names, over the texts of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import annotations as A
from ..functions import diffs, prompts
from ..functions import json_tree as J
from ..functions import text as T
from ..functions.payload import payload_places
from ..operators import documents as D
from ..operators import names as N
from .registry import query
from .text_queries import _sql_sanitize

_SPLIT = [("/name", "'equal'"), ("/balance", "CASE k WHEN 0 THEN 'within' WHEN 1 THEN 'changed' ELSE 'equal' END"), ("/nation/key", "CASE k WHEN 5 THEN 'type' ELSE 'equal' END"), ("/nation/segment", "CASE k WHEN 2 THEN 'missing' ELSE 'equal' END"), ("/marks/0", "'equal'"), ("/marks/1", "CASE k WHEN 4 THEN 'missing' ELSE 'equal' END"), ("/note", "CASE k WHEN 3 THEN 'extra' END")]


@query("WITH r AS (SELECT c_custkey % 7 AS k FROM customer) SELECT path, status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{path}' AS path, {status} AS status FROM r" for path, status in _SPLIT) + ") WHERE status IS NOT NULL GROUP BY ALL")
def document_equality(table, spark, sf):
    """A nested document of each customer against one with a number moved, a field gone, new or of another type, or a shorter list."""
    k = F.col("c_custkey") % 7
    text = lambda balance, key, segment, marks, note: F.to_json(F.struct(F.col("c_name").alias("name"), balance.alias("balance"), F.struct(key.alias("key"), segment.alias("segment")).alias("nation"), marks.alias("marks"), note.alias("note")))
    two, one = F.array("c_custkey", F.col("c_nationkey").cast("long")), F.array("c_custkey")
    none = F.lit(None).cast("string")
    customers = table("customer")
    balance, key, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    left = customers.select("c_custkey", text(balance, key, segment, two, none).alias("json"))
    moved = F.when(k == 0, balance + 0.001).when(k == 1, balance + 5).otherwise(balance)
    same = text(moved, key, F.when(k != 2, segment), F.when(k == 4, one).otherwise(two), F.when(k == 3, F.lit("new")))
    typed = text(moved, key.cast("string"), segment, two, none)
    right = customers.select("c_custkey", F.when(k == 5, typed).otherwise(same).alias("json"))
    return D.compared(left, right, "c_custkey", "json", [("^/balance$", 0.01, 0)]).groupBy("path", "status").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) END AS l FROM documents),
p AS (SELECT doc_id, l, (doc_id % greatest(len(l), 1))::BIGINT + 1 AS p, CASE WHEN len(l) = 0 OR doc_id % 7 = 0 THEN 'no hunk' WHEN doc_id % 5 = 0 THEN '2 lines are put in, not one' WHEN doc_id % 11 = 0 THEN '0 lines are put in, not one' END AS error FROM d)
SELECT doc_id, CASE WHEN error IS NULL THEN p::INTEGER END AS old_line, CASE WHEN error IS NULL THEN md5(l[p]) END AS old_md5, CASE WHEN error IS NULL THEN p::INTEGER END AS new_line, CASE WHEN error IS NULL THEN md5('X' || l[p]) END AS new_md5, error FROM p""")
def diff_targets(table, spark, sf):
    """The one line that a diff of each document changes; in some documents none, or one is taken away or two put in."""
    docs = table("documents").select("doc_id", T.lines("text").alias("l"))
    n, key = F.size("l"), F.col("doc_id")
    at = (key % F.greatest(n, F.lit(1))).cast("int")
    line = lambda x, i: F.when(i != at, F.array(x)).when(key % 5 == 0, F.array(F.concat(F.lit("X"), x), F.lit("Y"))).when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("X"), x)))
    text = lambda lines: F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    both = docs.select("doc_id", text(F.col("l")).alias("old"), text(F.when(key % 7 == 0, F.col("l")).otherwise(F.flatten(F.transform("l", line)))).alias("new"))
    got = both.select("doc_id", diffs.made_target("old", "new").alias("t"))
    return got.select("doc_id", "t.old_line", F.md5("t.old_text").alias("old_md5"), "t.new_line", F.md5("t.new_text").alias("new_md5"), "t.error")


_LABELS = ["explicit", "implied", "absent"]


@query(r"""WITH d AS (SELECT doc_id, doc_id % 12 AS k, text, substr(text, (1 + doc_id % 40)::BIGINT, 25) AS clause, substr(text, 1, (doc_id % 40)::BIGINT) || substr(text, (26 + doc_id % 40)::BIGINT) AS rest FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t, trim(rest, chr(32) || chr(9) || chr(10) || chr(13)) AS r, trim(clause, chr(32) || chr(9) || chr(10) || chr(13)) AS c FROM d)
SELECT doc_id, CASE k WHEN 0 THEN 'no annotation' WHEN 1 THEN 'annotator_id is incomplete' WHEN 2 THEN 'intent_label is none of the labels' WHEN 3 THEN 'redactable_without_hint is neither true nor false'
WHEN 4 THEN CASE WHEN rest <> '' OR clause <> '' THEN 'not redactable, but with a redaction' END
WHEN 5 THEN 'redacted_spec is missing'
WHEN 6 THEN CASE WHEN r = '' THEN 'redacted_spec is missing' WHEN clause <> '' THEN 'absent, but a clause is removed' WHEN r <> t THEN 'absent, but the text is changed' END
WHEN 7 THEN CASE WHEN r = '' THEN 'redacted_spec is missing' WHEN r <> t THEN 'absent, but the text is changed' END
WHEN 8 THEN CASE WHEN t = '' THEN 'redacted_spec is missing' ELSE 'the text is not changed' END
WHEN 9 THEN CASE WHEN r = '' THEN 'redacted_spec is missing' WHEN r = t THEN 'the text is not changed' ELSE 'minimal_removed_clause is missing' END
WHEN 10 THEN CASE WHEN r = '' THEN 'redacted_spec is missing' WHEN r = t THEN 'the text is not changed' ELSE 'not one exact clause is removed' END
ELSE CASE WHEN r = '' THEN 'redacted_spec is missing' WHEN r = t THEN 'the text is not changed' WHEN c = '' THEN 'minimal_removed_clause is missing' END END AS error FROM s""")
def annotation_refusals(table, spark, sf):
    """An annotation of each document that removes 25 characters, and eleven kinds of wrong ones."""
    key, text = F.col("doc_id"), F.col("text")
    k, at = key % 12, (key % 40).cast("int")
    clause = F.substring(text, at + 1, F.lit(25))
    rest = F.concat(F.left(text, at), F.substring(text, at + 26, F.length(text)))
    given = F.struct(
        F.when(k == 1, "\t ").otherwise("reader").alias("annotator_id"),
        F.when(k == 2, "unsure").when(k.isin(6, 7), "absent").otherwise("implied").alias("intent_label"),
        F.when(k != 3, k != 4).alias("redactable_without_hint"),
        F.when(k == 5, " \n").when(k == 8, text).otherwise(rest).alias("redacted_spec"),
        F.when(k.isin(7, 9), "").when(k == 10, F.concat(clause, F.lit("\x00"))).otherwise(clause).alias("minimal_removed_clause"),
    )
    docs = table("documents").where("text IS NOT NULL").select("doc_id", "text", F.when(k != 0, given).alias("a"))
    return docs.select("doc_id", A.annotation_error("a", "text", _LABELS).alias("error"))


@query(r"""WITH n AS (SELECT DISTINCT x AS old, '<' || upper(x) || '>' AS new FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS x FROM benchmark)),
t AS (SELECT doc_id, x, i FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM documents WHERE text <> '')))
SELECT doc_id, count(old) AS n_replaced, md5(string_agg(coalesce(new, x), '' ORDER BY i)) AS replaced_md5 FROM t LEFT JOIN n ON n.old = t.x GROUP BY doc_id""")
def renamed_texts(table, spark, sf):
    """Every word of the benchmark of five small letters or more, as a name in the documents."""
    words = table("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"))).alias("old")).distinct()
    listed = words.withColumn("new", F.concat(F.lit("<"), F.upper("old"), F.lit(">")))
    got = N.replace_names(table("documents").where("text <> ''").select("doc_id", "text"), "text", listed)
    return got.select("doc_id", F.col("n_replaced").cast("long").alias("n_replaced"), F.md5("replaced").alias("replaced_md5"))


#: A piece for some kinds, put behind each document; and for each kind a pattern for SQL, whose group 2 is the finding and group 1 what may stand before it.
_PIECES = ["sk-" + "a" * 24, "ghp_" + "c" * 32, "xoxb-" + "d" * 24, "AIza" + "e" * 32, "https://u:p@h/", "/home/u/x", "NVIDIA", "abc--my-app.modal.run", "</think >", "<Reasoning mode=1>"]
_FOUND = {
    "provider API key": r"(^|[^A-Za-z0-9])(sk-[A-Za-z0-9_-]{20,})",
    "GitHub token": r"(^|[^A-Za-z0-9])(gh[opsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "Slack token": r"(^|[^A-Za-z0-9])(xox[baprs]-[A-Za-z0-9-]{20,})",
    "Google API key": r"(^|[^A-Za-z0-9])(AIza[0-9A-Za-z_-]{30,})",
    "credential-bearing URL": r"(?i)()(https?://[^/\s:@]+:[^/\s@]+@)",
    "POSIX home path": r"(^|[^A-Za-z0-9])(/(?:Users|home)/[A-Za-z0-9._-]+/[^\s\"''<>]+)",
    "home folder": r"()(/(?:Users|home)/[A-Za-z0-9._-]+/)",
    "organization identifier": r"(?i)()(\bnvidia\b|\bnvcf\b|\bngc\b)",
    "personal serving endpoint": r"(^|[^<\w-])([a-z0-9]{3,}--[a-z0-9-]+\.modal\.run)",
    "reasoning tag": r"(?i)()(<\s*/?\s*(?:think|analysis|reasoning)(?:\s+[^>]*)?\s*>)",
    "e-mail address": r"()([\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
}
_PIECE_LIST = ", ".join(f"'{x}'" for x in _PIECES)


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') || ' ' || ([{_PIECE_LIST}])[1 + doc_id % {len(_PIECES)}] AS t FROM documents), f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(t, '{p}', 2) AS found FROM d" for k, p in _FOUND.items()) + ") SELECT doc_id, kind, len(found)::BIGINT AS n_places, list_sum(list_transform(found, lambda x: strlen(x)))::BIGINT AS n_bytes FROM f WHERE len(found) > 0")
def payload_findings(table, spark, sf):
    """How many findings of each kind the bytes of every document hold, and how long they are, with a piece put behind each."""
    piece = F.get(F.array(*[F.lit(x) for x in _PIECES]), (F.col("doc_id") % len(_PIECES)).cast("int"))
    content = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), piece), "UTF-8")
    docs = table("documents").select("doc_id", content.alias("content"))
    places = docs.select("doc_id", F.explode(payload_places(F.lit("document.txt"), F.col("content"))).alias("f")).select("doc_id", "f.*")
    return places.where(F.col("kind").isin(list(_FOUND))).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_places"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))


@query(rf"""WITH d AS (SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), 150) AS p, 'module ' || lang || '_' || doc_id || '; endmodule' AS c FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN c WHEN 1 THEN c END AS code, trim(p) AS explanation FROM d WHERE p <> ''""")
def document_answers(table, spark, sf):
    """Answers that explain with the words of each document: with code tagged behind an untagged block, untagged, of another language, or none."""
    said = F.trim(F.left(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " ")), F.lit(150)))
    code = F.concat(F.lit("module "), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("; endmodule"))
    fence = lambda tag, body: F.concat(F.lit(f"\n```{tag}\n"), body, F.lit("\n```\n"))
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat("p", fence("", F.lit("x")), fence("verilog", code))).when(kind == 1, F.concat("p", fence("", code), fence("py", F.lit("y")))).when(kind == 2, F.concat("p", fence("py", F.lit("module")))).otherwise(F.col("p"))
    made = prompts.explanation_and_code(text)
    return table("documents").withColumn("p", said).where("p <> ''").select("doc_id", made["code"].alias("code"), made["explanation"].alias("explanation"))


@query(rf"""SELECT doc_id, md5({_sql_sanitize('text')}) AS note_md5, '[ANONYMIZED]' AS author, CASE WHEN lang = 'de' THEN '$.more[0].raw response' ELSE '' END AS private FROM documents WHERE text IS NOT NULL""")
def sanitized_documents(table, spark, sf):
    """Every document as a value of a nested record: its text redacted, its source hidden, forbidden fields found."""
    more = F.array(F.struct(F.when(F.col("lang") == "de", F.col("lang")).alias("raw response"), F.col("n_chars").alias("n")))
    doc = F.to_json(F.struct(F.col("source").alias("author"), F.struct(F.col("text").alias("note")).alias("body"), more.alias("more")))
    got = table("documents").where("text IS NOT NULL").select("doc_id", J.examined(doc).alias("x")).select("doc_id", F.col("x.value").alias("clean"), F.array_join("x.places", ",").alias("private"))
    return got.select("doc_id", F.md5(F.get_json_object("clean", "$.body.note")).alias("note_md5"), F.get_json_object("clean", "$.author").alias("author"), "private")
