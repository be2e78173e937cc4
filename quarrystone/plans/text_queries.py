"""Queries over texts: normalising, extracting, duplicates, decontamination, redaction, scanning, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diffs
from ..functions import rtl as R
from ..functions import text as T
from ..operators import datagen as D
from ..operators import gates as G
from ..operators.sampling import quota_sample
from .registry import query

_COLLAPSE = r"lower(trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"


def _prints(df, least: int = 1):
    """Fingerprints of prose: the whole normalised text, and each of its lines of at least so many characters."""
    lines = F.filter(F.transform(T.lines("text"), T.collapse), lambda x: F.length(x) >= least)
    return df.withColumn("texts", F.array(F.sha1(T.collapse("text")))).withColumn("lines", F.transform(lines, F.sha1))


_REASONS = rf"""
WITH n AS (SELECT doc_id, {_COLLAPSE.format('text')} AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format('x')}), lambda x: length(x) >= 1) AS l FROM documents),
b AS (SELECT item_id, {_COLLAPSE.format('text')} AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_COLLAPSE.format('x')}), lambda x: length(x) >= 1) AS l FROM benchmark),
r AS (SELECT DISTINCT doc_id, 'text_hash' AS reason FROM n WHERE t IN (SELECT t FROM b)
 UNION SELECT DISTINCT doc_id, 'line_hash' FROM (SELECT doc_id, unnest(l) AS x FROM n) WHERE x IN (SELECT unnest(l) FROM b))"""


@query(_REASONS + " SELECT doc_id, array_to_string(list_sort(list(reason)), ',') AS reasons FROM r GROUP BY doc_id")
def decontaminate_reasons(table, spark, sf):
    got = D.fingerprint_reasons(_prints(table("documents")), _prints(table("benchmark")), "doc_id", {"text_hash": "texts", "line_hash": "lines"})
    return got.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(_REASONS + " SELECT d.doc_id, d.source, md5(d.text) AS text_md5 FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM r)")
def decontaminate_clean(table, spark, sf):
    docs = table("documents")
    clean, _ = D.decontaminate(docs, D.fingerprint_reasons(_prints(docs), _prints(table("benchmark")), "doc_id", {"text_hash": "texts", "line_hash": "lines"}), "doc_id")
    return clean.select("doc_id", "source", F.md5("text").alias("text_md5"))


@query(_REASONS + " SELECT reason, count(*) AS n FROM r GROUP BY reason")
def decontaminate_counts(table, spark, sf):
    docs = table("documents")
    return D.decontaminate(docs, D.fingerprint_reasons(_prints(docs), _prints(table("benchmark")), "doc_id", {"text_hash": "texts", "line_hash": "lines"}), "doc_id")[1]


@query(rf"""SELECT d.doc_id, b.item_id FROM (SELECT doc_id, {_COLLAPSE.format('text')} AS t FROM documents) d
JOIN (SELECT item_id, {_COLLAPSE.format('text')} AS t FROM benchmark) b ON contains(d.t, b.t) WHERE length(b.t) > 0""")
def containment(table, spark, sf):
    items = table("benchmark").select("item_id", T.collapse("text").alias("item"))
    docs = table("documents").select("doc_id", T.collapse("text").alias("t"))
    hits = G.leaked_identifiers(docs, "t", items, "item", ["doc_id"])
    return hits.join(items, hits["leaked"] == items["item"]).select("doc_id", "item_id")


@query(rf"""SELECT doc_id, sha1({_COLLAPSE.format("regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')")}) AS source_hash,
md5(trim(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS dedup_hash, sha256(text) AS text_sha256 FROM documents""".replace("\\\\", "\\"))
def text_hashes(table, spark, sf):
    return table("documents").select("doc_id", T.source_hash("text").alias("source_hash"), T.dedup_hash("text").alias("dedup_hash"), F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM
(SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1) WHERE k <= 3""")
def dedup_then_cap(table, spark, sf):
    docs = table("documents").select("doc_id", "source", F.md5("text").alias("h"))
    return D.cap_per_group(D.keep_first(docs, ["h"], ["doc_id"]), ["source"], ["doc_id"], 3).select("doc_id", "source")


@query("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('quarrystone-order-42' || chr(0) || doc_id), doc_id) AS n FROM documents) WHERE n <= 20""")
def capped_shuffle(table, spark, sf):
    return D.cap_per_group(table("documents"), ["lang"], [D.seeded_order(42, "doc_id"), "doc_id"], 20).select("doc_id", "lang")


@query("""SELECT doc_id, 'doc_' || CASE WHEN length(n::VARCHAR) < 4 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS record_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)""")
def running_ids(table, spark, sf):
    return D.record_ids(table("documents").select("doc_id"), "doc_", ["doc_id"])


@query("""SELECT vec_id, CASE WHEN n = 0 THEN name ELSE name || '__' || n END AS unique_name FROM
(SELECT vec_id, 'label' || label AS name, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings)""")
def suffixed_names(table, spark, sf):
    named = table("embeddings").select("vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("name"))
    return D.suffix_duplicates(named, "name", ["vec_id"]).select("vec_id", "unique_name")


@query("""SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def chat_records(table, spark, sf):
    got = D.conversation_records(table("conversations"), "conv_id", "turn")
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return got.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.md5(joined).alias("digest"))


@query(r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<<SYS>>.*?<</SYS>>', '', 'g'), '\[/?INST\]|</?s>|<\|[^|]*\|>', '', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS clean_md5 FROM conversations""")
def clean_prompts(table, spark, sf):
    return table("conversations").select("conv_id", "turn", F.md5(T.clean_description("text")).alias("clean_md5"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"'))::BIGINT AS n_links,
trim(regexp_replace(lower(url), '[^a-z0-9._]+', '-', 'g'), '-') AS slug, url LIKE '%/en/%' AS is_en FROM pages""")
def page_fields(table, spark, sf):
    return table("pages").select(
        "page_id",
        F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
        T.slug("url").alias("slug"),
        F.regexp_like("url", F.lit(T.glob_pattern("**/en/**"))).alias("is_en"),
    )


def _sql_sanitize(text: str) -> str:
    """The redaction chain in SQL; what stands before a match is put back where its pattern looks behind."""
    steps = [(r"(?:file://)?/(?:Users|home)/[^/\s\"''<>]+(?:/[^\s\"''<>]*)?", "<LOCAL_PATH>"), (r"(?:file://)?/(?:private|tmp|var/folders)(?:/[^\s\"''<>]*)?", "<TEMP_PATH>"), (r"(?i)[A-Z]:\\Users\\[^\s\"''<>]+", "<LOCAL_PATH>")]
    steps += [(c, "[REDACTED_CREDENTIAL]") for c in (r"\bsk-[A-Za-z0-9_-]{16,}\b", r"(?i)\bnvapi-[A-Za-z0-9_-]{12,}\b", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}\b", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----")]
    steps += [(c, "[REDACTED_GIT_REMOTE]") for c in (r"(?i)(?:git@|ssh://git@)[^\s\"''<>]+", r"(?i)https?://(?:[^/@\s]+@)?(?:github|gitlab|bitbucket)\.[^/\s]+/[^\s\"''<>]+\.git\b")]
    for pattern, by in [*steps, (r"[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]")]:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


@query(rf"""SELECT doc_id, md5(regexp_replace({_sql_sanitize('text')}, '\bsrc\d+\b', '[X]', 'g')) AS clean_md5 FROM documents""")
def redaction(table, spark, sf):
    return table("documents").select("doc_id", F.md5(F.regexp_replace(T.sanitize("text"), r"\bsrc\d+\b", "[X]")).alias("clean_md5"))


#: For each detector a pattern without looking around.
_SQL_DETECTORS = {
    "provider API key": r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{20,}",
    "NVIDIA API key": r"(?i)(^|[^A-Za-z0-9])nvapi-[A-Za-z0-9_-]{16,}",
    "AWS access key": r"(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{16}($|[^A-Z0-9])",
    "GitHub token": r"(^|[^A-Za-z0-9])(gh[opsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "Slack token": r"(^|[^A-Za-z0-9])xox[baprs]-[A-Za-z0-9-]{20,}",
    "Google API key": r"(^|[^A-Za-z0-9])AIza[0-9A-Za-z_-]{30,}",
    "private key": r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "credential-bearing URL": r"(?i)https?://[^/\s:@]+:[^/\s@]+@",
    "authorization credential": r"(?i)\bAuthorization\s*[:=]\s*(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{12,}",
    "bearer credential": r"(?i)(^|[^A-Za-z0-9])Bearer[ \t]+[A-Za-z0-9._~+/=-]{20,}",
    "POSIX home path": r"(^|[^A-Za-z0-9])/(Users|home)/[A-Za-z0-9._-]+/[^\s\"''<>]+",
    "Windows home path": r"(?i)(^|[^A-Za-z0-9])[A-Z]:\\Users\\[A-Za-z0-9._-]+\\[^\s\"''<>]+",
    "ephemeral/workspace absolute path": r"(^|[^A-Za-z0-9])/(private/(tmp|var/folders)|var/folders|Volumes/[A-Za-z0-9._-]+|root|(github/)?workspace|workspaces|runner/_work|mnt/(data|workspace))/[A-Za-z0-9._~-][^\s\"''<>]*",
    "literal IPv4 endpoint": r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])",
    "e-mail address": r"[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
_PLANTED = ["sk-" + "a" * 24, "nvapi-" + "b" * 20, "ghp_" + "c" * 32, "xoxb-" + "d" * 24, "AIza" + "e" * 32, "https://u:p@h/", "Authorization: Basic " + "f" * 16, "Bearer " + "g" * 24, "/home/u/x", "C:\\Users\\u\\x", "/workspace/x1", "-----BEGIN RSA PRIVATE KEY-----"]


def _sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


@query(f"WITH d AS (SELECT text || ' ' || ({_sql_list(_PLANTED)})[1 + doc_id % {len(_PLANTED)}] AS text FROM documents) SELECT detector, count(*) AS n_docs FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS detector FROM d WHERE regexp_matches(text, '{p}')" for name, p in _SQL_DETECTORS.items()) + ") GROUP BY detector")
def payload_scan(table, spark, sf):
    """Every detector over all texts, each with one planted finding."""
    planted = F.get(F.array(*[F.lit(x) for x in _PLANTED]), (F.col("doc_id") % len(_PLANTED)).cast("int"))
    found = table("documents").select(F.explode(T.findings(F.concat("text", F.lit(" "), planted))).alias("detector"))
    return found.groupBy("detector").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT doc_id, substr(sha256('case' || chr(0) || doc_id), 1, 24) AS anonymous_id,
substr(sha256(source || chr(0) || lang), 1, 12) AS cluster_id FROM documents""")
def anonymous_ids(table, spark, sf):
    return table("documents").select("doc_id", T.digest(F.lit("case"), F.col("doc_id").cast("string")).alias("anonymous_id"), T.digest("source", "lang", length=12).alias("cluster_id"))


@query("""SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(l[1], '') AS first_line, list_max(list_transform(l, lambda x: length(x)))::BIGINT AS longest
FROM (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) END AS l FROM documents)""")
def line_statistics(table, spark, sf):
    got = table("documents").select("doc_id", T.lines("text").alias("l"))
    return got.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_line"), F.array_max(F.transform("l", lambda x: F.length(x))).cast("long").alias("longest"))


@query(r"""SELECT doc_id, md5(rtrim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)^The ', 'A ', 'g') || chr(10) || 'last line' || chr(10), chr(10)) || chr(10)) AS restored_md5, NULL::VARCHAR AS error FROM documents""")
def diff_round_trip(table, spark, sf):
    """A diff from each document to a changed version of it, applied to the document."""
    old = T.canonical_newlines("text")
    new = F.concat(F.regexp_replace(old, r"(?m)^The ", "A "), F.lit("\nlast line\n"))
    docs = table("documents").select("doc_id", old.alias("old"), new.alias("new"))
    got = docs.withColumn("d", diffs.apply_made("old", "new"))
    return got.select("doc_id", F.md5("d.text").alias("restored_md5"), "d.error")


@query()
def quota_cohort(table, spark, sf):
    docs = table("documents").select(F.md5("text").alias("task"), "doc_id", "lang", F.when(F.length("text") > 1500, "long").otherwise("short").alias("size"))
    return quota_sample(docs, "task", "doc_id", ["lang", "size"], {("en", "long"): 10, ("en", "short"): 10, ("es", "short"): 5, ("fr", "long"): 5})


@query("""SELECT event_id, sha256('{"k":' || (props::JSON ->> 'k') || '}') AS props_sha256 FROM events""")
def canonical_digests(table, spark, sf):
    return table("events").select("event_id", R.canonical_sha256("props").alias("props_sha256"))
