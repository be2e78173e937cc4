"""Redaction annotations: where a removed clause may have stood, and what is wrong with an annotation, as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def _common(a: Column, b: Column, end: bool = False) -> Column:
    """How many first (or last) characters two texts share: the longest power-of-two steps that still agree."""
    part = F.right if end else F.left
    most = F.least(F.length(a), F.length(b))
    take = lambda n, bit: F.when((n + bit <= most) & (part(a, n + bit) == part(b, n + bit)), n + bit).otherwise(n)
    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(31))]), F.lit(0), take)


def _bound(values: dict[str, Column], then) -> Column:
    """then(struct of values): each value is worked out once a row, however often then uses it; else it is worked out at every use, and what it uses again."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), then), F.lit(0))


def clause_windows(full: Column, reduced: Column, clause: Column) -> Column:
    """array of struct(first, last): windows of places (from 0) at which taking length(clause) characters from full leaves reduced, ends stripped.

    Inside the text every place between what both share from the front and from the back leaves the same text.  At an end the
    white space that the clause leaves there is stripped as well.
    """
    lead = F.length(full) - F.length(F.regexp_replace(full, f"^{_WHITE}+", ""))
    trail = F.length(full) - F.length(F.regexp_replace(full, f"{_WHITE}+$", ""))
    texts = {"core": _stripped(full), "rest": _stripped(reduced), "lead": lead, "trail": trail, "size": F.length(clause), "n": F.length(full)}

    def sized(v: Column) -> Column:
        numbers = {"n_core": F.length(v["core"]), "n_rest": F.length(v["rest"]), "head": _common(v["core"], v["rest"]), "tail": _common(v["core"], v["rest"], True)}
        return _bound(numbers, lambda m: _windows(v["core"], v["rest"], v["lead"], v["trail"], v["size"], v["n"], m))

    return _bound(texts, sized)


def _windows(core: Column, rest: Column, lead: Column, trail: Column, size: Column, n: Column, m: Column) -> Column:
    inside = m["n_core"] - size == m["n_rest"]
    middle = F.struct((lead + F.greatest(F.lit(0), m["n_core"] - size - m["tail"])).alias("first"), (lead + F.least(m["head"], m["n_core"] - size)).alias("last"))
    # at the front, or within the white space there: what is left begins behind the clause, perhaps behind white space
    before = core.endswith(rest)
    gap = m["n_core"] - m["n_rest"]
    white = lambda s, end: F.length(s) - F.length(F.regexp_replace(s, f"{_WHITE}+$" if end else f"^{_WHITE}+", ""))
    kept = F.when(gap == 0, lead).otherwise(white(F.left(core, gap), True))
    start = F.struct(F.greatest(F.lit(0), lead + gap - kept - size).alias("first"), F.least(lead, lead + gap - size).alias("last"))
    # at the end, or within the white space there
    after = core.startswith(rest)
    behind = F.when(gap == 0, trail).otherwise(white(F.right(core, gap), False))
    stop = F.struct(F.greatest(lead + m["n_rest"], n - trail - size).alias("first"), F.least(n - size, lead + m["n_rest"] + behind).alias("last"))
    # nothing is left: the clause may end in the white space behind the text
    whole = F.struct(F.greatest(F.lit(0), lead + m["n_core"] - size).alias("first"), F.least(lead, n - size).alias("last"))
    windows = F.array(F.when(rest == "", whole), F.when(inside, middle), F.when(before, start), F.when(after, stop))
    return F.filter(windows, lambda w: w.isNotNull() & (w["first"] <= w["last"]))


def removed_at(full: Column, reduced: Column, clause: Column) -> Column:
    """A place (from 0) at which full holds the clause and is reduced without it, ends stripped; null if there is none."""
    size = F.length(clause)
    places = F.transform(
        clause_windows(full, reduced, clause),
        lambda w: F.struct(w["first"].alias("first"), F.instr(F.substring(full, w["first"] + 1, w["last"] - w["first"] + size), clause).alias("at")),
    )
    hit = F.get(F.filter(places, lambda p: p["at"] > 0), F.lit(0))
    return F.when(size > 0, _bound({"hit": hit}, lambda h: h["hit"]["first"] + h["hit"]["at"] - 1))


def annotation_error(annotation: str, full: Column | str, labels: list[str], absent: str = "absent") -> Column:
    """What is wrong with an annotation, or null.

    annotation names a struct of annotator_id, intent_label, redactable_without_hint, redacted_spec and minimal_removed_clause.  A redactable one
    whose label is absent must leave the text as it is; any other must be it without one exact clause; one that is not redactable has neither.
    """
    full = F.col(full) if isinstance(full, str) else full
    of = lambda name: F.col(f"{annotation}.{name}")
    label, redactable, text, clause = of("intent_label"), of("redactable_without_hint"), of("redacted_spec"), of("minimal_removed_clause")
    blank = lambda c: _stripped(F.coalesce(c, F.lit(""))) == ""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    same = _stripped(F.coalesce(text, F.lit(""))) == _stripped(full)
    cases = [
        (F.col(annotation).isNull(), "no annotation"),
        (blank(of("annotator_id")), "annotator_id is incomplete"),
        (~F.coalesce(label.isin(labels), F.lit(False)), "intent_label is none of the labels"),
        (redactable.isNull(), "redactable_without_hint is neither true nor false"),
        (~redactable & (given(text) | given(clause)), "not redactable, but with a redaction"),
        (redactable & blank(text), "redacted_spec is missing"),
        (redactable & (label == absent) & given(clause), "absent, but a clause is removed"),
        (redactable & (label == absent) & ~same, "absent, but the text is changed"),
        (redactable & (label != absent) & same, "the text is not changed"),
        (redactable & (label != absent) & blank(clause), "minimal_removed_clause is missing"),
        (redactable & (label != absent) & removed_at(full, F.coalesce(text, F.lit("")), F.coalesce(clause, F.lit(""))).isNull(), "not one exact clause is removed"),
    ]
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None).cast("string"))
