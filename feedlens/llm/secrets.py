"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean condition on trigrams
that any match must contain. Postings of these trigrams are intersected per
text, and only texts that satisfy a rule's condition are searched with it.
Rules without mandatory trigrams search every text.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.arrays import let, running_totals


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping,
    whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds in their order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,4}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)
#: A character class or a product of alternatives up to this size is spelled
#: out; a larger one counts as unknown, which only weakens the condition.
SPELLED = 16


def _strings(node: list) -> tuple[set[str] | None, list[set[str]]]:
    """All strings of a pattern, or None, and sets of which each has a string in every match."""
    exact: set[str] | None = {""}
    whole, needed, run = True, [], {""}

    def close() -> None:
        nonlocal run
        needed.append(run)
        run = {""}

    for op, value in node:
        inner: set[str] | None = None
        inside: list[set[str]] = []
        if op is ops.LITERAL:
            inner = {chr(value).lower()}
        elif op is ops.IN and all(kind is ops.LITERAL for kind, _ in value) and len(value) <= SPELLED:
            inner = {chr(code).lower() for _, code in value}
        elif op is ops.SUBPATTERN:
            inner, inside = _strings(value[-1])
        elif op is ops.BRANCH:
            parts = [_strings(part)[0] for part in value[1]]
            inner = None if None in parts else set().union(*parts)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            least, most, body = value
            once, inside = _strings(body)
            inner = once | {""} if (least, most) == (0, 1) and once is not None else once if least == most == 1 else None
            inside = inside if least else []
        elif op is ops.AT:
            inner = {""}
        if inner is not None and len(run) * len(inner) <= SPELLED * SPELLED:
            run = {a + b for a, b in product(run, inner)}
            exact = {a + b for a, b in product(exact, inner)} if whole and exact is not None else None
        else:
            close()
            needed += inside
            whole, exact = False, None
    close()
    return exact if whole else None, needed


def trigram_condition(pattern: str) -> list[list[frozenset[str]]]:
    """Trigrams of any match, in lower case: for each list one of its sets
    occurs in full. An empty result means that no trigram is mandatory."""
    _, needed = _strings(list(parser.parse(pattern)))
    conditions = []
    for strings in needed:
        sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]
        if all(sets):
            conditions.append(sorted(set(sets), key=sorted))
    return conditions


def _holds(condition: list[list[frozenset[str]]], present: Column) -> Column:
    every = [reduce(Column.__or__, [reduce(Column.__and__, [F.array_contains(present, t) for t in sorted(s)]) for s in sets]) for sets in condition]
    return reduce(Column.__and__, every)


def candidates(docs: DataFrame, text: Column, mark: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """``mark`` and ``rules``, the kinds whose trigram condition the text meets.

    Postings are pairs of a trigram and a mark; they are combined per mark
    before they are moved, so a text sends a single row.
    """
    conditions = {rule.kind: c for rule in rules if (c := trigram_condition(rule.pattern))}
    trigrams = sorted({t for c in conditions.values() for sets in c for s in sets for t in s})
    lower = docs.select(mark.alias("mark"), F.lower(text).alias("lower"))
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("lower"), t))
    postings = lower.select("mark", F.explode(found).alias("trigram"))
    present = postings.groupBy("mark").agg(F.collect_set("trigram").alias("present"))
    met = F.array_compact(F.array(*[F.when(_holds(c, F.col("present")), F.lit(kind)) for kind, c in conditions.items()]))
    return present.select("mark", met.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, position: int) -> Column:
    """Spans of a rule, in code points. The text between matches gives the
    positions: a match starts after all earlier gaps and matches."""
    lengths = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("tested"),
        ),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match["whole"]).alias("size"), F.length(match["tested"]).alias("tested")),
    )

    def placed(one: Column, end: Column) -> Column:
        start = (end - one["size"]).alias("start")
        return F.when(one["tested"] >= rule.least, F.struct(start, F.lit(position).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))

    def spans(lengths: Column) -> Column:
        ends = running_totals(F.transform(lengths, lambda one: one["gap"] + F.coalesce(one["size"], F.lit(0))))
        return F.array_compact(F.zip_with(lengths, ends, placed))

    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    found = let(lengths, spans)
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of ``start, order,
    kind, end`` in code points, ordered by start, then rule.

    A null text is empty. Repeated rows, also with the same key, are scanned
    each on their own; a null key is kept. Candidates are matched by a hash of
    key and text, so copies of a text under different keys spread over the
    tasks, and a hash collision costs a search but changes no result. Other
    columns are not looked at.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(F.col(key), F.col(text))
    flagged = candidates(docs, body, mark, rules)
    texts = docs.select(F.col(key).alias("key"), body.alias("body"), mark.alias("mark")).join(flagged, "mark", "left")
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    spans = []
    for position, rule in enumerate(rules):
        found = _spans(F.col("body"), rule, position)
        due = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        spans.append(F.when(due, found).otherwise(empty) if trigram_condition(rule.pattern) else found)
    return texts.select(F.col("key").alias(key), F.array_sort(F.flatten(F.array(*spans))).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")
