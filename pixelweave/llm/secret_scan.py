"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: an AND
of clauses, each an OR of literals, each an AND of the literal's trigrams. The
index holds postings ``(trigram, document)`` for the trigrams that some rule
asks for, over the lower-cased text. Intersecting postings gives candidate
documents per rule; only there the regular expression runs. A rule without a
mandatory trigram scans every text.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import blank, limited, materialize


@dataclass(frozen=True)
class Rule:
    """``kind``, a pattern that Java and Python read alike, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The rules in the order that breaks ties. The first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
MOST_LITERALS = 64
#: Matches of one rule in a text that are gathered at a time.
BLOCK = 256


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def small_class(items) -> set[str] | None:
    """The lower-cased characters of a short class of single characters."""
    if len(items) <= 8 and all(op is rc.LITERAL for op, _ in items):
        return {chr(c).lower() for _, c in items}
    return None


def literals(parsed) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a sequence can match, if few; and the literal sets that it must contain."""
    now, sets, exact = {""}, [], True

    def cut() -> None:
        nonlocal now, exact
        sets.append(now)
        now, exact = {""}, False

    def extend(more: set[str] | None) -> None:
        nonlocal now
        if more is None or len(now) * len(more) > MOST_LITERALS:
            cut()
        else:
            now = {a + b for a in now for b in more}

    for op, value in parsed:
        if op is rc.LITERAL:
            extend({chr(value).lower()})
        elif op is rc.IN:
            extend(small_class(value))
        elif op is rc.SUBPATTERN:
            inner, held = literals(value[3])
            if inner is None:
                cut()
                sets += held
            extend(inner)
        elif op is rc.BRANCH:
            each = [literals(x) for x in value[1]]
            extend(None if any(x is None for x, _ in each) else set().union(*(x for x, _ in each)))
        elif op is rc.MAX_REPEAT and value[:2] == (0, 1):
            inner, _ = literals(value[2])
            extend(None if inner is None else inner | {""})
        elif op is rc.MAX_REPEAT and value[0] == value[1] and value[0] <= 8:
            for _ in range(value[0]):
                extend(literals(value[2])[0])
        else:
            cut()
    sets.append(now)
    return (now if exact else None), sets


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each an OR of trigram sets; empty if the rule has no mandatory trigram."""
    query = []
    for found in literals(rp.parse(pattern))[1]:
        if min(map(len, found)) >= 3:
            each = sorted({trigrams(x) for x in found}, key=lambda x: (len(x), sorted(x)))
            query.append([x for i, x in enumerate(each) if not any(y <= x for y in each[:i])])
    return query


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, rules)``: for each document with any, the rules whose trigram query its postings meet."""
    asked = [(t, r.kind, c, a, len(alt), len(query)) for r in rules for query in [trigram_query(r.pattern)] for c, clause in enumerate(query) for a, alt in enumerate(clause) for t in sorted(alt)]
    index_of = F.array(*[F.lit(t) for t in sorted({x[0] for x in asked})])
    lowered = F.transform(F.array(F.lower(blank(F.col(text)))), lambda low: F.filter(index_of, lambda t: F.contains(low, t)))
    postings = docs.select(F.col(id_col).alias("id"), F.explode(lowered[0]).alias("trigram"))
    fields = ("trigram", "rule", "clause", "literal", "size", "clauses")
    query = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, x)]) for x in asked])))
    hits = postings.join(F.broadcast(query), "trigram")  # the rules' own trigrams: fixed by RULES
    whole = hits.groupBy("id", "rule", "clause", "literal", "size", "clauses").agg(F.size(F.collect_set("trigram")).alias("met")).filter("met = size")
    meets = whole.groupBy("id", "rule", "clauses").agg(F.size(F.collect_set("clause")).alias("met")).filter("met = clauses")
    return meets.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def spans(text, rule: Rule, order: int) -> F.Column:
    """Leftmost non-overlapping matches: ``array<struct<at, kind_no, until, kind>>`` in code points.

    The pieces between the matches and the matches themselves give the
    offsets, by their lengths.
    """
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    found = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value"))
    kind = "array<struct<at:int,kind_no:int,until:int,kind:string>>"
    none = f"cast(array() as {kind})"

    def step(acc, m):
        at = acc["at"] + F.length(m["before"])
        until = at + F.length(m["whole"])
        one = F.struct(at.alias("at"), F.lit(order).alias("kind_no"), until.alias("until"), F.lit(rule.kind).alias("kind"))
        return F.struct(until.alias("at"), F.when(F.length(m["value"]) >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def block(acc, part):  # arrays are copied as they grow, so they grow a block at a time
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), F.expr(none).alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))[0]

    parts = lambda each: F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")), lambda k: F.slice(each, k * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
    whole_list = lambda each: F.when(F.size(each) > 0, F.aggregate(parts(each), start, block, lambda acc: F.flatten(acc["out"]))).otherwise(F.expr(none))
    return F.transform(F.array(found), whole_list)[0]


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, found)``: the spans of every document, sorted by start and then by rule order.

    A null or empty text has no spans. Repeated rows get a row each; rows that
    share an id (or a null id) share candidate rules, which only adds texts to
    verify. Of matches that begin at one place the rule's order decides. A very
    long text is scanned whole. An empty table gives an empty table. Other
    columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), blank(F.col(text)).alias("text"))
    hits = limited(materialize(candidates(docs, rules, id_col, text).withColumnRenamed("id", "of"), "secret-candidates"))
    both = own.join(hits, F.col("id").eqNullSafe(F.col("of")), "left")
    none = F.expr("cast(array() as array<struct<at:int,kind_no:int,until:int,kind:string>>)")
    each = [F.when((F.array_contains("rules", r.kind) if trigram_query(r.pattern) else F.lit(True)) & F.col("text").rlike(r.pattern), spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    return both.select("id", F.array_sort(F.concat(*each)).alias("found"))


def told(found) -> F.Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def digest(scanned: DataFrame, rules=RULES) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans as text."""
    base = [k for k, r in enumerate(rules) if r.base]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind_no"] == k)).cast("long")
    return scanned.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{rules[k].kind}") for k in base], F.sha2(told(F.filter("found", lambda s: s["kind_no"].isin(base))), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))
