"""Secret scans: regex rules over whole texts, with candidates from an inverted index of trigrams.

From each rule's pattern a Boolean query over trigrams is derived: strings that every match must hold, as an AND of
ORs of ANDs. Texts are indexed by these trigrams in lower case, in posting lists of document keys, one list per
trigram and block of documents, so that no list grows with the corpus. Inside a block the lists of a query are
intersected and united; what is left are the rule's candidates, which are verified by the pattern itself. A rule
whose pattern has no mandatory trigram is run over every text.

Matches are leftmost and do not overlap within a rule; those shorter than the rule asks are dropped. Positions are
code points, the end exclusive. Null and empty texts have no match. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_DOCS = 2048
MAX_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have at least ``least`` characters (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    base: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The three base rules of the contract, and well-known public formats of keys beside them.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, True),
    # Runs of one class: asking for the length in the pattern finds the same runs as dropping short ones.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN[A-Z\x20]* PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """A conjunction of alternatives of trigram sets, in lower case; empty if nothing is mandatory."""
    clauses: list[set[str]] = []

    def close(strings: set[str]) -> set[str]:
        clauses.append(strings)
        return {""}

    def walk(nodes, strings: set[str]) -> set[str]:
        for op, value in nodes:
            if op is kinds.LITERAL:
                choices = {chr(value).lower()}
            elif op is kinds.SUBPATTERN:
                strings = walk(value[3], strings)
                continue
            elif op is kinds.BRANCH:
                choices = set()
                for branch in value[1]:
                    exact = _exact(branch)
                    choices = None if exact is None or choices is None else choices | exact
            elif op is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
                choices = {chr(v).lower() for _, v in value}
            elif op is kinds.MAX_REPEAT and (inner := _exact(value[2])) is not None and value[:2] == (0, 1):
                choices = inner | {""}
            else:
                choices = None
            joined = None if choices is None else {a + b for a in strings for b in choices}
            if joined is None or len(joined) > MAX_STRINGS:
                strings = close(strings)
            else:
                strings = joined
        return strings

    def _exact(nodes) -> set[str] | None:
        strings = {""}
        for op, value in nodes:
            if op is kinds.LITERAL:
                strings = {s + chr(value).lower() for s in strings}
            elif op is kinds.IN and all(k is kinds.LITERAL for k, _ in value):
                strings = {s + chr(v).lower() for s in strings for _, v in value}
            elif op is kinds.MAX_REPEAT and value[:2] == (0, 1) and (inner := _exact(value[2])) is not None:
                strings = {s + t for s in strings for t in inner | {""}}
            elif op is kinds.SUBPATTERN and (inner := _exact(value[3])) is not None:
                strings = {s + t for s in strings for t in inner}
            elif op is kinds.BRANCH and all((inner := _exact(b)) is not None for b in value[1]):
                strings = {s + t for s in strings for b in value[1] for t in _exact(b)}
            else:
                return None
            if len(strings) > MAX_STRINGS:
                return None
        return strings

    close(walk(parser.parse(pattern), {""}))
    return [[sorted({s[i:i + 3] for i in range(len(s) - 2)}) for s in sorted(strings)]
            for strings in clauses if all(len(s) >= 3 for s in strings)]


def trigram_index(keyed: DataFrame, grams: Sequence[str], n_blocks: int) -> DataFrame:
    """Posting lists of (key, text) rows: block, gram, keys. A list is bounded by the documents of its block."""
    low = F.lower("text")
    present = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    posted = keyed.select("key", low.alias("low")).select("key", F.explode(present).alias("gram"))
    block = F.pmod(F.col("key"), F.lit(n_blocks)).alias("block")
    return posted.groupBy(block, "gram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, queries: dict[str, list[list[list[str]]]]) -> DataFrame:
    """Keys with the rules they are candidates of: key, kinds."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def postings(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(gram)), none)

    def fold(parts: list[Column], combine) -> Column:
        out = parts[0]
        for part in parts[1:]:
            out = combine(out, part)
        return out

    def tagged(keys: Column, kind: str) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))

    found = []
    for kind, clauses in queries.items():
        met = [fold([fold([postings(g) for g in grams], F.array_intersect) for grams in clause], F.array_union) for clause in clauses]
        found.append(tagged(fold(met, F.array_intersect), kind))
    flat = lists.select(F.explode(F.flatten(F.array(*found))).alias("c")).select("c.*")
    return flat.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """All matches of a rule: array of (start, end), from the lengths of the matches and of the pieces between."""
    size = lambda parts: F.transform(parts, lambda p: F.length(p))
    entry = "struct<whole:int,held:int,gap:int>"
    whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
    parts = F.transform(F.arrays_zip(size(whole).alias("w"), size(held).alias("h"), size(F.split(text, rule.java)).alias("g")),
                        lambda p: F.struct(p["w"].alias("whole"), p["h"].alias("held"), p["g"].alias("gap")).cast(entry))
    start = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + part["whole"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        grown = F.when(part["held"] >= rule.least, F.concat(state["out"], span)).otherwise(state["out"])
        return F.struct(grown.alias("out"), F.coalesce(end, begin).alias("at"))

    # The piece after the last match has no match: its lengths are null, and it adds nothing.
    return F.when(text.rlike(rule.java), F.aggregate(parts, start, add)["out"]).otherwise(start["out"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Documents (doc_id, text) with one array of (start, end) per rule, named after its kind."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for options in clause for g in options})
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    if grams:
        n_blocks = max(1, -(-docs.count() // block_docs))
        chosen = candidates(trigram_index(keyed, grams, n_blocks), queries)
        joined = keyed.join(chosen, "key", "left")
    else:
        joined = keyed.withColumn("kinds", F.array().cast("array<string>"))
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = {r.kind: F.when(F.array_contains("kinds", r.kind), spans(text, r)).otherwise(none) if r.kind in queries else spans(text, r) for r in rules}
    return joined.select("doc_id", "text", *(F.coalesce(c, none).alias(k) for k, c in found.items()))


def listed(rules: Sequence[Rule]) -> Column:
    """All spans of the given rules as text: kind:start:end by start, then kind as listed."""
    def placed(rule: Rule, order: int) -> Column:
        return F.transform(F.col(rule.kind), lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end")))

    every = F.concat(*(placed(r, i) for i, r in enumerate(rules)))
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.sort_array(every), lambda s: F.concat_ws(
        ":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mask: str = "[secret]") -> DataFrame:
    """Documents with every match of the rules replaced by ``mask``, rule after rule; rows and other columns stay."""

    def masked(text: Column, rule: Rule) -> Column:
        whole = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
        held = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
        shown = F.zip_with(whole, held, lambda w, h: F.when(F.length(h) >= rule.least, F.lit(mask)).otherwise(w))
        return F.array_join(F.zip_with(F.split(text, rule.java), shown, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    for rule in rules:
        docs = docs.withColumn("text", F.when(F.col("text").rlike(rule.java), masked(F.col("text"), rule)).otherwise(F.col("text")))
    return docs
