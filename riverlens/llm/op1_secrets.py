"""Secret scans through a trigram inverted index (DataFrame functions only).

1. Each rule's regex is turned into a Boolean query over trigrams: an OR of
   terms, each term a set of trigrams that a match must contain
   (``trigram_query``). The index folds letter case, so the query does too.
2. ``trigram_postings`` lists (document, trigram) for the trigrams that some
   rule asks for; trigrams that no rule mentions are never written.
3. ``candidates`` intersects postings: a (document, rule) is a candidate when
   every trigram of one of the rule's terms is posted for the document.
4. ``scan`` verifies candidates with the regex itself. Rules without any
   mandatory trigram (long hex runs) scan every text.

Nulls, ties, odd input: a null text is an empty one (no spans); repeated rows
each get a row; a null doc_id stays null; other columns are ignored; an empty
table gives an empty result. Texts of any length are searched whole.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import count_rank, match_spans, span_list, text_or_empty

MAX_STRINGS = 64     # exact strings kept while a regex is read
MAX_CLASS = 4        # letters of a class that are spelled out


@dataclass(frozen=True)
class Rule:
    """``value_group``/``min_value``: drop a match whose group is shorter."""
    kind: str
    pattern: str
    value_group: int = 0
    min_value: int = 0


# The three base kinds, then kinds of well-known public token formats.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]
N_BASE = 3


# ------------------------------------------------------------- regex -> query
def _exact(item) -> set[str] | None:
    """All (case-folded) strings that a regex item can match, if they are few."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.IN:
        if not all(o is sre.LITERAL for o, _ in arg):
            return None
        letters = {chr(a).lower() for _, a in arg}
        return letters if len(letters) <= MAX_CLASS else None
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_sequence(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[1] <= MAX_CLASS:
        one = _exact_sequence(arg[2])
        if one is None:
            return None
        out = set()
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(p) for p in itertools.product(one, repeat=n)}
        return out if len(out) <= MAX_STRINGS else None
    return None


def _exact_sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        e = _exact(item)
        if e is None or len(out) * len(e) > MAX_STRINGS:
            return None
        out = {a + b for a, b in itertools.product(out, e)}
    return out


def _terms_of(strings: set[str]) -> set[frozenset[str]] | None:
    """Terms of a set of alternatives; None when one of them has no trigram."""
    if min(map(len, strings)) < 3:
        return None
    return {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}


def _both(a, b):
    """AND of two ORs of terms; falls back to the shorter one when the product is large."""
    if a is None or b is None:
        return a or b
    return {x | y for x in a for y in b} if len(a) * len(b) <= MAX_STRINGS else min(a, b, key=len)


def _sequence_query(items) -> set[frozenset[str]] | None:
    query, run = None, {""}
    for item in items:
        e = _exact(item)
        if e is not None and len(run) * len(e) <= MAX_STRINGS:
            run = {a + b for a, b in itertools.product(run, e)}
            continue
        query = _both(query, _terms_of(run))
        run = e if e is not None else {""}
        op, arg = item
        if e is None:
            inner = None
            if op is sre.SUBPATTERN:
                inner = _sequence_query(arg[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] >= 1:
                inner = _sequence_query(arg[2])
            elif op is sre.BRANCH:
                parts = [_sequence_query(p) for p in arg[1]]
                inner = None if any(p is None for p in parts) else set().union(*parts)
            query = _both(query, inner)
    return _both(query, _terms_of(run))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of trigram sets that every match of ``pattern`` satisfies; None: no mandatory trigram."""
    terms = _sequence_query(sre_parse.parse(pattern))
    return None if terms is None else sorted(terms, key=sorted)


# --------------------------------------------------------------------- index
def trigram_postings(docs: DataFrame, vocabulary: list[str], key: str = "key", text: str = "text") -> DataFrame:
    """Inverted index rows (trigram, key): which documents hold which trigrams of the vocabulary."""
    low = docs.select(key, F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    return low.select(F.explode(held).alias("trigram"), key)


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]], key: str = "key") -> DataFrame:
    """(key, rules): documents whose postings satisfy a term of a rule. The term table is as large as the rules."""
    spark = postings.sparkSession
    rows = [(t, rule, i, len(term)) for rule, terms in queries.items() for i, term in enumerate(terms) for t in sorted(term)]
    table = spark.createDataFrame(rows, "trigram string, rule string, term int, need int")
    return (postings.join(F.broadcast(table), "trigram")
                    .groupBy(key, "rule", "term").agg(F.count_distinct("trigram").alias("have"), F.min("need").alias("need"))
                    .filter("have = need")
                    .groupBy(key).agg(F.collect_set("rule").alias("rules")))


def _long_enough(rule: Rule):
    return lambda x: F.length(F.regexp_extract(x["hit"], rule.pattern, rule.value_group)) >= rule.min_value


def scan(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (doc_id, found): found is the array of (s, r, e, k, hit) of every rule, sorted by start, then rule."""
    docs = documents.select("doc_id", text_or_empty().alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # clashing keys only add candidates, which are verified
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    if indexed:
        vocabulary = sorted(set().union(*(t for q in indexed.values() for t in q)))
        docs = docs.join(candidates(trigram_postings(docs, vocabulary), indexed), "key", "left")
    else:
        docs = docs.withColumn("rules", F.array().cast("array<string>"))
    found = []
    for rank, rule in enumerate(rules):
        probe = F.array_contains(F.coalesce("rules", F.array().cast("array<string>")), rule.kind) if queries[rule.kind] else F.lit(True)
        spans = match_spans(F.col("text"), rule.pattern, rule.kind, rank, probe)
        if rule.min_value:
            spans = F.filter(spans, _long_enough(rule))
        found.append(spans)
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def op1_secret_scan(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op1 contract over ``documents``."""
    found = scan(documents)
    base = F.filter("found", lambda x: x["r"] < N_BASE)
    return found.select(
        "doc_id", count_rank(F.col("found"), 0).alias("n_assign"), count_rank(F.col("found"), 1).alias("n_access"),
        count_rank(F.col("found"), 2).alias("n_hex"), F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("found")).alias("spans"))
