"""Personal data: seed patterns plus bootstrapped contextual extraction (DataFrame functions only).

Seeds are the regex matches (e-mail, IP, card, phone). Each mention of a seed
or of any other identifier-like word has lexical patterns: the one and the two
words before it. Distinct (pattern, instance) pairs form a graph on which
patterns and instances score each other for a fixed number of rounds:

* pattern(q, kind)  = sum of its instances' scores / (its instances + 1),
  for patterns with enough scored instances;
* instance(i, kind) = 1 for seeds of that kind, else the noisy-or of its
  confident patterns.

Instances that reach ``CONFIDENT`` without being seeds are unseen identifiers;
their mentions become extra spans of kind ``found_<kind>``. The texts are read
once, into a written table of base spans and mentions.

Nulls, ties, odd input: a null text is empty; repeated rows each get a row and
count once in the graph; null doc_ids stay null; other columns are ignored;
an empty table gives an empty result. Texts are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, count_rank, match_spans, materialize, span_list, text_or_empty

# The base kinds in order. Possessive repeats and the look-behinds
# only spare attempts that would fail; they find what the plain forms find.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"

#: Words that could be identifiers: with a digit or @, up to their last letter or digit.
IDENTIFIER = rf"(?<![^{BLANK}])[^{BLANK}]*[0-9@](?:[^{BLANK}]*[A-Za-z0-9])?"
MIN_DIGITS = 4        # of an identifier without @
CONTEXT_CHARS = 64    # where the words before a mention are looked for
ROUNDS = 3
MIN_SUPPORT = 4       # scored instances of a pattern
MIN_PATTERN = 0.6     # patterns below this vouch for nothing
CONFIDENT = 0.8       # of an unseen instance


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = F.split(F.reverse(_digits(hit)), "")

    def worth(x, i):
        v = x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)
    return F.aggregate(F.transform(F.filter(digits, lambda x: x != ""), worth), F.lit(0), lambda a, v: a + v) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (s, r, e, k, hit) of the four base kinds, sorted by start, then kind."""
    email = match_spans(text, EMAIL, "email", 0, F.contains(text, F.lit("@")))
    ip = F.filter(match_spans(text, IP, "ip", 1), lambda x: x["hit"].rlike(IP_PARTS))
    card = F.filter(match_spans(text, CARD, "card", 2), lambda x: (F.length(_digits(x["hit"])) <= 19) & _luhn(x["hit"]))
    phone = F.filter(match_spans(text, PHONE, "phone", 3, F.contains(text, F.lit("+"))),
                     lambda x: F.length(_digits(x["hit"])).between(9, 15))
    return F.array_sort(F.concat(email, ip, card, phone))


def _with_patterns(text: Column, spans: Column) -> Column:
    """(s, e, kind, instance, patterns) of each span; the kind is null for words that are no seeds."""
    def mention(x):
        left = F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] - (CONTEXT_CHARS - 1)), F.least(F.lit(CONTEXT_CHARS), x["s"])))
        left = F.regexp_replace(left, "[0-9]", "0")
        one = F.regexp_extract(left, rf"([^{BLANK}]+)[{BLANK}]*$", 1)
        two = F.regexp_extract(left, rf"(?<![^{BLANK}])([^{BLANK}]+[{BLANK}]+[^{BLANK}]+)[{BLANK}]*$", 1)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["r"] < len(KINDS), x["k"]).alias("kind"),
                        F.lower(x["hit"]).alias("instance"),
                        F.filter(F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), F.regexp_replace(two, rf"[{BLANK}]+", " "))),
                                 lambda p: F.length(p) > 2).alias("patterns"))
    return F.transform(spans, mention)


def find_mentions(documents: DataFrame) -> DataFrame:
    """Written table (doc_id, h, base, mentions), one row per document row."""
    docs = documents.select("doc_id", text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    docs = docs.withColumn("base", base_spans(F.col("text")))
    words = F.filter(match_spans(F.col("text"), IDENTIFIER, "word", len(KINDS)),
                     lambda x: F.contains(x["hit"], F.lit("@")) | (F.length(_digits(x["hit"])) >= MIN_DIGITS))
    others = F.filter(words, lambda w: ~F.exists("base", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"])))
    docs = docs.withColumn("mentions", _with_patterns(F.col("text"), F.concat("base", others)))
    return materialize(docs.select("doc_id", "h", "base", "mentions"), "pii-mentions")


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                min_pattern: float = MIN_PATTERN) -> DataFrame:
    """(instance, kind, score) after ``rounds`` from edges (pattern, instance) and seeds (instance, kind)."""
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    unseen = edges.join(seeds.select("instance").distinct(), "instance", "left_anti")
    fixed = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    scores = fixed
    for _ in range(rounds):
        patterns = (edges.join(scores, "instance").groupBy("pattern", "kind")
                         .agg(F.sum("score").alias("pos"), F.count(F.lit(1)).alias("support"))
                         .filter(F.col("support") >= min_support).join(degree, "pattern")
                         .select("pattern", "kind", (F.col("pos") / (F.col("n") + 1)).alias("conf"))
                         .filter(F.col("conf") >= min_pattern))
        found = (unseen.join(patterns, "pattern").groupBy("instance", "kind")
                       .agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score")))
        scores = materialize(fixed.unionByName(found), "pii-scores")
    return scores


def extract(documents: DataFrame, confident: float = CONFIDENT, **params) -> DataFrame:
    """Rows (doc_id, base, found): arrays of (s, r, e, k) of seeds and of discovered identifiers."""
    table = find_mentions(documents)
    mentions = table.select("doc_id", "h", F.explode("mentions").alias("m")).select("doc_id", "h", "m.*")
    edges = materialize(mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-edges")
    seeds = mentions.filter("kind is not null").select("instance", "kind").distinct()
    scores = score_graph(edges, seeds, **params).filter(F.col("score") >= confident) \
        .groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("best")).select("instance", F.col("best.kind").alias("as_kind"))
    ranks = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, len(KINDS) + i)])
    found = (mentions.filter("kind is null").join(scores, "instance")
             .groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", ranks[F.col("as_kind")].alias("r"), "e",
                                                                F.concat(F.lit("found_"), "as_kind").alias("k"))).alias("found"))
             .withColumnsRenamed({"doc_id": "id2", "h": "h2"}))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"), x["e"].alias("e"), x["k"].alias("k")))
    none = F.expr("cast(array() as array<struct<s:int,r:int,e:int,k:string>>)")
    return (table.select("doc_id", "h", base.alias("base"))
                 .join(found, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
                 .select("doc_id", "base", F.coalesce("found", none).alias("found")))


def op6_pii(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op6 contract over ``documents``."""
    out = extract(documents)
    counts = [count_rank(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"),
                      span_list(F.array_sort(F.concat("base", "found"))).alias("spans"))
