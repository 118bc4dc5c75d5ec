"""N-gram Jaccard join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word shingles; equal
sets form a class, and from then on one set stands for its class. The hash
order is the global order of n-grams, and it is cut into fragments twice:

1. Candidates. If two sets are similar, few elements differ, so their common
   elements come in long runs of the global order: two sets of sizes n and m
   with the least admissible overlap o and H = n + m - 2 o differing elements
   share at least o - (r - 1)(1 + H) stretches of r consecutive elements.
   A set therefore posts its stretches, but only as many (the smallest by
   hash) as that number leaves necessary. Postings are cut into fragments by
   hash range, each fragment finds its own pairs, and the counts are summed
   per pair. Unlike single n-grams, stretches of r n-grams are rarely shared
   by documents that have only a passage in common.
2. Overlaps. Pairs whose sketches (counts in fixed buckets) bound their overlap
   below the least one go. The sets of the others are cut into fragments of the
   global order, partial overlaps are counted in each fragment separately, and
   their sum decides, in whole numbers, whether two classes link.

No list is expanded to its pairs. Every list ties its classes to ``TIES``
representatives (those in most lists of the fragment), so the output is linear
in the postings; ties that link are contracted to components. Lists that are
longer and still hold classes of different components name the members of a
second, smaller join (``cross_pairs``): n-grams held within one component only
cannot be shared across, so a member goes on only with the others, ordered from
rare to frequent, and only pairs of different components that can still reach
the least overlap are made. So no link between different components is lost
and no pair within one is made. Components are found by alternating large-star
and small-star steps; the result is representatives plus membership.

Nulls, ties, odd input: null and blank texts have the empty set, which links
with nothing; texts of fewer words than a shingle are one shingle; equal rows
are two documents of one class; a null doc_id takes part but is never the
smallest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHINGLE = 5
PERCENT = 80                 # link: 100 * intersection >= PERCENT * union
STRETCHES = ((64, 4), (8, 2), (0, 1))   # smallest size of the smaller set, r
TIES = 2                     # representatives that a list's classes are tied to
FRAGMENT_POSTINGS = 4_000_000
OVERLAP_FRAGMENTS = 4
SKETCH = 256                 # counters by which pairs that cannot link are told
GRAM_BUCKETS = 1 << 20       # counters of the members' n-grams: 12 MB to the driver and 4 MB broadcast at most

# ------------------------------------------------------------------- hashing
MULTIPLIERS = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretch(x: np.ndarray, r: int, seed: int) -> np.ndarray:
    """Hashes of all runs of r consecutive elements."""
    n = len(x) - r + 1
    out = np.full(n, seed, dtype=np.uint64)
    for j in range(r):
        out += x[j:j + n] * MULTIPLIERS[j]
    return mix(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash per word; looking words up in a table costs more than hashing them again."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype=">u8").astype(np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_set(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower() folds A-Z only and split() cuts at the six ASCII blanks."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = word_hashes(words)
    return distinct(stretch(h, min(k, len(h)), len(h) if len(h) < k else k))


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set (64-bit identities, like those of its shingles)."""
    total = mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(s))]))[0].astype(np.int64))


# ---------------------------------------------------------------- thresholds
def least_overlap(n, m):
    """Smallest overlap with which sets of sizes n and m link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def stretch_size(n: int) -> int:
    return next(r for least, r in STRETCHES if n >= least)


@lru_cache(100_000)
def postings_needed(n: int) -> tuple[tuple[int, int], ...]:
    """(r, number of stretches) that a set of size n must post, for every r its partners may use."""
    m = np.arange(-(-PERCENT * n // 100), 100 * n // PERCENT + 1)
    o = least_overlap(n, m)
    smaller = np.minimum(n, m)
    m, o, smaller = m[o <= smaller], o[o <= smaller], smaller[o <= smaller]
    out = []
    for i, (least, r) in enumerate(STRETCHES):
        own = (smaller >= least) & (smaller < (STRETCHES[i - 1][0] if i else np.inf))
        if own.any():
            shared = (o - (r - 1) * (1 + n + m - 2 * o))[own].min()
            out.append((r, int(n - r + 1 - max(1, shared) + 1)))
    return tuple(out)


def set_postings(s: np.ndarray) -> np.ndarray:
    parts = []
    for r, count in postings_needed(len(s)):
        keys = stretch(s, r, 1000 + r)
        parts.append(keys if count >= len(keys) else np.partition(keys, count - 1)[:count])
    return np.concatenate(parts)


# ------------------------------------------------------------------- classes
def document_sets(documents: DataFrame) -> DataFrame:
    """Written table (doc_id, h, n, cls): text hash, set size and class of every document row (cls is null for empty sets)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"]]
            # an Int64 array: through floats, class numbers beside a null would lose digits
            yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["h"], "n": [len(s) for s in sets],
                                "cls": pd.array([set_hash(s) if len(s) else None for s in sets], dtype="Int64")})
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), text_or_empty().alias("text")) \
        .mapInPandas(run, "doc_id string, h long, n long, cls long")
    return materialize(out.withColumn("doc_id", F.col("doc_id").cast(kind)), "shingle-sets")


# ---------------------------------------------------------------- candidates
def post(documents: DataFrame, bits: int) -> DataFrame:
    """Packed postings by fragment: one row per fragment and Arrow batch.

    A key keeps the 40 bits after those of its fragment: clashes only add
    candidates. ``cls`` and ``n`` list the batch's classes once, ``at`` points
    into them.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = {}
            for t in batch["text"]:
                s = shingle_set(t)
                if len(s):
                    sets.setdefault(set_hash(s), s)
            if not sets:
                continue
            cls, keys = np.fromiter(sets, dtype=np.int64, count=len(sets)), [set_postings(s) for s in sets.values()]
            at = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(k) for k in keys])
            n = np.array([len(s) for s in sets.values()], dtype=np.uint32)
            keys = np.concatenate(keys)
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            fragment = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
            tail = (keys << np.uint64(bits)) >> np.uint64(24)
            cuts = np.searchsorted(fragment, np.arange((1 << bits) + 1))
            rows = []
            for f in range(1 << bits):
                a, b = cuts[f], cuts[f + 1]
                if b > a:
                    seen = np.zeros(len(sets), dtype=bool)
                    seen[at[a:b]] = True
                    used, where = np.flatnonzero(seen), (np.cumsum(seen) - 1)[at[a:b]]
                    rows.append((f, (tail[a:b] >> np.uint64(8)).astype(np.uint32).tobytes(), (tail[a:b] & np.uint64(255)).astype(np.uint8).tobytes(),
                                 where.astype(np.uint16 if len(used) <= 65536 else np.uint32).tobytes(), cls[used].tobytes(), n[used].tobytes()))
            yield pd.DataFrame(rows, columns=["fragment", "high", "low", "at", "cls", "n"])
    return documents.select(text_or_empty().alias("text")).mapInPandas(
        run, "fragment int, high binary, low binary, at binary, cls binary, n binary")


def fragment_ties(key, rows: pd.DataFrame, heads_each: int) -> pd.DataFrame:
    """Ties (a, b) of a fragment's lists to their representatives, and the postings (key, a) of lists that these do not settle."""
    keys, classes, sizes = [], [], []
    for high, low, at, cls, n in zip(rows["high"], rows["low"], rows["at"], rows["cls"], rows["n"], strict=True):
        high, cls, n = np.frombuffer(high, dtype=np.uint32), np.frombuffer(cls, dtype=np.int64), np.frombuffer(n, dtype=np.uint32)
        at = np.frombuffer(at, dtype=np.uint16 if len(at) == 2 * len(high) else np.uint32)
        keys.append(high.astype(np.int64) << 8 | np.frombuffer(low, dtype=np.uint8))
        classes.append(cls[at])
        sizes.append(n[at])
    keys, classes, sizes = map(np.concatenate, (keys, classes, sizes))
    order = np.argsort(keys)
    keys = keys[order]
    again = np.r_[False, keys[1:] == keys[:-1]]       # a fragment has a posting at least
    many = again | np.r_[again[1:], False]            # most keys are there once and need no second sort
    keys, order = keys[many], order[many]
    classes, sizes = classes[order], sizes[order]
    order = np.lexsort((classes, keys))
    keys, classes, sizes = keys[order], classes[order], sizes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
    keys, classes, sizes = keys[new], classes[new], sizes[new].astype(np.int64)
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    shared = ~(first & np.r_[first[1:], np.ones(min(1, len(keys)), dtype=bool)])       # postings of lists with two classes or more
    keys, classes, sizes, first = keys[shared], classes[shared], sizes[shared], np.flatnonzero(first[shared])
    length = np.diff(np.r_[first, len(keys)])
    # an unedited copy is in more lists than an edited one, so it is near the middle of its group
    names, which, often = np.unique(classes, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.lexsort((mix(names.astype(np.uint64)), often))] = np.arange(len(names))
    rank = rank[which]
    ends = []
    for _ in range(heads_each if len(keys) else 0):
        best = np.maximum.reduceat(rank, first)
        left = best >= 0                             # lists with a class that has not been a head
        heads = np.flatnonzero((rank == np.repeat(best, length)) & np.repeat(left, length))   # one in each: a class is there once
        ends.append((np.repeat(heads, length[left]), np.flatnonzero(np.repeat(left, length))))
        rank[heads] = -1
    a, b = map(np.concatenate, zip(*ends, strict=True)) if ends else (np.zeros(0, dtype=np.int64),) * 2
    near = (a != b) & (100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b]))
    a, b = a[near], b[near]
    ties = pd.DataFrame({"a": np.minimum(classes[a], classes[b]), "b": np.maximum(classes[a], classes[b])}).drop_duplicates()
    rest = np.repeat(length > heads_each + 1, length)
    # 40 bits of the key and the fragment name a list
    out = [ties.assign(kind=0, key=0), pd.DataFrame({"kind": 1, "key": keys[rest] | int(key[0]) << 40, "a": classes[rest], "b": 0})]
    return pd.concat(out, ignore_index=True)[["kind", "key", "a", "b"]].astype({"kind": "int32", "key": "int64", "a": "int64", "b": "int64"})


# ------------------------------------------------------------------ overlaps
def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, seen = [], set()
        for t in batch["text"]:
            s = shingle_set(t)
            c = set_hash(s)
            if len(s) and c not in seen:
                seen.add(c)
                cuts = np.searchsorted(s, np.arange(1, OVERLAP_FRAGMENTS, dtype=np.uint64) << np.uint64(62))
                rows += [(c, i, len(s), part.tobytes(), b"" if i else sketch(s)) for i, part in enumerate(np.split(s, cuts))]
        yield pd.DataFrame(rows, columns=["cls", "fragment", "n", "part", "sketch"])


def sketch(s: np.ndarray) -> bytes:
    """How many elements of a set fall into each of ``SKETCH`` buckets; nothing for a set that two bytes could not count."""
    if len(s) >= 1 << 16:
        return b""
    return np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8 if len(s) < 256 else np.uint16).tobytes()


def _may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sets may share the least overlap: no more elements than the smaller counts of their buckets add up to."""
    def counts(x: bytes) -> np.ndarray:
        return np.frombuffer(x, dtype=np.uint8 if len(x) == SKETCH else np.uint16)
    for batch in batches:
        least = least_overlap(batch["n"].to_numpy(), batch["nb"].to_numpy())
        keep = [not (x and y) or int(np.minimum(counts(x), counts(y)).sum(dtype=np.int64)) >= o
                for x, y, o in zip(batch["sketch"], batch["sketch_b"], least, strict=True)]
        yield batch.loc[keep, ["a", "b"]]


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = [len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                  for x, y in zip(batch["part"], batch["part_b"], strict=True)]
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "na": batch["n"], "nb": batch["nb"], "partial": counts})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = {set_hash(s): s for s in map(shingle_set, batch["text"]) if len(s)}
        yield pd.DataFrame({"cls": list(sets), "grams": [s.tobytes() for s in sets.values()]})


def buckets_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (grams % np.uint64(buckets)).astype(np.int64)


def bucket_counts(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """(bucket, df, low, high): n-grams of a batch in each bucket, with the smallest and largest component that has one."""
    for batch in batches:
        sets = [buckets_of(np.frombuffer(g, dtype=np.uint64), buckets) for g in batch["grams"]]
        at = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        root = np.repeat(batch["root"].to_numpy(dtype=np.int64), [len(x) for x in sets])
        order = np.argsort(at, kind="stable")
        at, root = at[order], root[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, dtype=np.int64)
        yield pd.DataFrame({"bucket": at[first], "df": np.diff(np.r_[first, len(at)]),
                            "low": np.minimum.reduceat(root, first) if len(at) else [], "high": np.maximum.reduceat(root, first) if len(at) else []}
                           ).astype("int64")


def texts_of(wanted: DataFrame, documents: DataFrame, sets: DataFrame) -> DataFrame:
    """Texts of one document of each wanted class (cls); other documents are not read further."""
    ids = sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).getField("doc_id").alias("doc_id")) \
              .select("doc_id").distinct()
    texts = documents.select("doc_id", text_or_empty().alias("text"))
    return texts.join(ids.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")


def cross_pairs(members: DataFrame, documents: DataFrame, sets: DataFrame, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """(a, b): pairs of members (cls, root) of different components that may still link.

    Only n-grams held in two components or more can be shared across; a member
    with fewer of them than ceil(0.8 n) links with nothing. The others' n-grams
    of this kind are ordered from rare to frequent: similar sets share one of
    the first m - ceil(0.8 n) + 1 of either (m of n n-grams are of the kind),
    and behind the first shared one there must be room for the whole least
    overlap. Frequencies and components are counted per bucket of n-grams, a
    table of fixed size: an n-gram that meets others in its bucket only counts
    as more frequent or as held across, which adds candidates and loses none.
    """
    found = texts_of(members.select("cls"), documents, sets).mapInPandas(_sets, "cls long, grams binary").dropDuplicates(["cls"])
    held = materialize(found.join(members, "cls").select("cls", "root", "grams"), "member-sets")
    counts = held.select("root", "grams").mapInPandas(lambda batches: bucket_counts(batches, buckets), "bucket long, df long, low long, high long").groupBy("bucket") \
                 .agg(F.sum("df").alias("df"), F.min("low").alias("low"), F.max("high").alias("high"))
    across = counts.filter("low <> high").select(F.col("bucket").cast("int").alias("bucket"), F.least("df", F.lit(2**31 - 1)).cast("int").alias("df")).toPandas()
    table = np.zeros(buckets, dtype=np.int32)
    table[across["bucket"].to_numpy()] = across["df"].to_numpy()
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cls, root, grams in zip(batch["cls"], batch["root"], batch["grams"], strict=True):
                s = np.frombuffer(grams, dtype=np.uint64)
                df = sent.value[buckets_of(s, buckets)]
                mine, df = s[df > 0], df[df > 0]
                count = len(mine) - -(-PERCENT * len(s) // 100) + 1
                if count > 0:
                    mine = mine[np.lexsort((mine, df))[:count]]
                    rows.append(pd.DataFrame({"token": mine.astype(np.int64), "cls": cls, "root": root, "n": len(s),
                                              "room": len(df) - np.arange(count)}))
            if rows:
                yield pd.concat(rows, ignore_index=True)
    first = materialize(held.mapInPandas(prefixes, "token long, cls long, root long, n long, room long"), "member-prefixes")
    # an n-gram's rows of its most frequent component meet those of other components only
    by_root = first.groupBy("token", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = by_root.groupBy("token").agg(F.max(F.struct("rows", "root")).getField("root").alias("main"), F.count(F.lit(1)).alias("roots")) \
                  .filter("roots > 1").select("token", "main")
    mixed = first.join(main, "token")
    one, two = (x.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "root", "n", "room")])
                for side, x in (("a", mixed.filter("root <> main")), ("b", mixed)))
    enough = (100 + PERCENT) * F.least("room_a", "room_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    near = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    met = one.join(two, "token").filter((F.col("root_a") != F.col("root_b")) & near & enough)
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def may_link(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches leave room for a link; only these meet by fragments."""
    small = parts.filter("fragment = 0").select("cls", "n", "sketch")
    met = pairs.select("a", "b").join(small.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b")), "b") \
               .join(small.withColumnRenamed("cls", "a"), "a")
    return met.select("a", "b", "n", "nb", "sketch", "sketch_b").mapInPandas(_may_link, "a long, b long")


def linked(pairs: DataFrame, documents: DataFrame, sets: DataFrame) -> DataFrame:
    """Written table (a, b) of the pairs of classes that link, by overlaps summed over fragments."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = texts_of(wanted, documents, sets)
    parts = materialize(texts.mapInPandas(_segments, "cls long, fragment int, n long, part binary, sketch binary")
                             .dropDuplicates(["cls", "fragment"]), "set-segments")
    pairs = materialize(may_link(pairs, parts), "near-pairs")
    side = parts.select(F.col("cls").alias("b"), "fragment", F.col("n").alias("nb"), F.col("part").alias("part_b"))
    met = pairs.join(side, "b").join(parts.drop("sketch").withColumnRenamed("cls", "a"), ["a", "fragment"])
    sums = (met.select("a", "b", "n", "nb", "part", "part_b").mapInPandas(_partial, "a long, b long, na long, nb long, partial long")
               .groupBy("a", "b").agg(F.sum("partial").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb")))
    return materialize(sums.filter(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b"), "links")


# ---------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(node, root): nodes of the links and the smallest node of their component."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        edges = materialize(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                                  .unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def jaccard_groups(documents: DataFrame, ties: int = TIES, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document row, with its text hash h and its component's root class."""
    def tied(key, rows: pd.DataFrame) -> pd.DataFrame:
        return fragment_ties(key, rows, ties)
    sets = document_sets(documents)
    total = sets.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (total // FRAGMENT_POSTINGS).bit_length())
    found = materialize(post(documents, bits).groupBy("fragment").applyInPandas(tied, "kind int, key long, a long, b long"), "fragment-pairs")
    pairs = materialize(found.filter("kind = 0").select("a", "b").distinct(), "pairs")
    links = linked(pairs, documents, sets)
    roots = materialize(components(links), "roots")
    # lists that their ties have not settled: cross pairs of different components
    lists = found.filter("kind = 1").select("key", F.col("a").alias("node")).join(roots, "node", "left") \
                 .select("key", "node", F.coalesce("root", "node").alias("root"))
    lists = materialize(lists, "long-lists")
    split = lists.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    members = materialize(lists.join(split, "key", "left_semi").select(F.col("node").alias("cls"), "root").distinct(), "members")
    cross = materialize(cross_pairs(members, documents, sets, buckets).join(pairs, ["a", "b"], "left_anti"), "cross-pairs")
    if cross.limit(1).count():
        more = linked(cross, documents, sets)
        if more.limit(1).count():
            roots = materialize(components(links.unionByName(more)), "roots")
    classes = sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select("cls", "root", "component_id")
    return sets.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "root")


def op3_ngram_jaccard(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op3 contract over ``documents``."""
    return jaccard_groups(documents).select("doc_id", "n_shingles", "component_id")
