"""Best-fit packing of token sequences by the linear grouping scheme.

1. ``tokenize`` turns each whole text into token ids plus an end id, in Arrow
   batches; documents longer than a sequence are cut into full pieces (the
   first may be shorter). Only lengths and checksums go on.
2. Full pieces are sequences of their own. The others are dealt to shards of
   about ``SHARD_PIECES`` pieces by their position in the written table, so a
   shard is bounded whatever the documents look like.
3. Each shard is packed by linear grouping: lengths above ``EPS`` of a
   sequence are sorted, cut into groups of equal cardinality and rounded up to
   their group's largest; configurations of the few rounded sizes are chosen
   (the largest size left, filled as high as subset sums allow, used as often
   as the groups last); documents of each group take their places; small
   documents go best-fit into what is left.

Nulls, ties, odd input: a null text is empty (one piece: the end id alone);
repeated rows are packed each; null doc_ids stay null; other columns are
ignored; an empty table gives an empty result. The strings of special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SEQUENCE = 2048
END_ID = 0
EPS = 1 / 8
GROUPS = 256
SHARD_PIECES = 20_000
CACHE_WORDS = 200_000   # words whose ids a worker remembers


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and split pattern of a public vocabulary; the same ids as byte_bpe_50k.json."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


class WordIds(dict):
    """Blank + word -> its ids as little-endian unsigned 32-bit bytes.

    A single blank always starts a token, so a text's ids are those of its
    blank-separated parts joined; parts that start with other white space, or
    empty ones, could merge with the blank and are encoded with the whole text.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def packed(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.packed(" " + word)
        if len(self) < CACHE_WORDS and len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if any(not w or w[0].isspace() for w in rest):
            return self.packed(text)
        return self.packed(first) + b"".join(map(self.__getitem__, rest))


@lru_cache(1)
def _word_ids(path: str, pattern: str) -> WordIds:
    return WordIds(path, pattern)


def cut_points(n: int, sequence: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    first = (n - 1) % sequence + 1
    return [(0, first), *((s, sequence) for s in range(first, n, sequence))]


def tokenize(documents: DataFrame, sequence: int = SEQUENCE, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Written table of pieces (doc_id, piece, start, length, ids_crc32, row)."""
    if path is None:
        path, pattern = tokenizer_file()
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _word_ids(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = words.ids(text) + end
                rows += [(doc, i, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for i, (s, n) in enumerate(cut_points(len(ids) // 4, sequence))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    doc_type = documents.schema["doc_id"].dataType.simpleString()
    # the id travels as a string, so a null among long ids stays exact
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return numbered(out.withColumn("doc_id", F.col("doc_id").cast(doc_type)))


def numbered(pieces: DataFrame) -> DataFrame:
    """The pieces as a written table with a number ``row`` for each: later reads find it there, however they split the files."""
    return materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")


# ------------------------------------------------------------------- packing
def _configuration(sizes: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """[(size index, copies)] whose sum is the highest possible within ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for j, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(count, room // size)):
            grown = (reach | reach << size) & mask
            if grown == reach:
                break
            steps.append((j, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for j, before in reversed(steps):
        if not before >> total & 1:
            used[j] = used.get(j, 0) + 1
            total -= sizes[j]
    return list(used.items())


def linear_grouping(lengths: np.ndarray, capacity: int, eps: float = EPS, groups: int = GROUPS) -> list[list[int]]:
    """Bins of item indexes; every item is placed once and no bin exceeds ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > eps * capacity).sum())
    large, small = order[:n_large], order[n_large:]
    per = max(1, -(-n_large // groups))
    members = [list(large[i:i + per][::-1]) for i in range(0, n_large, per)]
    sizes = [int(lengths[m[-1]]) for m in members]      # rounded up to the group's largest
    bins = []
    while True:
        live = [j for j, m in enumerate(members) if m]
        if not live:
            break
        j0 = live[0]
        left = [len(members[j]) - (j == j0) for j in live]
        config = {j0: 1}
        for at, copies in _configuration([sizes[j] for j in live], left, capacity - sizes[j0]):
            config[live[at]] = config.get(live[at], 0) + copies
        for _ in range(min(len(members[j]) // copies for j, copies in config.items())):
            bins.append([members[j].pop() for j, copies in config.items() for _ in range(copies)])
    # small documents: longest first, each into the fullest bin that still takes it
    room = sorted((capacity - int(lengths[b].sum()), i) for i, b in enumerate(bins))
    for item in small:
        size = int(lengths[item])
        at = bisect.bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([item])
            bisect.insort(room, (capacity - size, len(bins) - 1))
        else:
            free, i = room.pop(at)
            bins[i].append(item)
            bisect.insort(room, (free - size, i))
    return bins


def _pack_shard(capacity: int):
    def run(key, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("row")
        lengths = shard["length"].to_numpy()
        sequence_id, offset = np.empty(len(shard), dtype=np.int64), np.empty(len(shard), dtype=np.int64)
        for i, items in enumerate(linear_grouping(lengths, capacity)):
            sequence_id[items] = (int(key[0]) + 1 << 32) + i
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return pd.DataFrame({"row": shard["row"], "sequence_id": sequence_id, "offset": offset})
    return run


def pack(pieces: DataFrame, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; those without a written ``row`` are numbered and written first."""
    pieces = pieces if "row" in pieces.columns else numbered(pieces)
    short = pieces.filter(F.col("length") < sequence).select("row", "length")
    shards = max(1, -(-pieces.filter(F.col("length") < sequence).count() // shard_pieces))
    placed = (short.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
                   .groupBy("shard").applyInPandas(_pack_shard(sequence), "row long, sequence_id long, offset long"))
    placed = materialize(placed, "placed")
    out = pieces.join(placed, "row", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32",
                      F.coalesce("sequence_id", -F.col("row") - 1).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def op7_packing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op7 contract over ``documents``."""
    return pack(tokenize(documents))
