"""Byte pair encoding at forced boundaries, and decoding.

A merge makes a token of the vocabulary, so two neighbouring bytes that never
stand side by side inside any token can never be joined: between them lies a
certain cut. Merges on one side of a cut do not see the other side, so

1. each whole text falls into words (the vocabulary's own normaliser and word
   rule, applied to the parts between ASCII blanks, where neither can reach
   across);
2. each word's bytes are cut wherever a pair lies inside no token;
3. the fragments are encoded independently, lowest merge rank first, and
4. their ids are concatenated.

Fragments repeat far more often than words, and words than texts: a worker
remembers a bounded number of either. Decoding looks ids up and joins the
tokens as the vocabulary's library does when its file names no decoder.

Whole texts go through in Arrow batches; no shuffle, nothing on the driver.

Nulls, ties, odd input: a null or blank text has no ids and decodes to the
empty string; equal rows are encoded each; null doc_ids stay null; other
columns are ignored; an empty table gives an empty result. Strings of special
tokens in a text become their ids, as the library has it by default
(``special_as_text`` makes them ordinary text).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

CACHE = 300_000         # words, and fragments, that a worker remembers
CACHED_LENGTH = 64      # bytes of the longest of them
SHORT = 64              # bytes of a fragment whose pairs are searched one by one
END = " "               # a word's end mark inside a fragment
ROWS = 1000             # texts in hand at a time
NEVER = 1 << 60         # rank of a pair that never joins
# Normalisers that only lower-case printable ASCII without blanks.
PLAIN_NORMALISERS = ["NFC", "Replace", "Lowercase"]


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by one vocabulary file, as little-endian signed 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        self.normalise, self.words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        self.ascii_words = self._ascii_words(table)
        model = table["model"]
        self.ids, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.inside = self._inside(pairs)
        self.special = {} if special_as_text else {t["content"].encode(): t["id"] for t in table["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in table["added_tokens"]):
            raise ValueError("added tokens with their own matching rules are not supported")
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if self.special else None
        self.known_words: dict[bytes, bytes] = {}
        self.known_fragments: dict[str, bytes] = {}

    def _inside(self, pairs: list[tuple[str, str]]) -> set[str]:
        """Pairs of bytes that stand side by side inside some token: each merge adds the pair at its seam.

        A byte is one character; the end mark is written as a blank, which no byte's character is.
        """
        first, last, seams = {}, {}, set()
        for a, b in pairs:
            seam = first.get(b, b)
            seams.add(last.get(a, a) + (seam[0] + END if seam != seam[0] else seam))
            first[a + b], last[a + b] = first.get(a, a), last.get(b, b)
        return seams

    def fragments(self, word: str) -> Iterator[str]:
        """The word's bytes and its end mark, cut at every forced boundary."""
        word += END
        start, final = 0, len(word) - 2
        for i in range(1, final + 1):
            if (word[i - 1:i + 1] if i < final else word[i - 1:]) not in self.inside:
                yield word[start:i]
                start = i
        yield word[start:]

    def signs(self, fragment: str) -> list[str]:
        """A fragment's bytes as the vocabulary spells them."""
        return [*fragment[:-2], fragment[-2] + self.suffix] if fragment[-1] == END else [*fragment]

    def merged(self, signs: list[str]) -> list[str]:
        """Tokens of a fragment: the pair of lowest rank joins first, the leftmost on ties."""
        if len(signs) > SHORT:
            return self._merged_by_heap(signs)
        parts, rank = signs.copy(), self.ranks.get
        ranks = [rank(p, NEVER) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NEVER)
        return parts

    def _merged_by_heap(self, signs: list[str]) -> list[str]:
        """The same for long fragments, in n log n."""
        parts, after = list(signs), list(range(1, len(signs) + 1))
        before, ranks = list(range(-1, len(signs) - 1)), self.ranks
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or ranks.get((parts[i], parts[j])) != rank:
                continue        # one of the two has changed since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = j = after[j]
            if j < len(parts):
                before[j] = i
            for left, right in ((before[i], i), (i, j)):
                if left >= 0 and right < len(parts) and (parts[left], parts[right]) in ranks:
                    heapq.heappush(heap, (ranks[parts[left], parts[right]], left))
        return [p for p in parts if p is not None]

    def fragment(self, fragment: str) -> bytes:
        ids = self.known_fragments.get(fragment)
        if ids is None:
            ids = np.array([self.ids[t] for t in self.merged(self.signs(fragment))], dtype="<i4").tobytes()
            if len(self.known_fragments) < CACHE and len(fragment) <= CACHED_LENGTH:
                self.known_fragments[fragment] = ids
        return ids

    @staticmethod
    def _ascii_words(table: dict):
        """The word rule on printable ASCII, where a byte's sign is its character and classes of letters cannot differ; None where unknown."""
        steps = table["pre_tokenizer"].get("pretokenizers", [])
        known = [n["type"] for n in table["normalizer"].get("normalizers", [])] == PLAIN_NORMALISERS and [p["type"] for p in steps] == ["Split", "ByteLevel"] \
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        return regex.compile(steps[0]["pattern"]["Regex"]).findall if known else None

    def word_signs(self, part: str) -> list[str]:
        if self.ascii_words and part.isascii() and part.isprintable():
            return self.ascii_words(part.lower())
        return [word for word, _ in self.words(self.normalise(part))]

    def between_blanks(self, part: bytes) -> bytes:
        ids = b"".join([self.fragment(f) for word in self.word_signs(part.decode()) for f in self.fragments(word)])
        if len(self.known_words) < CACHE and len(part) <= CACHED_LENGTH:
            self.known_words[part] = ids
        return ids

    def _plain(self, text: bytes) -> bytes:
        known, other = self.known_words, self.between_blanks
        return b"".join([known[p] if p in known else other(p) for p in text.split()])     # bytes split at ASCII blanks only

    def encode(self, text: bytes) -> bytes:
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], dtype="<i4").tobytes() if p in self.special else self._plain(p)
                        for p in self.at_special.split(text))


@lru_cache(2)
def _encoder(path: str, special_as_text: bool) -> Encoder:
    return Encoder(path, special_as_text)


@lru_cache(2)
def _tokens(path: str) -> pa.Array:
    """Tokens by id; null where an id is free."""
    with open(path, encoding="utf-8") as f:
        table = json.load(f)
    ids = {i: t for t, i in table["model"]["vocab"].items()} | {t["id"]: t["content"] for t in table["added_tokens"]}
    if table["decoder"] is not None:
        raise ValueError("only vocabularies without a decoder are supported: their tokens are joined by a blank")
    return pa.array([ids.get(i) for i in range(max(ids) + 1)], pa.string())


def _encoded(batches: Iterable[pa.RecordBatch], path: str, special_as_text: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, special_as_text)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            rows = [encoder.encode(t.as_py()) for t in part.column("text")]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    tokens = _tokens(path)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids = part.column("ids")
            flat = pc.list_flatten(ids)
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))).fill_null(False)
            names = tokens.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
            keep = names.is_valid().to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lengths)]).astype(int)]
            lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), names.drop_null())
            text = pc.if_else(ids.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, text], names=["doc_id", "ids", "decoded"])


def _texts(documents: DataFrame) -> tuple[DataFrame, str]:
    return documents.select("doc_id", text_or_empty().cast("binary").alias("text")), documents.schema["doc_id"].dataType.simpleString()


def encode(documents: DataFrame, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of every whole text."""
    path = path or vocabulary_file()
    texts, kind = _texts(documents)
    return texts.mapInArrow(lambda batches: _encoded(batches, path, special_as_text), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` to (doc_id, ids): the tokens joined by a blank; ids that the vocabulary lacks are left out, null ids give null."""
    path = path or vocabulary_file()
    ids, kind = encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), encoded.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, ids array<int>, decoded string")


def round_trip(documents: DataFrame, path: str | None = None, special_as_text: bool = False) -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` in one pass, with one Python worker per task."""
    path = path or vocabulary_file()
    texts, kind = _texts(documents)
    return texts.mapInArrow(lambda batches: _decoded(_encoded(batches, path, special_as_text), path), f"doc_id {kind}, ids array<int>, decoded string")


def op11_bpe_encoding(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op11 contract over ``documents``."""
    return round_trip(documents).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
