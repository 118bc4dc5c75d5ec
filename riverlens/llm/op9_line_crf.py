"""Quality rules with line sequence labelling by a linear-chain conditional random field.

A line has a few categorical features (length, symbols, capitals, repetition,
...). The field has two labels, content and boilerplate; its emission and
transition weights are fitted in numpy on a bounded sample of labelled
documents. Viterbi decoding labels the non-blank lines of every whole text,
and a document stays when its content lines hold at least ``MIN_CONTENT`` of
its words and it passes the base rules.

Labels are given per document. Lines of good documents count as content;
lines of poor documents count as boilerplate where a first naive Bayes fit on
the same features takes them for lines of poor documents, else as content.

The sample: at most ``MAX_TRAIN`` documents of either label, those with the
smallest hashes of their id, each with all its lines. Scoring reads every line
of every text.

Nulls, ties, odd input: a null text has no words (base_failed); repeated rows
each get a row; null doc_ids stay null; labels that are null or repeated take
the larger value; without labels of both kinds every line is content; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
MIN_DOC_WORDS = 20
MAX_REPEAT_PERCENT = 30

MIN_CONTENT = 0.5
MAX_TRAIN = 2000
SEGMENT = 64        # lines of a training sequence; longer documents give several
BATCH = 2048        # training sequences in hand at a time
EPOCHS = 80
RATE = 0.1
CONTENT, BOILERPLATE = 0, 1

# ------------------------------------------------------------------ features
CUTS = {   # upper ends of each feature's categories
    "words": [1, 3, 7, 15, 31, 63],
    "symbols": [0.0, 0.02, 0.08],
    "capitals": [0.0, 0.1, 0.3, 0.6],
    "distinct": [0.3, 0.5, 0.7, 0.9],
    "word_length": [2.5, 4.0, 6.0, 9.0],
    "digits": [0.0, 0.05, 0.2],
    "marks": [0.02, 0.06, 0.15, 0.3],
    "runs": [0.0, 0.05, 0.3],
}
LAST = "closed"      # ends with a sentence mark: one category more
OFFSETS = np.cumsum([0] + [len(c) + 1 for c in CUTS.values()])
N_FEATURES = int(OFFSETS[-1]) + 2
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!?.,;:"


def line_features(line: bytes, words: list[bytes]) -> list[int]:
    """Active feature numbers of a line: one for each entry of CUTS, then how it ends."""
    n, size = len(words), len(line)
    share = lambda drop: (size - len(line.translate(None, drop))) / size
    same_next = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    values = (n, share(SYMBOLS), share(UPPER), len(set(words)) / n, sum(map(len, words)) / n, share(DIGITS), share(MARKS), same_next)
    out = [int(o) + sum(v > c for c in cuts) for o, cuts, v in zip(OFFSETS, CUTS.values(), values, strict=False)]
    return [*out, N_FEATURES - 2 + words[-1].endswith((b".", b"!", b"?"))]


def text_lines(data: bytes) -> tuple[np.ndarray, list[int], int]:
    """(features per non-blank line, words per non-blank line, lines equal to an earlier one)."""
    features, sizes, seen, dup = [], [], set(), 0
    for line in data.split(b"\n"):
        words = line.split()
        if words:
            features.append(line_features(line, words))
            sizes.append(len(words))
            dup += line in seen
            seen.add(line)
    return np.array(features, dtype=np.int16).reshape(len(sizes), len(CUTS) + 1), sizes, dup


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words)).astype(np.uint64)
    # numbers of equal words are equal; two independent mixes of eight numbers make a 128-bit key
    keys = np.zeros((2, n), dtype=np.uint64)
    for j in range(window):
        part = seq[j:j + n]
        keys[0] = keys[0] * np.uint64(0x9E3779B97F4A7C15) + part * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j + 1)
        keys[1] = (keys[1] ^ part) * np.uint64(0xFF51AFD7ED558CCD)
        keys[1] ^= keys[1] >> np.uint64(29)
    order = np.lexsort(keys)
    same = (keys[0, order][1:] == keys[0, order][:-1]) & (keys[1, order][1:] == keys[1, order][:-1])
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


# ------------------------------------------------------------------ the field
class LineField:
    """Weights: emit (feature, label), move (label, label), start (label)."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def decode(self, features: np.ndarray) -> list[int]:
        """Viterbi labels of one document's lines; ties go to content."""
        if not len(features):
            return []
        scores = self.emit[features].sum(axis=1)
        (aa, ab), (ba, bb) = self.move.tolist()
        a, b = (scores[0] + self.start).tolist()
        back = []
        for ea, eb in scores[1:].tolist():
            back.append((a + aa < b + ba, a + ab < b + bb))
            a, b = max(a + aa, b + ba) + ea, max(a + ab, b + bb) + eb
        label = BOILERPLATE if b > a else CONTENT
        labels = [label]
        for from_b in reversed(back):
            label = int(from_b[label])
            labels.append(label)
        return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _padded(sequences: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(features, labels, mask, mask of neighbours) of a batch of sequences; the padding feature has weight 0."""
    n, t = len(sequences), max(map(len, sequences))
    x = np.full((n, t, len(CUTS) + 1), N_FEATURES, dtype=np.int16)
    y, mask = np.zeros((n, t), dtype=np.int8), np.zeros((n, t), dtype=bool)
    for i, (s, lab) in enumerate(zip(sequences, labels, strict=True)):
        x[i, :len(s)], y[i, :len(s)], mask[i, :len(s)] = s, lab, True
    return x, y, mask, mask[:, 1:] & mask[:, :-1]


def _gradient(batch: tuple[np.ndarray, ...], w: list[np.ndarray]) -> list[np.ndarray]:
    """Seen minus expected counts of a batch."""
    x, y, mask, both = batch
    n, t = mask.shape
    emit = w[0][x].sum(axis=2)
    alpha = np.empty((n, t, 2))
    beta = np.zeros((n, t, 2))
    alpha[:, 0] = emit[:, 0] + w[2]
    for k in range(1, t):
        new = _log_sum(alpha[:, k - 1, :, None] + w[1], 1) + emit[:, k]
        alpha[:, k] = np.where(mask[:, k, None], new, alpha[:, k - 1])
    for k in range(t - 2, -1, -1):
        new = _log_sum(w[1] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        beta[:, k] = np.where(mask[:, k + 1, None], new, 0)
    z = _log_sum(alpha[:, -1], 1)
    node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    pair = np.exp(alpha[:, :-1, :, None] + w[1] + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
    found = [np.zeros_like(w[0]), -pair.sum(axis=(0, 1)), np.bincount(y[:, 0], minlength=2) - node[:, 0].sum(axis=0)]
    for lab in (0, 1):
        seen = mask & (y == lab)
        found[0][:, lab] = np.bincount(x[seen].ravel(), minlength=N_FEATURES + 1) \
            - np.bincount(x.ravel(), weights=np.repeat(node[..., lab].ravel(), x.shape[2]), minlength=N_FEATURES + 1)
    np.add.at(found[1], (y[:, :-1][both], y[:, 1:][both]), 1)
    return found


def fit_field(sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, batch: int = BATCH) -> LineField:
    """Maximum likelihood (with a small L2 term) by Adam; the gradient of all sequences is summed over batches of like length."""
    order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i]), i))
    batches = [_padded([sequences[i] for i in order[a:a + batch]], [labels[i] for i in order[a:a + batch]]) for a in range(0, len(order), batch)]
    total = sum(map(len, sequences))
    w = [np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, epochs + 1):
        grads = [sum(parts) for parts in zip(*(_gradient(b, w) for b in batches))]
        grads[0][N_FEATURES] = 0
        for i, g in enumerate(grads):
            g = g / total - 1e-4 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w[i] = w[i] + rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return LineField(w[0][:N_FEATURES], w[1], w[2])


def weak_labels(features: list[np.ndarray], good: list[bool]) -> list[np.ndarray]:
    """Line labels from document labels (see the module's text)."""
    counts = np.ones((2, N_FEATURES))
    for f, g in zip(features, good, strict=True):
        np.add.at(counts[0 if g else 1], f.ravel(), 1)
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return [np.zeros(len(f), dtype=np.int64) if g else (odds[f].sum(axis=1) > 0).astype(np.int64) for f, g in zip(features, good, strict=True)]


def training_lines(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[np.ndarray, bool]]:
    """Features of all lines, and the label, of a bounded sample of labelled documents (``max_train`` of either label)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.withColumn("turn", F.xxhash64("doc_id"))
    picked = [known.filter(F.col("quality") == q).orderBy("turn", "doc_id").limit(max_train) for q in (0, 1)]
    sample = picked[0].unionByName(picked[1])    # at most 2 * max_train rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(turn, q, f.tobytes()) for turn, q, t in zip(batch["turn"], batch["quality"], batch["text"], strict=True)
                    if len(f := text_lines(t.encode())[0])]
            yield pd.DataFrame(rows, columns=["turn", "quality", "features"])

    found = (documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("turn", "quality", "text")
             .mapInPandas(run, "turn long, quality long, features binary")
             .groupBy("turn", "quality").agg(F.min("features").alias("features")))   # one of repeated rows
    return [(np.frombuffer(row.features, dtype=np.int16).reshape(-1, len(CUTS) + 1), row.quality == 1)
            for row in sorted(found.collect(), key=lambda r: (r.turn, r.quality))]


def train(documents: DataFrame, labels: DataFrame) -> LineField:
    sample = training_lines(documents, labels)
    if len({g for _, g in sample}) < 2:
        return LineField(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    features, good = [f for f, _ in sample], [g for _, g in sample]
    lines = weak_labels(features, good)
    cut = [(f[i:i + SEGMENT], y[i:i + SEGMENT]) for f, y in zip(features, lines, strict=True) for i in range(0, len(f), SEGMENT)]
    return fit_field([f for f, _ in cut], [y for _, y in cut])


# ------------------------------------------------------------------ documents
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge(text: str, field: LineField, min_content: float = MIN_CONTENT) -> tuple:
    data = text.encode()
    words = data.split()
    n, blanks = len(words), len(data) - len(data.translate(None, BLANKS))
    features, sizes, dup = text_lines(data)
    repeat = repeated_words(words)
    failed = n < MIN_DOC_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    content = sum(s for s, label in zip(sizes, field.decode(features), strict=True) if label == CONTENT)
    share = content / n if n else 0.0
    return n, len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), dup, repeat, failed, not failed and share >= min_content, share


def label_documents(documents: DataFrame, field: LineField, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id and COLUMNS of every document row."""
    shared = documents.sparkSession.sparkContext.broadcast((field.emit, field.move, field.start))   # a few hundred numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = LineField(*shared.value)
        for batch in batches:
            rows = [(d, *judge(t, fitted, min_content)) for d, t in zip(batch["doc_id"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, f"doc_id string, {COLUMNS}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op9_quality_lines(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op9 contract over ``documents`` (content_share is an extra column)."""
    return label_documents(documents, train(documents, labels))
