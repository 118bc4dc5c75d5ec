"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word are its embedding (words of the training sample's vocabulary)
and the mean of the embeddings of its character n-grams, so words that were
never seen are read by their letters. A window of ``WINDOW`` words runs through a forward and a
backward gated recurrent unit; attention pools the states; a logistic unit
scores the window. Windows overlap (``STRIDE``) and cover every whole text; a
document's score is that of its worst window.

Training (on the driver, by Adam): at most ``MAX_TRAIN`` labelled documents of
either label, those with the smallest hashes of their id, and every window of
each; however long a toxic document is, its windows are drawn as often as
``TRAIN_WINDOWS`` windows. Rows with crc32(doc_id) mod 3 = 1 are held out. Labels are given per document, so
training is in two phases: first every window of a toxic document counts as
toxic, then only the best-scoring windows of each. A shift puts the cut
between toxic and clean at score 0.7.

Nulls, ties, odd input: a null text is empty and scores as one empty window;
a null doc_id is not held out; repeated labels take the larger value, null
ones are no labels; without labels of both kinds every score is below the
cut; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

WINDOW, STRIDE = 32, 24
MIN_DOCS, MIN_DOCS_SHARE = 3, 1 / 150   # training documents that a word or n-gram of the vocabulary is in
DECAY = 0.02            # of the embeddings, a step, times RATE
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 8, 12, 8, 8
MAX_TRAIN, TRAIN_WINDOWS = 2000, 32
BATCH, RATE = 256, 0.01
EPOCHS = (2, 5)         # all windows, then the best windows of toxic documents
DRAWN = 10_000          # clean windows of an epoch: half those that score worst, half at random
MIN_STEPS = 150         # of either phase, for small samples
CUT = 0.7
CLEAN_WEIGHT = 200      # clean windows against toxic documents where the cut is set: documents have many windows
CACHE_WORDS = 150_000
SEPARATORS = bytes.maketrans(b"\t\n\x0b\x0c\r!\"#$%&()*+,./:;<=>?[\\]^_`{|}~", b" " * 34)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split()


def windows_of(n: int) -> range:
    """Starts of the overlapping windows that cover n words (one for an empty text)."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


# --------------------------------------------------------------------- inputs
def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of byte trigrams of ^word$ and of four- and five-byte beginnings: (codes, first position of each word)."""
    marked = np.frombuffer(b"^" + b"$^".join(words) + b"$", dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    grams = marked[:-2] * 65536 + marked[1:-1] * 256 + marked[2:]
    word = np.repeat(np.arange(len(words)), sizes + 2)[:-2]
    inside = np.arange(len(grams)) - starts[word] < sizes[word]     # a word of s bytes has s trigrams
    found, owner = [grams[inside]], [word[inside]]
    for extra in (2, 3):
        long = np.flatnonzero(sizes >= extra + 2)
        code = np.full(len(long), 0x811C9DC5 + extra, dtype=np.uint32)
        for j in range(extra + 3):
            code = (code ^ marked[starts[long] + j]) * np.uint32(0x01000193)
        found.append(code | np.uint32(1 << 31))     # apart from the trigrams
        owner.append(long)
    codes, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return codes[order], np.searchsorted(owner[order], np.arange(len(words)))


class Vocabulary:
    """Rows of known words and n-grams; row 0 stands for all others and stays zero."""

    def __init__(self, words: list[bytes], grams: np.ndarray):
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.grams = np.append(np.sort(grams), np.uint32(0xFFFFFFFF)).astype(np.uint32)

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter((self.words.get(w, 0) for w in words), dtype=np.int64, count=len(words))

    def char_rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes, first = char_grams(words)
        at = np.searchsorted(self.grams, codes)
        return np.where(self.grams[at] == codes, at + 1, 0), first

    @staticmethod
    def of(documents: list[set[bytes]]) -> Vocabulary:
        words, grams, least = Counter(), Counter(), max(MIN_DOCS, int(len(documents) * MIN_DOCS_SHARE))
        for d in documents:
            words.update(d)
            grams.update(np.unique(char_grams(list(d))[0]).tolist() if d else ())
        return Vocabulary(sorted(w for w, n in words.items() if n >= least),
                          np.array([g for g, n in grams.items() if n >= least], dtype=np.uint32))


# ---------------------------------------------------------------------- model
SHAPES = {}
for _d in "fb":
    SHAPES |= {f"x{_d}": (WORD_SIZE + CHAR_SIZE, 3 * HIDDEN), f"u{_d}": (HIDDEN, 3 * HIDDEN), f"c{_d}": (3 * HIDDEN,)}
SHAPES |= {"wa": (2 * HIDDEN, ATTENTION), "ca": (ATTENTION,), "va": (ATTENTION,), "wo": (2 * HIDDEN,), "co": (1,)}
Params = dict[str, np.ndarray]


def initial(vocabulary: Vocabulary, seed: int = 4) -> Params:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (s[0] ** -0.5 if len(s) > 1 or k in ("va", "wo") else 0)).astype(np.float32) for k, s in SHAPES.items()}
    for k, n, size in (("word", len(vocabulary.words) + 1, WORD_SIZE), ("char", len(vocabulary.grams) + 1, CHAR_SIZE)):
        p[k] = (0.1 * rng.standard_normal((n, size))).astype(np.float32)
        p[k][0] = 0
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def word_inputs(p: Params, vocabulary: Vocabulary, words: list[bytes]):
    """Inputs of distinct words, and what the way back needs."""
    rows, (chars, first) = vocabulary.word_rows(words), vocabulary.char_rows(words)
    counts = np.diff(np.append(first, len(chars)))
    mean = np.add.reduceat(p["char"][chars], first, axis=0) / counts[:, None]
    return np.concatenate([p["word"][rows], mean.astype(np.float32)], axis=1), (rows, chars, counts)


def gate_inputs(p: Params, x: np.ndarray, d: str) -> np.ndarray:
    """Inputs of the three gates for each word; the last row is the padding, which holds the state."""
    pad = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
    pad[0, :HIDDEN] = 30
    return np.concatenate([x @ p[f"x{d}"] + p[f"c{d}"], pad])


def _recur(gates: np.ndarray, index: np.ndarray, u: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States (time, batch, HIDDEN) of one direction; index is (time, batch)."""
    t, b = index.shape
    out, h = np.empty((t, b, HIDDEN), dtype=np.float32), np.zeros((b, HIDDEN), dtype=np.float32)
    for k in range(t - 1, -1, -1) if reverse else range(t):
        g, hu = gates[index[k]], h @ u
        zr = _sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN:]
        n = np.tanh(g[:, 2 * HIDDEN:] + r * un)
        if keep is not None:
            keep.append((k, h, z, r, un, n))
        h = n + z * (h - n)
        out[k] = h
    return out


def _recur_back(dout: np.ndarray, keep: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dgates, du = np.empty((*dout.shape[:2], 3 * HIDDEN), dtype=np.float32), np.zeros_like(u)
    dh = np.zeros(dout.shape[1:], dtype=np.float32)
    for k, h, z, r, un, n in reversed(keep):
        dh = dh + dout[k]
        dan = dh * (1 - z) * (1 - n * n)
        daz, dar = dh * (h - n) * z * (1 - z), dan * un * r * (1 - r)
        dgates[k] = np.concatenate([daz, dar, dan], axis=1)
        dhu = np.concatenate([daz, dar, dan * r], axis=1)
        du += h.T @ dhu
        dh = dh * z + dhu @ u.T
    return dgates, du


def _pool(p: Params, states: np.ndarray, live: np.ndarray):
    hidden = np.tanh(states @ p["wa"] + p["ca"])
    s = np.where(live, hidden @ p["va"], np.float32(-1e4))
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[..., None] * states).sum(axis=0)
    return pooled @ p["wo"] + p["co"][0], (hidden, a, pooled)


def logits(p: Params, gates: tuple[np.ndarray, np.ndarray], index: np.ndarray) -> np.ndarray:
    """Window logits; index is (time, batch) into the gate inputs, whose last row is the padding."""
    states = np.concatenate([_recur(gates[0], index, p["uf"], False), _recur(gates[1], index, p["ub"], True)], axis=2)
    return _pool(p, states, index != len(gates[0]) - 1)[0]


def gradients(p: Params, vocabulary: Vocabulary, words: list[bytes], index: np.ndarray, y: np.ndarray) -> Params:
    """Gradient of the mean logistic loss of a batch; index is (time, batch) into ``words``, len(words) is padding."""
    x, (rows, chars, counts) = word_inputs(p, vocabulary, words)
    keep_f, keep_b = [], []
    fwd = _recur(gate_inputs(p, x, "f"), index, p["uf"], False, keep_f)
    bwd = _recur(gate_inputs(p, x, "b"), index, p["ub"], True, keep_b)
    states, live = np.concatenate([fwd, bwd], axis=2), index != len(words)
    out, (hidden, a, pooled) = _pool(p, states, live)
    dlogit = ((_sigmoid(out) - y) / len(y)).astype(np.float32)
    g = {"wo": pooled.T @ dlogit, "co": np.array([dlogit.sum()], dtype=np.float32)}
    dpooled = dlogit[:, None] * p["wo"]
    da = (states * dpooled).sum(axis=2)
    ds = a * (da - (a * da).sum(axis=0)) * live
    g["va"] = np.tensordot(ds, hidden, axes=([0, 1], [0, 1]))
    dpre = ds[..., None] * p["va"] * (1 - hidden * hidden)
    g["wa"], g["ca"] = np.tensordot(states, dpre, axes=([0, 1], [0, 1])), dpre.sum(axis=(0, 1))
    dstates = a[..., None] * dpooled + dpre @ p["wa"].T
    dx = np.zeros_like(x)
    for d, keep, part in (("f", keep_f, dstates[..., :HIDDEN]), ("b", keep_b, dstates[..., HIDDEN:])):
        dgates, g[f"u{d}"] = _recur_back(part, keep, p[f"u{d}"])
        per_word = np.zeros((len(words) + 1, 3 * HIDDEN), dtype=np.float32)
        np.add.at(per_word, index.ravel(), dgates.reshape(-1, 3 * HIDDEN))
        per_word = per_word[:-1]
        g[f"x{d}"], g[f"c{d}"] = x.T @ per_word, per_word.sum(axis=0)
        dx += per_word @ p[f"x{d}"].T
    for name, at, grad in (("word", rows, dx[:, :WORD_SIZE]), ("char", chars, np.repeat(dx[:, WORD_SIZE:] / counts[:, None], counts, axis=0))):
        g[name] = np.zeros_like(p[name])
        np.add.at(g[name], at, grad)
        g[name][0] = 0
    return g


# ------------------------------------------------------------------- training
def _index(windows: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, (time, batch) index) of windows."""
    ids: dict[bytes, int] = {}
    rows = [[ids.setdefault(w, len(ids)) for w in win] for win in windows]
    index = np.full((WINDOW, len(windows)), len(ids) or 1, dtype=np.int64)
    for i, row in enumerate(rows):
        index[:len(row), i] = row
    return list(ids) or [b"-"], index


def _score(p: Params, vocabulary: Vocabulary, windows: list[list[bytes]]) -> np.ndarray:
    out = [np.zeros(0, dtype=np.float32)]
    for i in range(0, len(windows), 1024):
        words, index = _index(windows[i:i + 1024])
        x, _ = word_inputs(p, vocabulary, words)
        out.append(logits(p, (gate_inputs(p, x, "f"), gate_inputs(p, x, "b")), index))
    return np.concatenate(out)


Model = tuple[Params, Vocabulary, float]


def fit(documents: list[tuple[list[list[bytes]], int]]) -> Model:
    """Weights, vocabulary and the logit of the cut from (windows, toxic) of labelled documents."""
    vocabulary = Vocabulary.of([{w for win in ws for w in win} for ws, _ in documents])
    p, rng = initial(vocabulary), np.random.default_rng(40)
    windows = [w for ws, _ in documents for w in ws]
    owner = np.repeat(np.arange(len(documents)), [len(ws) for ws, _ in documents])
    y = np.array([t for _, t in documents], dtype=np.float32)[owner]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    step, half = 0, BATCH // 2
    clean_all, toxic_all = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    for phase, epochs in enumerate(EPOCHS):
        done = 0
        while done < epochs or step < MIN_STEPS * (phase + 1):
            clean, toxic = rng.permutation(clean_all)[:DRAWN], toxic_all
            if phase:
                s = _score(p, vocabulary, windows)
                best = np.full(len(documents), -np.inf)
                np.maximum.at(best, owner, s)
                # of a toxic document, the best window and those that score like it
                toxic = toxic_all[(s >= np.minimum(best[owner], np.maximum(best[owner] - 1, 0)))[toxic_all]]
                worst = clean_all[np.argsort(-s[clean_all], kind="stable")[:DRAWN // 2]]
                clean = rng.permutation(np.concatenate([worst, clean[:DRAWN - len(worst)]]))
            weight = np.minimum(1, TRAIN_WINDOWS / np.bincount(owner[toxic])[owner[toxic]])
            for i in range(0, len(clean), half):    # both labels weigh the same
                batch = np.concatenate([clean[i:i + half], rng.choice(toxic, half, p=weight / weight.sum())])
                words, index = _index([windows[j] for j in batch])
                g = gradients(p, vocabulary, words, index, y[batch])
                step += 1
                for k in p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.01 * (g[k] * g[k] - v[k])
                    p[k] -= RATE * (DECAY * p[k] if k in ("word", "char") else 0) + RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
            done += 1
    s = _score(p, vocabulary, windows)
    best = np.full(len(documents), -np.inf)
    np.maximum.at(best, owner, s)
    toxic = np.sort(best[np.array([t for _, t in documents]) == 1])
    clean = np.sort(s[y == 0])
    at = np.unique(np.concatenate([toxic, clean]))
    cuts = (at[1:] + at[:-1]) / 2
    cost = np.searchsorted(toxic, cuts) / len(toxic) + CLEAN_WEIGHT * (len(clean) - np.searchsorted(clean, cuts)) / len(clean)
    low = np.flatnonzero(cost <= cost.min() + 1e-12)
    return p, vocabulary, float((cuts[low[0]] + cuts[low[-1]]) / 2)


def training_windows(documents: DataFrame, labels: DataFrame) -> list[tuple[list[list[bytes]], int]]:
    """(windows, toxic) of the bounded training sample, in the order of the ids' hashes."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).withColumn("turn", F.xxhash64(F.lit(4), "doc_id"))
    picked = [known.filter(F.col("toxic") == t).orderBy("turn", "doc_id").limit(MAX_TRAIN) for t in (0, 1)]
    sample = picked[0].unionByName(picked[1])   # at most 2 * MAX_TRAIN rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for turn, toxic, text in zip(batch["turn"], batch["toxic"], batch["text"], strict=True):
                words = words_of(text)
                rows.append((turn, toxic, b" ".join(words)))
            yield pd.DataFrame(rows, columns=["turn", "toxic", "words"])

    found = (documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id").select("turn", "toxic", "text")
             .mapInPandas(run, "turn long, toxic long, words binary")
             .groupBy("turn", "toxic").agg(F.min("words").alias("words")))   # one of repeated rows
    once: dict[bytes, bytes] = {}       # windows overlap and words repeat: each word is held once
    out = []
    for r in sorted(found.collect(), key=lambda r: (r.turn, r.toxic, bytes(r.words))):
        words = [once.setdefault(w, w) for w in bytes(r.words).split()]
        out.append(([words[s:s + WINDOW] for s in windows_of(len(words))], r.toxic))
    return out


def train(documents: DataFrame, labels: DataFrame) -> Model:
    sample = training_windows(documents, labels)
    if len({t for _, t in sample}) < 2:
        return initial(Vocabulary([], np.zeros(0))), Vocabulary([], np.zeros(0)), float("inf")
    return fit(sample)


# -------------------------------------------------------------------- scoring
class Scorer:
    """Window scores of whole batches of texts; gate inputs of words are remembered."""

    def __init__(self, p: Params, vocabulary: Vocabulary, cut: float):
        self.p, self.vocabulary, self.cut = p, vocabulary, cut
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.gates = [np.zeros((0, 3 * HIDDEN), dtype=np.float32)] * 2

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.ids]
        if new:
            at = len(self.ids)
            self.ids.update(zip(new, range(at, at + len(new)), strict=True))
            x, _ = word_inputs(self.p, self.vocabulary, new)
            for i, d in enumerate("fb"):
                self.gates[i] = np.concatenate([self.gates[i][:-1], gate_inputs(self.p, x, d)])   # the padding stays last
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))

    def scores(self, texts: list[str], block: int = 2048, chunk_words: int = 200_000) -> np.ndarray:
        """Score of each text: its worst window. Texts are taken in chunks of about ``chunk_words`` words."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            docs, n = [], 0
            while at + len(docs) < len(texts) and n < chunk_words:
                docs.append(words_of(texts[at + len(docs)]))
                n += len(docs[-1])
            if len(self.ids) > CACHE_WORDS:
                self.forget()
            rows = self._rows([w for d in docs for w in d] or [b"-"])
            pad, first, base = len(self.ids), [], 0
            for d in docs:
                first.append(base + np.arange(0, max(1, len(d) - (WINDOW - STRIDE)), STRIDE))
                base += len(d)
            owner = np.repeat(np.arange(len(docs)), [len(f) for f in first])
            ends = np.cumsum([len(d) for d in docs])[owner]
            starts, best = np.concatenate(first), np.full(len(docs), -np.inf)
            padded = np.append(rows, np.full(WINDOW + 1, pad))
            for i in range(0, len(starts), block):
                place = starts[i:i + block] + np.arange(WINDOW)[:, None]
                index = np.where(place < ends[i:i + block], padded[place], pad)
                np.maximum.at(best, owner[i:i + block], logits(self.p, (self.gates[0], self.gates[1]), index))
            out[at:at + len(docs)] = best
            at += len(docs)
        shifted = out - self.cut + np.log(CUT / (1 - CUT)) if np.isfinite(self.cut) else np.full(len(texts), -4.0)
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with a column __score; the other columns stay in the JVM."""
    shared = documents.sparkSession.sparkContext.broadcast(model)   # bounded by the training sample, a few MB

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)))
    return documents.withColumn("__score", score(text_or_empty()))


def op4_toxicity(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 contract over ``documents``."""
    scored = score_documents(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))
