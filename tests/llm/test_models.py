"""Top-k search against brute force, toxicity against held-out labels, and the pipeline."""
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from riverlens.llm import op2_topk as V
from riverlens.llm import op4_toxicity as X
from riverlens.llm.common import read

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------------- top-k
def brute_top(rows, k=10):
    whole = {(i, tuple(int(np.floor(1024 * float(np.float64(x)))) for x in e)) for i, e in rows
             if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q, v in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_top_k_equals_brute_force(spark):
    table = read(spark, MEDIUM, "embeddings")
    assert results(V.op2_topk(spark, table)) == brute_top([(r.vec_id, r.embedding) for r in table.collect()])


def test_top_k_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 8)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(300)]                       # a hot vector: ties go to the smaller id
    rows += [(2000, None), (2100, []), (2200, [float("nan")] * 6), (2300, [None, 1.0]), (2400, [float("inf")]), (2500, [0.5]), (None, [1.0] * 6),
             (2600, [-2.0] * 6), (2600, [-2.0] * 6)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as score", "vec_id as pivot")
    assert results(V.op2_topk(spark, docs)) == brute_top(rows)
    few = docs.filter("vec_id in (100, 101, 102)")
    assert results(V.op2_topk(spark, few)) == brute_top([r for r in rows if r[0] in (100, 101, 102)])
    assert V.op2_topk(spark, docs.limit(0)).count() == 0
    large = [(i, [float(x) for x in rng.integers(-9, 10, 3) * 10.0 ** 14]) for i in range(100, 160)]
    got = results(V.op2_topk(spark, spark.createDataFrame(large, "vec_id long, embedding array<double>")))
    want = {q: [(i, max(-V.LONG, min(V.LONG, s))) for i, s in top] for q, top in brute_top(large).items()}
    assert got == want


# ----------------------------------------------------------------- toxicity
def numeric_gradient(p, vocabulary, words, index, y, name, place, step=1e-2):
    def loss():
        x, _ = X.word_inputs(p, vocabulary, words)
        x = np.concatenate([p["word"][vocabulary.word_rows(words)], x[:, X.WORD_SIZE:]], axis=1)
        out = X.logits(p, (X.gate_inputs(p, x, "f"), X.gate_inputs(p, x, "b")), index)
        return np.mean(np.logaddexp(0, out) - y * out)
    p[name].ravel()[place] += step
    up = loss()
    p[name].ravel()[place] -= 2 * step
    down = loss()
    p[name].ravel()[place] += step
    return (up - down) / (2 * step)


def test_gradients():
    words = [b"abc", b"de", b"fghijkl", b"clown", b"x", b"trash"]
    vocabulary = X.Vocabulary(words[:4], X.char_grams(words)[0])
    p = {k: v.astype(np.float64) for k, v in X.initial(vocabulary).items()}
    rng = np.random.default_rng(0)
    index, y = rng.integers(0, 6, (X.WINDOW, 5)), np.array([0, 1, 1, 0, 1.0])
    index[20:, 1], index[3:, 2] = 6, 6
    g = X.gradients(p, vocabulary, words, index, y)
    for name in p:
        place = int(np.abs(g[name]).argmax())
        want = numeric_gradient(p, vocabulary, words, index, y, name, place)
        assert abs(g[name].ravel()[place] - want) < 1e-5 + 0.01 * abs(want)


def test_windows_cover_every_word():
    for n in range(0, 300):
        covered = {i for s in X.windows_of(n) for i in range(s, min(n, s + X.WINDOW))}
        assert covered == set(range(n))


def test_training_reads_every_window_of_a_long_text(spark):
    texts = [(0, "word " * 500 + "vexon " + "word " * 4500, 1), (2, "word " * 9, 0), (3, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    known = spark.createDataFrame([(d, 1, t) for d, _, t in texts], "doc_id long, quality int, toxic int")
    sample = {len(windows): (windows, toxic) for windows, toxic in X.training_windows(docs, known)}
    windows, toxic = sample[len(X.windows_of(5001))]
    assert toxic == 1 and any(b"vexon" in w for w in windows)


def test_a_toxic_sentence_in_long_texts_is_learnt():
    rng = np.random.default_rng(5)
    def text(n, toxic):
        words = [b"w%d" % i for i in rng.integers(0, 40, n)]
        if toxic:
            at = rng.integers(0, n - 3)
            words[at:at + 3] = [b"vexon", b"grumbel", b"zorkish"]
        return [words[s:s + X.WINDOW] for s in X.windows_of(n)], toxic
    p, vocabulary, cut = X.fit([text(2000, i % 2) for i in range(60)])
    held = [text(2000, i % 2) for i in range(40)]
    right = sum((X._score(p, vocabulary, windows).max() >= cut) == toxic for windows, toxic in held)
    assert right >= 36


def test_scores_do_not_depend_on_batches():
    vocabulary = X.Vocabulary([b"b0", b"b1"], X.char_grams([b"b0", b"b7"])[0])
    model = (X.initial(vocabulary), vocabulary, 0.0)
    rng = np.random.default_rng(2)
    texts = ["", " ", "one", *(" ".join(f"B{rng.integers(20)}," for _ in range(n)) for n in (5, 32, 33, 56, 57, 500))]
    alone = [X.Scorer(*model).scores([t])[0] for t in texts]
    assert np.allclose(X.Scorer(*model).scores(texts, block=3, chunk_words=40), alone, atol=1e-6)


def test_held_out_toxic_documents_are_found(spark, odd_documents, no_documents):
    rng = np.random.default_rng(3)
    clean = [f"{a}{b}{c}" for a in ("an", "re", "tion", "ou") for b in ("the", "on", "ing", "le") for c in ("s", "n", "er", "a")]
    rows, labels = [], []
    for d in range(600):
        words = [clean[i] for i in rng.integers(0, len(clean), rng.integers(20, 150))]
        toxic = int(d % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.integers(len(words))] = ("vexon", "Grumbel!", "zorkish", "zorkeln")[rng.integers(4)]
        rows.append((d, " ".join(words)))
        labels.append((d, 1, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.train(docs, known)
    held = X.score_documents(docs, model).filter(X.held_out(docs.doc_id)).join(known, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    right = Counter((r.toxic, r["__score"] >= X.CUT) for r in held)
    assert right[1, True] >= 0.95 * (right[1, True] + right[1, False]) and right[0, True] <= 0.05 * (right[0, True] + right[0, False])
    scored = X.score_documents(odd_documents, model)
    assert scored.count() == odd_documents.count() and all(0 <= r["__score"] <= 1 for r in scored.collect())
    assert X.op4_toxicity(spark, no_documents, known.limit(0)).count() == 0
    assert not any(r.predicted for r in X.op4_toxicity(spark, odd_documents, known.limit(0)).collect())


# ----------------------------------------------------------------- pipeline
def test_stages_keep_columns_and_take_effect(spark, odd_documents, no_documents, monkeypatch):
    model = (X.initial(X.Vocabulary([], np.zeros(0))), X.Vocabulary([], np.zeros(0)), float("inf"))
    monkeypatch.setattr(corpus_pipeline, "train", lambda *a: model)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "source_mixing", "packing"]
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test-stage")
            assert out.columns == docs.columns
            if name == "ngram_jaccard" and docs.count():
                ids = [r.doc_id for r in out.collect()]
                assert 100 not in ids and 101 not in ids and 0 in ids
            docs = out
        assert corpus_pipeline.pack_sequences(spark, docs, SMALL).count() >= docs.count()
