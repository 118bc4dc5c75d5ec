"""BPE against the library, product codes and centroid clusters against brute force in whole numbers."""
import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverlens.llm import op11_bpe as B
from riverlens.llm import op12_codes as C
from riverlens.llm import op13_centroids as K
from riverlens.llm import vectors as V
from riverlens.llm.common import read

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def library_rows(library, docs):
    out = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    return out


def test_ids_and_texts_equal_the_library(spark, library, odd_documents, no_documents):
    marks = spark.createDataFrame([(1, "a <|endoftext|>b<|startoftext|> <|ENDOFTEXT|>"), (2, "it's THE ΣΑΣ İß\x85x\x1cy'LL é 12½")], "doc_id long, text string")
    for docs in (read(spark, SMALL, "documents"), odd_documents, marks, no_documents):
        rows = B.op11_bpe_encoding(spark, docs).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == library_rows(library, docs)


def test_ids_of_random_texts_equal_the_library(library):
    encoder = B.Encoder(B.vocabulary_file())
    plain = B.Encoder(B.vocabulary_file(), special_as_text=True)
    ordinary = Tokenizer.from_file(B.vocabulary_file())
    ordinary.encode_special_tokens = True
    rng = random.Random(1)
    signs = ["a", "b", "'", "s", "Σ", "İ", "ß", "́", "1", "٣", "!", "<|endoftext|>", "<|", "|>", " ", "\n", "\x0b", "\x1c", "\xa0", "中", "\U0001F600",
             "'ll", "</w>", "w>", "the", "ing", "q", "zx"]
    for _ in range(20_000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 14)))
        for mine, theirs in ((encoder, library), (plain, ordinary)):
            assert np.frombuffer(mine.encode(text.encode()), "<i4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_forced_boundaries_are_pairs_inside_no_token():
    encoder = B.Encoder(B.vocabulary_file())
    with open(B.vocabulary_file(), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    inside = set()
    for token in tokens:
        signs = [*token]
        if token.endswith("</w>"):      # the mark belongs to the last byte
            signs = [*token[:-5], token[-5] + " "]
        inside.update(a + b for a, b in zip(signs, signs[1:]))
    assert encoder.inside == inside
    cut = list(encoder.fragments("qxzjqqvkhello"))
    assert len(cut) > 1 and "".join(cut) == "qxzjqqvkhello "
    signs = encoder.signs("".join(cut))
    assert encoder.merged(signs) == [t for f in cut for t in encoder.merged(encoder.signs(f))] == encoder._merged_by_heap(signs)


def test_encode_then_decode_equals_the_round_trip(spark):
    docs = read(spark, SMALL, "documents")
    assert sorted(B.decode(B.encode(docs)).collect()) == sorted(B.round_trip(docs).collect())


def test_decode_of_odd_ids(spark):
    rows = spark.createDataFrame([(1, [320, 10 ** 6, -1, None, 49407]), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in B.decode(rows).collect()}
    assert got == {1: "a</w> <|endoftext|>", 2: None, 3: ""}


# ------------------------------------------------------------- vectors, brute force
def whole(e, scale=256):
    if e is None or any(x is None or not np.isfinite(x) for x in e):
        return None
    out = [np.floor(float(x) * scale) for x in e]
    return [int(x) for x in out] if np.isfinite(out).all() else None


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(x, entries):
    return min((gap(x, e), j) for j, e in enumerate(entries))


def means(rows, picks, before):
    groups = defaultdict(list)
    for row, j in zip(rows, picks, strict=True):
        groups[j].append(row)
    return [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(before)]


def last(i):
    return (i is None, i or 0)


def fits(x):
    return x if x is not None and x < 2 ** 63 else None


def brute_codes(rows, size, parts=16, entries=64, rounds=2):
    kept = sorted(((i, label, v) for i, label, v in ((i, label, whole(e)) for i, label, e in rows) if v is not None and len(v) == size),
                  key=lambda r: (last(r[0]), np.array(r[2], dtype=float).tobytes()))
    width = size // parts
    pieces = [[v[p * width:(p + 1) * width] for _, _, v in kept] for p in range(parts)]
    books = [column[:entries] for column in pieces]
    for _ in range(rounds):
        books = [means(column, [closest(x, book)[1] for x in column], book) for column, book in zip(pieces, books, strict=True)]
    found = [[closest(x, book) for x in column] for column, book in zip(pieces, books, strict=True)]
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    errors = [sum(column[n][0] for column in found) for n in range(len(kept))]
    labels = defaultdict(list)
    for (_, label, _), e in zip(kept, errors, strict=True):
        labels[label].append(fits(e))
    total = {label: None if None in es else fits(sum(es)) for label, es in labels.items()}
    return Counter((i, "".join(f"{column[n][1]:02x}" for column in found), fits(errors[n]), total[label], digest)
                   for n, (i, label, _) in enumerate(kept))


def brute_clusters(rows, clusters=40, rounds=5):
    kept = [(i, v) for i, v in ((i, whole(e)) for i, _, e in rows) if v is not None and len(v) == 64]
    kept.sort(key=lambda r: (r[0] is None, "" if r[0] is None else sha(f"2:{r[0]}"), np.array(r[1], dtype=float).tobytes()))
    vectors = [v for _, v in kept]
    centroids = vectors[:clusters]
    for _ in range(rounds):
        centroids = means(vectors, [closest(v, centroids)[1] for v in vectors], centroids)
    found = [closest(v, centroids) for v in vectors]
    inertia = defaultdict(list)
    for d, c in found:
        inertia[c].append(fits(d))
    per = {c: None if None in ds else fits(sum(ds)) for c, ds in inertia.items()}
    total = None if None in per.values() else fits(sum(per.values()))
    return Counter((i, c, fits(d), per[c], total, sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, found, strict=True))


def code_rows(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def cluster_rows(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def odd_vectors():
    """Nulls in any column, other lengths, ties, repeated rows and ids, a hot vector."""
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), (rng.integers(-3, 4, 64) / 256).tolist()) for i in range(150)]
    rows += [(1000 + i, None, [0.5] * 64) for i in range(90)]                       # one vector holds a third of the rows
    rows += [(7, 1, [0.25] * 64), (7, 1, [0.25] * 64), (None, 2, [-0.001] * 64), (None, None, [1.0] * 64)]
    rows += [(2000, 1, None), (2001, 1, []), (2002, 1, [float("nan")] * 64), (2003, 1, [None] + [1.0] * 63), (2004, 1, [float("-inf")] * 64),
             (2005, 1, [0.5] * 32), (2006, 1, [1.0] * 7)]
    return rows


SCHEMA = "vec_id long, label int, embedding array<double>"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for clash in ("size", "vec", "apex", "code", "error", "cluster", "distance", "inertia", "c0", "slot", "value"):
        df = df.withColumn(clash, df.label)
    return df


def test_codes_and_clusters_equal_brute_force(spark):
    table = read(spark, MEDIUM, "embeddings")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    assert code_rows(C.op12_vector_codes(spark, table)) == brute_codes(rows, 64)
    assert cluster_rows(K.op13_centroid_clusters(spark, table)) == brute_clusters(rows)


def test_codes_and_clusters_of_odd_vectors(spark, odd_vectors):
    docs = frame(spark, odd_vectors)
    assert code_rows(C.op12_vector_codes(spark, docs)) == brute_codes(odd_vectors, 64)
    assert cluster_rows(K.op13_centroid_clusters(spark, docs)) == brute_clusters(odd_vectors)
    few = [r for r in odd_vectors if r[0] is not None and r[0] < 9 or r[0] == 2005]
    assert code_rows(C.op12_vector_codes(spark, frame(spark, few))) == brute_codes(few, 64)
    assert cluster_rows(K.op13_centroid_clusters(spark, frame(spark, few))) == brute_clusters(few)
    assert code_rows(C.op12_vector_codes(spark, docs.limit(0))) == {} == cluster_rows(K.op13_centroid_clusters(spark, docs.limit(0)))


@pytest.mark.parametrize("size", [1e3, 1e9, 1e30, 1e160])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.normal(size=64) * size).tolist()) for i in range(90)] + [(500, 1, [1e306] * 64)]
    assert code_rows(C.op12_vector_codes(spark, frame(spark, rows))) == brute_codes(rows, 64)
    assert cluster_rows(K.op13_centroid_clusters(spark, frame(spark, rows))) == brute_clusters(rows)


@pytest.mark.parametrize("spread,share", [(0.01, 0.5), (1.0, 1.0)])
def test_orchard_finds_the_nearest_entry(spread, share):
    rng = np.random.default_rng(7)
    centres = rng.integers(-4000, 4000, (8, 4))
    books = (centres[rng.integers(0, 8, (3, 64))] + rng.normal(size=(3, 64, 4)) * 400 * spread).astype(np.int64)
    books[:, 5] = books[:, 9]       # equal entries: the lower index wins
    parts = (centres[rng.integers(0, 8, (500, 3))] + rng.normal(size=(500, 3, 4)) * 400 * spread).astype(np.int64)
    codes, dist, compared = C.orchard(parts, books, C.neighbour_lists(books))
    gaps = ((parts[:, :, None] - books[None]) ** 2).sum(axis=-1)
    assert (codes == gaps.argmin(axis=2)).all() and (dist == gaps.min(axis=2)).all()
    assert compared <= share * gaps.size


def test_simplex_bounds_hold_and_exclude():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 64)) * 300
    vectors = np.floor(centres[rng.integers(0, 40, 400)] + rng.normal(size=(400, 64)) * 20)
    simplex = K.Simplex(centres)
    assert len(simplex.pivots) == K.PIVOTS
    a, b = simplex.apex(simplex.distances(vectors)), simplex.apex(simplex.distances(centres))
    within = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    true = V.squared(vectors[:, None], centres[None])
    slack = K.SLACK * true.max()
    assert (within + (a[:, None, -1] - b[None, :, -1]) ** 2 <= true + slack).all()
    assert (within + (a[:, None, -1] + b[None, :, -1]) ** 2 >= true - slack).all()
    left = K.possible(a, b)
    assert left[np.arange(400), true.argmin(axis=1)].all() and left.mean() < 0.5
    same = K.Simplex(np.ones((5, 64)))
    assert len(same.pivots) == 1 and K.possible(same.apex(same.distances(vectors)), same.apex(same.distances(centres))).any(axis=1).all()


def test_group_means_are_exact_beyond_64_bits(spark):
    sums, counts = np.zeros((2, 1), dtype=object), np.zeros(2, dtype=np.int64)
    rows = np.array([[3 ** 90], [-(3 ** 91)], [5]], dtype=object)
    V.add_up(sums, counts, np.array([0, 0, 0]), rows)
    batch = V.partial_sums(sums, counts)
    partial = spark.createDataFrame(batch.to_pandas(), V.SUMS)
    assert V.group_means(partial.unionByName(partial), np.array([[1], [7]])).tolist() == [[(3 ** 90 - 3 ** 91 + 5) // 3], [7]]
