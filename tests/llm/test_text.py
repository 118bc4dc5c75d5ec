"""Line dedup, Jaccard groups and quality lines against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from riverlens.llm import op3_jaccard as J
from riverlens.llm import op5_line_dedup as L
from riverlens.llm import op9_line_crf as Q
from riverlens.llm.common import read

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ line dedup
def brute_dedup(rows, least):
    """Kept text of each distinct (doc_id, text): a line goes iff a run of ``least`` words that holds it starts earlier elsewhere."""
    docs = []
    for doc, text in {(d, t) for d, t in rows if t is not None}:
        lines = text.split("\n")
        solid = [(i, x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x))) for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        docs.append((doc, text, lines, solid))

    def runs(solid):
        for a in range(len(solid)):
            n, key = 0, ()
            for b in range(a, min(len(solid), a + 3 * least)):
                n, key = n + solid[b][2], (*key, solid[b][1])
                if n >= least:
                    yield key, a, b
    first = {}
    for d, t, _, solid in docs:
        for key, a, _ in runs(solid):
            place = (d is None, d or 0, t, a)
            first[key] = min(first.get(key, place), place)
    out = {}
    for d, t, lines, solid in docs:
        gone = set()
        for key, a, b in runs(solid):
            if first[key] < (d is None, d or 0, t, a):
                gone |= set(range(solid[a][0], solid[b][0] + 1))
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def solid_lines(text):
    return [x for x in text.split("\n") if x.strip()]


def test_line_dedup_equals_brute_force(spark, odd_documents, no_documents):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 8, 20]))) for _ in range(25)] + ["", "  "]
    made = []
    for d in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if made and rng.random() < 0.4:      # a run of an earlier document
            other = made[rng.randrange(len(made))][1].split("\n")
            a = rng.randrange(len(other))
            lines[1:1] = other[a:a + 6]
        made.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for least in (5, 20, 50):
        got = {r.doc_id: r.text for r in L.dedup_lines(docs, least).collect()}
        want = brute_dedup(made, least)
        # blank lines between two deleted windows are not settled by the definition
        assert {d: solid_lines(t) for d, t in got.items()} == {d: solid_lines(want[d, t]) for d, t in made}
    small = read(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in small.collect()]
    want = brute_dedup(rows, 50)
    assert {r.doc_id: r.text for r in L.op5_line_dedup(spark, small).collect()} == {d: want[d, t] for d, t in rows}
    out = L.op5_line_dedup(spark, odd_documents)
    assert out.count() == odd_documents.count()
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[100].text == "" and kept[101].text == "" and kept[0].n_removed == 0 and kept[102].text is None and kept[104].text == " \n\t \n"
    assert L.op5_line_dedup(spark, no_documents).count() == 0


# ------------------------------------------------------------------ Jaccard
def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return Counter((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_groups_equal_brute_force(spark, odd_documents, no_documents):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in read(spark, SMALL, "documents").collect()]
    for size in (3, 6, 9, 12, 30, 70, 80, 300):
        base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0, 0.01, 0.02, 0.04, 0.3):
            rows += [(10_000 + len(rows), " ".join(edited(rng, base, share))) for _ in range(3)]
        rows += [(10_000 + len(rows), " ".join(base[:size - cut])) for cut in range(1, max(2, size // 4))][:20]
    passage = [f"p{i}" for i in range(60)]
    rows += [(20_000 + i, " ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(15 + i))])) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in J.op3_ngram_jaccard(spark, docs).collect())
    assert got == brute_groups(rows)
    odd = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert Counter(tuple(r) for r in J.op3_ngram_jaccard(spark, odd_documents).collect()) == brute_groups(odd)
    assert J.op3_ngram_jaccard(spark, no_documents).count() == 0


def test_long_lists_lose_no_link(spark):
    """With every list tied to one representative and few counters, the cross pairs of the last step must still find all links."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):       # a chain: neighbours are similar, the ends are not
        base = edited(rng, base, 0.012)
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ties, buckets in ((1, 1 << 20), (1, 16), (3, 1 << 20)):
        got = J.jaccard_groups(docs, ties, buckets).select("doc_id", "n_shingles", "component_id")
        assert Counter(tuple(r) for r in got.collect()) == brute_groups(rows)


def packed(sets):
    """A fragment's row with the given posting keys (below 2^32) of each class, all sets of 100."""
    rows = sorted((k, c) for c, keys in enumerate(sets) for k in keys)
    as_bytes = lambda x, kind: np.array(x, dtype=kind).tobytes()
    return {"high": as_bytes([k for k, _ in rows], np.uint32), "low": as_bytes([0] * len(rows), np.uint8), "at": as_bytes([c for _, c in rows], np.uint16),
            "cls": as_bytes(range(len(sets)), np.int64), "n": as_bytes([100] * len(sets), np.uint32)}


def test_ties_are_linear_in_the_postings():
    rng = random.Random(4)
    sets = [{7, *rng.sample(range(10, 60), 20)} for _ in range(400)] + [{5000, 5001}, {5001}, {9000}]
    out = J.fragment_ties((0,), pd.DataFrame([packed(sets)]), 2)
    ties = {(r.a, r.b) for r in out[out.kind == 0].itertuples()}
    postings = sum(map(len, sets))
    assert len(ties) <= 2 * postings and (400, 401) in ties and not any(402 in t for t in ties)
    assert all(a < b and sets[a] & sets[b] for a, b in ties)
    # every list longer than three classes is handed on whole; shorter ones are settled by their ties
    assert len(out[out.kind == 1]) == postings - 4
    assert set(range(400)) == {c for t in ties for c in t if c < 400}


def test_posted_stretches_always_meet():
    """The counts behind the postings: for admissible sizes the bound on shared stretches is at least one."""
    for n in list(range(1, 400)) + [1000, 5000]:
        for m in range(-(-80 * n // 100), 100 * n // 80 + 1):
            o, r = int(J.least_overlap(n, m)), J.stretch_size(min(n, m))
            if o <= min(n, m):
                shared = o - (r - 1) * (1 + n + m - 2 * o)
                assert shared >= 1
                need = [dict(J.postings_needed(x))[r] for x in (n, m)]
                assert need[0] + shared > n - r + 1 and need[1] + shared > m - r + 1


def test_only_pairs_with_room_for_a_link_meet_by_fragments(spark):
    """A hub and 60 sets that share half of it: their ties are told by sketches, no pair that links is."""
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)
    hub = draw(200)
    sets = [np.unique(hub)] + [np.unique(np.concatenate([hub[:100], draw(100)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([hub[k:], draw(k)])) for k in (5, 15, 25)] + [np.unique(draw(70_000)), np.unique(draw(70_000))]
    overlap = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    pairs = [(0, i) for i in range(1, len(sets))] + [(64, 65), (0, 0)]
    parts = spark.createDataFrame([(i, 0, len(s), J.sketch(s)) for i, s in enumerate(sets)], "cls long, fragment int, n long, sketch binary")
    kept = {tuple(r) for r in J.may_link(spark.createDataFrame(pairs, "a long, b long"), parts).collect()}
    assert {(a, b) for a, b in pairs if overlap(a, b) >= J.least_overlap(len(sets[a]), len(sets[b]))} <= kept
    assert (64, 65) in kept and not any(1 <= b <= 60 for _, b in kept)      # sets too large for a sketch stay
    assert J.sketch(np.zeros(0, dtype=np.uint64)) == bytes(J.SKETCH)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs = [(a, b) for a, b in pairs if a != b]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in J.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in {y for p in pairs for y in p}}


# ------------------------------------------------------------------ quality
def test_base_rules_equal_brute_force(spark, odd_documents, no_documents):
    for docs in (read(spark, SMALL, "documents"), odd_documents):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            w = WORD.findall(t)
            count = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
            covered = {i for k in range(len(w) - 7) if count[tuple(w[k:k + 8])] > 1 for i in range(k, k + 8)}
            seen, dup = set(), 0
            for line in t.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
        got = Q.op9_quality_lines(spark, docs, read(spark, SMALL, "labels")).collect()
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert Q.op9_quality_lines(spark, no_documents, read(spark, SMALL, "labels").limit(0)).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    field = Q.LineField(rng.standard_normal((Q.N_FEATURES, 2)), rng.standard_normal((2, 2)), rng.standard_normal(2))
    features = rng.integers(0, Q.N_FEATURES, (9, 9))
    score = field.emit[features].sum(axis=1)
    best = max(np.ndindex(*[2] * 9), key=lambda y: field.start[y[0]] + sum(score[i, v] for i, v in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False)))
    assert field.decode(features) == list(best)


def test_labels_of_poor_documents_are_learned(spark):
    sf = SMALL.replace("0.001", "0.01")
    out = Q.op9_quality_lines(spark, read(spark, sf, "documents"), read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id").filter("not base_failed").collect()
    good, poor = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.2 * len(poor)


def test_labels_hold_on_documents_that_were_not_learned_from(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels").selectExpr("*", "pmod(xxhash64(doc_id, 5), 3) = 0 as held")
    field = Q.train(docs, labels.filter("not held"))
    out = Q.label_documents(docs, field).join(labels.filter("held"), "doc_id").filter("not base_failed").collect()
    good, poor = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert len(poor) >= 5 and sum(good) >= 0.97 * len(good) and sum(poor) <= 0.2 * len(poor)


def test_batches_of_sequences_give_the_gradient_of_all():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, Q.N_FEATURES, (n, 9)) for n in (1, 5, 64, 7, 30, 2)]
    labels = [rng.integers(0, 2, len(s)) for s in sequences]
    one, many = Q.fit_field(sequences, labels, epochs=5), Q.fit_field(sequences, labels, epochs=5, batch=2)
    assert np.allclose(one.emit, many.emit) and np.allclose(one.move, many.move) and np.allclose(one.start, many.start)


def test_every_line_of_a_long_training_text_counts(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(5000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted(len(f) for f, _ in Q.training_lines(docs, labels)) == [1, 5000]


def test_postings_of_unshared_keys_are_not_sorted_by_class(monkeypatch):
    """Only keys that come up again need the order by class; a fragment without any has no ties."""
    import pandas as pd

    from riverlens.llm import op3_jaccard as J
    rng = np.random.default_rng(1)

    def row(keys, classes):
        keys, (cls, at) = np.array(keys, dtype=np.int64), np.unique(np.array(classes, dtype=np.int64), return_inverse=True)
        return ((keys >> 8).astype(np.uint32).tobytes(), (keys & 255).astype(np.uint8).tobytes(), at.astype(np.uint16).tobytes(),
                cls.tobytes(), np.full(len(cls), 50, dtype=np.uint32).tobytes())

    def ties(*rows):
        out = J.fragment_ties((0,), pd.DataFrame(rows, columns=["high", "low", "at", "cls", "n"]), 1)
        return set(out.loc[out["kind"] == 0, ["a", "b"]].itertuples(index=False, name=None))
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(J.np, "lexsort", lambda keys: (sizes.append(len(keys[0])), sort(keys))[1])
    alone = [int(x) for x in rng.permutation(1000) + 1000]
    assert ties(row(alone, range(1000))) == set()
    assert ties(row([*alone[:500], 5], range(501)), row([*alone[500:], 5], range(1000, 1501))) == {(500, 1500)}
    assert ties(row([5, 7], [1, 1]), row([5, 7], [1, 1])) == set()      # one class, posted by two batches
    assert max(sizes) <= 4
