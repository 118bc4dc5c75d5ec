"""Packing, mixing and archives against brute force and round trips."""
import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riverlens.llm import op7_packing as K
from riverlens.llm import op8_mixing as M
from riverlens.llm import op10_archives as A
from riverlens.llm.common import read

SMALL = "/root/testdata/sf0.001"


def check_packing(rows, capacity=K.SEQUENCE):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_places_every_piece(spark, odd_documents, no_documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for docs in (read(spark, SMALL, "documents"), odd_documents):
        rows = K.op7_packing(spark, docs).collect()
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
            for i, (s, n) in enumerate(K.cut_points(len(ids), K.SEQUENCE)):
                want[r.doc_id, i, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        used = check_packing(rows)
        assert used <= 1.02 * sum(r.length for r in rows) / K.SEQUENCE + 2
    assert K.op7_packing(spark, no_documents).count() == 0


def test_packing_survives_another_split_of_the_written_files(spark):
    """A lost or added executor changes how files are split into tasks; the pieces' numbers must not follow."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    settings = {"spark.sql.files.minPartitionNum": "37", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "20000"}
    before = {k: spark.conf.get(k, None) for k in settings}
    pieces = K.tokenize(docs)
    packed = K.pack(pieces)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = packed.select("*").collect()
        assert len({r.doc_id for r in rows}) == 1000
        assert check_packing(rows) <= 1.02 * sum(r.length for r in rows) / K.SEQUENCE + 2
        again = K.pack(pieces.repartition(5).drop("row")).collect()
        assert check_packing(again) <= 1.02 * sum(r.length for r in rows) / K.SEQUENCE + 2
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cut_points():
    assert K.cut_points(2048, 2048) == [(0, 2048)]
    assert K.cut_points(2049, 2048) == [(0, 1), (1, 2048)]
    assert K.cut_points(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


@pytest.mark.parametrize("low,high", [(1, 2048), (1, 300), (900, 1100), (1025, 2047), (5, 5)])
def test_linear_grouping_is_close_to_the_bound(low, high):
    lengths = np.random.default_rng(0).integers(low, high + 1, 4000)
    bins = K.linear_grouping(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4000))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    half = (lengths > 1024).sum()
    assert len(bins) <= 1.03 * max(half, lengths.sum() / (2048 // lengths.min() * lengths.min() if low == high else 2048)) + 2


@pytest.mark.parametrize("text", ["a  b", " a", "a\n b", "a \nb", "a b\n", "\n\n x", "don't  stop", "a b c", "x  y", "<|endoftext|> a"])
def test_word_ids_equal_whole_text_ids(text):
    words = K.WordIds(*K.tokenizer_file())
    assert words.ids(text) == words.packed(text)


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rest, left, out = 1.5 * sum(sizes.values()), set(order), {}
    while left:
        total = sum(weight[s] for s in left)
        full = [s for s in left if rest * weight[s] / total > 2 * sizes[s]]
        for s in full or left:
            out[s] = 2.0 * sizes[s] if full else rest * weight[s] / total
        rest -= sum(out[s] for s in full)
        left -= set(full) if full else left
    return out


def words(text):
    return len((text or "").encode().split())


def test_mixing_meets_targets(spark, odd_documents, no_documents):
    for docs in (read(spark, SMALL, "documents"), odd_documents):
        for bucket in (M.BUCKET_DOCS, 3):
            rows = M.mix(docs, bucket_docs=bucket).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
            source = defaultdict(set)
            sizes = Counter()
            for r in docs.select("doc_id", "text", "source").collect():
                sizes[r.source] += words(r.text)
                source[r.doc_id].add(r.source)
            targets = brute_targets(sizes)
            assert all(0 <= r.taken <= 2 * r.size for r in rows)
            taken = Counter()
            for r in rows:
                if r.doc_id is not None:
                    assert any(abs(r.target - targets[s]) < 1e-6 and r.source_size == sizes[s] for s in source[r.doc_id])
            by = M.mix(docs, bucket_docs=bucket).groupBy("target", "source_size").sum("taken").collect()
            assert all(abs(r["sum(taken)"] - r.target * round(sum(1 for s in targets if sizes[s] == r.source_size and abs(targets[s] - r.target) < 1e-6))) <= 1 for r in by)
            del taken
        first, again = (sorted(map(str, M.op8_source_mixing(spark, docs).collect())) for _ in range(2))
        assert first == again
    assert M.op8_source_mixing(spark, no_documents).count() == 0


def test_repeated_documents_hold_the_taken_words(spark):
    docs = read(spark, SMALL, "documents")
    mixed = M.mix(docs)
    out = M.repeat_documents(docs, mixed)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += words(r.text)
    assert got == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def brute_pages(rows):
    best = {}
    for r in rows:
        key = (r.html or "").encode()
        best[key] = max(best.get(key, -1), -1 if r.page_id is None else r.page_id)
    out = Counter()
    for r in rows:
        data = (r.html or "").encode()
        response = best[data] == (-1 if r.page_id is None else r.page_id)
        out[r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else best[data]] += 1
    return out


def test_archives_round_trip(spark):
    odd = [(1, "http://a b/\n", "x\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "", ""), (4, "u", "x" * 300_000), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000),
           (None, "v", "only null"), (None, "v", "u"), (6, "w", "u"), (2 ** 60 + 1, "w", "top"), (2 ** 60 + 3, "w", "top"), (7, "w", "é\U0001F600\n"), (8, "w", "9 9 9\nhttp://x 0.0.0.0 1 t 5\n")]
    tables = [read(spark, SMALL, "pages"), spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "page_id as archive", "html as digest")]
    for pages in tables:
        got = Counter(tuple(r) for r in A.op10_warc(spark, pages).collect())
        assert got == brute_pages(pages.collect())
    assert A.op10_warc(spark, tables[1].limit(0)).count() == 0


def test_archive_size_changes_nothing(spark):
    pages = read(spark, SMALL, "pages")
    path = A.write_arc(pages, archive_bytes=20_000)
    assert A._archives(spark, path).count() > 5
    assert A.read_warc(spark, A.convert(spark, path)).count() == pages.count()


def test_arc_versions_and_short_bodies():
    for version in (1, 2):
        data = A.arc_file(7, version, [("http://x/ y", b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nabc"), ("u", b"no head")])
        first, second = A.arc_records(data + b"\n")
        assert (first["url"], first["payload"], first["page_id"], first["date"]) == (b"http://x/%20y", b"abc", 3, A.CAPTURED.encode())
        assert second["page_id"] is None and not second["truncated"]
        assert [r["truncated"] for r in A.arc_records(data[:-3])] == [False, True]
