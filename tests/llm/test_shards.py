"""Packing and sorted-string tables."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortarium.llm import packing, queries, sstable, tokens
from cohortarium.llm.common import new_path
from cohortarium.llm.tokens import default_path

from .conftest import DATA


def library(name):
    t = Tokenizer.from_file(default_path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def packed(rows, room):
    """Whether the pieces of every sequence stand one after the other and fit."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_packing(spark, documents, odd_documents, no_documents):
    encode = library("word_bpe_49k.json")
    for df in (documents, odd_documents):
        want = sorted((str(r.doc_id), k // 4096, k, len(c := ids[k : k + 4096]), crc(c)) for r in df.collect() for ids in [encode(r.text) + [1]] for k in range(0, len(ids), 4096))
        rows = packing.pack_documents(df).collect()
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert packed(rows, 4096) <= 1.02 * (sum(r.length for r in rows) / 4096) + 1
    assert packing.pack_documents(no_documents).count() == 0
    assert queries.op4_best_fit_packing(spark, DATA).count() >= documents.count()


def test_packing_of_many_equal_lengths(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(case when id % 3 = 0 then 60 when id % 3 = 1 then 40 else 7 end as bigint) as length")
    got = packing.pack(rows, 100).collect()
    assert len(got) == 3000 and packed(got, 100) == 1072


@pytest.mark.parametrize("seed", range(5))
def test_fullest_combination(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 6), rng.integers(1, 4, 6), strict=True)}
    used = packing.fullest(counts, 47)
    assert all(n <= counts[k] for k, n in used.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 47)


def test_shards(spark, documents, odd_documents, no_documents):
    encode = library("byte_bpe_50k.json")
    for df in (documents, odd_documents):
        start, want = 0, []
        for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
            ids = encode(r.text) + [0]
            want.append((r.doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.round_trip(df).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    assert sstable.round_trip(no_documents).count() == 0
    assert queries.op10_token_shards(spark, DATA).count() == documents.count()


def test_shard_lookup(spark, documents):
    encode = library("byte_bpe_50k.json")
    shards = sstable.write_shards(documents, new_path(spark, "test-shards"))
    some = documents.limit(5).collect()
    for r in some:
        assert list(memoryview(sstable.lookup(shards, r.doc_id)).cast("H")) == encode(r.text) + [0]
    assert sstable.lookup(shards, 10**9) is None and sstable.lookup(shards, -5) is None


def test_shard_file(tmp_path):
    import pyarrow.fs as fs

    place = str(tmp_path / "a.sst")
    keys = [sstable.key_of(None)] + [sstable.key_of(i) for i in sorted({-3, 0, 1, 255, 256, 70000, *range(500, 900, 7)})]
    with fs.LocalFileSystem().open_output_stream(place) as sink:
        w = sstable.Writer(sink)
        for k in keys:
            w.put(k, k * 1000)
        w.close()
        with pytest.raises(ValueError):
            w.put(sstable.key_of(-9), b"")
    with fs.LocalFileSystem().open_input_file(place) as source:
        reader = sstable.Reader(source)
        assert len(reader.index) > 2
        assert [(k, v) for k, v in reader.scan()] == [(k, k * 1000) for k in keys]
        assert all(reader.get(k) == k * 1000 for k in keys) and reader.get(sstable.key_of(501)) is None
        assert [sstable.id_of(k) for k in keys][:3] == [None, -3, 0]
    data = bytearray((tmp_path / "a.sst").read_bytes())
    data[100] ^= 1
    (tmp_path / "a.sst").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(place) as source, pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(source).scan())


@pytest.mark.parametrize(("name", "chunks"), [("byte_bpe_50k.json", "runs"), ("word_bpe_49k.json", "words")])
def test_ids_are_the_librarys(name, chunks, monkeypatch):
    """Signs of every kind at random, in texts shorter and longer than what is cut at a time."""
    monkeypatch.setattr(tokens, "_BYTES", 500)
    rng = np.random.default_rng(3)
    signs = [*"ab Z9éßİ×÷Ãʰй中'`.,-_<>|\n\t\r\x0b\x1c\x85\xa0 　́Å😀", " the", "it's", "<|endoftext|>", "  "]
    said = ["".join(rng.choice(signs, rng.integers(0, 60), p=None)) for _ in range(1500)] + ["".join(rng.choice([*"abé ,"], 5000)) for _ in range(4)] + ["", " ", "a", "\n\n"]
    for special in (False, True):
        mine, its = tokens.Encoder(default_path(name), chunks, 50, special), Tokenizer.from_file(default_path(name))
        its.encode_special_tokens = not special
        want = [its.encode(t, add_special_tokens=False).ids for t in said]
        for _ in range(2):
            assert [np.frombuffer(x, "<u2").tolist() for x in mine.ids(said)] == want


def test_pack_keeps_columns_of_any_name(spark):
    rows = spark.range(50).selectExpr("id as doc_id", "0 as piece", "cast(id % 7 + 1 as bigint) as length", "id as _rank", "'x' as _salt", "id as _n", "id as _before")
    got = packing.pack(rows, 10).collect()
    assert sorted((r.doc_id, r._rank, r._n, r._before) for r in got) == [(k, k, k, k) for k in range(50)] and packed(got, 10) <= 21
