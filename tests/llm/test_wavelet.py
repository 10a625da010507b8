import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callweave.llm import wavelet as wv


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(wv.tokenizer_path())


ENCODER = wv.Encoder(wv.tokenizer_path(), cache=50)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r", "\xa0", " ", "the", "Theß", "éà", "x1", "9", "!!", ".\nA", "a,", "ß.", "²;", "e\u0301.", "\n\n", "\x0b\n", ",", ".", "'s", "don't", "漢字", "ǆ", "ʰa", "<|endoftext|>", "|", "a|", "\x1c", "٣", "𝒳y"]), max_size=14).map("".join))
def test_ids_are_the_tokenizers(text):
    whole = Tokenizer.from_file(wv.tokenizer_path()) if not hasattr(test_ids_are_the_tokenizers, "t") else test_ids_are_the_tokenizers.t
    test_ids_are_the_tokenizers.t = whole
    assert np.frombuffer(ENCODER([text])[0], ENCODER.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_matrix(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 50256).astype(np.uint32)
    m = wv.WaveletMatrix(wv.encode_file(ids, [(None, n)]))
    assert (m.decode() == ids).all() and m.documents() == [(None, n)]
    for i in rng.integers(0, n, 40) if n else []:
        assert m.access(int(i)) == ids[i]
    for t in [*rng.choice(ids, 20), 0, 3, 70000] if n else [5]:
        places = np.flatnonzero(ids == t)
        assert m.count(int(t)) == len(places)
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        assert m.count(int(t), lo, hi) == ((places >= lo) & (places < hi)).sum()
        for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
            assert m.select(int(t), k) == places[k]
        with pytest.raises(IndexError):
            m.select(int(t), len(places))


def test_written_and_read(spark, tokenizer, monkeypatch):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "Über", "x1", "end.\n", "a|b"]) for _ in range(rng.randrange(60)))) for k in range(300)]
    rows += [(-5, None), (7, rows[7][1]), (None, "no id"), (900, ""), (901, "word " * 20000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    shards = wv.write_shards(docs, wv.new_folder(spark, "t"), shard_tokens=1000)
    kept = wv.saved(shards, "t")
    assert kept.count() > 10 and kept.agg({"n_docs": "sum"}).first()[0] == len(rows)
    got = sorted(wv.read_documents(kept).collect(), key=lambda r: r.start)
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_empty_table(spark):
    assert wv.written_and_read(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_distinct_words_are_looked_up_once():
    """However often a word comes in the texts of a call, it is looked up once, as is a line break with its word."""

    class Counting(dict):
        looked_up = 0

        def get(self, *args):
            Counting.looked_up += 1
            return super().get(*args)

    encode = wv.Encoder(wv.tokenizer_path())
    texts = ["one two, three\none two, three\n" * 50 + "end"] * 20
    want = encode(texts)
    encode.chunks = Counting(encode.chunks)
    assert encode(texts) == want and 0 < Counting.looked_up <= 5
    whole = Tokenizer.from_file(wv.tokenizer_path())
    assert np.frombuffer(want[3], encode.dtype).tolist() == whole.encode(texts[3], add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", " a", " b,", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x85", " ", "　", "﻿", "c", "'ll", "é.", "7", "...", "w" * 300, "<|endoftext|>"]), max_size=9).map("".join), max_size=5))
def test_ids_of_several_texts(texts):
    whole = test_ids_of_several_texts.__dict__.setdefault("t", Tokenizer.from_file(wv.tokenizer_path()))
    assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
