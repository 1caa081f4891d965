from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pingworks.llm import idfile, tokencounts, tokenids
from pingworks.llm.encode import Encoder
from pingworks.llm.shared import new_path

PIECES = P.path("piece_bpe_32k.model")
WORDS = P.path("word_bpe_49k.json")
ODD = ["", " ", "a  b", " a", "a ", "é è", "a　 b", "a ́b", "<|endoftext|> x <|endoftext|>", "It's  \n\n ok don't", "Σ ΑΣ Σ", "日本 語", "🙂 🙂", "<s> </s>", "a▁b ▁c", "ﬁ Å", "x\x00 \x00y", "One.\nTwo,\n\nthree!\r\nfour\n five \nsix.seven:8\n9;a's\n", "<|EndOfText|> A.\nB", "E\u0301.\nE\u0301 É.\né", "Été$$$ ÀÖØÞß×÷ ×$ ÷% é-É_é=\u0338 a=\u0338 don't-it's"]


def _library(name):
    if name.endswith(".model"):
        return SentencePieceProcessor(model_file=P.path(name)).encode
    tok = Tokenizer.from_file(P.path(name))
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab é'<|>\n\t 日́ .1"), max_size=30), max_size=4))
def test_chunks_give_the_librarys_ids(name, texts):
    texts, encode = [*texts, *ODD], _library(name)
    encoder = Encoder(P.path(name)) if name not in Encoder._by_path else Encoder.of(P.path(name))
    got = [f[a:b].tolist() for _, _, f, at in encoder.ids(pa.array(texts), 1) for a, b in zip(at[:-1], at[1:])]
    assert got == [[*encode(t), 1] for t in texts]


def _complements(a: str, b: str, rounds: int = 10) -> list[str]:
    """A long word of two blocks and the word with the blocks exchanged: equal sums of
    any polynomial modulo 2^64."""
    x, y = a, b
    for _ in range(rounds):
        x, y = x + y, y + x
    return [x, y]


TWINS = [*_complements("a", "b"), *_complements("ing", "zqx"), *_complements("a", "b", 11)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_chunks_of_one_hash_keep_their_own_ids(name):
    encode, encoder = _library(name), Encoder(P.path(name))
    texts = [*TWINS, *reversed(TWINS), f"x {TWINS[3]} y {TWINS[2]} z"]
    for _ in range(2):
        got = [f[a:b].tolist() for _, _, f, at in encoder.ids(pa.array(texts), 1) for a, b in zip(at[:-1], at[1:])]
        assert got == [[*encode(t), 1] for t in texts]
    assert encoder.odd
    assert encoder.counts(pa.array(texts)).tolist() == [len(encode(t)) for t in texts]


def test_counts_and_cache(spark):
    encode = _library("piece_bpe_32k.model")
    texts = [None, "", "two words", "two words", "word " * 5000, *ODD]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    cache = new_path(spark, "cache")
    rows = tokencounts.count_tokens(docs, cache, PIECES).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        n = len(encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096)
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    tokencounts.count_tokens(docs.union(spark.createDataFrame([(99, "new one", "x")], docs.schema)), cache, PIECES).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1  # only the miss was added
    assert tokencounts.count_tokens(docs.limit(0), new_path(spark, "cache"), PIECES).count() == 0


def test_query_counts_the_whole_table(spark):
    encode = _library("piece_bpe_32k.model")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in tokencounts.query(spark, SMALL).collect()} == {k: len(encode(t)) for k, t in texts.items()}


def _blocks(raw):
    return np.concatenate([np.zeros(0, np.uint16), *idfile.read_ids(raw)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.sampled_from([1, 7, 64]), st.sampled_from([1, 16, 4096]), st.sampled_from([100, 1 << 22]))
def test_range_code_round_trip(ids, lane_ids, lanes, block):
    ids = np.array(ids, np.uint16)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(idfile, "LANE_IDS", lane_ids), m.setattr(idfile, "LANES", lanes), m.setattr(idfile, "BLOCK", block)
        assert _blocks(idfile.write_ids(ids)).tolist() == ids.tolist()


def test_range_code_of_repetitive_and_random_ids():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(20_000, np.uint16), np.tile(np.arange(50, dtype=np.uint16), 3000), rng.integers(0, 65536, 70_000).astype(np.uint16), np.array([65535], np.uint16)):
        assert (_blocks(idfile.write_ids(ids)) == ids).all()
    assert len(idfile.write_ids(np.zeros(20_000, np.uint16))) < 1_000
    assert len(idfile.write_ids(np.tile(np.arange(50, dtype=np.uint16), 3000))) < 40_000
    assert len(idfile.write_ids(rng.integers(0, 65536, 70_000).astype(np.uint16))) < 2.4 * 70_000  # and the alphabet


def _entropy(ids):
    p = np.bincount(ids) / len(ids)
    return -(p[p > 0] * np.log2(p[p > 0])).sum()


@pytest.mark.parametrize("n", [60_000, 250_000, 900_000])
def test_mixing_beats_its_order_0_part_and_deflate(n):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0)
    ids = np.concatenate([f for _, _, f, _ in Encoder.of(WORDS).ids(texts, 1)])[:n]
    bits = 8 * len(idfile.write_ids(ids)) / len(ids)
    assert bits < _entropy(ids) and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_order_0_counts_move_the_code():
    # ids that never repeat a context: only order 0 can tell that half of them are one id
    rng = np.random.default_rng(4)
    ids = rng.permutation(30_000).astype(np.uint16)
    ids = np.where(rng.random(30_000) < 0.5, 7, ids).astype(np.uint16)
    m = idfile._Mixer(30_000, 4)
    before = m.base[7]
    for i in range(0, 2000, 4):
        m.predict()
        m.learn(ids[i : i + 4].astype(np.uint32))
    assert m.base[7] > 1000 * before


def test_damage_is_found_in_its_block(monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 1000)
    ids = np.arange(3000, dtype=np.uint16) % 99
    raw = idfile.write_ids(ids)
    _, second = idfile.decode_block(raw)
    for at in (3, 40, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            _blocks(bytes(bad))
    bad = bytearray(raw)
    bad[second + 50] ^= 1
    assert (idfile.decode_block(bytes(bad))[0] == ids[:1000]).all()  # damage stays in its block
    _, third = idfile.decode_block(raw, second)
    assert (idfile.decode_block(raw, third)[0] == ids[2000:]).all()  # a block alone


def test_file_alone_has_the_documents():
    docs, lengths = [None, -5, 7, 7, 1 << 40], np.array([2, 1, 3, 0, 4])
    raw = idfile.write_file(docs, lengths, np.arange(10, dtype=np.uint16))
    got = idfile.read_file(raw)
    assert got[0] == docs and got[1].tolist() == lengths.tolist() and got[2].tolist() == list(range(10))
    for at in (2, 35, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            idfile.read_file(bytes(bad))


def test_id_files_round_trip(spark):
    encode = _library("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got, at = {r.doc_id: r for r in tokenids.query(spark, SMALL).collect()}, 0
    for k in sorted(texts):
        ids = [*encode(texts[k]), 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_id_file_edges(spark):
    docs = spark.createDataFrame([(5, ""), (None, "x y"), (5, ""), (2, None), (7, "w " * 9000)], "doc_id long, text string")
    path = new_path(spark, "ids")
    tokenids.write(docs, path, WORDS)
    rows = sorted(((r.start, r.doc_id, r.n_tokens) for r in tokenids.read(spark, path, True).collect()))
    assert rows == [(0, None, 3), (3, 2, 1), (4, 5, 1), (5, 5, 1), (6, 7, 9001)]
    path = new_path(spark, "ids")
    tokenids.write(docs.limit(0), path, WORDS)
    assert tokenids.read(spark, path).count() == 0
