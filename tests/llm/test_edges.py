"""Rows without ids, texts of a megabyte, repeated rows and columns of clashing names,
through each operator on documents."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from pingworks.llm import jaccard, media, mixing, packing, quality, tokencounts, tokenids
from pingworks.llm.shared import new_path

LONG = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(180_000))  # 1.3 MB, no word twice
TEXTS = [(None, "one two"), (None, "one two"), (None, "three four five"), (None, None), (1, None), (2, ""), (3, LONG), (3, LONG), (None, LONG), (4, "one two")]
#: Names that the operators give to columns of their own.
CLASH = ["ids", "n_ids", "start", "length", "offset", "n_tokens", "n_bytes", "media", "size", "member", "comp", "row_hash", "sig", "part", "tokens", "epoch", "domain", "kept", "n_words", "score", "bucket"]


@pytest.fixture(scope="module")
def odd(spark):
    names = [F.lit("x").alias(c) for c in CLASH]
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit("src1").alias("source"), *names)


def _ids(name):
    tok = Tokenizer.from_file(P.path(name))
    return lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing(odd):
    ids = _ids("byte_bpe_50k.json")
    got, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(odd, P.path("byte_bpe_50k.json")).collect():
        got[r.doc_id].append((r.start, tuple(np.frombuffer(r.ids, "<u2"))))
        seqs[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for k, t in TEXTS:
        want[k].update(ids(t))
    # the same ids under each doc_id, rows without one included
    assert {k: Counter(x for _, p in v for x in p) for k, v in got.items()} == want
    for pieces in seqs.values():
        at = 0
        for a, n in sorted(pieces):
            assert a == at
            at += n
        assert at == 2048 or at < 2048 and at & (at - 1) == 0


def test_token_ids(spark, odd):
    ids, path = _ids("word_bpe_49k.json"), new_path(spark, "ids")
    tokenids.write(odd, path, P.path("word_bpe_49k.json"))
    rows = sorted(tokenids.read(spark, path).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)  # rows without doc_id come first
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((k, len(ids(t)), crc(t)) for k, t in TEXTS)


def test_media(spark, odd):
    path = new_path(spark, "media")
    media.store(odd, path)
    pad = lambda b: b.ljust(max(192, -(-len(b) // 192) * 192), b" ")
    want = Counter((k, len(b), hashlib.sha256(pad(b)).hexdigest()) for k, b in ((k, (t or "").encode()) for k, t in TEXTS))
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256) for r in media.load(spark, path).collect()) == want


def test_token_counts(spark, odd):
    encode = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")).encode
    got = tokencounts.count_tokens(odd, new_path(spark, "cache"), P.path("piece_bpe_32k.model"))
    size = {t: len(encode(t or "")) for t in {t for _, t in TEXTS}}
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == Counter((k, len((t or "").encode()), size[t], size[t] > 4096) for k, t in TEXTS)


def test_quality_rules(odd):
    words = lambda t: len((t or "").split())
    rows = quality.judge(odd).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed) for r in rows) == Counter((k, words(t), 0, words(t) < 10) for k, t in TEXTS)
    assert all(not (r.base_failed and r.kept) for r in rows)


def test_jaccard_join(odd):
    rows = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect())
    # copies share the smallest id, also with rows that have none; those alone have null
    want = [(None, 1, 4), (None, 1, 4), (None, 1, None), (None, 0, None), (1, 0, 1), (2, 0, 2), (3, 179_996, 3), (3, 179_996, 3), (None, 179_996, 3), (4, 1, 4)]
    assert rows == Counter(want)


def test_mixing(odd):
    rows = mixing.select(odd).collect()
    words = Counter((k, len((t or "").split())) for k, t in TEXTS)
    taken = Counter((r.doc_id, int(r.tokens), r.epoch) for r in rows)
    assert rows and all((k, n) in words and c <= words[(k, n)] for (k, n, _), c in taken.items())


def test_pipeline_keeps_one_of_the_repeated_rows(spark, odd):
    prose = "The house on the hill was sold to a man who had come from the town in the spring, and he said that it was good."
    more = spark.createDataFrame([(9, prose), (8, prose), (8, prose), (None, prose)], "doc_id long, text string")
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id") + 1000, "text")  # so that the mix has something to take
    docs = odd.unionByName(more.union(table), allowMissingColumns=True).fillna({"lang": "en", "source": "src1"})
    clash = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    docs = docs.fillna("x", clash)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        out.write.parquet(path := new_path(spark, "edges"))
        assert T.StructType(out.schema).names == docs.columns
        docs = spark.read.parquet(path)
        if name == "n-gram Jaccard join":
            assert [r.doc_id for r in docs.filter(F.col("text") == prose).collect()] == [8]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert ids(packing.stage(spark, docs, SMALL)) == ids(docs) != set()
