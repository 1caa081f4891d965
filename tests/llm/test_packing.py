from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from conftest import SMALL
from tokenizers import Tokenizer

from pingworks.llm import packing

BYTES = P.path("byte_bpe_50k.json")


def _gapless(pieces):
    at = 0
    for a, n in sorted(pieces):
        assert a == at and n > 0
        at += n
    return at


def _check(rows, texts):
    tok = Tokenizer.from_file(BYTES)
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        docs[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {k: _gapless(v) for k, v in docs.items()} == {k: len(v) for k, v in ids.items()}
    for v in seqs.values():
        n = _gapless(v)
        assert n == 2048 or n < 2048 and n & (n - 1) == 0  # full, or a power of two: no padding


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    _check(packing.query(spark, SMALL).collect(), texts)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a", 5: "a"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, ids string")
    _check(packing.pack(df, BYTES).collect(), texts)
    twice = packing.pack(df.filter("doc_id = 4").union(df.filter("doc_id = 4")), BYTES).collect()
    assert sum(r.length for r in twice) == 4 and {r.start for r in twice} <= {0, 1}
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert((cells + 0.5) / 4 - 1, 3)
    path = cells[np.argsort(key)]
    assert len(set(key.tolist())) == 512 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one language lie together more often than chance would have it."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    keys = packing.place(rows.select("doc_id", "text"), BYTES).select("doc_id", "curve_key").join(rows, "doc_id").orderBy("curve_key").collect()
    langs = [r.lang for r in keys]
    same = np.mean([a == b for a, b in zip(langs, langs[1:])])
    chance = sum((langs.count(x) / len(langs)) ** 2 for x in set(langs))
    assert same > chance + 0.15
