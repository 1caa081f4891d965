from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from conftest import SMALL
from test_jaccard import _brute
from tokenizers import Tokenizer

import corpus_pipeline
from pingworks.llm import mixing, quality, toxicity
from pingworks.llm.shared import cut


def test_stages_one_by_one(spark):
    """Each stage against a plain version of it, on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "n-gram Jaccard join", "mixing to target weights", "packing"]
    start = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = start, []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SMALL), "test")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == start.columns
    good, clean, single, mixed, packed = kept
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) == {r.doc_id for r in quality.judge(start).filter("kept").collect()}
    model = toxicity.train(start, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert ids(clean) == {r.doc_id for r in toxicity.score(good, model).filter("predicted = 0").collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert ids(single) == {c for _, c in _brute(texts).values()} and single.count() == len(ids(single))
    want = Counter(r.doc_id for r in mixing.select(single).collect())
    assert Counter(r.doc_id for r in mixed.collect()) == want
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u2").tolist()))
    for doc, n in want.items():
        row = tok.encode(texts[doc], add_special_tokens=False).ids + [1]
        assert Counter(x for _, p in pieces[doc] for x in p) == Counter({k: n * v for k, v in Counter(row).items()})
    assert set(pieces) == set(want)


def test_run_gives_the_pieces(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0


def test_empty_and_odd_tables_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "src1", 0), (None, "x y", None, "s", 3), (2, "The house is on the hill and it was sold to the man for a sum.", "en", "src2", 60)]
    odd = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for df in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            out.collect()
            assert name == "packing" or out.columns == df.columns
