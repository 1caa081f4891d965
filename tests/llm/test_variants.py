from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL, same_rows

from pingworks.llm import variants as V

LOW = {i: i + 32 for i in range(65, 91)}


def _words(docs, damage=199):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % damage == 0:
                p = h % len(w)
                w = w[:p] + w[p + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def _edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _near(words) -> dict[str, list[str]]:
    out, by_form = {w: set() for w in words}, {}
    for w in words:
        for f in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_form.setdefault(f, []).append(w)
    for group in by_form.values():
        for a in group:
            out[a] |= {b for b in group if a != b and _edit(a, b)}
    return out


def _brute(words):
    near = _near(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_equals_its_sql(spark, duck):
    same_rows(V.query(spark, SMALL), duck, V.ORACLE_SQL)


def _rows(df):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    assert len(out) == df.count()
    return out


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = _brute(_words(docs))
    assert _rows(V.query(spark, SMALL)) == want and sum(v[0] is not None for v in want.values()) > 10


@pytest.mark.parametrize(("hot", "block"), [(V.HOT, V.BLOCK), (2, 64), (40, 3)])
def test_pairs_of_close_words(spark, hot, block):
    """Words of few letters, one edit apart in every way; also through hot keys and tiles."""
    rng = random.Random(hot)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 7, 8, 9, 12]))) for _ in range(400)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ÿ÷×àèì", "ÿ÷×àèìo"}
    vocab = spark.createDataFrame([(w, 5 + len(w)) for w in words], "word string, n long")
    rows = [(r.word, r.near, r.near_n) for r in V.near_pairs(vocab, hot=hot, block=block).collect()]
    near = _near(words)
    assert Counter(rows) == Counter((a, b, 5 + len(b)) for a, v in near.items() for b in v)


def test_chains_ties_and_odd_rows(spark):
    chain = ["banana", "bananas", "bananass", "bananasss", "bananassss"]  # each form a fifth as frequent as the last
    counts = {w: 5 ** (5 - k) for k, w in enumerate(chain)} | {"kitten": 5, "mitten": 25, "bitten": 25, "sitten": 24, "abcdef": 4, "short": 99}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    long = "x" * 300_000
    rows = [(1, text, "w", 3), (None, None, None, None), (2, "", None, None), *[(3, f"{long} {long}y", None, None)] * 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    got = _rows(V.group(docs))
    assert got[chain[4]] == (chain[3], "banana", 5, 1, 25) and got["banana"] == (None, "banana", 3125, 1, None)
    assert got["kitten"][0] == "bitten" and got["kitten"][3] == 3 and "abcdef" not in got and "short" not in got
    assert got[long] == (None, long, 5, 1, None)
    assert set(got) == {*chain, "kitten", "mitten", "bitten", "sitten", long, long + "y"}
    assert V.group(docs.limit(0)).count() == 0


def test_damage_and_letters(spark):
    rng = random.Random(2)
    docs = [(d, " ".join("".join(rng.choice("ABCabcÀéß×") for _ in range(7)) + rng.choice(["", "1", "Ā", "-"]) for _ in range(400))) for d in (None, 4, 5)]
    docs = [(d, t + " " + t + " ÀBCDEFG àbcdefg") for d, t in docs] * 3
    got = {r.word: r.n for r in V.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), 199).collect()}
    assert got == _words(docs) and any(len(w) == 6 for w in got)
