from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from pingworks.llm import jaccard
from pingworks.llm.shared import text_buffer

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _set(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _brute(texts: dict) -> dict:
    sets = {i: _set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def _rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert _rows(jaccard.query(spark, SMALL)) == _brute(texts)


def _near_copies(seed: int) -> dict:
    rng = random.Random(seed)
    texts, n = {}, 0
    for size in (4, 6, 7, 9, 14, 30, 70, 140, 300, 600):
        base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 2 + size // 25)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(0, 2)] = [f"e{rng.randrange(10_000)}"] * rng.randrange(0, 2)
            texts[n] = " ".join(w)
            n += 1
    line = " ".join(f"p{k}" for k in range(40))  # a passage that many share
    for _ in range(40):
        texts[n] = " ".join(f"u{rng.randrange(10_000)}" for _ in range(rng.randrange(1, 30))) + " " + line
        n += 1
    return texts


@pytest.mark.parametrize("single", [False, True])
def test_near_copies_against_brute_force(spark, single):
    texts = _near_copies(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _rows(jaccard.join(df, single=single)) == _brute(texts)


def test_indexed_segments_suffice():
    """Sets that differ by at most H share a signature at a common band."""
    rng = np.random.default_rng(5)
    for n in (1, 3, 4, 8, 20, 63, 64, 100, 127, 128, 200, 400):
        for _ in range(20):
            base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            d = int(rng.integers(0, n // 9 + 1))
            other = np.concatenate([base[d:], rng.integers(1, 1 << 63, int(rng.integers(0, max(1, n // 9))), dtype=np.uint64)])
            a, b = len(base), len(other)
            both = a - d
            if not b or 100 * both < 80 * (a + b - both):
                continue
            h = np.concatenate([np.sort(base), np.sort(other)])
            sets, _, counts, sig, irregular = jaccard.signatures(h, np.array([0, a, a + b]), False)
            assert not len(irregular)
            of = np.repeat(sets, counts)
            assert set(sig[of == 0]) & set(sig[of == 1])


def test_deletions_meet_where_one_element_differs():
    """A set and the same less one element: the segments meet as they are or less one."""
    rng = np.random.default_rng(3)
    for n in (70, 150, 300):
        base = np.sort(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        for gone in range(0, n, 7):
            h = np.concatenate([base, np.delete(base, gone)])
            of, band, seg, size, kind, sig = jaccard.neighbourhoods(h, np.array([0, n, 2 * n - 1]), False)
            mine, theirs = of == 0, (of == 1) & (kind == 0)
            last = seg[theirs].max()
            for s in set(seg[mine & (size > 1) & (seg < last - 1)]):
                assert set(sig[mine & (seg == s)]) & set(sig[theirs])


@pytest.mark.parametrize("single", [False, True])
def test_neighbour_pairs_find_every_link(spark, single):
    """Nothing connected yet, hot passages and all: every link is among the candidates."""
    texts = _near_copies(11)
    sets = {i: _set(t) for i, t in texts.items()}
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    ids = sorted(first.values())
    bodies = spark.createDataFrame([(i, texts[i]) for i in ids], "member long, body string")
    members = jaccard.sketches(bodies).selectExpr("*", "member as comp", "size as shared")
    got = {(r.a, r.b) for r in jaccard.neighbour_pairs(members, bodies, single).collect()}
    links = {(i, j) for i in ids for j in ids if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert links and links <= got


def test_edges(spark):
    rows = [(4, None), (3, ""), (2, " \n\t"), (9, "a b"), (8, "A  B"), (7, "a b c"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "a b"), (5, "A b C d e f g")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, member string, band int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)
    want = [(4, 0, 4), (3, 0, 3), (2, 0, 2), (9, 1, 8), (8, 1, 8), (7, 1, 7), (6, 2, 6), (6, 2, 6), (None, 1, 8), (5, 3, 5)]
    assert got == sorted(want, key=str)
    assert jaccard.join(df.limit(0)).count() == 0


def test_stage_leaves_one_of_each_group(spark):
    texts = _near_copies(3)
    df = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, comp string")
    kept = {r.doc_id for r in jaccard.stage(spark, df, "").collect()}
    assert kept == {c for _, c in _brute(texts).values()}


def test_rows_without_id_link(spark):
    """A chain 1 - null - 2 whose ends do not link, and a near copy without an id."""
    w = [f"w{k}" for k in range(200)]
    a, n, c = w, [*w[:186], *(f"u{k}" for k in range(14))], [*(f"v{k}" for k in range(14)), *w[14:186], *(f"u{k}" for k in range(14))]
    texts = [(1, a), (None, n), (2, c), (None, [*(f"s{k}" for k in range(100))]), (3, [*(f"s{k}" for k in range(99))])]
    sets = [_set(" ".join(t)) for _, t in texts]
    link = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert link(0, 1) and link(1, 2) and not link(0, 2)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, 3), (3, 3)], key=str)
    kept = [r.doc_id for r in jaccard.stage(spark, df, "").collect()]
    assert sorted(kept) == [1, 3]


def test_stage_leaves_one_row_of_each_group(spark):
    w = lambda c: " ".join(f"{c}{k}" for k in range(12))
    rows = [
        (5, w("a"), "x"), (5, w("a"), "x"), (5, w("a"), "y"),  # repeated rows, one with another column
        (1, w("b"), "x"), (7, w("b"), "x"), (7, w("c"), "x"), (8, w("c"), "x"),  # one id with two texts
        (None, w("b"), "x"), (None, w("d"), "x"), (None, w("d"), "x"), (None, w("e"), "x"), (None, w("e").upper(), "x"),
        (9, "", "x"), (9, "", "x"), (None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, (r.text or "").lower()) for r in jaccard.stage(spark, df, "").collect()]
    want = [(5, w("a")), (1, w("b")), (7, w("c")), (None, w("d")), (None, w("e")), (9, ""), (9, ""), (None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(str, jaccard.stage(spark, df.repartition(5), "").collect())) == sorted(map(str, jaccard.stage(spark, df, "").collect()))


def test_shingles_do_not_cross_rows():
    buf, offs = text_buffer(pa.array(["a b c d e", None, "f", "A B c d E"]))
    h, at = jaccard.shingles(buf, offs)
    assert np.diff(at).tolist() == [1, 0, 1, 1] and h[0] == h[2] != h[1]


def test_long_words_of_equal_sums_stay_apart(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    rows = [(1, f"one two three four {x}"), (2, f"one two three four {y}"), (3, f"one two three four {x}")]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
