from __future__ import annotations

from collections import defaultdict

from conftest import SMALL, same_rows

from pingworks.llm import mixing
from pingworks.llm.mixing import Mix

SCHEMA = "doc_id long, text string, lang string, source string"


def test_equals_its_sql(spark, duck):
    same_rows(mixing.query(spark, SMALL), duck, mixing.ORACLE_SQL)


def test_siblings_take_a_shortage_before_other_families(spark):
    """books/en is short: books/de takes its share, web keeps its own."""
    leaves = [("web", "en", "s", 1000, 10), ("books", "en", "s", 10, 1), ("books", "de", "s", 1000, 10)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    mix = Mix(domain={"web": 50, "books": 50}, lang={"en": 90, "de": 10}, share_pct=20, max_epochs=1)
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(df, mix).collect()}
    assert got == {("web", "en"): 201, ("books", "en"): 10, ("books", "de"): 191}


def test_a_whole_family_short_passes_on_and_epochs_repeat(spark):
    leaves = [("web", "en", "a", 100, 10), ("web", "en", "b", 400, 10), ("books", "en", "s", 50, 5)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    mix = Mix(domain={"web": 10, "books": 90}, source={"a": 10, "b": 30}, share_pct=100, max_epochs=2)
    rows = {(r.domain, r.source): (r.budget, r.epochs, r.rest) for r in mixing.budgets(df, mix).collect()}
    assert rows == {("books", "s"): (100, 2, 0), ("web", "a"): (112, 1, 12), ("web", "b"): (337, 0, 337)}


def test_prefix_is_the_longest_that_fits_whatever_the_buckets(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "src0" if i % 3 else "src1") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    picks = []
    for size in (3, 50, 10_000):
        picks.append(sorted((r.doc_id, r.epoch) for r in mixing.select(df, Mix(share_pct=37, bucket_docs=size)).collect()))
    assert picks[0] == picks[1] == picks[2]
    taken = defaultdict(int)
    for i, _ in picks[0]:
        taken[rows[i][3]] += i % 7 + 1
    total = sum(i % 7 + 1 for i in range(400))
    assert total * 0.37 - 14 <= sum(taken.values()) <= total * 0.37


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (2, "a b", "en", "web"), (None, "c", "xx", "src3"), (3, "", "en", "src1")]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], SCHEMA + ", tokens string, epoch int")
    out = mixing.select(df, Mix(share_pct=100, max_epochs=1))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "2", "3", "None"]
    assert mixing.select(df.limit(0)).count() == 0
    staged = mixing.stage(spark, df, "")
    assert staged.columns == df.columns


def test_weight_0_has_no_capacity(spark):
    """books holds only a source without weight, web/de has no weight: all goes to web/en."""
    leaves = [("web", "en", "s", 1000, 10), ("web", "de", "s", 1000, 10), ("books", "en", "none", 1000, 10)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, docs long")
    mix = Mix(domain={"web": 50, "books": 50}, lang={"en": 50, "de": 0}, source={"none": 0}, share_pct=20, max_epochs=1)
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(df, mix).collect()}
    assert got == {("web", "en"): 600, ("web", "de"): 0, ("books", "en"): 0}


def test_rows_without_ids_are_dealt_by_their_texts(spark):
    """10,000 of them in one leaf, with ties and one very long text: the same choice
    whatever the buckets and the order of the input, in many buckets."""
    rows = [(None, f"t{i} " * (i % 5 + 1), "en", "src0") for i in range(10_000)] + [(7, "a b", "en", "src0"), (7, "c d", "en", "src0"), (None, "x " * 500_000, "en", "src0")]
    picks = []
    for size, order in ((200, 1), (5000, -1)):
        df = spark.createDataFrame(rows[::order], SCHEMA)
        mix = Mix(share_pct=30, bucket_docs=size, max_epochs=1)
        picks.append(sorted(hash(r.text) for r in mixing.select(df, mix).collect()))
    assert picks[0] == picks[1] and len(set(picks[0])) == len(picks[0]) > 1000
