from __future__ import annotations

from conftest import SMALL, same_rows

from pingworks.llm import quality

SCHEMA = "doc_id long, text string"


def test_equals_its_sql(spark, duck):
    same_rows(quality.query(spark, SMALL), duck, quality.ORACLE_SQL)


def _brute(text: str) -> tuple[int, int, int, int, int]:
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_counts_against_brute_force(spark):
    texts = [
        None, "", " \t\n", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g", "one\ntwo\none\n\n \none", "é ü # $ |", "\x0b\x0cw\rv",
        "a a a a a a", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6", "long " * 3000 + "tail",
    ]
    rows = quality.judge(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        if len(t) < 1000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _brute(t), t
    big = next(r for r in rows if r.doc_id == 11)
    assert (big.n_words, big.n_repeat_words, big.base_failed, big.kept) == (3001, 3000, True, False)


def test_kinds_of_junk_go_and_prose_stays(spark):
    prose = "The house is on the hill and it was sold to the old man for a sum that he had.\nIt is big and it has windows."
    texts = [prose, prose.upper().replace(" ", "!! "), prose.replace(" ", "$$$ "), " | ".join("zq" + chr(97 + i % 26) * 3 + str(i) for i in range(60)), None]
    kept = {r.doc_id: (r.kept, r.failed_rules) for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [kept[i][0] for i in range(5)] == [True, False, False, False, False]
    assert "shouting" in kept[1][1] and "symbols" in kept[2][1] and "stop_words" in kept[3][1]


def test_stage_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "The house is on the hill and it was sold to the man for a sum.", 7, "x")], "doc_id long, text string, n_words long, kept string")
    out = quality.stage(spark, df, "")
    assert out.columns == df.columns and out.first().n_words == 7
    assert quality.stage(spark, df.limit(0), "").count() == 0


def test_figures_replace_columns_of_their_names(spark):
    text = "The house is on the hill and it was sold to the man for a sum."
    df = spark.createDataFrame([(1, text, "x", "y", 5.0), (1, text, "x", "y", 5.0), (None, None, None, None, None)], "doc_id long, text string, n_words string, kept string, mean_word_chars double")
    rows = quality.judge(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 0, False), (1, 16, True), (1, 16, True)]
    assert {r.mean_word_chars for r in rows if r.doc_id} == {len(text.replace(" ", "")) / 16}


def test_verdicts_may_be_filtered(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    every = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in quality.judge(docs).filter("kept").select("doc_id").collect()} == {k for k, v in every.items() if v}


def test_filtered_verdicts_cost_their_length(spark):
    """A repeated window in 100,000 words, null ids and a text of 1 MB under a filter."""
    import random

    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    again = " ".join(["the", "is", *words, *words[:5]])
    big = " ".join(["the of and", *(f"word{rng.randrange(10**5)} the" for _ in range(90_000))])
    assert len(big) > 1_000_000
    rows = [(1, again), (None, big), (None, None), (None, big)]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).filter("kept").select("doc_id", "n_words", "n_repeat_words").collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 180_003), (0, 180_003)]  # ``again`` lacks stop words
    one = next(r for r in quality.judge(spark.createDataFrame(rows[:1], SCHEMA)).collect())
    assert (one.n_words, one.n_repeat_words, one.failed_rules) == (100_007, 10, ["stop_words"])
