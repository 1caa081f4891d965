"""Quality rules: one table of thresholds, compiled into one projection.

Every figure comes from Spark's own expressions, so the rules run inside the scan
stage: no shuffle, no Python.

Defined cases: a null text is an empty text (no words: rejected by ``min_words``);
a null doc_id is kept as it is, since no rule reads it;
repeated rows are judged one by one; other columns pass through untouched, but a
column that bears the name of a count, a ratio or a verdict is replaced by it; helper
columns carry a ``__q_`` prefix so that they cannot clash; an empty table gives an
empty table; very long texts are judged whole (tested at 1 MB)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words by language.
STOP_WORDS = {
    "en": "a an and are as at be by for from he in is it of on or re that the this to was with",
    "de": "auf aus das dem den der des die ein eine im in ist mit nicht sie sich und von zu",
    "fr": "au aux avec dans de des du elle en et il la le les par pas pour que qui sur un une",
    "es": "al con de del el en es esta la las lo los no para por que se su un una y",
}


@dataclass(frozen=True)
class Rule:
    """``figure`` must lie in [low, high]; a missing bound is open.  ``when`` names
    figures that must reach a value before the rule applies."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None
    when: tuple[str, float] | None = None


#: Names and bounds; `figures` says how each figure is computed.
RULES = (
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=15.0),
    Rule("symbols", "symbols_per_word", high=0.3),
    Rule("shouting", "upper_per_letter", high=0.5),
    Rule("exclamation", "marks_per_word", high=0.3),
    Rule("letters", "letter_words_per_word", low=0.7),
    Rule("stop_words", "stop_words_per_word", low=0.02, when=("n_words", 50)),
    Rule("duplicate_lines", "dup_lines_per_line", high=0.3, when=("n_dup_lines", 4)),
    Rule("bullets", "bullet_lines_per_line", high=0.9),
    Rule("ellipses", "ellipsis_lines_per_line", high=0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(words: Column) -> Column:
    """A hash for each window of words, in place; null for fewer words than a window."""
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    return F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window))


def _repeated(hashes: Column) -> Column:
    """Ascending places of the windows found twice or more; only texts with some repeat
    pay for the sort."""
    placed = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = lambda s: lambda x, j: F.when(
        ((j > 0) & (x["h"] == F.get(s, j - 1)["h"])) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"]
    )
    return F.sort_array(_let(placed, lambda s: F.array_compact(F.transform(s, twice(s)))))


def _covered(at: Column) -> Column:
    """Words that the windows at these places cover."""
    own = lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))
    return F.coalesce(F.aggregate(F.transform(at, own), F.lit(0), lambda a, x: a + x), F.lit(0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The base counts of a text."""
    covered = _let(_hashes(words), lambda h: _let(_repeated(h), _covered))
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
    }
    return {k: v.cast("long") for k, v in out.items()}


def figures(text: Column, words: Column, lines: Column, c: Column) -> dict[str, Column]:
    """Length, symbol, stop-word and line ratios; ``c`` holds the base counts."""
    n, n_lines = c["n_words"], F.size(lines)
    stop = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    of_lines = lambda p: _ratio(F.size(F.filter(lines, lambda x: x.rlike(p))), n_lines)
    return {
        "mean_word_chars": _ratio(c["word_chars"], n),
        "symbols_per_word": _ratio(c["n_symbols"], n),
        "upper_per_letter": _ratio(F.regexp_count(text, F.lit(r"\p{Lu}")), F.length(F.regexp_replace(text, r"\P{L}+", ""))),
        "marks_per_word": _ratio(F.regexp_count(text, F.lit(r"[!?]+")), n),
        "letter_words_per_word": _ratio(F.size(F.filter(words, lambda x: x.rlike(r"\p{L}"))), n),
        "stop_words_per_word": _ratio(F.size(F.filter(words, lambda x: F.lower(x).isin(*stop))), n),
        "dup_lines_per_line": _ratio(c["n_dup_lines"], n_lines),
        "bullet_lines_per_line": of_lines(r"^\s*[-*•]"),
        "ellipsis_lines_per_line": of_lines(r"(\.\.\.|…)\s*$"),
    }


def compile_rules(rules: tuple[Rule, ...], of: Callable[[str], Column]) -> dict[str, Column]:
    """One boolean column a rule, true where a text breaks it; ``of`` gives a count or
    figure by name."""
    out = {}
    for r in rules:
        x = of(r.figure)
        broken = F.lit(False)
        if r.low is not None:
            broken = broken | (x < F.lit(float(r.low)))
        if r.high is not None:
            broken = broken | (x > F.lit(float(r.high)))
        if r.when is not None:
            broken = broken & (of(r.when[0]) >= F.lit(r.when[1]))
        out[r.name] = broken
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_pct: int = 20) -> Column:
    """Counts, ratios, ``base_failed``, ``failed_rules`` and ``kept`` of a text, as one
    struct.  Words, lines, counts and ratios are lambda arguments, each computed once a
    row; so the struct may be filtered on, pushed down or repeated at its own cost."""
    named = lambda d: F.struct(*[v.alias(k) for k, v in d.items()])

    def judged(c: Column, f: Column) -> Column:
        n = c["n_words"]
        base = (n < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * n)
        broken = compile_rules(rules, lambda x: c[x] if x in COUNTS else f[x])
        failed = F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in broken.items()]))
        whole = lambda x: F.struct(*[c[k].alias(k) for k in COUNTS], *[f[k].alias(k) for k in ratios], base.alias("base_failed"), x.alias("failed_rules"), (~base & (F.size(x) == 0)).alias("kept"))
        return _let(failed, whole)

    ratios = list(figures(text, text, text, F.struct()))
    lines_of = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parted = lambda t, body: _let(F.array_remove(F.split(t, SPACES), ""), lambda w: _let(lines_of(t), lambda l: body(t, w, l)))
    counted = lambda t, w, l: _let(named(counts(t, w, l)), lambda c: _let(named(figures(t, w, l, c)), lambda f: judged(c, f)))
    return _let(F.coalesce(text, F.lit("")), lambda t: parted(t, counted))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """``docs`` with counts, ratios, ``base_failed``, ``failed_rules`` and ``kept``."""
    df = docs.withColumn("__q_verdict", verdict(F.col(text), rules, min_words, max_repeat_pct))
    fields = [f.name for f in df.schema["__q_verdict"].dataType.fields]
    return df.withColumns({k: F.col(f"__q_verdict.{k}") for k in fields}).drop("__q_verdict")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(*RESULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that every rule keeps, with their columns."""
    return docs.filter(F.coalesce(verdict(F.col("text"))["kept"], F.lit(False)))


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))

ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), win AS (
  SELECT doc_id, i, list_aggregate(words[i : i + 4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), rep AS (
  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5) AS gap
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT doc_id, sum(least(5, gap))::BIGINT AS n FROM rep GROUP BY doc_id
), c AS (
  SELECT w.doc_id, t, words, lines, len(words)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols,
    length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS letters,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS uppers,
    len(regexp_extract_all(t, '[!?]+')) AS marks,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS letter_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS stops,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS ellipses
  FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND mean_word_chars BETWEEN 2.0::DOUBLE AND 15.0::DOUBLE
  AND symbols <= 0.3::DOUBLE
  AND (letters = 0 OR uppers::DOUBLE / letters <= 0.5::DOUBLE)
  AND marks::DOUBLE / n_words <= 0.3::DOUBLE
  AND letter_words::DOUBLE / n_words >= 0.7::DOUBLE
  AND (n_words < 50 OR stops::DOUBLE / n_words >= 0.02::DOUBLE)
  AND (n_dup_lines < 4 OR n_dup_lines::DOUBLE / len(lines) <= 0.3::DOUBLE)
  AND bullets::DOUBLE / len(lines) <= 0.9::DOUBLE
  AND ellipses::DOUBLE / len(lines) <= 0.3::DOUBLE AS kept
FROM f
"""
