"""Mixing sources to target weights: hierarchical token budgets, seeded epochs.

Leaves are (domain, language, source).  A total budget flows down the tree by weight.
A node never gets more than its leaves can give (their tokens times ``max_epochs``);
what it lacks goes to its siblings first, by weight, and only what a whole family
lacks goes to the families beside it.  Within a family that is a water level: children
in ascending order of capacity per weight are full until the level is below one.
All of it is integer arithmetic in window functions over one row a leaf.

The unit is whitespace-delimited words, so that SQL can check every row; ``tokens`` takes
another count, such as that of the digest cache.

A leaf's budget is spent epoch by epoch: whole epochs take every document, the last one
takes the longest prefix that fits of that epoch's seeded order.  The prefix is found
over hash buckets of some thousand documents, so no leaf is ever sorted in one task.

Defined cases: null domain, language or source is the name "" of its level; a null text
has no tokens and is taken while its turn comes before the budget ends; repeated rows
are documents of their own; where the seeded order, by doc_id, ties, token count and then
the text's hash decide; rows without doc_id are ordered, and dealt to buckets, by the hash
of their text; very long texts count whole (tested at 1 MB);
a weight that is absent is ``default_weight``, weight 0 gives nothing and leaves its part
to its siblings, then to other families; other columns
pass through (helpers carry a ``__m_`` prefix); an empty table gives an empty table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingworks.llm.shared import cut

LEVELS = ("domain", "lang", "source")


def _domains() -> dict[str, int]:
    return {"web": 40, "books": 30, "news": 20, "forum": 10}


@dataclass(frozen=True)
class Mix:
    """Integer weights by level and name, and how much to take."""

    domain: dict[str, int] = field(default_factory=_domains)
    lang: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source: dict[str, int] = field(default_factory=dict)
    default_weight: int = 10
    share_pct: int = 80  # of all tokens there are
    max_epochs: int = 2
    seed: str = "mix-1"
    bucket_docs: int = 2048


def domain_of(source: Column) -> Column:
    """Domain of a source where the table names none: by the number in its name."""
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, r"(\d+)$", 1), F.lit("")), F.lit("999999999999999")).cast("long"), F.lit(0))
    return F.when(source.isNull(), F.lit("")).otherwise(F.element_at(F.array(*[F.lit(d) for d in _domains()]), (number % 4 + 1).cast("int")))


def count_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    named = getattr(mix, level)
    out = F.lit(mix.default_weight).cast("long")
    if named:
        table = F.create_map(*[F.lit(x) for kv in named.items() for x in (kv[0], int(kv[1]))])
        out = F.coalesce(F.try_element_at(table, F.col(level)).cast("long"), out)
    return out


def _share(nodes: DataFrame, parents: list[str], level: str, budget: Column, mix: Mix) -> DataFrame:
    """``nodes`` (one row a child, with ``cap``) with its ``budget`` out of the parent's."""
    big = lambda c: c.cast("decimal(38,0)")
    df = nodes.withColumn("__m_w", _weight(level, mix)).withColumn("__m_b", budget).withColumn("__m_cap", F.when(F.col("__m_w") > 0, F.col("cap")).otherwise(0))
    w, cap = F.col("__m_w"), F.col("__m_cap")
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    # by capacity per weight, compared as exact fractions scaled to whole numbers
    per = F.when(w > 0, (big(cap) * F.lit(1_000_000)).cast("decimal(38,0)") / w)
    line = family.orderBy(per.asc_nulls_last(), level)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("__m_b") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    rest = F.sum(w).over(family) - F.coalesce(F.sum(w).over(before), F.lit(0))
    df = df.withColumns({"__m_left": left, "__m_rest": rest})
    full = (w > 0) & (big(cap) * F.col("__m_rest") <= big(w) * F.col("__m_left"))
    df = df.withColumn("__m_full", full)
    # the level is set by the first child that is not full
    open_ = ~F.col("__m_full") & (w > 0)
    df = df.withColumns({
        "__m_top": F.min(F.when(open_, F.struct(per.alias("p"), F.col(level).alias("n"), F.col("__m_left").alias("left"), F.col("__m_rest").alias("rest")))).over(family),
    })
    part = F.floor(big(w) * big(F.col("__m_top.left")) / big(F.col("__m_top.rest"))).cast("long")
    df = df.withColumn("budget", F.when(F.col("__m_full"), cap).when(w > 0, F.greatest(F.lit(0), part)).otherwise(0).cast("long"))
    return df.drop(*[c for c in df.columns if c.startswith("__m_")])


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with budget, whole epochs and the
    rest of the budget for the epoch that is cut."""
    can = lambda level, cap: F.when(_weight(level, mix) > 0, cap).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("cap", can("source", F.col("tokens") * mix.max_epochs))  # what has no weight gives nothing
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    langs = langs.withColumn("cap", can("lang", F.col("cap")))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))).cast("decimal(38,0)") * mix.share_pct / 100).cast("long")
    domains = _share(domains, [], "domain", total, mix).select("domain", F.col("budget").alias("above"))
    langs = _share(langs.join(domains, "domain"), ["domain"], "lang", F.col("above"), mix).select("domain", "lang", F.col("budget").alias("above"))
    out = _share(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", F.col("above"), mix)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).otherwise(0).cast("int")
    out = out.withColumn("epochs", whole)
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("cap", "above")


def select(docs: DataFrame, mix: Mix = Mix(), tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """``docs`` with domain, tokens and epoch: one row for each time that a document is
    taken.  ``docs`` needs doc_id, text, lang and source."""
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__m_row"), *[c for c in ("doc_id", "text", "lang", "source")])
    body = F.xxhash64(F.coalesce("text", F.lit("")))
    salt = F.when(F.col("doc_id").isNull(), F.hex(body)).otherwise(F.lit(""))
    work = work.select(
        "__m_row", "doc_id", salt.alias("__m_salt"), body.alias("__m_body"),
        F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        (count_words() if tokens is None else tokens).alias("tokens"),
    )
    leaf = list(LEVELS)
    light = cut(work.drop("__m_row"), "mix-docs")
    plan = cut(budgets(light.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), mix).withColumnRenamed("tokens", "leaf_tokens"), "mix-plan")

    def placed(rows: DataFrame) -> DataFrame:
        """Each document's key in the epoch that its leaf cuts, and the key's bucket."""
        out = rows.join(plan.select(*leaf, "epochs", "rest", "docs"), leaf)
        key = F.md5(F.concat_ws("|", F.lit(mix.seed), F.col("epochs").cast("string"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("__m_salt"))).cast("binary"))
        out = out.withColumn("__m_key", key)
        n = F.floor((F.col("docs") + mix.bucket_docs - 1) / mix.bucket_docs)
        at = F.conv(F.substring("__m_key", 1, 8), 16, 10).cast("long")
        return out.withColumn("__m_bucket", F.floor(at * n / F.lit(4294967296)).cast("long"))

    sums = placed(light).groupBy(*leaf, "__m_bucket").agg(F.sum("tokens").alias("__m_sum"), F.first("rest").alias("__m_rest"))
    before = Window.partitionBy(*leaf).orderBy("__m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__m_before", F.coalesce(F.sum("__m_sum").over(before), F.lit(0)))
    sums = sums.withColumn("__m_in", F.when(F.col("__m_before") + F.col("__m_sum") <= F.col("__m_rest"), 2).when(F.col("__m_before") <= F.col("__m_rest"), 1).otherwise(0))
    sums = cut(sums.select(*leaf, "__m_bucket", "__m_before", "__m_in"), "mix-buckets")
    rows = placed(work).join(sums, [*leaf, "__m_bucket"])
    epoch = lambda last: F.explode(F.sequence(F.lit(0), last))
    inside = rows.withColumn("__m_last", F.col("epochs") - F.when(F.col("__m_in") == 2, 0).otherwise(1)).filter("__m_last >= 0")
    inside = inside.select("__m_row", *leaf, "tokens", epoch(F.col("__m_last")).alias("epoch"))
    run = Window.partitionBy(*leaf).orderBy("__m_key", "tokens", "__m_body").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.filter("__m_in = 1").withColumn("__m_sum", F.sum("tokens").over(run) + F.col("__m_before")).filter("__m_sum <= rest")
    edge = edge.select("__m_row", *leaf, "tokens", F.col("epochs").alias("epoch"))
    both = inside.unionByName(edge)
    added = ("domain", "tokens", "epoch")
    return both.select(*[F.col(f"__m_row.`{c}`").alias(c) for c in names if c not in added], *[F.col(c).cast("int") if c == "epoch" else F.col(c) for c in added])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return select(docs).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as its leaf's epochs take it."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return select(docs.select(own, "doc_id", "text", "lang", "source")).select("__row.*")


def _level_sql(table: str, parents: list[str], level: str, mix: Mix) -> str:
    named = getattr(mix, level)
    case = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in named.items()) + f" ELSE {mix.default_weight} END" if named else str(mix.default_weight)
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""{table}_w AS (
  SELECT *, ({case})::HUGEINT AS w FROM {table}_in
), {table}_o AS (
  SELECT *, b - coalesce(sum(cap) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w
  FROM {table}_w
), {table}_f AS (
  SELECT *, cap * open_w <= w * remaining AS is_full FROM {table}_o
), {table}_t AS (
  SELECT *, min(CASE WHEN NOT is_full THEN [cap::DOUBLE / w, remaining::DOUBLE, open_w::DOUBLE] END) OVER ({part}) AS top FROM {table}_f
), {table} AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE greatest(0, (w * top[2]::HUGEINT) // top[3]::HUGEINT) END AS budget FROM {table}_t
)"""


_M = Mix()
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN source IS NULL THEN '' ELSE ['web', 'books', 'news', 'forum'][coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0) % 4 + 1] END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {_M.max_epochs} AS cap FROM d GROUP BY ALL
), a_in AS (
  SELECT domain, sum(cap)::HUGEINT AS cap, (sum(sum(tokens)) OVER () * {_M.share_pct})::HUGEINT // 100 AS b FROM leaves GROUP BY domain
), {_level_sql("a", [], "domain", _M)}
, b_in AS (
  SELECT domain, lang, sum(leaves.cap)::HUGEINT AS cap, any_value(a.budget)::HUGEINT AS b FROM leaves JOIN a USING (domain) GROUP BY domain, lang
), {_level_sql("b", ["domain"], "lang", _M)}
, c_in AS (
  SELECT domain, lang, source, leaves.cap, leaves.tokens, b.budget::HUGEINT AS b FROM leaves JOIN b USING (domain, lang)
), {_level_sql("c", ["domain", "lang"], "source", _M)}
, plan AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget, tokens AS leaf_tokens FROM c
), keyed AS (
  SELECT d.*, epochs, budget - epochs * leaf_tokens AS rest,
    sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{_M.seed}|' || epochs || '|' || doc_id), d.tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, unnest(range(0, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch
FROM keyed
"""
