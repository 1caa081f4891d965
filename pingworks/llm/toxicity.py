"""Toxicity: a linear classifier over character n-grams whose features are scaled by
naive Bayes log-count ratios.

Features are hashed byte n-grams of the text with A-Z lower-cased.  On a bounded
sample of labelled rows (`Bounds`, a parameter) the log-count ratio r of each feature
is taken, features whose document rates differ between the classes beyond chance are
kept, and a logistic regression is fitted to x_f * r_f, with x_f = count_f / sqrt(n)
for a text of n n-grams.  The product of ratios and weights is one vector of fixed
size that goes to every task; scoring is one pass over whole texts, without a shuffle.

Defined cases: null and empty texts have no n-grams and get the score of the intercept;
labels other than 0 and 1 and rows without doc_id teach nothing; a label repeated for a
doc_id counts once, and so do its rows (the text with the smallest hash teaches); without
labelled documents of both classes every score is 0; where every text of a class is over the
bound, the shortest of them alone speaks for it; repeated rows are scored one by one; other
columns pass through; an empty table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingworks.llm.bytescan import LOWER, _power, mix, prefix_sums
from pingworks.llm.shared import bound_batches, cut, slices, text_buffer, tidy

THRESHOLD = 0.3
BUCKET_BITS = 20
SIZES = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Bounds:
    """Most rows and bytes of text of one class that the fit may use."""

    rows: int = 2500
    bytes: int = 6 << 20


#: Texts over this part of the bound on bytes come after all shorter ones of their class.
LONG = 100


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one a bucket
    bias: float
    trained: bool


def _grams(buf: np.ndarray) -> Iterator[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each byte; those that
    would cross a row end are for the caller to leave out."""
    sums = prefix_sums(LOWER[buf])
    down = _power("down", len(sums))
    for n in SIZES:
        if len(buf) < n:
            yield np.zeros(0, np.int64)
            continue
        h = (sums[n:] - sums[:-n]) * down[: len(buf) - n + 1]
        yield (mix(h + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _n_grams(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths - n + 1, 0) for n in SIZES)


def margins(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Sum of weights over a text's n-grams / sqrt(their number), for each row."""
    buf, offs = text_buffer(column)
    out = np.zeros(len(offs) - 1)
    for i, j in slices(offs, 2 << 20):
        part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        total = np.zeros(j - i)
        for n, grams in zip(SIZES, _grams(part)):
            sums = np.append(0.0, np.cumsum(weights[grams], dtype=np.float64))
            last = np.maximum(at[1:] - n + 1, at[:-1])
            cap = len(sums) - 1
            total += sums[np.minimum(last, cap)] - sums[np.minimum(at[:-1], cap)]
        out[i:j] = total / np.sqrt(np.maximum(_n_grams(np.diff(at)), 1))
    return out


def _features(text: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Distinct buckets of a text, their counts, and its number of n-grams."""
    grams = np.concatenate(list(_grams(np.frombuffer(text.encode(), np.uint8))))
    buckets, counts = np.unique(grams, return_counts=True)
    return buckets, counts, float(max(len(grams), 1))


def fit(texts: list[str], toxic: np.ndarray, prior: float, rounds: int = 300) -> Model:
    """Log-count ratios, feature choice and logistic regression on a sample that
    fits one process; ``prior`` is the share of toxic rows among all labelled."""
    size, yes = 1 << BUCKET_BITS, toxic == 1
    empty = Model(np.zeros(size, np.float32), -np.inf, False)
    if not yes.any() or yes.all():
        return empty
    rate = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    for text, y in zip(texts, yes):
        rate[int(y)][_features(text)[0]] += 1
    n = [float((~yes).sum()), float(yes.sum())]
    ratio = np.log((rate[1] + 1) / (n[1] + 2)) - np.log((rate[0] + 1) / (n[0] + 2))
    pooled = (rate[0] + rate[1]) / (n[0] + n[1])
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n[0] + 1 / n[1]))
    chosen = np.abs(rate[1] / n[1] - rate[0] / n[0]) > 3 * error
    if not chosen.any():
        return empty
    index = (np.cumsum(chosen) - 1).astype(np.int32)
    lens = np.array([int(chosen[_features(text)[0]].sum()) for text in texts])
    offs = np.append(0, np.cumsum(lens))
    cols, vals = np.zeros(offs[-1], np.int32), np.zeros(offs[-1], np.float32)  # filled in place: no second copy
    for i, text in enumerate(texts):
        buckets, counts, total = _features(text)
        keep = chosen[buckets]
        cols[offs[i] : offs[i + 1]] = index[buckets[keep]]
        vals[offs[i] : offs[i + 1]] = counts[keep] * ratio[buckets[keep]] / np.sqrt(total)
    parts = _row_parts(lens, 1 << 20)
    y, k = yes.astype(float), int(chosen.sum())
    weight = np.where(yes, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(k), 0.0
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the ridge-penalised log loss
        g, gb = 1e-5 * w, 0.0
        for first, last, at, rows in parts:  # in parts, so that temporaries stay small
            c, x = cols[at], vals[at]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[c], last - first) + b, -30, 30)))
            d = (p - y[first:last]) * weight[first:last]
            g, gb = g + np.bincount(c, x * d[rows], k), gb + d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - step * m / (np.sqrt(v) + 1e-10), b - step * mb / (np.sqrt(vb) + 1e-10)
    out = np.zeros(size, np.float32)
    out[chosen] = (w * ratio[chosen]).astype(np.float32)
    return Model(out, float(b + np.log(prior / (1 - prior))), True)


def _row_parts(lens: np.ndarray, most: int) -> list[tuple]:
    """Ranges of texts of about ``most`` features: first, last + 1, features, their rows."""
    offs, out = np.append(0, np.cumsum(lens)), []
    for i, j in slices(offs, most):
        out.append((i, j, slice(int(offs[i]), int(offs[j])), np.repeat(np.arange(j - i, dtype=np.int32), lens[i:j])))
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model:
    """Fits on labelled rows outside the held-out quarter."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("__h", F.xxhash64("doc_id"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return fit([], np.zeros(0, int), 0.5)
    body = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(body).alias("__t_hash"), F.octet_length(body).cast("long").alias("__bytes"))
    one = texts.join(known, "doc_id").groupBy("doc_id", "toxic", "__h").agg(F.min(F.struct("__t_hash", "__bytes")).alias("__t"))
    one = cut(one.select("doc_id", "toxic", "__h", "__t.*"), "labelled")
    late = F.when(F.col("__bytes") <= bounds.bytes / LONG, 0).when(F.col("__bytes") <= bounds.bytes, 1).otherwise(2)
    chosen = []
    for y in (0, 1):
        found = one.filter(F.col("toxic") == y).orderBy(late, "__h", "doc_id").limit(bounds.rows).collect()  # rows of five numbers
        fits = _within(found, bounds.bytes)
        # where every text is over the bound, the shortest alone speaks for its class
        chosen += fits or sorted(found, key=lambda r: (r["__bytes"], r["__h"]))[:1]
    if not chosen:
        return fit([], np.zeros(0, int), 0.5)
    sample = docs.sparkSession.createDataFrame(chosen, one.schema)
    rows = docs.select("doc_id", body.alias("__t")).join(F.broadcast(sample), "doc_id").filter(F.xxhash64("__t") == F.col("__t_hash"))
    rows = rows.dropDuplicates(["doc_id"]).select("__t", "toxic", "__h", "doc_id").repartition(1).sortWithinPartitions("toxic", "__h", "doc_id")
    return _fit_in_task(rows.select("__t", "toxic"), total[1] / (total[0] + total[1]))


def _fit_in_task(sample: DataFrame, prior: float) -> Model:
    """`fit` of the rows of a one-partition table, by the task that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        m = fit(texts, np.array(toxic, np.int64), prior)
        at = np.flatnonzero(m.weights)
        one = [[at.astype("<i4").tobytes()], [m.weights[at].astype("<f4").tobytes()], [m.bias], [m.trained]]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, (pa.binary(), pa.binary(), pa.float64(), pa.bool_()))], names=["at", "weights", "bias", "trained"])

    row = sample.mapInArrow(tidy(run), "at binary, weights binary, bias double, trained boolean").first()  # at most one number a bucket
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if row is None:
        return Model(weights, -np.inf, False)
    weights[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["weights"], "<f4")
    return Model(weights, row["bias"], row["trained"])


def _within(rows: list, most: int) -> list:
    """The rows, in order, whose texts fit together; one that does not fit is passed over."""
    out, used = [], 0
    for r in rows:
        if used + r["__bytes"] <= most:
            out.append(r)
            used += r["__bytes"]
    return out


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``threshold``)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at, weights, bias, trained = names.index(text), model.weights, model.bias, model.trained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = 1 / (1 + np.exp(-np.clip(margins(b.column(at), weights) + bias, -700, 700))) if trained else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents not predicted toxic.  The model learns from the
    labelled documents of ``sf_dir``, whatever earlier stages kept of them."""
    every = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    work = docs.select(F.struct(*own).alias("__row"), F.col("text").alias("__body"))
    return score(work, model, "__body").filter("predicted = 0").select("__row.*")
