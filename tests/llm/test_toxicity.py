from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from pingworks.llm import toxicity

BIG = "/root/testdata/sf0.01"


def _corpus(n: int, seed: int):
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "in", "th", "er", "on", "ti", "ou", "sh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 200))]
        bad = i % 5 == 0
        for _ in range(max(1, len(words) // 25) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grubwort", "Zankler", "mufflig"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _corpus(600, 3)
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labs)
    truth = dict(labels)
    held = [r for r in toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect() if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    hit = [r.predicted == truth[r.doc_id] for r in held]
    assert np.mean(hit) > 0.97 and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in held)


def test_table_scores_separate_the_classes(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = toxicity.query(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [r.score for r in held if labels[r.doc_id]], [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.85 and np.mean(np.array(neg) >= 0.3) < 0.05


def _bucket(gram: bytes) -> int:
    return int(list(toxicity._grams(np.frombuffer(gram, np.uint8)))[toxicity.SIZES.index(len(gram))][0])


def _plain_counts(text: str) -> tuple[dict[int, int], int]:
    raw, out, n = text.encode(), {}, 0
    for size in toxicity.SIZES:
        for i in range(len(raw) - size + 1):
            b = _bucket(raw[i : i + size])
            out[b], n = out.get(b, 0) + 1, n + 1
    return out, max(n, 1)


def _plain_scores(texts: list[str], toxic: list[int], prior: float, rounds: int) -> list[float]:
    """Ratios, feature choice and regression over plain dictionaries and lists."""
    counted = [_plain_counts(t) for t in texts]
    n = [toxic.count(0), toxic.count(1)]
    rate = [{}, {}]
    for (c, _), y in zip(counted, toxic):
        for b in c:
            rate[y][b] = rate[y].get(b, 0) + 1
    ratio = {}
    for b in set(rate[0]) | set(rate[1]):
        p, q = rate[0].get(b, 0), rate[1].get(b, 0)
        pooled = (p + q) / (n[0] + n[1])
        error = math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n[0] + 1 / n[1]))
        if abs(q / n[1] - p / n[0]) > 3 * error:
            ratio[b] = math.log((q + 1) / (n[1] + 2)) - math.log((p + 1) / (n[0] + 2))
    assert ratio
    x = [{b: k * ratio[b] / math.sqrt(total) for b, k in c.items() if b in ratio} for c, total in counted]
    w, bias = dict.fromkeys(ratio, 0.0), 0.0
    m, v, mb, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for t in range(1, rounds + 1):
        g, gb = {b: 1e-5 * u for b, u in w.items()}, 0.0
        for row, y in zip(x, toxic):
            d = (1 / (1 + math.exp(-sum(u * w[b] for b, u in row.items()) - bias)) - y) * 0.5 / n[y]
            gb += d
            for b, u in row.items():
                g[b] += u * d
        step = 0.1 * math.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for b in w:
            m[b], v[b] = 0.9 * m[b] + 0.1 * g[b], 0.99 * v[b] + 0.01 * g[b] ** 2
            w[b] -= step * m[b] / (math.sqrt(v[b]) + 1e-10)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= step * mb / (math.sqrt(vb) + 1e-10)
    bias += math.log(prior / (1 - prior))
    return [1 / (1 + math.exp(-sum(u * w[b] for b, u in row.items()) - bias)) for row in x]


def test_fit_and_score_agree_with_a_plain_version(spark):
    rows, labels = _corpus(60, 21)
    texts, toxic = [t[:150] for _, t in rows] + ["", rows[0][1][:150]], [y for _, y in labels] + [0, 1]
    theirs = _plain_scores(texts, toxic, 0.2, 25)
    model = toxicity.fit(texts, np.array(toxic), 0.2, 25)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours = [r.score for r in toxicity.score(table, model).orderBy("doc_id").collect()]
    assert np.allclose(ours, theirs, atol=2e-4)
    # ties: a text that repeats among the rows scores the same each time
    assert ours[0] == ours[-1]


def test_held_out_labels_teach_nothing(spark):
    rows, labels = _corpus(120, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_margins_do_not_depend_on_the_batch():
    w = np.random.default_rng(0).standard_normal(1 << toxicity.BUCKET_BITS).astype(np.float32)
    texts = ["", None, "ab", "abc", "some text", "SOME text", "x" * 3000]
    one = [toxicity.margins(pa.array([t], pa.string()), w)[0] for t in texts]
    assert np.allclose(toxicity.margins(pa.array(texts), w), one) and one[4] == one[5] and one[0] == one[1] == one[2] == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "x", "b"), (1, "", "c")], "doc_id long, text string, score string")
    none = toxicity.train(docs.drop("score"), spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int"))
    out = toxicity.score(docs, none)
    assert [r.score for r in out.collect()] == [0.0, 0.0, 0.0] and out.columns == ["doc_id", "text", "score", "predicted"]
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_long_texts_do_not_empty_a_class(spark):
    rows, labels = _corpus(300, 9)
    bounds = toxicity.Bounds(rows=200, bytes=100_000)
    labs = spark.createDataFrame(labels, "doc_id long, toxic int")
    plain = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labs, bounds)
    # giants and repeated rows, more of them than the bound has room for
    ids = range(1000, 1300)
    more = [(i, "ab " * (60_000 if i % 3 else 2_000)) for i in ids] + [r for r in rows[:100] for _ in range(20)]
    both = spark.createDataFrame(rows + more, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(i, 1) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(both, known, bounds)
    assert plain.trained and model.trained
    held = [r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).withColumn("h", toxicity.held_out()).collect() if r.h]
    truth = dict(labels)
    pos, neg = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9
    # a class of giants alone: the shortest of them speaks for it
    giants = toxicity.train(both, spark.createDataFrame([(i, 0) for i, _ in rows] + [(i, 1) for i in ids if i % 3], "doc_id long, toxic int"), bounds)
    assert giants.trained
