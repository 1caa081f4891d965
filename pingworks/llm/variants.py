"""Spelling variant grouping over a bit-sliced position index.

The vocabulary is dealt into blocks of words that share two thirds of their letters: two
words one edit apart have a common prefix p and suffix s with p + s >= l - 1 for the shorter
length l, so with m = l // 3 they share a prefix of 2m, a suffix of 2m, or both of m.  A
block's index holds, for each (position, letter), a bitset over its words.  All words of a
block walk it at once as queries: the zero-error set is cut by the letter's bitset, and the
one-error sets by that of the same position (replaced), the next (the word has a letter
more) and the one before (a letter less), 64 words at a step.  A pair may meet in several
blocks and counts in the first kind it shares.  A key of more than HOT words is dealt again
by the words with one letter left out, of which no key has more than its length times the
alphabet.

Defined cases: a null text has no words; a null doc_id is the empty text in the checksum;
repeated rows count again; ties of n go to the smallest word; very long texts and words are
taken whole (a block holds so many letters, not words); other columns are left behind; an
empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.llm.shared import cut, parts_for

#: Runs of these are words; of them only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, FACTOR = 6, 5, 5
#: Every so many runs lose a letter.
DAMAGE = 199
HOT = 16_384
BLOCK = 2048
#: Letters of a block's words, each padded to the longest.
CELLS = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, damage: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of ``shortest`` code points and ``least`` occurrences on.  With
    ``damage``, of about every so many runs one letter goes, by checksum of document and run."""
    runs = F.array_remove(F.split(F.translate("text", _UPPER, _UPPER.lower()), f"[^{LETTERS}]+"), "")
    rows = docs.select("doc_id", F.explode(runs).alias("word")).filter(F.length("word") >= shortest)
    if damage:
        mark = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = F.pmod(F.col("mark"), F.length("word")).cast("int")
        less = F.concat(F.left("word", at), F.substring("word", at + 2, F.length("word")))
        rows = rows.withColumn("mark", mark).select(F.when(F.col("mark") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & (F.length("word") >= shortest))


def keys(vocab: DataFrame, shortest: int = SHORTEST, hot: int = HOT) -> DataFrame:
    """(key, word, n): where words meet.  A key starts with its kind (P, S or B) and m."""
    size = F.length("word")
    ms = F.array_distinct(F.array(F.floor(size / 3), F.floor(F.greatest(size - 1, F.lit(shortest)) / 3)))
    part = lambda kind, m, *x: F.concat(F.lit(kind), m.cast("string"), F.lit(":"), *x)
    three = lambda m: F.array(
        part("P", m, F.left("word", (2 * m).cast("int"))), part("S", m, F.right("word", (2 * m).cast("int"))),
        part("B", m, F.left("word", m.cast("int")), F.lit(":"), F.right("word", m.cast("int"))),
    )
    rows = cut(vocab.select(F.explode(F.flatten(F.transform(ms, three))).alias("key"), "word", "n"), "variant-keys")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") > hot).select(F.col("key").alias("hot"))
    rows = rows.join(many, F.col("key") == F.col("hot"), "left")
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.left("word", i - 1), F.substring("word", i + 1, size)))
    forms = F.array_distinct(F.concat(F.array("word"), less))
    # a hot key goes on with each form; the others have one row
    tails = F.when(F.col("hot").isNull(), F.array(F.lit(""))).otherwise(F.transform(forms, lambda x: F.concat(F.lit("/"), x)))
    return rows.select(F.col("key"), F.explode(tails).alias("tail"), "word", "n").select(F.concat("key", "tail").alias("key"), "word", "n")


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def _index(codes: np.ndarray, sizes: np.ndarray, p: int, wide: int) -> np.ndarray:
    """Bitsets of the words by their letter at position p (row 0 stands for none)."""
    flags = np.zeros((256, wide), bool)
    if 0 <= p < codes.shape[1]:
        some = np.flatnonzero(sizes > p)
        flags[codes[some, p], some] = True
    return _bits(flags)


def _near(codes: np.ndarray, sizes: np.ndarray, asks: np.ndarray, ask_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart.  Words and queries are rows of Latin-1 codes
    padded with 0; queries stand in order of length."""
    n, wide = len(codes), -(-len(codes) // 64) * 64
    of_size = lambda k: _bits(np.pad(sizes == k, (0, wide - n))[None])[0]
    none = np.zeros((len(asks), wide // 64), np.uint64)
    zero, swap, more, less, found = ~none, none.copy(), none.copy(), none.copy(), none.copy()
    here, ahead, behind = _index(codes, sizes, 0, wide), _index(codes, sizes, 1, wide), _index(codes, sizes, -1, wide)
    for p in range(int(ask_sizes[-1]) + 1):
        ends = slice(*np.searchsorted(ask_sizes, [p, p + 1]))
        if ends.stop > ends.start:
            found[ends] = (swap[ends] & of_size(p)) | ((more[ends] | zero[ends]) & of_size(p + 1)) | (less[ends] & of_size(p - 1))
        on = slice(ends.stop, None)
        if ends.stop == len(asks):
            break
        letter = asks[on, p]
        same = here[letter]
        z = zero[on]
        swap[on] = (swap[on] & same) | (z & ~same)
        more[on] = (more[on] | z) & ahead[letter]
        less[on] = (less[on] & behind[letter]) | z
        zero[on] = z & same
        behind, here, ahead = here, ahead, _index(codes, sizes, p + 2, wide)
    flags = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little", count=n)
    return np.nonzero(flags)


def _matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), sizes


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _block(entries: list[tuple[str, str, int]], block: int) -> Iterator[tuple[list[str], list[str], list[int]]]:
    """(word, near word, its n) of whole keys, each pair in the one place that counts."""
    entries.sort(key=lambda e: len(e[1]))
    words = [e[1].encode("latin-1") for e in entries]
    heads = [e[0].split(":", 1)[0] for e in entries]
    kinds, ms = np.array([h[0] for h in heads]), np.array([int(h[1:]) for h in heads])
    codes, sizes = _matrix(words)
    back, _ = _matrix([w[::-1] for w in words])
    step = max(64, min(block, CELLS // codes.shape[1]))
    for a in range(0, len(words), step):
        for b in range(0, len(words), step):
            i, j = _near(codes[a : a + step], sizes[a : a + step], codes[b : b + step], sizes[b : b + step])
            i, j = i + b, j + a
            m = np.minimum(sizes[i], sizes[j]) // 3
            for lo in range(0, len(i), step):
                x, y, k = i[lo : lo + step], j[lo : lo + step], m[lo : lo + step]
                first, last = _shared(codes[x], codes[y]), _shared(back[x], back[y])
                kind = np.where(first >= 2 * k, "P", np.where(last >= 2 * k, "S", "B"))
                ok = (kinds[x] == kind) & (kinds[y] == kind) & (ms[x] == k) & (ms[y] == k)
                for q, w, p in zip(x[ok].tolist(), y[ok].tolist(), first[ok].tolist()):
                    if entries[q][0] != entries[w][0]:
                        continue  # neighbours of another key in this block
                    form = entries[q][0].partition("/")[2]
                    if form:
                        longer = max(entries[q][1], entries[w][1], key=len)
                        if form != longer[:p] + longer[p + 1 :]:
                            continue
                    yield entries[q][1], entries[w][1], entries[w][2]


def near_pairs(vocab: DataFrame, shortest: int = SHORTEST, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): each two words one edit apart, both ways, once."""
    rows = cut(keys(vocab, shortest, hot), "variant-blocks")
    parts = parts_for(rows.agg(F.sum(F.octet_length("word") + F.octet_length("key") + 8)), 8 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int]] = []
        group: list[tuple[str, str, int]] = []
        last = None

        def put() -> Iterator[pa.RecordBatch]:
            out = []
            for pair in _block(held, block) if len(held) > 1 else ():
                out.append(pair)
                if len(out) == 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["word", "near", "near_n"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["word", "near", "near_n"])
            held.clear()

        def take() -> Iterator[pa.RecordBatch]:
            """The group just ended joins the block, which goes first if it would be too large."""
            if len(group) > 1:
                longest = max(len(e[1]) for e in (*held, *group))
                if held and ((len(held) + len(group)) > block or (len(held) + len(group)) * longest > CELLS):
                    yield from put()
                held.extend(group)
            group.clear()

        for b in batches:
            for entry in zip(*[c.to_pylist() for c in b.columns]):
                if entry[0] != last:
                    yield from take()
                    last = entry[0]
                group.append(entry)
        yield from take()
        yield from put()

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")


def forms(vocab: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``vocab`` with n_near, and form and form_n where the near word of largest n (the
    smallest of several) has ``factor`` times the word's n."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = vocab.join(near, "word", "left")
    fits = -F.col("best.less") >= factor * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, factor: int = FACTOR, least: int = LEAST) -> DataFrame:
    """`forms` with root, by pointer jumping: each hop multiplies n by ``factor``, so a
    chain has few, and each round doubles what a pointer spans."""
    top = found.agg(F.max("n")).first()[0] or 1
    hops = max(1, math.ceil(math.log(max(top / least, 1), factor)) + 1)
    way = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops))):
        way = cut(way, "variant-roots")
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return found.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``."""
    vocab = cut(vocabulary(docs, damage), "vocabulary")
    found = cut(forms(vocab, near_pairs(vocab)), "variant-forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), DAMAGE)


ORACLE_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[{LETTERS}]+')) AS w FROM documents
), counted AS (
  SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS mark, count(*) AS k FROM runs WHERE length(w) >= {SHORTEST} GROUP BY doc_id, w
), marked AS (
  SELECT w, k, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(mark))), lambda i: CAST(('0x' || hex(encode(mark))[2 * i + 1 : 2 * i + 2]) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) AS h
  FROM counted
), vocab AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN w[1 : CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2 :] ELSE w END AS word, k FROM marked)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}
), less AS (
  SELECT word, p, word[1 : p - 1] || word[p + 1 :] AS f FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM vocab)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS near FROM less a JOIN less b ON a.f = b.f AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN vocab b ON a.f = b.word
  UNION SELECT b.word, a.word FROM less a JOIN vocab b ON a.f = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, first(p.near ORDER BY v.n DESC, p.near) AS near, max(v.n) AS near_n FROM pairs p JOIN vocab v ON p.near = v.word GROUP BY p.word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word
), ways AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.root FROM ways w JOIN forms f ON w.root = f.word WHERE f.form IS NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM forms f LEFT JOIN ends e ON f.word = e.word
"""
