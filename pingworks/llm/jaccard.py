"""N-gram Jaccard join: universe partitioning, pigeonhole, exact verification.

A document's set holds its distinct 5-word shingles.  Sets of one size band are cut
by hash into the same segments.  If two sets link, at most H = floor((a + b) / 9) of
their elements differ (a, b: their sizes; similarity 0.8), so of any H + 1 segments
that both index, one is equal in both.  Each set indexes a subset of its non-empty
segments, in segment order, of which H + 1 and some to spare suffice; sets that may
join the next band as the smaller side index there too.

Allocation: segment signatures are counted over all sets.  A signature that no other
set has costs nothing, so a set takes its cheapest H + 1 segments, and only those of
them that others share are looked up.  A set with more than H segments of its own
(which any partner must differ in) is looked up not at all.

Small bands use segments of one shingle.  Among members that stay unconnected, the
shingles that each has to itself are counted, which bounds what a pair can share,
and parity sketches bound from below how much two sets differ.  What is left is indexed
with one-deletion neighbourhoods, and each member spends its H + 1 on segments as they
are (1) or with their neighbourhoods (2), whichever meet the fewest rows.

A set whose non-empty segments are too few for the pigeonhole is irregular; were there
any, the join runs again with segments of one shingle for all sets, which has none.

Equal sets share one 64-bit fingerprint and are one member from the start, so groups
of copies never meet in pairs.  Look-ups go to a few representatives of each shared
signature first; pairs are spelled out only between members that are not connected
yet.  All candidates are verified on whole sets of 64-bit shingle hashes.

Defined cases: null, empty and blank texts have an empty set, link with nothing and
form their own component; texts of one to four words have one shingle, the whole
sequence; very long texts count whole (tested at 1 MB); repeated rows share their
component; component_id is the smallest non-null doc_id reachable (null if a component
has none); other columns of the input are left alone, whatever their names; an empty
table gives an empty table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingworks.llm.bytescan import LOWER, mix, ranges, word_hashes, word_spans
from pingworks.llm.shared import cut, parts_for, slices, text_buffer, tidy

SHINGLE = 5
SLICE_BYTES = 1 << 20
#: Bands are powers of two; below this one a segment is one shingle.
FIRST_CUT_BAND = 7
SEGMENTS_PER_SIZE = 0.4
SPARE = 1.4
VERIFY_GROUP = 256
#: 64-bit words of a parity sketch.
SKETCH = 8

#: A member's index at one band, as it travels with its signatures.
HEAD = [("member", "<u8"), ("size", "<u4"), ("band", "<u4"), ("all", "<u4")]

_ORDER = [np.uint64(int(x)) for x in np.random.default_rng(11).integers(1, 1 << 63, SHINGLE, dtype=np.int64) | 1]


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and row bounds."""
    low = LOWER[buf]
    starts, ends, bounds = word_spans(low, offs)
    words = word_hashes(low, starts, ends)
    n_words = np.diff(bounds)
    n_all = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    first = ranges(bounds[:-1], n_all)  # first word of each shingle
    row = np.repeat(np.arange(len(n_all)), n_all)
    have = bounds[1:][row] - first  # words from there to the row's end
    h = np.zeros(len(first), np.uint64)
    padded = np.append(words, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        h += np.where(have > k, padded[first + k] + np.uint64(1), np.uint64(0)) * _ORDER[k]
    h = mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(n_all) + 1))


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = text_buffer(column)
    for i, j in slices(offs, SLICE_BYTES):
        yield (i, j, *shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))


def _sum_rows(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _prints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each set; 0 only for the empty set."""
    n = np.diff(bounds).astype(np.uint64)
    out = mix(_sum_rows(mix(h ^ np.uint64(0x5851F42D4C957F2D)), bounds) + n * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n == 0, np.uint64(0), np.maximum(out, np.uint64(1)))


def _band(n: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1]


def _most_differences(n: np.ndarray) -> np.ndarray:
    """H of a set with its largest possible partner."""
    return (n + n * 5 // 4) // 9


def _segments(h: np.ndarray, bounds: np.ndarray, single: bool) -> dict[str, np.ndarray]:
    """The segments of each set at each band it indexes at.

    By index of a set: ``sets``, ``bands``.  By element, in segment order: ``value`` (its
    part of a signature) and ``seg`` (its segment's position).  By segment: ``of`` (the
    index it belongs to), ``rank`` there, ``n`` elements, ``total`` of their values, ``key``,
    and ``keep``, true for the subset that is indexed."""
    n = np.diff(bounds)
    own = _band(n)
    nexts = np.flatnonzero((n > 0) & (5 * n >= 4 * (1 << own.astype(np.int64))))
    sets = np.concatenate([np.flatnonzero(n > 0), nexts])
    bands = np.concatenate([own[n > 0], own[nexts] + 1])
    sizes = n[sets]
    at = np.repeat(np.arange(len(sets)), sizes)
    x = h[ranges(bounds[:-1][sets], sizes)]
    b = bands[at]
    seed = mix(x ^ (b.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
    m = np.ceil(SEGMENTS_PER_SIZE * (1 << bands.astype(np.int64))).astype(np.uint64)
    one = (bands < FIRST_CUT_BAND) | single
    # the segment's number; of one shingle: the hash itself
    seg = np.where(one[at], seed >> np.uint64(16), (seed >> np.uint64(32)) * m[at] >> np.uint64(32))
    order = np.lexsort((seg, at))
    at, x, seg, b = at[order], x[order], seg[order], b[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (seg[1:] != seg[:-1])
    cuts = np.flatnonzero(new)
    value = mix(x + np.uint64(0x2545F4914F6CDD1D))
    of = at[cuts]
    rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(sets)))[of]
    wanted = np.where(one & (not single), sizes, np.ceil(SPARE * (_most_differences(sizes) + 1)).astype(np.int64))
    return {
        "sets": sets, "bands": bands, "value": value, "seg": np.cumsum(new) - 1,
        "of": of, "rank": rank, "n": np.diff(np.append(cuts, len(at))),
        "total": np.add.reduceat(value, cuts) if len(cuts) else value,
        "key": mix(seg[cuts] * np.uint64(0xA0761D6478BD642F) + b[cuts].astype(np.uint64)),
        "keep": rank < wanted[of],
    }


def signatures(h: np.ndarray, bounds: np.ndarray, single: bool) -> tuple[np.ndarray, ...]:
    """Each set at each band it indexes at: arrays of set, band and number of
    signatures, then all signatures in that order; last the irregular sets."""
    g = _segments(h, bounds, single)
    sets, keep = g["sets"], g["keep"]
    sizes = np.diff(bounds)[sets]
    counts = np.bincount(g["of"][keep], minlength=len(sets))
    irregular = sets[counts < np.minimum(_most_differences(sizes) + 1, sizes)]
    return sets, g["bands"], counts, mix(g["total"] ^ g["key"])[keep], irregular


def neighbourhoods(h: np.ndarray, bounds: np.ndarray, single: bool) -> tuple[np.ndarray, ...]:
    """Signatures of the indexed segments (kind 0) and of each of them less one of its
    elements (kind 1; segments of one element have none): arrays of set, band, segment,
    elements of the segment, kind and signature."""
    g = _segments(h, bounds, single)
    of, keep, seg = g["of"], g["keep"], g["seg"]
    whole = np.flatnonzero(keep)
    less = np.flatnonzero(keep[seg] & (g["n"][seg] > 1))
    segs = np.concatenate([whole, seg[less]])
    sig = np.concatenate([mix(g["total"] ^ g["key"])[whole], mix((g["total"][seg[less]] - g["value"][less]) ^ g["key"][seg[less]])])
    kind = np.repeat([0, 1], [len(whole), len(less)])
    return g["sets"][of[segs]], g["bands"][of[segs]], g["rank"][segs], g["n"][segs], kind, sig


def _arrow(schema_names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema_names)


def _blob(bucket: int, heads: np.ndarray, runs: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int64()), pa.array([heads.tobytes()]), pa.array([runs.astype("<u4").tobytes()]), pa.array([sigs.tobytes()])],
        names=["bucket", "heads", "runs", "sigs"],
    )


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row_hash, n_shingles, member): a member is a distinct set, 0 the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, bounds in _sets(b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_signed(_prints(h, bounds)))],
                    names=["doc_id", "row_hash", "n_shingles", "member"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text), "row_hash").mapInArrow(tidy(run), "doc_id long, row_hash long, n_shingles long, member long")


def shared_signatures(docs: DataFrame, parts: int, single: bool, text: str = "text") -> DataFrame:
    """(sig, member, size, band, n_all, df) of every signature that two members or more
    have, df of them; ``n_all`` counts the member's signatures at that band.  Irregular
    members come as rows of band 0 and df 0."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h, bounds in _sets(batch.column(0)):
                prints = _prints(h, bounds)
                _, once = np.unique(prints, return_index=True)
                once = once[prints[once] != 0]
                if not len(once):
                    continue
                sizes = np.diff(bounds)[once]
                h = h[ranges(bounds[:-1][once], sizes)]
                bounds = np.append(0, np.cumsum(sizes))
                sets, bands, counts, sig, irregular = signatures(h, bounds, single)
                # by bucket: signatures, and which index of which member each is of
                head = np.zeros(len(sets), HEAD)
                head["member"], head["size"], head["band"], head["all"] = prints[once][sets], sizes[sets], bands, counts
                if len(irregular):  # told by band 0
                    odd = np.zeros(len(irregular), HEAD)
                    odd["member"], odd["size"] = prints[once][irregular], sizes[irregular]
                    yield _blob(0, odd, np.zeros(len(odd)), sig[:0])
                of = np.repeat(np.arange(len(sets)), counts)
                bucket = (sig >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                sig, of, bucket = sig[order], of[order], bucket[order]
                cuts = np.searchsorted(bucket, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    a, z = cuts[p], cuts[p + 1]
                    heads, runs = np.unique(of[a:z], return_counts=True)
                    yield _blob(int(p), head[heads], runs, sig[a:z])

    names = ["sig", "member", "size", "band", "n_all", "df"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, runs, sigs = [], [], []
        for b in batches:
            for c, out, kind in ((1, heads, HEAD), (2, runs, "<u4"), (3, sigs, "<u8")):
                out += [np.frombuffer(x.as_py(), kind) for x in b.column(c)]
        if not heads:
            return
        head, run, sig = np.concatenate(heads), np.concatenate(runs), np.concatenate(sigs)
        odd = head[head["band"] == 0]
        if len(odd):
            nil = np.zeros(len(odd), np.int64)
            yield _arrow(names, nil, _signed(odd["member"]), odd["size"].astype(np.int64), nil, nil, nil)
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        # only signatures seen twice go on
        twice = np.zeros(len(sig), bool)
        twice[1:] = sig[1:] == sig[:-1]
        twice[:-1] |= twice[1:]
        of = np.repeat(np.arange(len(head)), run)[order[twice]]
        sig, member = sig[twice], head["member"][of]
        order = np.lexsort((member, sig))
        sig, of, member = sig[order], of[order], member[order]
        first = np.ones(len(sig), bool)  # copies in other slices
        first[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
        sig, of, member = sig[first], of[first], member[first]
        _, back, df = np.unique(sig, return_inverse=True, return_counts=True)
        df = df[back]
        keep = np.flatnonzero(df > 1)
        for i in range(0, len(keep), 50_000):
            k = keep[i : i + 50_000]
            o = of[k]
            yield _arrow(names, _signed(sig[k]), _signed(member[k]), head["size"][o].astype(np.int64), head["band"][o].astype(np.int64), head["all"][o].astype(np.int64), df[k].astype(np.int64))

    blobs = docs.select(text).mapInArrow(tidy(emit), "bucket long, heads binary, runs binary, sigs binary")
    return blobs.repartition(parts, "bucket").mapInArrow(tidy(count), "sig long, member long, size long, band long, n_all long, df long")


def allocate(live: DataFrame) -> DataFrame:
    """Adds ``own`` and ``probe``: true for the signatures that a member looks up."""
    per = Window.partitionBy("member", "band")
    # every segment alone costs nothing; of the shared ones the cheapest fill up to H + 1
    h = F.floor((F.col("size") + F.floor(F.col("size") * 5 / 4)) / 9)
    df = live.withColumn("own", F.col("n_all") - F.count(F.lit(1)).over(per))
    rank = F.row_number().over(per.orderBy("df", "sig"))
    return df.withColumn("probe", rank <= h + 1 - F.col("own"))


def star_pairs(probes: DataFrame) -> DataFrame:
    """(a, b): members and representatives of the signatures that some member looks up.
    One representative is the member with the fewest segments of its own: among near
    copies that is the one they were all made from."""
    central = F.min_by("member", F.struct(F.col("own") / F.col("n_all"), F.col("member")))
    reps = probes.groupBy("sig").agg(
        F.max("probe").alias("asked"),
        F.array_distinct(F.array(F.min("member"), central, F.min_by("member", F.xxhash64("member")))).alias("reps"),
    )
    hubs = reps.filter("asked").select("sig", F.explode("reps").alias("hub"))
    pairs = probes.select("sig", "member").join(hubs, "sig").filter("member <> hub")
    return pairs.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b")).distinct()


def _common(a: Column, b: Column) -> Column:
    """Fewest shingles that linked sets of these sizes share."""
    return F.ceil(4 * (a + b) / 9)


def own_shingles(texts: DataFrame) -> DataFrame:
    """(member, alone): how many shingles of a member no other member of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, bounds in _sets(b.column(1)):
                of = np.asarray(b.column(0))[i:j].repeat(np.diff(bounds))
                for k in range(0, len(h), 50_000):
                    yield _arrow(["h", "member"], _signed(h[k : k + 50_000]), of[k : k + 50_000])

    rows = texts.select("member", "body").mapInArrow(tidy(run), "h long, member long")
    once = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("member")).filter("n = 1")
    return once.groupBy("member").agg(F.count(F.lit(1)).alias("alone"))


def sketches(texts: DataFrame) -> DataFrame:
    """(member, size, k0, ...): parity of the number of shingles in each of 64 * SKETCH hash
    cells, as bits.  Two sets differ in at least as many shingles as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, bounds in _sets(b.column(1)):
                row = np.repeat(np.arange(j - i), np.diff(bounds))
                cell = (h >> np.uint64(20)).astype(np.int64) % (64 * SKETCH)
                bits = np.bincount(row * 64 * SKETCH + cell, minlength=(j - i) * 64 * SKETCH) & 1
                words = np.packbits(bits.astype(np.uint8).reshape(j - i, -1), axis=1).view(np.int64)
                yield _arrow(["member", "size", *[f"k{k}" for k in range(SKETCH)]], np.asarray(b.column(0))[i:j], np.diff(bounds), *[np.ascontiguousarray(words[:, k]) for k in range(SKETCH)])

    schema = "member long, size long, " + ", ".join(f"k{k} long" for k in range(SKETCH))
    return texts.select("member", "body").mapInArrow(tidy(run), schema)


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return sum(F.bit_count(F.col(f"{a}.k{k}").bitwiseXOR(F.col(f"{b}.k{k}"))) for k in range(SKETCH))


def plausible(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    out = pairs.join(sketch.alias("x"), F.col("a") == F.col("x.member")).join(sketch.alias("y"), F.col("b") == F.col("y.member"))
    need = _common(F.col("x.size"), F.col("y.size"))
    fits = (need <= F.col("x.size")) & (need <= F.col("y.size")) & (_differ("x", "y") <= F.col("x.size") + F.col("y.size") - 2 * need)
    return out.filter(fits).select("a", "b")


def rest_pairs(probes: DataFrame, component: DataFrame, done: DataFrame, texts: DataFrame, sketch: DataFrame, single: bool) -> DataFrame:
    """Candidates between members that are not connected yet.

    What a member has to itself cannot be shared: a member whose size less its own
    shingles falls short of the common part that any link needs is no candidate."""
    rows = probes.join(component, "member", "left").withColumn("comp", F.coalesce("comp", "member"))
    mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("probe").alias("asked")).filter("lo <> hi and asked").select("sig")
    members = cut(rows.join(mixed, "sig", "left_semi").select("member", "comp").distinct(), "mixed")
    texts = texts.join(members.select("member"), "member", "left_semi")
    members = members.join(own_shingles(texts), "member", "left").join(sketch, "member").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
    members = cut(members.filter(F.col("shared") >= _common(F.col("size"), F.ceil(F.col("size") * 4 / 5))), "unconnected")
    return neighbour_pairs(members, texts, single).join(done, ["a", "b"], "left_anti")


def neighbour_index(texts: DataFrame, single: bool) -> DataFrame:
    """(member, band, seg, n, kind, sig) of ``neighbourhoods``."""
    names = ["member", "band", "seg", "n", "kind", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, bounds in _sets(b.column(1)):
                of, *columns, sig = neighbourhoods(h, bounds, single)
                columns = [np.asarray(b.column(0))[i:j][of], *(c.astype(np.int64) for c in columns), _signed(sig)]
                for k in range(0, len(of), 50_000):
                    yield _arrow(names, *(c[k : k + 50_000] for c in columns))

    return texts.select("member", "body").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def allot(index: DataFrame, members: DataFrame) -> DataFrame:
    """(member, band, seg, units): how each member spends its H + 1 at each band, at the
    least cost.

    A segment looked up as it is (1 unit) is missed only by a partner that differs there;
    looked up with its one-deletion neighbourhood (2 units), only by one that differs in
    two elements or more.  The cost is the number of index rows met; a signature that one
    component has to itself meets none.  Segments that cost nothing are not looked up."""
    holds = index.join(members.select("member", "comp"), "member").groupBy("sig").agg(
        F.count_if(F.col("kind") == 0).alias("whole"), F.count_if(F.col("kind") == 1).alias("less"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    met = index.join(holds.filter("lo <> hi"), "sig")
    cost = met.groupBy("member", "band", "seg").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("whole") - 1)).alias("one"),
        F.sum(F.when(F.col("kind") == 0, F.col("whole") - 1 + F.col("less")).otherwise(F.col("whole"))).alias("two"),
    )
    segs = index.filter("kind = 0").select("member", "band", "seg", "n").join(cost, ["member", "band", "seg"], "left").na.fill(0, ["one", "two"])
    segs = segs.withColumn("most", F.when((F.col("n") > 1) & ((F.col("two") < 2 * F.col("one")) | (F.col("two") == 0)), 2).otherwise(1))
    segs = segs.withColumn("each", F.when(F.col("most") == 2, F.col("two") / 2).otherwise(F.col("one")))
    before = F.sum("most").over(Window.partitionBy("member", "band").orderBy("each", "seg").rowsBetween(Window.unboundedPreceding, -1))
    h = F.floor((F.col("size") + F.floor(F.col("size") * 5 / 4)) / 9)
    segs = segs.withColumn("before", F.coalesce(before, F.lit(0))).join(members.select("member", "size"), "member")
    segs = segs.withColumn("units", F.least("most", h + 1 - F.col("before")).cast("int"))
    spent = F.when(F.col("units") == 2, F.col("two")).otherwise(F.col("one"))
    return segs.filter((F.col("units") > 0) & (spent > 0)).select("member", "band", "seg", "units")


def neighbour_pairs(members: DataFrame, texts: DataFrame, single: bool) -> DataFrame:
    """(a, b): candidates of different components among ``members`` (member, comp, size,
    shared, k0, ...; ``shared`` bounds what a member has in common with another)."""
    index = cut(neighbour_index(texts.join(members.select("member"), "member", "left_semi"), single), "index")
    look = cut(index.join(allot(index, members), ["member", "band", "seg"]).filter("kind = 0 or units = 2").select("sig", "member", "kind", "units"), "lookups")
    found = index.select("sig", "member", "kind").join(look.select("sig").distinct(), "sig", "left_semi")
    # written first, so that Spark may split a hot signature in the join
    p, q = cut(look.join(members, "member"), "asking").alias("p"), cut(found.join(members, "member"), "asked").alias("q")
    need = _common(F.col("p.size"), F.col("q.size"))
    deleted = F.col("p.kind") + F.col("q.kind")
    on = (F.col("p.sig") == F.col("q.sig")) & ((deleted == 0) | ((deleted == 1) & (F.col("p.units") == 2)))
    on = on & (F.col("p.comp") != F.col("q.comp")) & (F.col("p.shared") >= need) & (F.col("q.shared") >= need)
    on = on & (5 * F.col("p.size") >= 4 * F.col("q.size")) & (5 * F.col("q.size") >= 4 * F.col("p.size"))
    on = on & (_differ("p", "q") <= F.col("p.size") + F.col("q.size") - 2 * need)
    return p.join(q, on).select(F.least("p.member", "q.member").alias("a"), F.greatest("p.member", "q.member").alias("b")).distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, by exact overlap of their sets.

    Pairs are gathered by their hub (the member with more pairs to serve), in groups
    of about VERIFY_GROUP, so that each text travels once a group and hot hubs spread."""
    load = pairs.select(F.explode(F.array("a", "b")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    la, lb = load.select(F.col("m").alias("a"), F.col("n").alias("na")), load.select(F.col("m").alias("b"), F.col("n").alias("nb"))
    sided = pairs.join(la, "a").join(lb, "b").select(
        F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("leaf"),
        F.greatest("na", "nb").alias("n"),
    )
    sided = sided.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.floor(F.col("n") / VERIFY_GROUP) + 1).alias("part"))
    body = texts.select(F.col("member").alias("leaf"), "body")
    leaves = sided.join(body, "leaf").select("hub", "part", F.lit(1).alias("side"), F.col("leaf").alias("id"), "body")
    hubs = sided.select("hub", "part").distinct().join(texts.select(F.col("member").alias("hub"), "body"), "hub")
    rows = hubs.select("hub", "part", F.lit(0).alias("side"), F.col("hub").alias("id"), "body").unionByName(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, base = None, np.zeros(0, np.uint64)
        for b in batches:
            heads, sides, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out_a, out_b = [], []
            for i, j, h, bounds in _sets(b.column(3)):
                for r in range(i, j):
                    mine = h[bounds[r - i] : bounds[r - i + 1]]
                    if sides[r] == 0:
                        hub, base = heads[r], mine
                    elif heads[r] == hub and len(base):
                        at = np.searchsorted(base, mine)
                        both = int((base[np.minimum(at, len(base) - 1)] == mine).sum())
                        if 100 * both >= 80 * (len(base) + len(mine) - both):
                            out_a.append(hub)
                            out_b.append(ids[r])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "hub", "part").sortWithinPartitions("hub", "part", "side")
    return dealt.select("hub", "side", "id", "body").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(member, comp): comp is the smallest member reachable.  Each round hooks every
    component to the smallest neighbouring one and then jumps pointers once; links
    inside a component leave the next round."""
    spark = links.sparkSession
    both = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    edges, label = both, None
    while True:
        hooks = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        # where a component's target hooks further down, follow it
        step = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a"), "left")
        step = cut(step.select(F.col("x.a").alias("a"), F.coalesce("y.to", "x.to").alias("to")), "hooks")
        if label is None:
            label = step.select(F.col("a").alias("member"), F.col("to").alias("comp"))
        else:
            label = label.join(step, F.col("comp") == F.col("a"), "left").select("member", F.coalesce("to", "comp").alias("comp"))
        label = cut(label, "labels")
        to_a, to_b = step.select("a", F.col("to").alias("ta")), step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(to_a, "a").join(to_b, "b").filter("ta <> tb")
        edges = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return label


def grouped_rows(docs: DataFrame, single: bool = False) -> DataFrame:
    """(doc_id, row_hash, n_shingles, member, comp), one row a row of ``docs``, which has
    doc_id, text and a row_hash."""
    about = cut(describe(docs), "sets")
    parts = parts_for(about.agg(F.sum("n_shingles") * 16), 32 << 20)
    live = cut(shared_signatures(docs, parts, single), "signatures")
    if not single and not live.filter("df = 0").isEmpty():
        return grouped_rows(docs, True)
    probes = cut(allocate(live), "probes")
    asked = probes.filter("probe").select("sig").distinct()
    probes = cut(probes.join(asked, "sig", "left_semi"), "asked")
    # one text for each member that may link
    firsts = about.groupBy("member").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first"))
    wanted = probes.select("member").distinct().join(firsts, "member").select("member", F.col("first.doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    on = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("row_hash") == F.col("first_hash"))
    bodies = docs.join(wanted, on).select("member", F.col("text").alias("body"))

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # where doc_id and hash repeat with another text, only the right one
            ok = np.concatenate([_signed(_prints(h, at)) for _, _, h, at in _sets(b.column(1))] or [np.zeros(0, np.int64)]) == np.asarray(b.column(0))
            yield b.filter(pa.array(ok))

    bodies = cut(bodies.mapInArrow(tidy(matching), "member long, body string").dropDuplicates(["member"]), "bodies")
    star = cut(star_pairs(probes), "stars")
    sketch = cut(sketches(bodies), "sketches")
    links = cut(verify(cut(plausible(star, sketch), "plausible"), bodies), "linked")
    label = components(links)
    rest = cut(rest_pairs(probes, label, star, bodies, sketch, single), "rest")
    more = verify(rest, bodies)
    label = components(links.unionByName(more))
    grouped = about.join(label, "member", "left").withColumn("comp", F.coalesce("comp", "member"))
    return cut(grouped, "grouped")


def join(docs: DataFrame, text: str = "text", single: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document.  ``single``: segments of
    one shingle for all sets, which is also the way for irregular ones."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("row_hash"))
    grouped = grouped_rows(docs, single)
    # read back from a table, so that Spark may split a hot component in the join
    smallest = cut(grouped.filter("member <> 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return grouped.join(smallest, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("member") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


RESULT = ["doc_id", "n_shingles", "component_id"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*RESULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, that with the smallest doc_id (rows
    without one come last), among rows of that id the one with the smallest hash of the
    row; documents without words stay as they are."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rest = F.to_json(F.struct(F.col("doc_id"), *[c for c, n in zip(own, docs.columns) if n not in ("doc_id", "text")]))
    docs = docs.select(F.struct(*own).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), F.xxhash64("text", rest).alias("__hash"))
    found = grouped_rows(docs.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"), F.col("__hash").alias("row_hash"))).filter("member <> 0")
    # rows are told apart by doc_id and hash; those equal in both are the same row repeated
    keys = cut(found.groupBy("comp", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")), "keys")
    best = cut(found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("best")), "best")
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_hash") == F.col("best.row_hash"))
    # a key is gone, or it stays but its rows repeat; all others stay as they are
    told = keys.join(best, "comp").withColumn("first", first).filter("not first or n > 1")
    told = cut(told.select(F.col("doc_id").alias("__told"), F.col("row_hash").alias("__told_hash"), "first"), "told")
    on = F.col("__id").eqNullSafe(F.col("__told")) & (F.col("__hash") == F.col("__told_hash"))
    rows = docs.drop("__text")
    again = rows.join(told.filter("first"), on, "left_semi").dropDuplicates(["__id", "__hash"])
    return rows.join(told, on, "left_anti").unionByName(again).select("__row.*")
