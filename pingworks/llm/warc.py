"""WARC archives: written by Spark's text writer, read back by boundary chains.

Writing: one record a page; of equal payloads of at least ``least`` bytes the one with
the smallest page_id is a response and the others are revisits of it.

Reading: files are read in splits, cut at the magic line.  Every magic is only a
candidate: a payload may hold the same bytes.  Tasks emit, for each candidate, its
offset and the offset that its declared length leads to; pointer jumping from the start
of each file keeps the candidates on that chain and drops all others.  Only then are
records on the chain that consist of several pieces (a payload that holds the magic, or
a record over a split's end) put together, so that a candidate costs no more than its
header however much it claims to hold.

Defined cases: null html is the empty payload; control characters and blanks in a url
are left out of its header, a null url has no header; a null page_id is written and read
as null (never a target of revisits); repeated rows are records of their own; a
candidate with a broken header ends its chain; other columns are left behind; an empty
table gives an archive without records and an empty result."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingworks.llm.shared import cut, new_path

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 100
#: Pieces and the records that they belong to meet by stretches of so many bytes.
STRETCH = 1 << 20

FIELDS = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string"


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(record): each page's record as text, without the blank lines that end it."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body")).withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha2("body", 256)})
    # only digests of several pages, without their payloads
    firsts = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = cut(firsts.filter("n > 1").select("digest", "first"), "warc-firsts")
    rows = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(_http(F.col("size")), F.when(F.col("again"), "").otherwise(F.col("body")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    rows = rows.withColumn("again", again).withColumn("block", block)
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "")
    return rows.select(F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\n"),
        F.lit("WARC-Record-ID: "), urn(F.col("page_id")), F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\n"),
        F.when(F.col("again"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    ).alias("record"))


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    records(pages, least).write.option("lineSep", END).text(path)


def _header(raw: bytes) -> dict[str, str] | None:
    """Fields of a record header; None if it has none or no length."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(re.findall(r"([A-Za-z-]+): ?([^\r\n]*)", raw[:end].decode("utf-8", "replace")))
    if not re.fullmatch(r"\d{1,18}", fields.get("Content-Length", "")):
        return None
    return fields | {"": str(end + 4)}


def _urn(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


def _content(fields: dict[str, str], block: bytes | None) -> tuple:
    """Record fields; a response's size and digest are those of what was read."""
    kind, size, digest, payload = fields.get("WARC-Type"), fields.get("X-Payload-Length", ""), fields.get("WARC-Payload-Digest", "").removeprefix("sha256:"), None
    if kind == "response" and block is not None:
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    size = int(size) if str(size).isdigit() else None
    return _urn(fields.get("WARC-Record-ID")), kind, _urn(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"), size, digest, payload


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): what lies between magics, in order within a split."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


_CANDIDATE = "file string, split long, at long, length long, piece long, whole boolean, " + FIELDS


def candidates(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a piece: its place in its split (of the magic before it), the length that
    its header declares (null: none) and, where the piece holds all of it, its content."""
    schema = _CANDIDATE + (", payload binary" if payloads else "")
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    kinds += [pa.binary()] * payloads
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at, out = None, 0, []
        for b in batches:
            for file, split, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = value.as_py()
                if (file, split) != place:
                    place, at = (file, split), 0
                fields = _header(raw)
                head = (file, split, at - len(MAGIC))
                if fields is None:
                    out.append((*head, None, len(raw), False, *[None] * (len(kinds) - 6)))
                else:
                    start, need = int(fields[""]), int(fields["Content-Length"])
                    whole = len(raw) >= start + need
                    values = _content(fields, raw[start : start + need] if whole else None)
                    out.append((*head, len(MAGIC) + start + need + len(END), len(raw), whole, *(values if payloads else values[:-1])))
                at += len(raw) + len(MAGIC)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return _pieces(spark, path).mapInArrow(run, schema)


def _bases(found: DataFrame) -> DataFrame:
    """(file, split, base): where each split's first piece starts in its file."""
    sizes = found.groupBy("file", "split").agg(F.sum(F.col("piece") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("file", "split", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))


def reachable(nodes: DataFrame) -> DataFrame:
    """(file, offset) of the candidates on the chain from offset 0 of their file, by
    doubling: after k rounds every pointer spans 2^k records."""
    state = cut(nodes.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("reached")), "warc-chain")
    longest = state.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        far = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("far"))
        jumped = state.join(far, ["file", "jump"], "left").select("file", "offset", F.col("far").alias("jump"), "reached", F.lit(True).alias("node"))
        marks = state.filter("reached and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("reached"), F.lit(False).alias("node"))
        merged = jumped.unionByName(marks).groupBy("file", "offset").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached"), F.max("node").alias("node"))
        state = cut(merged.filter("node").drop("node"), "warc-chain")
    return state.filter("reached").select("file", "offset")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``: page_id, record_type, refers_to, url,
    payload_bytes, payload_digest and, if asked, payload (null for revisits)."""
    light = cut(candidates(spark, path), "warc-candidates")
    bases = cut(_bases(light), "warc-bases")
    placed = light.join(bases, ["file", "split"]).withColumn("offset", F.col("base") + F.col("at"))
    nodes = placed.filter("offset >= 0").select("file", "offset", (F.col("offset") + F.col("length")).alias("next"))
    chain = cut(reachable(nodes), "warc-reached")
    source = candidates(spark, path, True).join(bases, ["file", "split"]).withColumn("offset", F.col("base") + F.col("at")) if payloads else placed
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payloads
    true = source.join(chain, ["file", "offset"])
    out = true.filter("whole").select(*names)
    broken = placed.join(chain, ["file", "offset"]).filter("not whole and length is not null").select("file", "offset", "length", *[c for c in names if c != "payload"])
    if broken.isEmpty():
        return out
    # records of several pieces: gather just those, found by stretches of their file
    stretch = lambda c: F.floor(c / STRETCH)
    ends = placed.groupBy("file").agg(F.max(F.col("offset") + F.col("piece")).alias("end"))  # a length may claim more than there is
    spans = broken.select("file", F.col("offset").alias("record"), F.col("length").alias("size")).join(ends, "file")
    spans = spans.withColumn("stretch", F.explode(F.sequence(stretch(F.col("record")), stretch(F.least(F.col("record") + F.col("size"), F.col("end"))))))
    want = placed.withColumn("stretch", stretch(F.col("offset"))).join(spans, ["file", "stretch"])
    want = want.filter((F.col("offset") >= F.col("record")) & (F.col("offset") < F.col("record") + F.col("size"))).select("file", "split", "at", "record", "offset")
    parts = _numbered(spark, path).join(want, ["file", "split", "at"])
    whole = parts.groupBy("file", F.col("record").alias("offset")).agg(F.sort_array(F.collect_list(F.struct(F.col("offset").alias("o"), "value"))).alias("parts")).join(broken, ["file", "offset"])
    kinds = FIELDS + (", payload binary" if payloads else "")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pieces in b.column(0):
                raw = MAGIC.encode().join(p["value"] for p in pieces.as_py())
                fields = _header(raw)
                start, need = int(fields[""]), int(fields["Content-Length"])
                values = _content(fields, raw[start : start + need])
                rows.append(values if payloads else values[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    return out.unionByName(whole.select("parts").mapInArrow(join_pieces, kinds))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, at, value): pieces with their place in their split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, at = None, 0
        for b in batches:
            ats = []
            for file, split, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (file, split) != place:
                    place, at = (file, split), 0
                ats.append(at - len(MAGIC))
                at += len(value.as_buffer()) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ats, pa.int64()), b.column(2)], names=["file", "split", "at", "value"])

    return _pieces(spark, path).mapInArrow(run, "file string, split long, at long, value binary")


RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read(spark, path).select(*RESULT)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
