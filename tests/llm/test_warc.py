from __future__ import annotations

import hashlib
import time

import pytest
from conftest import SMALL, same_rows

from pingworks.llm import warc
from pingworks.llm.shared import new_path

SCHEMA = "page_id long, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def test_equals_its_sql(spark, duck):
    same_rows(warc.query(spark, SMALL), duck, warc.ORACLE_SQL)


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_planted_magic_and_splits(spark, split):
    rows = [
        (1, "u", "a" * 50), (2, None, None), (3, "x\r\ny", "b" * 200), (4, "u", "b" * 200), (10, "u", "a" * 50), (None, "u", "z" * 150),
        (5, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" + "c" * 3000), (6, "u", FAKE), (7, "u", "b" * 200),
        (8, "u", "WARC/1.1\r\nContent-Length: 100000\r\n\r\n" + "é" * 4000 + "WARC/1.1\r\n" * 20), (9, "u", FAKE * 30 + "end"),
    ]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        path = new_path(spark, "warc")
        warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
        got = {r.page_id: r for r in warc.read(spark, path, payloads=True).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert set(got) == {r[0] for r in rows}
    for page, _, html in rows:
        body, r = (html or "").encode(), got[page]
        again = page in (4, 7)
        assert (r.record_type, r.refers_to) == (("revisit", 3) if again else ("response", None))
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.payload is None if again else bytes(r.payload) == body


def test_quoted_archives_cost_their_bytes_only(spark):
    """Hundreds of headers in a payload, each claiming the rest of the archive and more."""
    nested = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {900_000_000 + i}\r\n\r\n" + chr(97 + i % 26) * 20_000 for i in range(500))
    rows = [(1, "u", "before"), (2, "u", nested), (3, "u", "after"), (4, "u", nested)]
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    began = time.time()
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read(spark, path).collect()}
    assert time.time() - began < 60
    digest = hashlib.sha256(nested.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4} and got[2] == ("response", None, len(nested), digest) and got[4] == ("revisit", 2, len(nested), digest)


def test_a_length_beyond_the_file_is_read_to_its_end(spark):
    path = new_path(spark, "warc")
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 99999999999999999\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", warc.END).text(path)
    assert [(r.page_id, r.record_type) for r in warc.read(spark, path).collect()] == [(5, "response")]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "same" * 50), (1, "u", "same" * 50), (2, "u", "same" * 50)], SCHEMA)
    path = new_path(spark, "warc")
    warc.write(df, path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    path = new_path(spark, "warc")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


def test_chain_keeps_only_what_leads_from_the_start(spark):
    nodes = [("a", 0, 10), ("a", 10, 30), ("a", 15, 30), ("a", 30, 99), ("a", 50, 60), ("b", 0, None), ("b", 5, 7)]
    got = warc.reachable(spark.createDataFrame(nodes, "file string, offset long, next long")).collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("a", 10), ("a", 30), ("b", 0)]
