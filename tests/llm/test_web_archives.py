"""Operator 9: a round trip, SQL, and archives with faults."""
import duckdb
import hashlib
import pytest

import __spark_entry__ as entry
from dossierflow.llm import warc
from tests.llm.rows import by_id

SF = "/root/testdata/sf0.001"


def expected(rows):
    out = []
    for i, _, html in rows:
        own = (html or "").encode()
        equal = [j for j, _, h in rows if (h or "").encode() == own and j is not None] if len(own) >= 1000 else []
        revisit = bool(equal) and i != max(equal)
        out.append((i, len(own), hashlib.sha1(own).hexdigest(), "revisit" if revisit else "response", max(equal) if revisit else None))
    return by_id(out)


def test_pages(spark):
    got = entry.queries()["op9_web_archives"](spark, SF)
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    rows = by_id(map(tuple, got.collect()))
    assert rows == expected(pages) == by_id(c.execute(entry.oracle_sql()["op9_web_archives"]).fetchall())


def test_odd_pages(spark):
    same, long = "<p>é</p>" * 200, "x" * 3_000_000
    rows = [(1, "http://a", same), (2, None, same), (2, "", same), (None, "http://b\r\nX: y", same), (3, "http://c", None), (4, "u", ""), (4, "u", ""),
            (5, "u", "short"), (6, "u", "short"), (7, "u", long), (8, "u", long), (None, None, None), (None, "n", "y" * 1000), (None, "n", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, k string, id int")
    got = warc.archive_round_trip(pages, with_payload=True).collect()
    assert by_id((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)
    assert all(len(r.payload) == r.payload_bytes for r in got if r.record_type == "response")
    assert warc.archive_round_trip(pages.where("false")).collect() == []


def test_archive_faults():
    records = [warc.record(i, "http://x", b"body %d" % i, hashlib.sha1(b"body %d" % i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(40)]
    data = warc.to_archive(records)
    assert list(warc.from_archive(data)) == records
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    with pytest.raises(ValueError):
        list(warc.from_archive(data[:-3]))
    for bad in (records[0].replace(b"body 0", b"body 1"), records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/x"),
                records[0].replace(b"Content-Length: 6", b"Content-Length: 7")):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)
