import base64
import hashlib

import pytest

from ballast.functions.store import scratch_path
from ballast.llm import web_archives
from ballast.llm.web_archives import arc_records, convert, convert_arc, digest_rows, read_warc, write_arc

PAGES = [(1, "http://a.com/x y", "<p>one</p>"), (2, "http://b.com/", None), (3, None, ""), (4, "http://é.com/\n", "same\r\n\r\nWARC/1.1\r\n"), (5, "http://d.com", "same\r\n\r\nWARC/1.1\r\n"),
         (6, "u", "l" * 300_000), (7, "http://b.com/", "<p>one</p>"), (8, "v", "HTTP/1.1 x\r\n\r\ny"), (9, "w", "ünïcode 日本")]


def want(rows, least=0):
    first = {}
    for i, _, h in sorted(rows):
        if len((h or "").encode()) >= least:
            first.setdefault(h or "", i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "", i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(4)
    records, path = convert(pages, least)
    got = digest_rows(records).collect()
    assert sorted(map(tuple, got)) == want(PAGES, least)
    back = {int(r["page_id"]): r["payload"] for r in read_warc(spark, path).where("record_type = 'response'").collect()}
    assert all(back[i] == (h or "") for i, _, h in PAGES if i in back)


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_are_read(spark, version):
    path = scratch_path(spark, "arc-test")
    write_arc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), path, (version,))
    got = {int(r["page_id"]): (r["payload"], r["date"], r["mime"]) for r in convert_arc(spark, path).collect()}
    assert got == {i: (h or "", "2024-01-01T00:00:00Z", "text/html") for i, _, h in PAGES}


def test_header_lines_of_each_version():
    head1 = b"filedesc://x 0.0.0.0 19960101000000 text/plain 10\n1 0 x\nURL\n\n"
    (fields, block), = arc_records(head1 + b"http://a b/ 1.2.3.4 19970102030405 text/html 4\nab\nc\n")
    assert fields["URL"] == "http://a b/" and fields["Content-type"] == "text/html" and block == b"ab\nc"
    head2 = b"filedesc://x 0.0.0.0 19960101000000 text/plain 200 - - 0 f 10\n2 0 x\nURL\n\n"
    (fields, block), = arc_records(head2 + b"http://a/ 1.2.3.4 19970102030405 text/html 200 - - 99 f 4\nabcd\n")
    assert fields["Result-code"] == "200" and fields["Offset"] == "99" and block == b"abcd"
    with pytest.raises(ValueError):
        list(arc_records(head1 + b"http://a/ 1.2.3.4 19970102030405 text/html 40\nab"))


def test_repeated_rows_and_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert digest_rows(convert(empty)[0]).collect() == []
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "v", "x"), (3, "w", "y"), (3, "w", "y")]  # a row for each, one response a payload
    got = digest_rows(convert(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))[0]).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == sorted([(1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (3, "response", None), (3, "revisit", 3)], key=str)


def test_urls_and_ids_that_look_like_headers(spark):
    rows = [("a\r\nX-Page-Id: b", "filedesc:x", "p"), ("50%0A%", "filedesc://y 1", "q"), ("c", "filedesc:x", "p")]
    records, _ = convert(spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1))
    got = digest_rows(records, "string").collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [("50%0A%", "response", None), (rows[0][0], "response", None), ("c", "revisit", rows[0][0])]


def test_many_files_a_partition(spark, monkeypatch):
    monkeypatch.setattr(web_archives, "FILE_BYTES", 60_000)
    rows = [(i, f"u{i}", f"{i % 7} " * 2000) for i in range(100)]
    records, path = convert(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    assert sorted(map(tuple, digest_rows(records).collect())) == want(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).count()
    assert files >= 9
