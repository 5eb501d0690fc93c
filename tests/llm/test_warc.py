import base64
import hashlib

import pytest

from clickspark.llm import warc as W
from clickspark.staging import new_path

REC = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <https://archive.example/page/999>\r\n"
       "Content-Length: 5\r\n\r\nabcde\r\n\r\n")
ROWS = [(1, "u", REC * 3), (2, "u", "x" + REC + "WARC/1.1\r\n"), (3, None, None), (4, "u", ""), (5, "u\r\nEvil: 1", REC * 3),
        (None, "u", "zz"), (6, "u", "WARC/1.1\r\n" * 500), (7, "u", "\r\n\r\n" + REC[:60]), (8, "u", "é" * 5000 + REC + "ü" * 9000),
        (9, "u", "same"), (9, "u", "same"), (10, "u", "WARC/1.1\r\nContent-Length: 99999\r\nWARC-Type: x\r\n\r\n"), (None, "u", "same")]


def want(rows, least=0):
    owner = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= least:
            owner[h] = max(owner.get(h, i), i)
    out = []
    for i, _, h in rows:
        data, o = (h or "").encode(), owner.get(h or "")
        re = o is not None and i != o
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if re else "response",
                    o if re else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,least", [("16m", 0), ("7k", 0), ("16m", 6)])
def test_magic_inside_payloads(spark, split, least):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        path = new_path(spark, "warc_test")
        W.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(2), path, least)
        got = sorted((tuple(r) for r in W.read_warc(spark, path).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want(ROWS, least)


def test_archives_are_warc_files(spark):
    path = new_path(spark, "warc_test")
    W.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    at = n = 0
    while at < len(data):  # a plain reader: header, length, payload, two line ends
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        assert data[at:].startswith(b"WARC/1.1\r\n")
        at = end + 4 + int(head[b"Content-Length"])
        assert data[at:at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(ROWS)


def test_query(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in W.query(spark, sf).collect()), key=str) == want(pages)


def test_no_pages(spark):
    path = new_path(spark, "warc_test")
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.read_warc(spark, path).count() == 0
