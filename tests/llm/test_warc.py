import hashlib

import pytest

from hanok.llm import warc
from hanok.llm.queries.op12 import op12_warc

LINE = "\r\n"


def record(page_id, payload, more=""):
    block = f"HTTP/1.1 200 OK{LINE}{LINE}{payload}"
    return f"WARC/1.0{LINE}WARC-Type: response{LINE}WARC-Record-ID: <urn:page:{page_id}>{LINE}{more}Content-Length: {len(block.encode())}{LINE}{LINE}{block}{LINE}{LINE}"


def brute(rows):
    """A row of the query for each (page_id, html), from the contract."""
    digest = lambda html: hashlib.sha1((html or "").encode()).hexdigest()
    last = {}
    for page_id, html in rows:
        if page_id is not None:
            last[digest(html)] = max(page_id, last.get(digest(html), page_id))
    out = []
    for page_id, html in rows:
        size = len((html or "").encode())
        to = last.get(digest(html)) if size >= 1000 else None
        to = to if to != page_id else None
        out.append((page_id, size, digest(html), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture
def small_splits(spark):
    """Files are cut into many splits, inside magics too."""
    keys = {"spark.sql.files.maxPartitionBytes": "313", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pages(spark):
    long = "".join(f"<p>{i}</p>" for i in range(200))
    feigned = record(999, "feigned") + record(998, long)
    rows = [(1, "http://a.b/%20?x=1", long), (2, "http://a.b/2", long), (3, None, None), (4, "", ""), (5, "http://ü.b/ x\r\nWARC-Type: revisit", "short"), (6, "http://a.b/", "short")]
    rows += [(7, "u", feigned), (8, "u", f"WARC/1.0{LINE}" * 9), (9, "u", f"{LINE}{LINE}WARC/1.0{LINE}Content-Length: 5{LINE}{LINE}"), (10, "u", "日本語" * 500), (11, "u", "日本語" * 500)]
    rows += [(None, "u", long), (None, "u", None), (2, "http://a.b/2", long), (12, "u", f"{feigned}WARC/1.0"), (13, "u", "WARC/1.0\r"), (14, "u", "x" * 30_000), (-5, "u", feigned)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, record_type string, block string")


@pytest.mark.parametrize("files", [1, 4])
def test_what_is_written_is_read_and_feigned_records_are_not(spark, tmp_path, small_splits, files):
    table = pages(spark)
    wide = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # fewer tasks for a table with one long page
    warc.write(table.coalesce(files), f"{tmp_path}/a")
    got = warc.read(spark, f"{tmp_path}/a").collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", wide)
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute([(p, h) for p, _, h in rows])
    assert all(r.intact for r in got) and sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(p), str(u)) for p, u, _ in rows)
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response" and r.page_id is not None} == {p: h or "" for p, _, h in rows if p not in (None, -5, 1, 10)}


def test_chains_over_many_splits_start_at_the_file_only(spark, tmp_path, small_splits):
    honest = "".join(record(i, "p" * (i * 37 % 900)) for i in range(40))
    inner = record(500, record(501, "deep") + record(502, "deeper")) + record(503, "last")
    whole = honest + inner
    (tmp_path / "whole.warc").write_bytes(whole.encode())
    (tmp_path / "cut.warc").write_bytes((record(101, "a") + record(102, "b" * 800) + record(103, "c" * 900)[:-5]).encode())
    (tmp_path / "overlong.warc").write_bytes((record(104, "a") + record(105, "b").replace("Content-Length: ", "Content-Length: 9")).encode())
    (tmp_path / "junk.warc").write_bytes(("junk" + record(106, "a")).encode())
    (tmp_path / "none.warc").write_bytes(b"")
    (tmp_path / "bytes.warc").write_bytes(record(108, "#" * 200).encode().replace(b"#", b"\xff"))
    got = {r.page_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path)).collect()}
    want = {i: b"p" * (i * 37 % 900) for i in range(40)} | {500: (record(501, "deep") + record(502, "deeper")).encode(), 503: b"last"}
    assert got == want | {101: b"a", 102: b"b" * 800, 104: b"a", 108: b"\xff" * 200}


def test_query_equals_brute_force(spark, tmp_path):
    table = pages(spark)
    table.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, op12_warc(spark, str(tmp_path)).collect()), key=str) == brute([(r.page_id, r.html) for r in table.collect()])


def test_empty_table(spark, tmp_path):
    pages(spark).limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert op12_warc(spark, str(tmp_path)).collect() == []
