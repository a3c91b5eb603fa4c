import hashlib

import pytest

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, off long"


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        h = h or ""
        f = first.get(h)
        again = f is not None and i != f
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def rows():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:tessera:page:999>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long = "é" * 80 + "x" * 60
    return [
        (1, "http://a", "<p>short</p>"), (2, "http://b", "<p>short</p>"), (3, None, None), (4, "http://d\r\nWARC-Type: x", ""),
        (5, "u", long), (6, "u", long), (7, "u", long), (7, "u", long), (8, "u", "tail\r\n\r\n"), (9, "u", "\r\n\r\n" + fake),
        (10, "u", "a\r\n\r\n" + fake + fake + "\r\n\r\nWARC/1.1\r\nContent-Length: 100000\r\n\r\nzz"), (11, "u", fake),
        (12, "u", "HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (13, "u", "y" * 200_000), (None, "u", long),
    ]


@pytest.mark.parametrize("split", [None, "2000"])
def test_round_trip_rejects_magic_in_payloads(spark, tmp_path, split):
    data = [(*r, "clash", 0) for r in rows()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.round_trip(spark.createDataFrame(data, SCHEMA).coalesce(2), str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=repr) == expected(data)


def test_payload_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(*r, "c", 0) for r in rows()], SCHEMA)
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).filter("record_type = 'response'").collect()
    assert {hashlib.sha256(r["payload"].encode()).hexdigest() for r in got} == {r["payload_digest"] for r in got}
    assert {r["payload"] for r in got} == {r[2] or "" for r in rows()}


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_other_version_and_compressed_files_are_read(spark, tmp_path, packed):
    import gzip

    one = lambda v, i, body: f"WARC/1.{v}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:tessera:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    parts = [one(0, 1, "first"), one(1, 2, "WARC/1.0 \r\n\r\nWARC/1.7 in it"), one(0, 3, "")]
    path = tmp_path / ("a.warc.gz" if packed else "a.warc")
    path.write_bytes(b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts))
    got = warc.read_archives(spark, str(path), with_payload=True).collect()
    assert sorted((r["record_id"], r["payload"]) for r in got) == [("<urn:tessera:page:1>", "first"), ("<urn:tessera:page:2>", "WARC/1.0 \r\n\r\nWARC/1.7 in it"), ("<urn:tessera:page:3>", "")]
