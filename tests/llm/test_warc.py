import gzip
import hashlib
import io

import pytest

from fleetlens.llm import warc
from fleetlens.session import scratch_path

BIG = "<p>é" * 900


def rows(spark):
    data = [
        (1, "http://a/", BIG), (2, "http://b/\r\nX: y", BIG), (9, None, BIG), (9, None, BIG), (None, "u", BIG),
        (3, "c", "small"), (4, "d", "small"), (5, "e", None), (6, "f", ""), (7, "g", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"),
        (8, "h", "q" * 999), (10, "i", "q" * 999), (11, "j", "z" * 1000), (12, "k", "z" * 1000), (13, "l", "long " * 5000),
    ]
    return data, spark.createDataFrame(data, "page_id long, url string, html string")


@pytest.mark.parametrize("compress", [False, True])
def test_archives_round_trip_in_small_chunks(spark, compress):
    data, pages = rows(spark)
    folder = scratch_path(spark, "warc")
    manifest = warc.write_archives(warc.chunk_rows(pages, "page_id", "url", "html", chunk=700), folder, compress, file_bytes=300 if compress else 3000)
    chunks = warc.read_chunks(manifest, chunk=512, batch_bytes=2000)
    table = chunks.collect()
    assert manifest.count() > 2 and max(len(r.data) for r in table) <= 512
    bodies, payload = {}, {}
    for r in sorted(table, key=lambda r: (r.path, r.record, r.chunk)):
        bodies.setdefault((r.path, r.record), []).append(r)
    for parts in bodies.values():
        assert [p.chunk for p in parts] == list(range(len(parts))) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
        so_far = b""
        for p in parts:
            so_far += bytes(p.data)
            assert (p.n_bytes, p.digest) == (len(so_far), hashlib.sha1(so_far).hexdigest())
        if parts[0].record_type == "response":
            payload.setdefault(parts[0].key, set()).add(so_far.decode())
    got = sorted(((r.key, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.records(chunks).collect()), key=repr)
    winner = {BIG: 9, "z" * 1000: 12}
    want = []
    for key, _, html in data:
        body = (html or "").encode()
        ref = winner.get(html) if winner.get(html) not in (None, key) else None
        want.append((key, "revisit" if ref else "response", ref, len(body), hashlib.sha1(body).hexdigest()))
        if not ref:
            assert (html or "") in payload[key]
    assert got == sorted(want, key=repr)
    assert all(r.intact for r in warc.records(chunks).collect())
    assert {r.url for r in table if r.key == 2} == {"http://b/%0D%0AX: y"}


def test_files_are_plain_warc(spark):
    _, pages = rows(spark)
    manifest = warc.archive(pages.where("page_id = 3"), compress=True).collect()
    path = manifest[0].path.removeprefix("file://")
    record = gzip.open(path).read()
    head, http, body = record.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == b"small\r\n\r\n"
    assert f"Content-Length: {len(http) + 4 + 5}".encode() in head


def test_damaged_archives_are_noticed():
    with pytest.raises(ValueError, match="ends early"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")), "x", 4))
    with pytest.raises(ValueError, match="no record"):
        list(warc.read_records(io.BufferedReader(io.BytesIO(b"hello\r\n")), "x", 4))


def test_empty_table(spark):
    _, pages = rows(spark)
    assert warc.records(warc.read_chunks(warc.archive(pages.limit(0)))).count() == 0
