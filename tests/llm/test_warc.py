import base64
import gzip
import hashlib
import io

import pytest

from quillmere.llm import warc

PAGES = "page_id long, url string, html string"


def test_arc_versions_and_declared_lengths():
    for version in (1, 2):
        out = io.BytesIO()
        warc.write_arc_start(out, "a.arc.gz", "20240101000000", version)
        for i, body in enumerate([b"", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nx\n\ny", b"no head\n"]):
            warc.write_arc_record(out, "a.arc.gz", version, f"http://x/{i} é", "20240102030405", body, 0)
        got = list(warc.parse_arc(io.BytesIO(gzip.decompress(out.getvalue()))))
        assert [r.body for r in got] == [b"", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nx\n\ny", b"no head\n"]
        assert got[0].url == "http://x/0%20%C3%A9" and got[0].iso_date == "2024-01-02T03:04:05Z" and {r.version for r in got} == {version}


@pytest.mark.parametrize("data", [b"http://x 1 2 3 4\n", b"filedesc://a 0 0 t 4\n9 0 \n", b"filedesc://a 0 0 t 4\n1 0\n\nhttp://x 0 20240101000000 t 9\nabc", b"filedesc://a 0 0 t 4\n1 0\n\nhttp://x 0 x t 3\nabc"])
def test_malformed_archives_are_refused(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data)))


def brute(rows, least=0):
    best = {}
    for i, (p, _, h) in enumerate(rows):
        body = (h or "").encode()
        if p is not None and len(body) >= least:
            best[body] = max(best.get(body, p), p)
    out, taken = [], set()
    for p, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = p is not None and len(body) >= least and (best[body] != p or (body, p) in taken)
        taken.add((body, p))
        out.append((p, len(body), digest, "revisit" if revisit else "response", best[body] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_archives_read_back(spark, least):
    rows = [(i, f"http://h/{i % 7}?q= a", [None, "", "same body of some size", f"own {i}", "é\r\n\r\nx", "WARC/1.1\r\n\r\n"][i % 6]) for i in range(80)]
    rows += [(5, None, "twice here"), (5, None, "twice here"), (None, "u", "same body of some size"), (99, "v", "z" * 300_000)]
    frame = spark.createDataFrame(rows, PAGES).repartition(5)
    read = warc.read_warcs(warc.archive(frame, least)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read), key=repr) == brute(rows, least)
    ids = {r["record_id"]: r for r in read}
    for r in read:
        if r["record_type"] == "revisit":
            assert ids[r["refers_to_id"]]["page_id"] == r["refers_to"] and ids[r["refers_to_id"]]["payload_digest"] == r["payload_digest"]


def test_no_pages(spark):
    assert warc.read_warcs(warc.archive(spark.createDataFrame([], PAGES))).collect() == []


def test_archives_end_at_their_size(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(60)]
    frame = spark.createDataFrame(rows, PAGES).coalesce(1)
    arcs = warc.write_arcs(frame, archive_bytes=2000)
    assert arcs.count() > 3
    read = warc.read_warcs(warc.convert(arcs, warc.decide(warc.index_arcs(arcs)))).collect()
    assert sorted(r["page_id"] for r in read) == list(range(60)) and {r["record_type"] for r in read} == {"response"}
