"""WARC archives that others wrote, and pages without ids."""

import gzip
import hashlib


def made(kind, name, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, **more, "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    from millrace.llm import warc

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    a, b = b"<html>one</html>", bytes(range(256))
    sha = hashlib.sha1(a).hexdigest()
    parts = [
        made("warcinfo", "<urn:uuid:0>", b"software: x\r\n"),
        made("request", "<urn:uuid:1>", b"GET / HTTP/1.1\r\n\r\n"),
        made("response", "<urn:uuid:2>", http + a, WARC_Payload_Digest=f"sha1:{sha.upper()}"),
        made("response", "<urn:uuid:3>", http + a, WARC_Payload_Digest="sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA"),
        made("resource", "<urn:uuid:4>", b),
        made("response", "<urn:uuid:5>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=y\r\nabc\r\n0\r\n\r\n"),
        made("response", "<urn:uuid:6>", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz"),
        made("revisit", "<urn:uuid:7>", http, WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest=f"sha1:{sha}"),
        made("response", "<urn:uuid:8>", b"HTTP/1.1 200 OK\r\n\r\nAB", WARC_Segment_Number=1),
        made("continuation", "<urn:uuid:9>", b"CD", WARC_Segment_Origin_ID="<urn:uuid:8>", WARC_Segment_Number=2, WARC_Segment_Total_Length=23),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:5]))
    (tmp_path / "two.warc").write_bytes(b"".join(parts[5:]))
    got = {r.record_id[-2]: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert sorted(got) == ["2", "3", "4", "5", "6", "7", "8"]
    assert all(r.page_id is None and r.refers_to is None for r in got.values())
    assert (bytes(got["2"].payload), got["2"].digest_ok, got["3"].digest_ok) == (a, True, None)
    assert bytes(got["4"].payload) == b and bytes(got["5"].payload) == b"abc" and bytes(got["8"].payload) == b"ABCD"
    assert got["6"].payload is None and got["6"].digest_ok is False
    assert (got["7"].record_type, got["7"].payload, got["7"].payload_digest) == ("revisit", None, sha)


def test_pages_without_ids(spark, tmp_path):
    from millrace.llm import warc

    text = "x" * 2000
    rows = [(None, "u", text), (1, "u", text), (2, "u", text), (None, "u", None), (None, "u", text)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in got) == sorted(map(str, [(None, "response", None, 2000)] * 2 + [(None, "response", None, 0), (1, "revisit", 2, 2000), (2, "response", None, 2000)]))
    assert len({r.record_id for r in got}) == 5
