"""Archives with broken records: what is broken is told, and everything else is read."""

import gzip
import random

from test_foreign_archives import made

HTTP = b"HTTP/1.1 200 OK\r\n\r\n"


def one(k, text=b"text"):
    return made("response", f"<urn:x:{k}>", HTTP + text + str(k).encode())


ARCHIVES = {
    "cut-off.warc": one(1) + one(2)[:-9],
    "line-feeds.warc": one(3).replace(b"\r\n", b"\n").replace(b"Content-Length: 24", b"Content-Length: 22") + one(4).replace(b"\r\n", b"\n").replace(b"Content-Length: 24", b"Content-Length: 22"),
    "blank lines.warc": b"\r\n" + one(5) + b"\r\n\r\n\r\n" + one(6) + b"\n",
    "no-length.warc": one(7).replace(b"Content-Length", b"Content-Size") + one(8),
    "no-name.warc": one(9).replace(b"WARC-Record-ID", b"WARC-Record-Name") + one(10),
    "too-long.warc": one(11).replace(b"Content-Length: 25", b"Content-Length: 60") + one(12) + one(13),
    "too-short.warc": one(14).replace(b"Content-Length: 25", b"Content-Length: 20") + one(15),
    "beyond-the-end.warc": one(16) + one(17).replace(b"Content-Length: 25", b"Content-Length: 99999"),
    "odd-length.warc": one(18).replace(b"Content-Length: 25", b"Content-Length: many") + one(19),
    "rubbish.warc": b"no archive at all\r\n" * 3 + one(20) + b"rubbish between\r\n\r\n" + one(21),
    "nothing.warc": b"",
    "only-rubbish.warc": b"\x00\x01" * 500,
    "members.warc.gz": gzip.compress(one(22)) + b"\x1f\x8b\x08\x00broken member" + gzip.compress(one(23)) + gzip.compress(one(24))[:-20],
    "one-member.warc.gz": gzip.compress(one(25) + one(26)),
    "damaged.warc.gz": gzip.compress(one(27) + "".join(random.Random(1).choices("abcdefgh \n", k=300_000)).encode())[:60_000] + gzip.compress(one(28) + made("metadata", "<urn:x:29>", "".join(random.Random(2).choices("abcdefgh", k=90_000)).encode())),
}
GOOD = {1, 3, 4, 5, 6, 8, 10, 12, 13, 15, 16, 19, 20, 21, 22, 23, 25, 26, 27, 28}
BAD = {2, 7, 11, 14, 17, 18}


def test_broken_archives(spark, tmp_path):
    from millrace.llm import warc

    for name, raw in ARCHIVES.items():
        (tmp_path / name).write_bytes(raw)
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    named = {int(r.record_id[7:-1]): r for r in rows if r.record_id}
    assert {k for k, r in named.items() if r.payload is not None} >= GOOD
    for k in GOOD:
        assert bytes(named[k].payload) == b"text" + str(k).encode(), k
    assert {k for k, r in named.items() if r.payload is None} == BAD | ({24} & set(named))  # of a member that is cut off the name may be lost
    assert all(named[k].digest_ok is False for k in BAD)
    assert [bytes(r.payload) for r in rows if not r.record_id and r.record_type == "response"] == [b"text9"]
    assert all(r.digest_ok is False and r.payload is None for r in rows if r.record_type == warc.UNREADABLE) and any(r.record_type == warc.UNREADABLE for r in rows)


def test_pieces_of_any_size_give_the_same_records():
    from millrace.llm import warc

    for name, raw in ARCHIVES.items():
        if name in ("members.warc.gz", "damaged.warc.gz"):  # how much of a broken member is seen depends on the pieces
            continue
        want = list(warc.parse(iter([raw])))
        for size in (1, 3, 7, 50):
            assert list(warc.parse(raw[i : i + size] for i in range(0, len(raw), size))) == want, (name, size)


def test_large_members_come_in_pieces(monkeypatch):
    from millrace.llm import warc

    monkeypatch.setattr(warc, "READ_BYTES", 1000)
    text = b"y" * 500_000
    got = list(warc.parse(iter([gzip.compress(made("response", "<urn:x:1>", HTTP + text)), gzip.compress(one(2))])))
    assert [b for _, b in got] == [HTTP + text, HTTP + b"text2"]


def test_a_segmented_record_with_a_broken_segment_is_not_whole(spark, tmp_path):
    from millrace.llm import warc

    parts = [
        made("response", "<urn:x:1>", HTTP + b"AB", WARC_Segment_Number=1),
        made("continuation", "<urn:x:2>", b"CD", WARC_Segment_Origin_ID="<urn:x:1>", WARC_Segment_Number=2).replace(b"Content-Length: 2", b"Content-Length: x"),
        made("continuation", "<urn:x:3>", b"EF", WARC_Segment_Origin_ID="<urn:x:1>", WARC_Segment_Number=3, WARC_Segment_Total_Length=25),
        made("response", "<urn:x:4>", HTTP + b"whole"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    got = {r.record_id: (r.payload and bytes(r.payload), r.digest_ok) for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got == {"<urn:x:1>": (None, False), "<urn:x:4>": (b"whole", None)}
