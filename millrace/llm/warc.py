"""WARC archives: write pages as records, read archives back, put segmented records together again.

Writing: one HTTP response per page, its body in chunked transfer coding; a record longer than `segment_bytes` goes on in
continuation records.  Pages whose payload equals that of another are revisits of one response.  Spark's text writer
makes the files: a record is a row, and the line separator is the blank lines that end a record.

Reading: each file is streamed, decompressed and parsed record by record by Content-Length; continuation records are grouped by
the identifier of the record they continue, ordered by segment number and checked against the total length; then chunked
framing is decoded.  A broken record is told as such, and reading goes on at the next one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import by_key, narrowed, surely_without, written

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
#: Shorter payloads are never revisits.
LEAST_REVISIT = 1_000
RECORDS_A_FILE = 500
END = "\r\n\r\n"
PREFIX = "<urn:page:"
DATE = "2024-01-01T00:00:00Z"


def _whole(raw: bytes, at: int) -> int:
    """at, or the start of the character that `at` would cut."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _cut(raw: bytes, most: int) -> Iterator[bytes]:
    start = 0
    while start < len(raw):
        stop = _whole(raw, start + most)
        yield raw[start:stop]
        start = stop


def chunked(payload: bytes, most: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _cut(payload, most)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decode chunked transfer coding; chunk extensions and trailers are passed over.  Bad framing raises ValueError."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + n])
        at += n + 2


def record(headers: dict[str, object], block: bytes) -> str:
    """A record's text without the blank lines at its end."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def records(name: str, url: str | None, payload: bytes | int, digest: str, refers_to: str | None, segment_bytes: int = SEGMENT_BYTES) -> Iterator[str]:
    """The records of one page; a revisit's payload is only its length."""
    own = f"{PREFIX}{name}>"
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else None
    common = {"WARC-Date": DATE, "WARC-Target-URI": uri}
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Payload-Length: {payload}\r\n\r\n".encode()
        yield record({"WARC-Type": "revisit", "WARC-Record-ID": own, **common, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Refers-To": f"{PREFIX}{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type": "application/http;msgtype=response"}, block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(_cut(block, segment_bytes))
    for i, part in enumerate(parts, 1):
        first = {"WARC-Type": "response", "WARC-Record-ID": own, **common, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"{own[:-1]}/{i}>", **common, "WARC-Segment-Origin-ID": own}
        last = {"WARC-Segment-Total-Length": len(block)} if 1 < i == len(parts) else {}
        yield record({**(first if i == 1 else more), "WARC-Segment-Number": i if len(parts) > 1 else None, **last}, part)


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write pages (page_id, url, html) to WARC files under path.

    Of pages with equal payloads (UTF-8 of html; null: empty) of LEAST_REVISIT bytes or more, the one with the largest
    page_id is the response that all others revisit.  A row without page_id is a response under a name of its own, which
    no other revisits.  Repeated rows are written each; of rows with one page_id and payload none revisits the others.
    Extra columns are ignored.  An empty table gives an empty folder.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("unnamed-"), F.monotonically_increasing_id().cast("string")))).withColumn("key", F.concat_ws(":", "name", "sha"))
    keyed = rows.select("page_id", "key", "name", "url", "sha", F.octet_length("html").alias("n")).where(f"page_id IS NOT NULL AND n >= {LEAST_REVISIT}")
    largest = written(keyed.groupBy("sha", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1"), "largest")
    revisits = written(by_key(keyed, largest, ["sha", "n"], n="copies").where("page_id <> response").select("key", "name", "url", "sha", "n", F.col("response").cast("string").alias("response")), "revisits")
    # A revisit needs no payload; of the others, those that the bitmap can't tell from revisits are few, and they alone are shuffled.
    keys = revisits.select("key").distinct()
    unsure = narrowed(rows.where("page_id IS NOT NULL").select("key"), keys, "key").join(keys, "key", "left_anti").distinct()
    unsure = written(unsure, "unsure")
    responses = surely_without(rows, keys, "key").unionByName(narrowed(rows, unsure, "key").join(unsure, "key", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for name, url, html, sha, n, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(records(name, url, n if html is None else html.encode(), sha, response, segment_bytes))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    none = F.lit(None).cast("string")
    every = responses.select("name", "url", "html", "sha", F.lit(0).alias("n"), none.alias("response")).unionByName(revisits.select("name", "url", none.alias("html"), "sha", "n", "response"))
    lines = every.mapInArrow(run, "value string")
    lines.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(path)


#: Bytes that are read at once, and most bytes of a record's headers.
READ_BYTES, MOST_HEADERS = 1 << 20, 1 << 20
_START = re.compile(rb"(?:\r?\n)WARC/[0-9]")
_BLANK = re.compile(rb"\r?\n\r?\n")


def plain(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Bytes as they are, or what gzip members hold; a broken member ends in a blank line, and the next one goes on."""
    first = b""
    while len(first) < 2 and (piece := next(chunks, b"")):
        first += piece
    if first[:2] != b"\x1f\x8b":
        yield first
        yield from chunks
        return
    raw, d = first, zlib.decompressobj(31)
    while True:
        before = d.copy()
        try:
            out = d.decompress(raw, READ_BYTES)
        except zlib.error:
            yield from _upto_error(before, raw)
            yield b"\r\n\r\n"
            raw, d = raw[1:], zlib.decompressobj(31)
            while b"\x1f\x8b\x08" not in raw:
                more = next(chunks, b"")
                if not more:
                    return
                raw = raw[-2:] + more
            raw = raw[raw.index(b"\x1f\x8b\x08") :]
            continue
        if out:
            yield out
        if d.eof:
            raw, d = d.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
        else:
            raw = d.unconsumed_tail
        if not raw and len(out) < READ_BYTES:  # else more may be to come of what went in
            raw = next(chunks, b"")
            if not raw:
                return


def _upto_error(d, raw: bytes) -> Iterator[bytes]:
    """What a member gives before it breaks, but for the last few bytes."""
    try:
        while out := d.decompress(raw, 256):
            yield out
            raw = d.unconsumed_tail
    except zlib.error:
        return


class _Bytes:
    """What is at hand of a stream, and more on demand."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held, self.ended = chunks, bytearray(), False

    def upto(self, n: int) -> bool:
        """Hold n bytes, if there are so many."""
        while len(self.held) < n and not self.ended:
            more = next(self.chunks, None)
            if more is None:
                self.ended = True
            else:
                self.held += more
        return len(self.held) >= n

    def find(self, pattern: re.Pattern, start: int, most: int | None = None) -> re.Match | None:
        """The first match from start on, reading on for it, `most` bytes at most."""
        at = start
        while True:
            m = pattern.search(self.held, at)
            if m and (m.end() < len(self.held) or self.ended):
                return m
            if self.ended or most is not None and len(self.held) - start > most:
                return m
            at = max(start, len(self.held) - 16)
            self.upto(len(self.held) + 1)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers by lower-cased name, block) of each record of a file, given in pieces, plain or in gzip members.

    Lines may end in LF alone, and blank lines may stand between records.  The block is null, and reading goes on at the next
    record's start, where a length is missing or isn't that of the block, and where the file ends within it; what isn't a record
    at all comes without headers.
    """
    s = _Bytes(plain(chunks))
    while True:
        s.upto(16)
        blank = re.match(rb"(?:\r?\n)*", s.held).end()
        if blank:
            del s.held[:blank]
            continue
        if not s.held:
            return
        end = s.find(_BLANK, 0, MOST_HEADERS) if s.held[:5] == b"WARC/" else None
        if end is None:
            yield {}, None
            following = s.find(_START, 0)
            if not following:
                return
            del s.held[: following.start()]
            continue
        lines = bytes(s.held[: end.start()]).decode(errors="replace").splitlines()[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n, start = headers.get("content-length", ""), end.end()
        if n.isascii() and n.isdigit() and s.upto(start + int(n)):
            stop = start + int(n)
            s.upto(stop + 16)
            tail = re.match(rb"(?:\r?\n)*", s.held[stop : stop + 16]).end()
            lines_between = s.held[stop : stop + tail].count(b"\n")
            if lines_between > 1 or lines_between and s.held[stop + tail : stop + tail + 5] == b"WARC/" or len(s.held) == stop + tail and s.ended:
                yield headers, bytes(s.held[start:stop])
                del s.held[:stop]
                continue
        yield headers, None
        following = s.find(_START, start - 2)
        if not following:
            return
        del s.held[: following.start()]


RECORDS = "record_id string, type string, uri string, digest string, refers_to string, origin string, segment int, total long, block binary"
#: The type of what stands in an archive and is no record.
UNREADABLE = "unreadable"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path, as it stands there; a broken one has a null block.

    Files are streamed by the tasks, through pyarrow's file systems, so they may be of any size.  Of a store that only Spark can read
    each file comes as one row, of 2 GB at most.
    """
    fields = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    try:
        _opened(path)
        streamed = True
    except (pa.ArrowInvalid, OSError):
        streamed = False

    def pieces(x: pa.Scalar) -> Iterator[bytes]:
        if not streamed:
            yield x.as_py()
            return
        fs, name = _opened(x.as_py())
        with fs.open_input_stream(name, compression=None) as f:
            while piece := f.read(READ_BYTES):
                yield piece

    def number(x: str | None) -> int | None:
        return int(x) if x and x.isascii() and x.isdigit() and len(x) < 19 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["record_id", "type", "uri", "digest", "refers_to", "origin", "segment", "total", "block"])

        for batch in batches:
            for x in batch.column(0):
                rows, size = [], 0
                for h, block in parse(pieces(x)):
                    name, kind, *more = (h.get(f) for f in fields)
                    own, segment = h.get("warc-segment-origin-id", name), number(h.get("warc-segment-number")) or 0
                    if own is None:  # nothing to put its segments together by
                        segment = 0
                    rows.append((name, kind or UNREADABLE, *more, own, segment if segment < 1 << 31 else 0, number(h.get("warc-segment-total-length")), block))
                    size += len(block or b"")
                    if size >= 8 * READ_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return files.select("path" if streamed else "content").mapInArrow(run, RECORDS)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def reassemble(parts: DataFrame) -> DataFrame:
    """Whole records: segments in order of number, one after another; `whole` tells whether all are there and the length is right.

    Records without segments pass as they are, whole unless they are broken.  Repeated segments count once.  Only segmented records are shuffled.
    """
    single = parts.where("segment = 0").select("record_id", "type", "uri", "digest", "refers_to", "block", F.col("block").isNotNull().alias("whole"))
    split = parts.where("segment > 0 AND block IS NOT NULL").dropDuplicates(["origin", "segment"])
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    joined = split.groupBy("origin").agg(*(first(c) for c in ("type", "uri", "digest", "refers_to")), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("x"), F.max("total").alias("total"), F.max("segment").alias("n"))
    block = F.unhex(F.array_join(F.transform("x.block", F.hex), ""))  # one pass, however many segments
    whole = joined.withColumn("block", block).withColumn("whole", (F.size("x") == F.col("n")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False)))
    return single.unionByName(whole.select(F.col("origin").alias("record_id"), "type", "uri", "digest", "refers_to", "block", "whole"))


def page_of(name: str | None) -> int | None:
    """The page_id in a record's name, null for names that write() doesn't give."""
    tail = name[len(PREFIX) : -1] if name and name.startswith(PREFIX) else ""
    return int(tail) if tail.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, digest_ok.

    Archives may be others' than write()'s: record names are any text, and page_id and refers_to are then null.  Only
    response, resource and revisit records are pages, and what is no record (UNREADABLE); warcinfo, request, metadata and the like are passed over.  A
    resource's block is its payload.  A revisit's payload is null, its length (null if it isn't told) and digest are those
    it was written with.  A broken record, or one with missing segments or bad framing, has a null payload and digest_ok false;
    digest_ok is null where a record names no SHA-1 digest in hexadecimal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, kind, uri, digest, refers, block, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = block or b""
                end = _BLANK.search(block) if kind != "resource" else None
                head, body = (block[: end.start()], block[end.end() :]) if end else (b"", block) if kind == "resource" else (block, b"")
                http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.splitlines()[1:])}
                payload, n = None, None
                want = (digest or "").lower().removeprefix("sha1:")
                if kind == "revisit":
                    told = http.get(b"x-payload-length", b"")
                    n, ok = int(told) if told.isdigit() else None, whole
                else:
                    try:
                        payload = (unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body) if whole else None
                    except ValueError:
                        payload = None
                    own = hashlib.sha1(payload).hexdigest() if payload is not None else None
                    ok = False if own is None else own == want if len(want) == 40 else None
                    n, want = (len(payload), own) if payload is not None else (None, want)
                rows.append((name, page_of(name), uri, kind, page_of(refers), n, want, payload, ok))
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            names = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "digest_ok"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    whole = reassemble(read_records(spark, path)).where(f"type IN ('response', 'resource', 'revisit', '{UNREADABLE}')").select("record_id", "type", "uri", "digest", "refers_to", "block", "whole")
    return whole.mapInArrow(run, "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, digest_ok boolean")
