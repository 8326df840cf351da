"""WARC archives with a two-level capture index.

Writing: each archive starts with a warcinfo record; each page becomes one WARC/1.1 record (WARC-Date is a parameter, the
tables have no time of capture; record ids are UUIDs of archive and offset; the page's number stands in a field of its own,
X-Page-ID), a gzip member of its own; tasks append records to archives of about
``ARCHIVE`` bytes in a shared folder. An archive has a name of its own for each task attempt and counts only if the
attempt's result arrives, so a lost executor leaves at most an archive that nobody reads. Pages whose payloads are equal
(by SHA-1, at least ``least`` bytes) are written once: that with the smallest page_id as response, others as revisit.

Index: capture lines are sorted by reversed-host URL key (then page_id), dealt into ranges of about ``RANGE`` lines, and
packed into compressed blocks of ``BLOCK`` lines. The first key of each block is the sparse directory of a range, the
first key of each range the directory above it (one entry for ``RANGE`` lines: 100 MB for some 10**11 captures).

Lookup: a URL is placed by binary search in the upper directory, then in the sparse directory, then within one
decompressed block; the record is read by a range read of the archive at the line's offset.

Defined results: null html is an empty payload; a null url has an empty key; a null page_id sorts last and never is the
response of a page that has one; rows with the same page_id and payload are written as often as they occur. Line ends in
a URL are percent-encoded in headers. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._words import small_batches

ARCHIVE, BLOCK, RANGE = 32 << 20, 512, 32_768
#: Groups of equal payloads are broadcast up to this number and these bytes of URLs; beyond, they are joined by a shuffle.
BROADCAST_GROUPS, BROADCAST_URLS = 50_000, 16 << 20
SALTS = 64
#: WARC-Date of all records, and the target of a page without a URL.
DATE, NO_URL = "2024-01-01T00:00:00Z", "about:blank"
NO_ID = (1 << 63) - 1


def url_key(url: str | None) -> str:
    """Reversed-host sort key: ``http://www.a.org:80/x?y`` gives ``org,a,www:80)/x?y``; anything else sorts as it is."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return (url or "").strip()
    return ",".join(reversed(m[1].lower().rstrip(".").split("."))) + (m[2] or "") + ")" + (m[3] or "/")


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 SHA-1, from groups of 20 bits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(kind: str, name: str, at: int, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{at}')}>"), ("WARC-Date", date)]
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in [*first, *fields, ("Content-Length", str(len(block)))])])
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def info_record(name: str, date: str) -> bytes:
    fields = [("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _member(
        "warcinfo", name, 0, date, fields,
        b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    )


def record(
    name: str, at: int, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int, str | None] | None
) -> bytes:
    """The record of a page at an offset of an archive; ``first``: page_id and url of the response that it revisits."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Target-URI", _header(url or "") or NO_URL), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id))
    ]
    if first is None:
        body += payload
    else:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", _header(first[1] or "") or NO_URL),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-ID", str(first[0])),
        ]
    fields += [
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response")
    ]
    return _member("response" if first is None else "revisit", name, at, date, fields, body)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and the payload's full length (also of a revisit, from its HTTP header)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, int(re.search(rb"Content-Length: (\d+)", http)[1])


def _write(root: str, most: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _store(root)
        out, name, at = None, "", 0
        for batch in small_batches(batches, "html"):
            rows = []
            for page_id, url, html, digest, first, first_url in zip(
                *(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "first_url")), strict=True
            ):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    data = info_record(name, date)
                    out.write(data)
                    at = len(data)
                again = first is not None and first != page_id
                data = record(name, at, date, page_id, url, (html or "").encode(), digest, (first, first_url) if again else None)
                out.write(data)
                rows.append((_header(url_key(url)), page_id, name, at, len(data)))
                at += len(data)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, root: str, least: int = 0, archive: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Writes the records of pages (page_id, url, html) below ``root``; gives a lazy table (key, page_id, file, offset,
    length) whose one evaluation writes them. Keep its result: a second evaluation writes a second set of archives."""
    scratch = Scratch(pages.sparkSession, "warc-groups")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    rows = rows.withColumn("digest", sha1_base32(F.col("html")))
    # Of equal page_ids the least url counts.
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("x")
    groups = rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("g")).agg(first, F.count(F.lit(1)).alias("c"))
    groups = groups.where("c > 1 and x is not null").select("g", F.col("x.page_id").alias("first"), F.col("x.url").alias("first_url"))
    groups = scratch.keep(groups, "groups")
    n, size = groups.agg(F.count(F.lit(1)), F.sum(F.octet_length("first_url"))).first()
    if n <= BROADCAST_GROUPS and (size or 0) <= BROADCAST_URLS:
        rows = rows.join(F.broadcast(groups), rows.digest == groups.g, "left").select("page_id", "url", "html", "digest", "first", "first_url")
    else:
        # Narrow rows meet the groups first; html then moves by its page, so a common payload is no one task's work.
        known = rows.select("page_id", "digest").where("page_id is not null").distinct().join(groups, F.col("digest") == F.col("g")).select(
            F.col("page_id").alias("i"), F.col("digest").alias("d"), "first", "first_url"
        )
        known = scratch.keep(known, "known")
        with_id = rows.where("page_id is not null").join(
            known, (F.col("page_id") == F.col("i")) & (F.col("digest") == F.col("d")), "left"
        ).drop("i", "d")
        without = rows.where("page_id is null").withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        without = without.join(salted, (without.digest == salted.g) & (without.salt == salted.salt), "left").select(*with_id.columns)
        rows = with_id.unionByName(without)
    files, base = _store(root)
    files.create_dir(base, recursive=True)
    return rows.mapInArrow(_write(root, archive, date), "key string, page_id long, file string, offset long, length long")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines to compressed blocks; a block never holds lines of two ranges."""
    held, current, number = [], None, 0

    def block():
        lines = "\n".join(f"{k}\t{i}\t{f}\t{o}\t{n}" for k, i, f, o, n in held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([current], pa.int32()), pa.array([number], pa.int32()), pa.array([held[0][0]]),
                pa.array([held[0][1]], pa.int64()), pa.array([zlib.compress(lines.encode(), 6)], pa.binary())
            ],
            ["range", "block", "first_key", "first_id", "data"]
        )

    for batch in batches:
        for part, *line in zip(*(batch.column(c).to_pylist() for c in ("range", "key", "id", "file", "offset", "length")), strict=True):
            if held and (part != current or len(held) == BLOCK):
                yield block()
                number, held = (number + 1 if part == current else 0), []
            current = part
            held.append(line)
    if held:
        yield block()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_header(url_key(u)) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("id")], ["key", "id"])


class CaptureIndex:
    """The two-level index of the captures in ``lines`` (a kept table of ``write_archives``)."""

    def __init__(self, lines: DataFrame, root: str, range_lines: int = RANGE):
        self.root, scratch = root, Scratch(lines.sparkSession, "warc-index")
        n, self.files = lines.agg(F.count(F.lit(1)), F.greatest(F.count_distinct("file"), F.lit(1))).first()
        self.ranges = max(1, -(-n // range_lines))
        # An empty string and a missing id have places of their own: first and last.
        dealt = lines.withColumn("id", F.coalesce("page_id", F.lit(NO_ID))).repartitionByRange(self.ranges, "key", "id").withColumn("range", F.spark_partition_id()).sortWithinPartitions(
            "key", "id", "file", "offset"
        )
        self.blocks = scratch.keep(
            dealt.select("range", "key", "id", "file", "offset", "length").mapInArrow(
                _pack, "range int, block int, first_key string, first_id long, data binary"
            ),
            "blocks"
        )
        tops = self.blocks.where("block = 0").select("range", "first_key", "first_id").collect()  # one row for RANGE lines
        self.upper = sorted((r.first_key, r.first_id, r.range) for r in tops)

    def place(self, queries: DataFrame) -> DataFrame:
        """Adds the range of each query (key, id) by binary search in the upper directory."""
        firsts, ranges = [x[:2] for x in self.upper], [x[2] for x in self.upper]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), strict=True)
                found = [ranges[max(0, bisect_right(firsts, x) - 1)] for x in asked] if firsts else [0] * batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("id"), batch.column("n"), pa.array(found, pa.int32())], ["key", "id", "n", "range"]
                )

        return queries.mapInArrow(run, "key string, id long, n long, range int")

    def locate(self, urls: DataFrame) -> DataFrame:
        """Captures of the pages (page_id, url): (id, file, offset, length), one row for each capture of that url and id."""
        asked = urls.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"))
        asked = asked.mapInArrow(_keys, "key string, id long").groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))

        def find(queries: pa.Table, blocks: pa.Table) -> pa.Table:
            directory = sorted(
                zip(blocks.column("first_key").to_pylist(), blocks.column("first_id").to_pylist(), range(blocks.num_rows), strict=True)
            )
            firsts, data, opened, out = [x[:2] for x in directory], blocks.column("data"), {}, []
            for key, page in sorted(zip(queries.column("key").to_pylist(), queries.column("id").to_pylist(), strict=True)):
                at = max(0, bisect_right(firsts, (key, page)) - 1)
                while at > 0 and firsts[at] == (key, page):  # captures of one url and id may start in an earlier block
                    at -= 1
                while at < len(firsts) and firsts[at] <= (key, page):
                    if at not in opened:
                        if len(opened) > 4:
                            opened.clear()
                        lines = [x.split("\t") for x in zlib.decompress(data[directory[at][2]].as_py()).decode().split("\n")]
                        opened[at] = ([(x[0], int(x[1])) for x in lines], lines)
                    keys, lines = opened[at]
                    for x in lines[bisect_left(keys, (key, page)) : bisect_right(keys, (key, page))]:
                        out.append((page, x[2], int(x[3]), int(x[4])))
                    at += 1
            return pa.table(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["id", "file", "offset", "length"]
            )

        return self.place(asked).groupBy("range").cogroup(self.blocks.groupBy("range")).applyInArrow(
            find, "id long, file string, offset long, length long"
        )

    def fetch(self, captures: DataFrame) -> DataFrame:
        """Range reads of (file, offset, length): page_id, url, record_type, refers_to, payload_digest, payload_bytes and
        payload (null for a revisit). A digest that does not fit its payload raises an error."""
        root = self.root

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = _store(root)
            name, source = None, None
            for batch in batches:
                rows, size = [], 0
                for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, files.open_input_file(f"{base}/{file}")
                    fields, payload, n = parse_record(source.read_at(length, offset))
                    page, url, kind, digest = (fields[k] for k in ("X-Page-ID", "WARC-Target-URI", "WARC-Type", "WARC-Payload-Digest"))
                    first, digest = fields.get("X-Refers-To-Page-ID", ""), digest[5:]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{file} at {offset}: the payload does not fit its digest")
                    said = payload.decode() if kind == "response" else None
                    rows.append((int(page) if page else None, "" if url == NO_URL else url, kind, int(first) if first else None, digest, n, said))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                yield _records(rows)
            if source is not None:
                source.close()

        asked = captures.select("file", "offset", "length").repartition(self.files, "file").sortWithinPartitions("file", "offset")
        return asked.mapInArrow(
            read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"
        )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
        ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    )


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, builds the index, finds every page through it and reads its record back."""
    scratch = Scratch(pages.sparkSession, "warc")
    root = scratch.path("archives")
    lines = scratch.keep(write_archives(pages, root, least), "lines")
    index = CaptureIndex(lines, root)
    return index.fetch(index.locate(pages))
