"""WARC records in ZIP packages: a writer, and a reader that fetches records by byte ranges.

A package is a ZIP file with two stored members: archive/data.warc.gz (one gzip member for each
record) and indexes/index.cdxj (one line for each record: key, offset, length).  The reader parses
the end-of-directory records (ZIP64 too) and the central directory, computes where stored members
lie, reads the index, and then reads records by ranges; nothing is extracted.

Defined cases: a null html is an empty payload; of equal payloads of at least REVISIT_BYTES the
largest page_id's record is the response and the others are revisits of it (rows that share that
page_id are all responses; without any page_id all are); a null page_id or URL is kept as null;
an empty table gives no package and an empty result; other columns of the input are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, written

#: Payloads from this size are written once.
REVISIT_BYTES = 1000
#: Bytes of records after which a package is closed; bytes of one range read.
PACKAGE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
#: Reading tasks at most; beyond, a task reads several packages one after the other.
MOST_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
DATA_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

#: ZIP signatures and the largest numbers of the older format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MOST16, MOST32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------------


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> list[bytes]:
    """Chunks of a ZIP file of stored members; zip64: sizes and offsets in the larger records."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, n, crc = name.encode(), len(data), zlib.crc32(data)
        big = zip64 or n >= MOST32 or at >= MOST32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if big else b""
        small = MOST32 if big else n
        out += [struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)), raw, extra, data]
        extra2 = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45 if big else 20, 45 if big else 20, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra2), 0, 0, 0, 0, MOST32 if big else at) + raw + extra2)
        at += 30 + len(raw) + len(extra) + n
    directory = b"".join(central)
    out.append(directory)
    n, big = len(members), zip64 or at >= MOST32 or len(members) >= MOST16
    if big:
        out.append(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(directory), at))
        out.append(struct.pack("<IIQI", LOCATOR, 0, at + len(directory), 1))
    out.append(struct.pack("<IHHHHIIH", END, 0, 0, MOST16 if big else n, MOST16 if big else n, MOST32 if big else len(directory), MOST32 if big else at, 0))
    return out


def zip_members(read, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of the stored members; read(offset, length) -> bytes."""
    tail_at = max(0, size - 22 - MOST16 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(struct.pack("<I", END), 0, end)  # the comment may hold the signature
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
    if MOST16 == count or MOST32 in (length, start):
        sig, _, at64, _ = struct.unpack("<IIQI", read(tail_at + end - 20, 20))
        if sig == LOCATOR:
            sig, _, _, _, _, _, _, count, length, start = struct.unpack("<IQHHIIQQQQ", read(at64, 56))
            if sig != END64:
                raise ValueError("no ZIP64 end of directory where its locator points")
    directory, out, p = read(start, length), {}, 0
    for _ in range(count):
        sig, _, _, _, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, at = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if sig != CENTRAL:
            raise ValueError("broken ZIP directory")
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # only the numbers that don't fit are there, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = values.pop(0) if plain == MOST32 else plain
                packed = values.pop(0) if packed == MOST32 else packed
                at = values.pop(0) if at == MOST32 else at
            q += 4 + n
        p += 46 + n_name + n_extra + n_note
        if method == 0:
            n_name, n_extra = struct.unpack("<HH", read(at + 26, 4))  # the local header has its own extra field
            out[name] = (at + 30 + n_name + n_extra, packed)
    return out


# --- WARC --------------------------------------------------------------------------------------


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit (refers_to is not None) carries the HTTP header only."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{b32}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page", json.dumps([page_id, url, refers_to])),
    ]
    if url is not None and "\n" not in url and "\r" not in url:
        head.append(("WARC-Target-URI", url))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """RECORD's values of one record; a response's payload is checked against its digest."""
    stop = raw.index(b"\r\n\r\n")
    lines = raw[:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[stop + 4 : stop + 4 + int(head["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:])
    page_id, url, refers_to = json.loads(head["X-Page"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, payload = int(http["Content-Length"]), None
    if head["WARC-Type"] == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {page_id}: the payload doesn't match its digest")
    return page_id, size, digest, head["WARC-Type"], refers_to, url, payload


# --- Spark -------------------------------------------------------------------------------------


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body).alias("digest"))
    large = F.octet_length("html") >= REVISIT_BYTES
    # only payloads that occur twice reach the join: of others nothing refers to anything
    twice = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    twice = written(twice.select(F.col("digest").alias("_same"), "last", "n"), "warc-twice")
    # pages of twice's rows are no more than all pages: a key is hot by its share of them
    total = twice.agg(F.sum("n")).first()[0] or 0
    out = joined(rows.withColumn("_same", F.when(large, F.col("digest")).otherwise(F.concat_ws(":", F.lit("small"), "digest", F.xxhash64("page_id", "url")))), twice, "_same", "n", total)
    return out.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = False, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ZIP packages to `folder` (a URI that all executors share); returns their paths (run by the action).

    A package appears under its name when it is whole; a repeated task writes it anew under another name, and
    only the paths of tasks that succeeded are returned.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        records, index, at = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal records, index, at
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            index.sort()
            lines = "".join(f"{key} {json.dumps({'offset': o, 'length': n})}\n" for key, o, n in index)
            chunks = zip_bytes([(DATA_NAME, b"".join(records)), (INDEX_NAME, lines.encode())], zip64)
            with fs.open_output_stream(path + ".part") as f:
                for c in chunks:
                    f.write(c)
            fs.move(path + ".part", path)
            out = pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([len(records)], pa.int64())], ["package", "n_records"])
            records, index, at = [], [], 0
            return out

        for batch in batches:
            for row in batch.to_pylist():
                raw = gzip.compress(warc_record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"]), 3, mtime=0)
                index.append((f"{row['page_id'] if row['page_id'] is not None else '-'}", at, len(raw)))
                records.append(raw)
                at += len(raw)
                if at >= package_bytes:
                    yield close()
        if records:
            yield close()

    return planned(pages, page_id, url, html).mapInArrow(step, "package string, n_records long")


def _opened(fs, path: str):
    """read(offset, length) and the size of a file."""
    f = fs.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read, f.size()


def read(packages: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD's columns of all records in the packages; packages: column `package`, names below `folder`."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("package").to_pylist():
                fetch, size = _opened(fs, f"{root}/{name}")
                members = zip_members(fetch, size)
                (start, _), (at, n) = members[DATA_NAME], members[INDEX_NAME]
                places = sorted((x["offset"], x["length"]) for line in fetch(at, n).decode().splitlines() for x in [json.loads(line.split(" ", 1)[1])])
                k = 0
                while k < len(places):
                    # one range read covers neighbouring records up to RANGE_BYTES
                    first, stop = places[k][0], k
                    while stop < len(places) and (stop == k or places[stop][0] + places[stop][1] - first <= RANGE_BYTES):
                        stop += 1
                    raw = fetch(start + first, places[stop - 1][0] + places[stop - 1][1] - first)
                    rows = [parse_record(gzip.decompress(raw[o - first : o - first + m])) for o, m in places[k:stop]]
                    k = stop
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                    cols = [pa.array([r[i] if payloads or i < 6 else None for r in rows], t) for i, t in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(cols, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return packages.select("package").mapInArrow(step, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write packages, then read all their records back (without payloads)."""
    packages = written(write(pages, folder, **options), "warc-packages")
    # a package's bytes are bounded, so tasks are dealt packages, not bytes
    tasks = min(max(1, packages.count()), MOST_TASKS)
    return read(packages.repartitionByRange(tasks, "package"), folder, payloads=False)
