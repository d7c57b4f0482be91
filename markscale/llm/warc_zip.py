"""WARC records in ZIP packages: written by many tasks, read back by byte ranges.

A package is a ZIP file whose members are *stored*: ``archive/data.warc.gz`` (one gzip member per
record) and ``indexes/index.cdxj`` (one line per record with its offset and length). Because members
are stored, a record's bytes lie at ``member start + offset`` of the package, and reading it needs
the central directory, the index and that one range; nothing is unpacked.

A package of up to ``row_bytes`` is one row of Spark's binary scan, of which ranges are taken. A larger one is opened
where it lies: one task reads its directories and indexes and cuts its records into ranges of neighbours, and
the ranges are dealt over tasks, each of which seeks and reads its own. A package may so have any size, and many
tasks read it; a task holds one range, or one package's list of record places.

Packages are written through Spark's own text sink, one row per file, so that they reach any file
system that Spark reaches and a repeated task replaces its files. The line end that the sink adds is
the package's one-byte archive comment.

- A NULL payload is empty. A NULL url is written without a target and read back as NULL; line
  breaks in a url come back percent-encoded.
- Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the response
  and the others revisit it; rows that repeat that id are responses too. NULL ids rank below all others.
- An empty table gives packages without records, and no rows. A record longer than a range is a range of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes after which a package is closed; a larger payload has a package of its own.
PACKAGE_BYTES = 4 << 20
MIN_REVISIT_BYTES = 1000
#: Packages beyond ROW_BYTES are read by ranges of about RANGE_BYTES, TASK_BYTES of them by a task.
ROW_BYTES, RANGE_BYTES, TASK_BYTES = 64 << 20, 8 << 20, 128 << 20
#: Bytes of an index that are read at a time.
INDEX_BYTES = 1 << 20
SINK_END = b"\n"


class Layout:
    """A fixed record layout (a compiled ``struct`` cannot be shipped to tasks)."""

    def __init__(self, form: str):
        self.form, self.size = form, struct.calcsize(form)

    def unpack(self, data: bytes, at: int = 0) -> tuple:
        return struct.unpack_from(self.form, data, at)


# Fixed values of the ZIP format: signatures and record layouts (little-endian).
END = Layout("<4s4H2LH")
END64_LOCATOR = Layout("<4sLQL")
END64 = Layout("<4sQ2H2L4Q")
CENTRAL = Layout("<4s6H3L5H2L")
LOCAL = Layout("<4s5H3L2H")
END_SIGN, LOCATOR_SIGN, END64_SIGN = b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
CENTRAL_SIGN, LOCAL_SIGN = b"PK\x01\x02", b"PK\x03\x04"
ZIP64_EXTRA, FULL16, FULL32 = 1, 0xFFFF, 0xFFFFFFFF
STORED, ENCRYPTED_FLAG = 0, 1

ReadAt = Callable[[int, int], bytes]
Opener = Callable[[str], BinaryIO]

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """The bytes are not a package that this reader can serve."""


# Reading


def read_directory(read_at: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """Name to (start, length) of every stored member, from the central directory (ZIP64 included)."""
    tail_at = max(0, size - END.size - FULL16)
    tail = read_at(tail_at, size - tail_at)
    at = len(tail) - END.size
    while at >= 0:
        at = tail.rfind(END_SIGN, 0, at + len(END_SIGN))
        if at < 0:
            break
        if at + END.size + END.unpack(tail, at)[-1] == len(tail):  # the comment ends the file
            break
        at -= 1
    if at < 0:
        raise ArchiveError("no end of central directory")
    _, disk, first_disk, _, entries, length, start, _ = END.unpack(tail, at)
    end_at = tail_at + at
    locator = read_at(end_at - END64_LOCATOR.size, END64_LOCATOR.size) if end_at >= END64_LOCATOR.size else b""
    if locator[:4] == LOCATOR_SIGN:
        end64 = read_at(END64_LOCATOR.unpack(locator)[2], END64.size)
        if end64[:4] != END64_SIGN:
            raise ArchiveError("the ZIP64 locator points elsewhere")
        _, _, _, _, disk, first_disk, _, entries, length, start = END64.unpack(end64)
    elif FULL32 in (length, start) or entries == FULL16:
        raise ArchiveError("the ZIP64 directory is missing")
    if disk or first_disk:
        raise ArchiveError("the package spans several disks")
    directory = read_at(start, length)
    members: dict[str, tuple[int, int]] = {}
    at = 0
    for _ in range(entries):
        fields = CENTRAL.unpack(directory, at)
        if fields[0] != CENTRAL_SIGN:
            raise ArchiveError("a broken central directory")
        flags, method = fields[3], fields[4]
        packed, full, name_length, extra_length, comment_length, local = *fields[8:13], fields[16]
        name_at = at + CENTRAL.size
        name = directory[name_at : name_at + name_length].decode("utf-8", "replace")
        extra = directory[name_at + name_length : name_at + name_length + extra_length]
        full, packed, local = wide_values(extra, full, packed, local)
        if method == STORED and not flags & ENCRYPTED_FLAG:
            head = LOCAL.unpack(read_at(local, LOCAL.size))
            if head[0] != LOCAL_SIGN:
                raise ArchiveError(f"no local header of {name}")
            members[name] = (local + LOCAL.size + head[9] + head[10], full)
        at = name_at + name_length + extra_length + comment_length
    return members


def wide_values(extra: bytes, *values: int) -> tuple[int, ...]:
    """Those values that fill 32 bits, replaced by the ones of the ZIP64 extra field, in order."""
    wide: list[int] = []
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            wide = list(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
        at += 4 + length
    if sum(v == FULL32 for v in values) > len(wide):
        raise ArchiveError("a ZIP64 value is missing")
    return tuple(wide.pop(0) if v == FULL32 else v for v in values)


def read_index(read_at: ReadAt, members: dict[str, tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """Member, offset and length of each record, from the stored indexes."""
    for name in sorted(members):
        if not name.endswith(".cdxj"):
            continue
        for line in lines_at(read_at, *members[name]):
            if line.strip():
                entry = json.loads(line[line.index(b"{") :])
                yield f"archive/{entry['filename']}", int(entry["offset"]), int(entry["length"])


def lines_at(read_at: ReadAt, start: int, length: int) -> Iterator[bytes]:
    """The lines of a member, of which a piece is held at a time."""
    rest = b""
    for at in range(start, start + length, INDEX_BYTES):
        *lines, rest = (rest + read_at(at, min(INDEX_BYTES, start + length - at))).split(b"\n")
        yield from lines
    yield rest


def record_places(read_at: ReadAt, size: int) -> Iterator[tuple[int, int]]:
    """Start in the package and length of every record that the indexes name."""
    members = read_directory(read_at, size)
    for member, offset, length in read_index(read_at, members):
        if member not in members:
            raise ArchiveError(f"the index names {member}, which is not stored")
        start, whole = members[member]
        if offset < 0 or length < 0 or offset + length > whole:
            raise ArchiveError("a record reaches beyond its member")
        yield start + offset, length


def neighbours(places: Iterable[tuple[int, int]], limit: int) -> Iterator[tuple[int, list[int]]]:
    """Records that follow each other without a gap, as start and lengths; ``limit`` bytes or one record at most."""
    begin, end, lengths = 0, 0, []
    for start, length in sorted(places):
        if lengths and (start != end or start + length - begin > limit):
            yield begin, lengths
            lengths = []
        if not lengths:
            begin = start
        lengths.append(length)
        end = start + length
    if lengths:
        yield begin, lengths


def parse_record(data: bytes) -> dict:
    """One gzip member: headers and payload of a WARC record, its digest checked."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    payload = rest[: int(headers["Content-Length"])]
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ArchiveError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": page_of(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "record_type": headers["WARC-Type"],
        "refers_to": page_of(headers.get("WARC-Refers-To")),
        "payload_bytes": int(headers["X-Payload-Length"]),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def read_package(read_at: ReadAt, size: int) -> Iterator[dict]:
    for start, length in record_places(read_at, size):
        yield parse_record(read_at(start, length))


def open_seekable(path: str) -> BinaryIO:
    """The file at a path of Spark's, local or in any store that Arrow reaches, to seek in."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inside = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_file(inside)


def range_reader(handle: BinaryIO) -> tuple[ReadAt, int]:
    def read_at(at: int, length: int) -> bytes:
        handle.seek(at)
        return handle.read(length)

    return read_at, handle.seek(0, io.SEEK_END)


# Writing


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A WARC record as one gzip member; a revisit carries no payload of its own."""
    body = payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", page_urn(page_id)),
        *([] if url is None else [("WARC-Target-URI", one_line(url))]),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        *([] if refers_to is None else [("WARC-Refers-To", page_urn(refers_to))]),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def package_bytes(records: Iterable[tuple[str, bytes]]) -> bytes:
    """A package of (url, record bytes) pairs; its comment is the sink's line end, still to come."""
    out, index, data = io.BytesIO(), [], io.BytesIO()
    for url, record in records:
        entry = {"url": url, "filename": ARCHIVE.rpartition("/")[2], "offset": data.tell(), "length": len(record)}
        index.append(f"{one_line(url).split('://')[-1].replace(' ', '%20').replace('{', '%7B')} {json.dumps(entry)}\n")
        data.write(record)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        package.writestr(ARCHIVE, data.getvalue())
        package.writestr(INDEX, "".join(sorted(index)))
        package.comment = SINK_END
    return out.getvalue().removesuffix(SINK_END)


def with_revisits(df: DataFrame, page: str, payload: str, min_bytes: int) -> DataFrame:
    """The response that each row revisits, or NULL. Equal payloads are found by SHA-256 and length."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.withColumns({"__body": body, "__key": F.when(F.length(body) >= min_bytes, F.sha2(body, 256))})
    responses = (
        rows.where("__key is not null").groupBy("__key").agg(F.max(page).alias("__response"), F.count(F.lit(1)).alias("__n"))
    )
    # Pre-aggregated per task; a hot payload's rows meet one row here, and Spark splits such a join.
    joined = rows.join(responses.where("__n > 1").drop("__n"), "__key", "left")
    revisit = F.when(~F.col("__response").eqNullSafe(F.col(page)), F.col("__response"))
    return joined.select(F.col(page).alias("page_id"), "url", "__body", revisit.alias("refers_to"))


def write_packages(
    df: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES, package_size: int = PACKAGE_BYTES,
) -> None:
    """Write a record per row of ``df`` to packages under ``path``."""
    rows = with_revisits(
        df.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html")),
        "page_id", "html", min_bytes,
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pending: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for page_id, target, body, refers_to in zip(*(batch[c].array for c in batch.columns)):
                body = bytes(body)
                record = record_bytes(
                    None if pd.isna(page_id) else int(page_id), target, body, hashlib.sha1(body).digest(),
                    None if pd.isna(refers_to) else int(refers_to),
                )
                pending.append((target or "", record))
                size += len(body)
                if size >= package_size:
                    yield pd.DataFrame({"package": [package_bytes(pending)]})
                    pending, size = [], 0
        if pending:
            yield pd.DataFrame({"package": [package_bytes(pending)]})

    # Ids travel as text: pandas would make floats of a nullable number.
    texts = rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    packages = texts.mapInPandas(pack, "package binary").select(F.col("package").cast("string"))
    packages.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_packages(
    spark: SparkSession, path: str, columns: Iterable[str] | None = None, row_bytes: int = ROW_BYTES,
    range_bytes: int = RANGE_BYTES, open_file: Opener = open_seekable,
) -> DataFrame:
    """The records of all packages under ``path``; ``columns`` drops what is not needed early.

    Lists the packages when it is called. ``open_file`` opens those of more than ``row_bytes`` on the executors; pass
    your own for a store that Arrow does not reach.
    """
    kinds = dict(part.strip().split(" ") for part in RECORD.split(","))
    wanted = list(columns or kinds)
    schema = ", ".join(f"{c} {kinds[c]}" for c in wanted)

    def frame_of(rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=list(kinds))[wanted]
        for c in wanted:
            if kinds[c] == "long":
                frame[c] = frame[c].astype("Int64")
        return frame

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                view = memoryview(content)
                yield frame_of(list(read_package(lambda at, length: bytes(view[at : at + length]), len(view))))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package in batch["path"]:
                with open_file(package) as handle:
                    found = list(neighbours(record_places(*range_reader(handle)), range_bytes))
                for i in range(0, len(found), 1000):
                    part = found[i : i + 1000]
                    yield pd.DataFrame({"path": package, "start": [p[0] for p in part], "lengths": [p[1] for p in part]})

    def by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, start, lengths in zip(batch["path"], batch["start"], batch["lengths"]):
                with open_file(package) as handle:
                    data = range_reader(handle)[0](int(start), int(sum(lengths)))
                rows, at = [], 0
                for length in lengths:
                    rows.append(parse_record(data[at : at + length]))
                    at += length
                yield frame_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > row_bytes).select("path", "length")
    n_large, n_bytes = large.agg(F.count(F.lit(1)), F.sum("length")).first()
    records = files.where(F.col("length") <= row_bytes).select("content").mapInPandas(whole, schema)
    if not n_large:
        return records
    # Told numbers of tasks: what is shuffled here is small, what it stands for is not.
    packages = large.select("path").repartition(min(n_large, 10_000), "path")
    ranges = packages.mapInPandas(cut, "path string, start long, lengths array<long>")
    dealt = ranges.repartition(max(1, n_bytes // TASK_BYTES), "path", "start")
    return records.unionByName(dealt.mapInPandas(by_range, schema))
