import hashlib
import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from markscale.llm import warc_zip
from markscale.llm.warc_zip import ArchiveError, package_bytes, read_directory, read_package, read_packages, record_bytes, write_packages


def reader(data):
    return (lambda at, length: data[at : at + length]), len(data)


def package(count=3):
    records = [(f"http://x/{i}", record_bytes(i, f"http://x/{i}", b"p" * i, hashlib.sha1(b"p" * i).digest(), None)) for i in range(count)]
    return package_bytes(records) + b"\n"


def to_zip64(data):
    """The same package with a ZIP64 end record and 64-bit sizes and offsets in its directory."""
    at = data.rindex(b"PK\x05\x06")
    entries, length, start = struct.unpack_from("<HLL", data, at + 10)
    directory, wide, spot = data[start : start + length], b"", 0
    for _ in range(entries):
        packed, full, name, extra, comment = struct.unpack_from("<LLHHH", directory, spot + 20)
        (local,) = struct.unpack_from("<L", directory, spot + 42)
        end = spot + 46 + name
        field = struct.pack("<HHQQQ", 1, 24, full, packed, local)
        head = bytearray(directory[spot:end])
        struct.pack_into("<LLHH", head, 20, 0xFFFFFFFF, 0xFFFFFFFF, name, extra + len(field))
        struct.pack_into("<L", head, 42, 0xFFFFFFFF)
        wide += bytes(head) + directory[end : end + extra] + field + directory[end + extra : end + extra + comment]
        spot = end + extra + comment
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, len(wide), start)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(wide), 1)
    end = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 1)
    return data[:start] + wide + end64 + locator + end + b"\n"


@pytest.mark.parametrize("form", [lambda d: d, to_zip64])
def test_package_round_trip(form):
    data = form(package(5))
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None  # an ordinary package to others too
    got = list(read_package(*reader(data)))
    assert sorted((r["page_id"], r["payload"]) for r in got) == [(i, b"p" * i) for i in range(5)]


def test_only_needed_ranges_are_read():
    data, asked = package(200), []

    def read_at(at, length):
        asked.append(length)
        return data[at : at + length]

    members = read_directory(read_at, len(data))
    spots = list(warc_zip.read_index(read_at, members))
    before = sum(asked)
    warc_zip.parse_record(read_at(members[spots[7][0]][0] + spots[7][1], spots[7][2]))
    assert sum(asked) - before < len(data) / 50


def test_neighbours_are_read_together():
    found = warc_zip.neighbours([(30, 5), (0, 10), (10, 10), (35, 0), (35, 50), (85, 1), (90, 2)], 20)
    assert list(found) == [(0, [10, 10]), (30, [5, 0]), (35, [50]), (85, [1]), (90, [2])]
    assert list(warc_zip.neighbours([], 20)) == []


def test_index_lines_cross_pieces(monkeypatch):
    data = package(40)
    whole = list(warc_zip.read_index(reader(data)[0], read_directory(*reader(data))))
    monkeypatch.setattr(warc_zip, "INDEX_BYTES", 7)
    assert list(warc_zip.read_index(reader(data)[0], read_directory(*reader(data)))) == whole and len(whole) == 40


def test_an_index_that_names_no_member_is_refused():
    data = package().replace(b'"data.warc.gz"', b'"dado.warc.gz"')
    with pytest.raises(ArchiveError):
        list(read_package(*reader(data)))


def test_broken_packages_are_refused():
    data = package()
    for bad in (b"", b"not a package", data[:-30], data.replace(b"PK\x01\x02", b"PK\x09\x09", 1)):
        with pytest.raises(ArchiveError):
            list(read_package(*reader(bad)))
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 100)
    assert read_directory(*reader(squeezed.getvalue())) == {}  # packed members cannot be range-read


def test_pages_round_trip(spark, tmp_path):
    long, same = "ä" * 3_000_000, "s" * 1500
    pages = [
        (1, "http://a", same), (2, "http://b", same), (3, None, same), (3, None, same), (4, "http://c", None), (5, "x\ny", ""),
        (6, "u", "short"), (7, "u", "short"), (None, "n", same), (8, "l", long), (9, None, "é{ "),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit(2))
    write_packages(df, str(tmp_path / "w"), package_size=4000)
    want = []
    for page, url, html in pages:
        body = (html or "").encode()
        revisit = html == same and page != 3
        want.append((page, None if url is None else url.replace("\n", "%0A"), "revisit" if revisit else "response", 3 if revisit else None,
                     len(body), hashlib.sha1(body).hexdigest(), None if revisit else body))
    for limit in (warc_zip.ROW_BYTES, 3000, 0):  # as rows, as rows and by ranges, by ranges only
        got = read_packages(spark, str(tmp_path / "w"), row_bytes=limit, range_bytes=500).collect()
        assert sorted(map(repr, ([*r[:6], None if r[6] is None else bytes(r[6])] for r in got))) == sorted(map(repr, map(list, want)))


def test_large_packages_are_never_read_whole(spark, tmp_path):
    """Every read of a package of 0.7 MB is of 70 KB at most; the ranges are dealt over tasks."""
    rng = random.Random(2)
    folder = tmp_path / "a folder %20 of packages"
    folder.mkdir()
    payloads = {i: rng.randbytes(rng.choice([0, 100, 5_000, 60_000])) for i in range(60)}
    records = [(f"http://x/{i}", record_bytes(i, f"http://x/{i}", p, hashlib.sha1(p).digest(), None)) for i, p in payloads.items()]
    (folder / "one.zip").write_bytes(to_zip64(package_bytes(records) + b"\n"))
    assert (folder / "one.zip").stat().st_size > 600_000

    def guarded(path):
        handle = warc_zip.open_seekable(path)

        class Guarded:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                handle.close()

            def seek(self, *spot):
                return handle.seek(*spot)

            def read(self, length):
                if length > 70_000:
                    raise MemoryError(length)
                return handle.read(length)

        return Guarded()

    got = read_packages(spark, str(folder), row_bytes=0, range_bytes=50_000, open_file=guarded)
    assert {r.page_id: bytes(r.payload) for r in got.collect()} == payloads
    assert read_packages(spark, str(folder), ["page_id"], row_bytes=0).count() == 60


def test_no_pages(spark, tmp_path):
    write_packages(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert read_packages(spark, str(tmp_path / "w")).count() == 0
