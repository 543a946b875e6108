import hashlib
import struct

import pytest
import zstandard

from meetpoint.llm import warc


def test_round_trip_of_bytes():
    records = [warc.build_record(i, f"http://x/{i}", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), None, "2026-01-01T00:00:00Z") for i in range(40)]
    archive = warc.archive_bytes(records)
    assert struct.unpack_from("<I", archive)[0] == 0x184D2A5D
    assert list(warc.iter_records(archive)) == records
    assert warc.parse_record(records[7])["payload"] == b"p" * 7
    raw = struct.pack("<II", warc.DICTIONARY_FRAME, 5) + b"abcde" + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"abcde")).compress(records[3])
    assert list(warc.iter_records(raw)) == [records[3]]  # a dictionary that is not compressed


@pytest.mark.parametrize(
    "broken",
    [
        lambda r: r[:-1], lambda r: r + b"x", lambda r: r.replace(b"WARC/1.1", b"WARC/0.9"), lambda r: r.replace(b"WARC-Date", b"WARC-Dote"),
        lambda r: r.replace(b"payload", b"paylaod"), lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "),
    ],
)
def test_broken_records_are_refused(broken):
    record = warc.build_record(1, "http://x", b"some payload", hashlib.sha256(b"some payload").hexdigest(), None, "2026-01-01T00:00:00Z")
    with pytest.raises(warc.WarcError):
        warc.parse_record(broken(record))


def test_broken_archives_are_refused():
    archive = warc.archive_bytes([b"x" * 100])
    for bad in (archive[:-2], b"", b"1234567890", archive[8:]):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.iter_records(bad))


def test_pages(spark):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a", big), (3, None, big), (9, "http://b\r\nX: y", big), (3, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and page in (5, 9)
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
