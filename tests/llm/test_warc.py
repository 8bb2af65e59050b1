import gzip
import hashlib
import io
import os
import zlib

import pytest

from spendaudit.llm.warc import inflate, normalise, read_index, read_records, record, split_records, write_archives
from tests.llm.conftest import prose


@pytest.fixture
def make_pages(spark):
    def make(*rows):
        return spark.createDataFrame([(i, f"http://x/{i}", h, 1) for i, h in rows], "page_id long, url string, html string, offset int")

    return make


def round_trip(pages, tmp_path, name="a"):
    whole, members = f"{tmp_path}/{name}-whole", f"file://{tmp_path}/{name}-members"
    names = normalise(write_archives(pages, whole), whole, members)
    return names, whole, members


def test_round_trip_and_revisits(make_pages, tmp_path):
    big, small = prose(1, 400), "small"
    rows = [(1, big), (2, big), (9, big), (3, small), (4, small), (5, None), (6, ""), (7, "é" * 600), (8, "é" * 499), (10, "é" * 499), (11, "x\r\n\r\nWARC/1.1\r\n")]
    names, _, members = round_trip(make_pages(*rows), tmp_path)
    found = {r.page_id: r for r in read_records(names, members).collect()}
    assert len(found) == len(rows)
    for i, html in rows:
        payload = (html or "").encode()
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
        assert r.html == ("" if i in (1, 2) else html or "") and r.url == f"http://x/{i}"
    index = read_index(names, members).collect()
    assert sorted((r.page_id, r.length) for r in index) == sorted((r.page_id, r.length) for r in found.values())


def test_every_record_is_a_member_of_its_own(make_pages, tmp_path):
    names, whole, members = round_trip(make_pages(*[(i, prose(i, 50)) for i in range(20)]), tmp_path)
    folder = members.removeprefix("file://")
    total = 0
    for name in os.listdir(folder):
        if name.endswith(".warc.gz"):
            one, many = (open(f"{f}/{name}", "rb").read() for f in (whole, folder))
            assert gzip.decompress(one) == gzip.decompress(many)
            first = zlib.decompressobj(31)
            first.decompress(one)
            assert not first.unused_data  # one stream before
            while many:
                member = zlib.decompressobj(31)
                assert len(list(split_records(iter([member.decompress(many)])))) == 1
                many = member.unused_data
                total += 1
    assert total == 20 and not [n for n in os.listdir(folder) if "partial" in n]


def test_normalising_again_and_removing_the_source(make_pages, tmp_path):
    pages = make_pages(*[(i, prose(i, 50)) for i in range(5)])
    whole, members = f"{tmp_path}/w", f"{tmp_path}/m"
    archives = write_archives(pages, whole)
    normalise(archives, whole, members, remove_source=True)
    assert os.listdir(whole) == []
    names = normalise(archives, whole, members, remove_source=True)  # the sources are gone, the results are whole
    assert read_records(names, members).count() == 5


def test_odd_rows(make_pages, tmp_path):
    big = prose(3, 400)
    rows = [(None, big), (1, big), (1, big), (2, big), (2, "other"), (None, None)]
    names, _, members = round_trip(make_pages(*rows), tmp_path)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in read_records(names, members).collect())
    assert got == [(-1, "response", -1)] * 2 + [(1, "revisit", 2)] * 2 + [(2, "response", -1)] * 2
    names, _, members = round_trip(make_pages(), tmp_path, "b")
    assert read_records(names, members).collect() == []


def test_streams_in_small_pieces(monkeypatch):
    from spendaudit.llm import warc

    monkeypatch.setattr(warc, "PIECE", 7)
    records = [record(i, "u", os.urandom(300 * i), "d", None) for i in range(6)]
    members = gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:]))
    assert [w for _, _, w in split_records(inflate(io.BytesIO(members)))] == records
    with pytest.raises(ValueError):
        list(split_records(inflate(io.BytesIO(members[:-30]))))
