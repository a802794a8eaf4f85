import hashlib
import io
import zipfile

import pytest

from ewpanel.llm.common import filesystem, new_path
from ewpanel.llm.warc_archive import ARCHIVE, Package, archive_pages, parse_record, read_packages


def test_round_trip_of_odd_pages(spark):
    big, other = "<p>é" * 500, "x" * 999
    rows = [(1, "http://a b", big), (9, "u", big), (4, None, big), (None, "n", big), (5, "u", other), (6, "u", other), (7, "u", None), (8, "u", ""), (9, "u", big), (2, "u", "a\r\n\r\nb" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = new_path(spark, "warc")
    got = read_packages(archive_pages(pages, folder), slice_records=2).collect()
    assert len(got) == len(rows)
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    assert sorted((str(r.id), r.payload_bytes, r.digest) for r in got) == sorted((str(i), len((h or "").encode()), sha(h)) for i, _, h in rows)
    copies = [r for r in got if r.digest == sha(big)]
    assert sorted(r.kind for r in copies) == ["response"] + ["revisit"] * 4
    assert [r.id for r in copies if r.kind == "response"] == [9] and {r.refers_to for r in copies if r.kind == "revisit"} == {9}
    assert all(r.kind == "response" and r.refers_to is None for r in got if r.digest != sha(big))
    assert {bytes(r.payload).decode() for r in got if r.kind == "response"} == {h or "" for _, _, h in rows}
    assert read_packages(archive_pages(pages.limit(0), new_path(spark, "warc"))).count() == 0
    path = sorted(archive_pages(pages, new_path(spark, "warc")).collect())[0].path
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:  # another reader agrees
        assert z.testzip() is None and ARCHIVE in z.namelist()


@pytest.mark.parametrize("wide", [False, True])
def test_package_directories(wide, monkeypatch):
    if wide:  # directory and offsets in their ZIP64 form
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            z.writestr(f"m{i}", bytes([i]) * 100)
        z.comment = b"a comment"
    with zipfile.ZipFile(buffer, "a", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"x" * 1000)
    data = buffer.getvalue()
    package = Package(buffer, len(data))
    assert list(package.members) == ["m0", "m1", "m2", "m3", "m4", "packed"]
    assert package.range("m3", 10, 20) == b"\x03" * 20
    with pytest.raises(ValueError):
        package.range("m3", 90, 20)
    with pytest.raises(ValueError):
        package.stored("packed")
    with pytest.raises(ValueError):
        Package(io.BytesIO(b"no zip" * 10), 60)
    with pytest.raises(ValueError):
        parse_record(b"nothing")
