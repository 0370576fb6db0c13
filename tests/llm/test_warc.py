import hashlib
import random

import pyarrow.fs as files
import pytest
import zstandard

from plumbline.llm import warc
from plumbline.llm.scratch import Scratch

PAGES = "page_id long, url string, html string"


def pages(rng):
    same, shared = "x" * 300, "é" * 60
    rows = [(i, f"https://example.org/{i}", "<p>" + "".join(rng.choice("abc \r\n") for _ in range(rng.randrange(0, 900))) + "</p>") for i in range(80)]
    rows += [(100 + i, "https://example.org/same", same) for i in (3, 1, 2)] + [(200, None, None), (201, "", ""), (202, "a b\r\nWARC-Type: x", "short"), (203, "u", "short")]
    rows += [(None, "n", same), (150, "s", shared), (151, "s", shared), (150, "s", shared), (90, "big", "z" * 400_000), (91, "crlf", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20)]
    return rows


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in data:
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in data:
        revisit = i is not None and len(b) >= 100 and i > first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_round_trip(spark):
    rows = pages(random.Random(1))
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "url as bundle", "page_id as frame", "html as payload", "page_id as id")
    assert found(warc.archived(spark, df)) == expected(rows)


def test_empty_table(spark):
    assert warc.archived(spark, spark.createDataFrame([], PAGES)).collect() == []


@pytest.fixture
def index(spark):
    scratch = Scratch(spark, "test-warc")
    rows = pages(random.Random(2))
    made = warc.write_bundles(warc.decided(spark.createDataFrame(rows, PAGES).repartition(3), scratch), f"{scratch.at}/bundles", frame_bytes=2000, bundle_bytes=4000)
    return scratch.keep(made, "index"), rows


def test_bundles_are_seekable(spark, index):
    index, rows = index
    listed = index.select("bundle").distinct().collect()
    assert len(listed) > 3
    for (uri,) in listed:
        fs, path = files.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as file:
            table = warc.seek_table(file)
            file.seek(0)
            data = file.read()
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # the seek table is a frame that readers pass over
        assert len(whole) == sum(raw for _, _, raw, _ in table) and whole.startswith(b"WARC/1.1\r\n")
        starts = {i: sum(raw for _, _, raw, _ in table[:i]) for i in range(len(table))}
        for r in index.where(index.bundle == uri).collect():
            record = whole[starts[r.frame] + r.offset :][: r.length]
            assert record.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: <{r.record_id}>".encode() in record and record.endswith(b"\r\n\r\n")
            assert r.offset + r.length <= table[r.frame][2]
    assert index.count() == len(rows)


def test_fetch_reads_records_by_their_ids(spark, index):
    index, rows = index
    asked = spark.createDataFrame([(f"urn:page:{i}",) for i in (5, 90, 102, 17, 5, 999)], "record_id string")
    got = {r.record_id: r for r in warc.fetch(index, asked).collect()}
    html = {i: h for i, _, h in rows}
    assert set(got) == {f"urn:page:{i}" for i in (5, 90, 102, 17)}
    assert all(bytes(got[f"urn:page:{i}"].payload).decode() == html[i] for i in (5, 90, 17))
    assert got["urn:page:102"].refers_to == "urn:page:101" and got["urn:page:102"].payload is None and got["urn:page:102"].payload_bytes == 300


def test_payloads_come_back_whole(spark, index):
    index, rows = index
    got = {r.record_id: r for r in warc.read_bundles(index.select("bundle").distinct()).collect()}
    for i, url, h in rows:
        if i is not None and got[f"urn:page:{i}"].record_type == "response":
            assert bytes(got[f"urn:page:{i}"].payload) == (h or "").encode()
    assert got["urn:page:202"].url == "a%20b%0D%0AWARC-Type:%20x" and got["urn:page:200"].url is None


def test_damage_is_told(spark, index):
    index, _ = index
    uri = index.first().bundle
    fs, path = files.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as file:
        data = bytearray(file.read())
    data[-1] ^= 1
    with fs.open_output_stream(path, compression=None) as file:
        file.write(bytes(data))
    with pytest.raises(Exception, match="no seek table"):
        warc.read_bundles(index.select("bundle").distinct()).count()
