import hashlib
import io

import pyarrow.fs as fs
import pytest
import zstandard

from mosaiq.llm import warc
from mosaiq.llm.common import written


def want(rows, least=1000):
    out = []
    last = {}
    for p, _, html in rows:
        if len(html or "") and len(html.encode()) >= least and p is not None:
            last[html] = max(last.get(html, p), p)
    for p, _, html in rows:
        data = (html or "").encode()
        kept = last.get(html) if len(data) >= least else None
        again = kept is not None and p != kept
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


ROWS = [(k, f"http://a.net/{k}", "<p>" + "x" * (400 + 300 * (k % 5)) + str(k % 7) + "</p>") for k in range(60)] + [(100, None, None), (101, "u\r\nv", ""), (102, "http://b", "café" * 300), (103, "http://c", "café" * 300), (103, "http://c", "café" * 300), (104, "http://long", "ab" * 400_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, last int, digest string")


def test_archive_equals_the_rule(spark):
    found = warc.archive(frame(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in found), key=str) == want(ROWS)


def test_bundles_are_seekable_and_the_map_is_right(spark):
    stored = written(warc.bundles(frame(spark, ROWS).repartition(1)), "t")
    urls = {r[0]: r for r in ROWS}
    seen = 0
    for b in stored.collect():
        data = bytes(b.data)
        frames = warc.seek_table(data)
        assert len(frames) > 1
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == sum(f[2] for f in frames)
        for r in b.records:
            head, block = warc.read_record(data, r.frame, r.offset)
            assert head["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
            if head["WARC-Type"] == "response":
                assert block == (urls[r.page_id][2] or "").encode()
            else:
                assert block == b"" and "WARC-Refers-To" in head
            seen += 1
    assert seen == len(ROWS)


def test_export_writes_whole_files(spark, tmp_path):
    stored = written(warc.bundles(frame(spark, ROWS)), "t2")
    told = {r.bundle: r.size for r in warc.export(stored, f"file://{tmp_path}/out").collect()}
    files = fs.LocalFileSystem().get_file_info(fs.FileSelector(f"{tmp_path}/out"))
    assert {f.base_name: f.size for f in files} == {f"{b}.warc.zst": n for b, n in told.items()}


def test_a_changed_payload_is_noticed(spark):
    schema = "bundle string, data binary, records array<struct<page_id:long, frame:int, offset:long>>"

    def stored(digest, page_id):
        bundle = warc.Bundle()
        bundle.add(warc.record(9, "u", "response", b"xyz", hashlib.sha1(b"xyz").hexdigest(), 3, None))
        spot = bundle.add(warc.record(1, "u", "response", b"abc", digest, 3, None))
        return spark.createDataFrame([("b", bytearray(bundle.close()), [(page_id, *spot)])], schema)

    good = hashlib.sha1(b"abc").hexdigest()
    assert [tuple(r) for r in warc.read_bundles(stored(good, 1)).collect()] == [(1, 3, good, "response", None)]
    with pytest.raises(Exception, match="another digest"):
        warc.read_bundles(stored("0" * 40, 1)).collect()
    with pytest.raises(Exception, match="another record"):
        warc.read_bundles(stored(good, 2)).collect()


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "u", "y" * 2000), (5, "u", "y" * 2000), (5, "u", "y" * 2000), (4, "v", "y" * 2000), (4, "w", "short"), (None, None, None)]
    found = sorted((tuple(r) for r in warc.archive(frame(spark, rows)).collect()), key=str)
    assert [r[3:] for r in found if r[1] == 2000 and r[0] == 5] == [("response", None)] * 2
    assert [r[3:] for r in found if r[1] == 2000 and r[0] == 4] == [("revisit", 5)]
    assert [r[3:] for r in found if r[1] == 2000 and r[0] is None] == [("revisit", 5)]
    assert warc.archive(frame(spark, [])).collect() == []


def test_batch_size_of_the_session_is_left_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = warc.archive(frame(spark, ROWS))
    before = spark.conf.get(name)
    assert before != "4" and found.count() == len(ROWS) and spark.conf.get(name) == before
