"""Bundles there and back."""

import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from pagewright.llm import warc


def test_bundles_are_plain_zstandard_and_seekable(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    bundle, raws = warc.Bundle(), []
    for i in range(20):
        raws.append(warc.record(i, f"http://x/{i}", b"p%d" % i * 30, "0" * 64, 60, None))
        bundle.add(f"<urn:page:{i}>", raws[-1])
    data = bundle.data()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(raws)
    archive = warc.Seekable(data)
    assert len(archive.at) > 5
    for (_, frame, offset, length), raw in reversed(list(zip(bundle.index, raws))):
        assert archive.record(frame, offset, length) == raw
    # one frame suffices for one record
    start, packed, _, _ = archive.at[3]
    torn = data[:start] + b"\0" * packed + data[start + packed:]
    first = bundle.index[0]
    assert warc.Seekable(torn).record(*first[1:]) == raws[0]
    with pytest.raises(Exception):
        warc.Seekable(torn).frame(3)


def test_pages_read_back(spark, tmp_path):
    same = "s" * 100
    rows = [(5, "u5", same), (3, "u3", same), (9, "u\r\n9", same), (1, None, None), (2, "u2", ""), (4, "u4", "short"), (6, "u6", "short"),
            (7, "u7", "é" * 50), (8, "u8", "é" * 50), (10, "u", "x" * 3_000_000), (None, "n", same), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (3, "u3", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "size", "first", "data", "payload")})
    archives = warc.stored(warc.bundles(pages), str(tmp_path / "a"))
    got = warc.records(archives).collect()
    firsts = {same: 3, "é" * 50: 7}
    want = []
    for i, _, h in rows:
        h = h or ""
        first = firsts.get(h)
        refers = first if first is not None and i != first else None
        want.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted((tuple(r)[:1] + tuple(r)[3:] for r in got), key=str) == sorted(want, key=str)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    one = warc.records(archives, ["<urn:page:11>"]).collect()
    assert [bytes(r["payload"]).decode() for r in one] == [rows[11][2]]
    assert warc.records(warc.bundles(pages.limit(0))).count() == 0
